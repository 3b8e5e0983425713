"""Section labels from signals in the text, and the text that is embedded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree import fixed
from filigree.functions.text import squeeze


#: For each signal, pieces of text one of which every match holds in lower case.
PIECES = {
    "item_1a_risk_factors": ("risk factors",),
    "risk_factors_heading": ("risk",),
    "risk_content": ("risk", "uncertainties", "could adversely affect", "production delays"),
    "item_7_mda": ("discussion and analysis",),
    "mda_heading": ("discussion and analysis",),
    "results_of_operations": ("results of operations",),
    "liquidity_capital_resources": ("liquidity and capital resources",),
    "trend_revenue_growth": ("revenue", "sales", "volume", "subscri", "advertising"),
    "item_3_legal_proceedings": ("legal proceedings",),
    "part_ii_item_1_legal": ("legal proceedings",),
    "legal_proceedings_heading": ("legal proceedings",),
    "legal_content": ("lawsuit", "claim", "litigation", "investigation", "settlement", "product liability", "legal proceedings"),
    "item_1_business": ("business",),
    "business_overview": ("business",),
    "business_model_content": ("business model", "and services", "customer", "member", "warehouse", "served", "service offerings"),
    "item_8_financial_statements": ("financial statements",),
    "financial_statement_heading": ("statement", "balance sheet"),
    "revenue_table": ("revenue", "net sales"),
    "item_1c_cybersecurity": ("cybersecurity",),
    "item_7a_market_risk": ("market risk",),
}
#: Letters that a pattern takes for a-z and that lower() leaves or changes otherwise.
ODD_LETTERS = "\u017f\u212a\u0130\u0131"


def signals(plain: Column, low: Column, odd: Column) -> Column:
    """Structs (section, signal, confidence, priority, source) of the rules that fit, the best first.

    plain: the squeezed text; low: it in lower case; odd: whether it holds ODD_LETTERS. Rules
    of equal confidence and priority keep their order. A rule's pattern is tried only on
    texts that hold one of its pieces.
    """
    hits = []
    for order, (section, signal, pattern, confidence, source) in enumerate(fixed.SIGNALS):
        entry = F.struct(
            F.lit(-confidence).alias("c"),
            F.lit(-fixed.SECTION_PRIORITY.get(section, 0)).alias("p"),
            F.lit(order).alias("o"),
            F.lit(section).alias("section"),
            F.lit(signal).alias("signal"),
            F.lit(source).alias("source"),
        )
        may = odd
        for piece in PIECES[signal]:
            may = may | low.contains(piece)
        hits.append(F.when(may & plain.rlike("(?iU)" + pattern), entry))
    return F.sort_array(F.array_compact(F.array(*hits)))


def with_signals(chunks: DataFrame) -> DataFrame:
    """chunks with _hits; the text is squeezed and lowered once for all rules."""
    df = chunks.withColumn("_plain", squeeze(F.coalesce("text", F.lit(""))))
    df = df.withColumns({"_low": F.lower("_plain"), "_odd": F.translate("_plain", ODD_LETTERS, "") != F.col("_plain")})
    return df.withColumn("_hits", signals(F.col("_plain"), F.col("_low"), F.col("_odd"))).drop("_plain", "_low", "_odd")


def own_confidence(section: Column) -> Column:
    return F.when(section.isin(*fixed.WEAK_SECTIONS), 0.35).when(section.isin(*fixed.CANONICAL_SECTIONS), 0.82).otherwise(0.55)


def _priority(section: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in fixed.SECTION_PRIORITY.items() for x in pair))
    return F.coalesce(F.get(F.array(table[section]), F.lit(0)), F.lit(50))


def resolve(chunks: DataFrame) -> DataFrame:
    """chunks (text, section) with the final section, its signals, flags and quality."""
    df = with_signals(chunks).withColumn("_best", F.get("_hits", F.lit(0)))
    before = F.coalesce("section", F.lit(""))
    now = F.when(before == "", "Other").otherwise(before)
    best = F.col("_best.section")
    confidence, found = own_confidence(now), -F.col("_best.c")
    stronger = (found >= confidence + 0.08) | (_priority(best) > _priority(now) + 20)
    switch = F.col("_best").isNotNull() & (now.isin(*fixed.WEAK_SECTIONS) | (best == now) | stronger)
    names = F.transform("_hits", lambda x: x["signal"])
    any_of = lambda test: F.exists(names, test)
    kept = F.col("section_original") if "section_original" in chunks.columns else F.lit("")
    flags = {
        "has_risk_heading": any_of(lambda s: s.startswith("item_1a") | s.contains("risk")),
        "has_mda_heading": any_of(lambda s: s.isin(*fixed.MDA_SIGNALS)),
        "has_legal_heading": any_of(lambda s: s.contains("legal")),
        "has_business_heading": any_of(lambda s: s.contains("business")),
        "has_financial_table": any_of(lambda s: s.contains("financial") | s.contains("statement") | (s == "revenue_table")),
        "has_revenue_table": any_of(lambda s: s.contains("revenue")),
    }
    df = df.withColumns(
        {
            "section_original": F.coalesce(F.nullif(kept, F.lit("")), before),
            "section_confidence": F.round(F.when(switch, found).otherwise(confidence), 3),
            "section_source": F.when(switch, F.col("_best.source")).otherwise("initial_section"),
            "section_signals": F.array_join(F.array_distinct(names), "|"),
            "section": F.when(switch, best).otherwise(now),
        }
        | flags
    ).drop("_hits", "_best")
    return df.withColumn("metadata_quality", metadata_quality(df))


def metadata_quality(df: DataFrame) -> Column:
    """0.7 of the confidence and 0.3 of the share of core fields that are there."""
    present = F.lit(0)
    for name in fixed.QUALITY_FIELDS:
        if name in df.columns:
            present = present + F.when(~F.coalesce(F.col(name).cast("string"), F.lit("")).isin("", "0"), 1).otherwise(0)
    score = 0.7 * F.col("section_confidence") + 0.3 * present / len(fixed.QUALITY_FIELDS)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)


def enrich(chunks: DataFrame) -> DataFrame:
    """chunks with embed_text: a line of metadata over the text."""
    full = lambda *names: F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names), F.lit(""))
    year = F.when(F.col("year") != 0, F.col("year").cast("string")).otherwise(F.coalesce(F.nullif(F.substring("fiscal_period", 1, 4), F.lit("")), F.substring("filing_date", 1, 4)))
    quarter = F.coalesce(F.nullif("quarter", F.lit("")), F.lit("FY"))
    parts = [
        ("Company", F.concat("company", F.lit(" ("), "ticker", F.lit(")"))),
        ("Filing", F.col("form")),
        ("Year", year),
        ("Quarter", quarter),
        ("Fiscal focus", F.coalesce(F.nullif("document_fiscal_period_focus", F.lit("")), quarter)),
        ("Period end", full("document_period_end_date", "report_period")),
        ("CIK", F.col("cik")),
        ("Amended", F.when(F.col("amendment_flag") | F.col("is_amended"), "yes").otherwise("no")),
        ("Section", F.col("section")),
    ]
    head = F.concat_ws(" | ", *(F.concat(F.lit(f"{name}: "), value) for name, value in parts))
    return chunks.withColumn("embed_text", F.concat(head, F.lit("\n---\n"), "text"))
