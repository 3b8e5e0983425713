"""Filing metadata as expressions over a raw text and its file name."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from filigree import fixed
from filigree.functions.text import body_of, first_match, header_of, squeeze, strip
from filigree.session import ship_package


def header_map(raw: Column) -> Column:
    """Header labels to values, split at the first colon; a later label wins."""
    lines = F.filter(F.split(header_of(raw), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("k"), strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")))
    named = F.filter(pairs, lambda p: p["k"] != "")
    last = F.filter(named, lambda p, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def file_part(name: Column, group: int) -> Column:
    return F.regexp_extract(name, fixed.FILE_NAME, group)


def normal_form(text: Column) -> Column:
    letter = F.upper(F.regexp_extract(text, r"(?iU)10-?\s*([KQ])", 1))
    return F.when(letter != "", F.concat(F.lit("10-"), letter)).otherwise("")


def truth(text: Column) -> Column:
    return F.lower(strip(text)).isin("true", "1", "yes", "y")


def is_amended(*sources: Column) -> Column:
    text = F.concat_ws(" ", *(F.coalesce(s, F.lit("")) for s in sources))
    return text.rlike(r"(?iU)10-?\s*[KQ]\s*/\s*A\b|\bamend(?:ed|ment)?\b")


def is_restated(*sources: Column) -> Column:
    text = F.concat_ws(" ", *(F.coalesce(s, F.lit("")) for s in sources))
    return text.rlike(r"(?iU)\brestat(?:e|ed|ement|ements|ing)\b")


def quarter_of(period: Column) -> Column:
    digit = F.regexp_extract(period, "(?i)Q([1-4])", 1)
    return F.when(digit != "", F.concat(F.lit("Q"), digit)).otherwise("")


def year_of(*sources: Column) -> Column:
    """The first year in the first source that has one, else 0."""
    found = [first_match(s, r"(?:19|20)\d{2}").cast("int") for s in sources]
    return F.coalesce(*found, F.lit(0))


def iso_date(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{8}$"), F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise("")


def sector_of(ticker: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in fixed.SECTOR_OF.items() for x in pair))
    return F.coalesce(F.get(F.array(table[F.upper(ticker)]), F.lit(0)), F.lit(""))


@F.pandas_udf(StringType())
def _unescape(text: pd.Series) -> pd.Series:
    """HTML character references have no built-in; texts without one pass as they are."""
    return text.map(lambda x: html.unescape(x) if x is not None and "&" in x else x)


def without_tags(value: Column) -> Column:
    return squeeze(_unescape(F.regexp_replace(value, "<[^>]+>", "")))


def tag_value(raw: Column, tag: str) -> Column:
    """A fact from its element, else from an inline element that names it, else null."""
    plain = rf"(?is)<(?:[A-Za-z0-9_-]+:)?{tag}\b[^>]*>(.*?)</(?:[A-Za-z0-9_-]+:)?{tag}>"
    inline = rf"(?is)<(?:[A-Za-z0-9_-]+:)?non(?:Numeric|Fraction)\b[^>]*\bname=[\"'](?:dei:)?{tag}[\"'][^>]*>(.*?)</(?:[A-Za-z0-9_-]+:)?non(?:Numeric|Fraction)>"
    return F.coalesce(first_match(raw, plain, 1), first_match(raw, inline, 1))


def preamble(body: Column) -> Column:
    """What leads up to the prose anchor (12000 characters without one), without white space."""
    at = F.regexp_instr(body, F.lit(fixed.PROSE_ANCHOR))
    lead = F.when(at > 0, F.substring(body, F.lit(1), at - 1)).otherwise(F.substring(body, 1, 12000))
    return F.regexp_replace(lead, r"(?U)[\s\x1c-\x1f]+", "")


def build_metadata(filings: DataFrame) -> DataFrame:
    """The 28 metadata columns of filings (doc_id, raw); missing is '' or 0."""
    ship_package(filings.sparkSession)
    df = filings.select("doc_id", "raw", header_map(F.col("raw")).alias("_h"), body_of(F.col("raw")).alias("_body"))
    df = df.withColumn("_lead", preamble(F.col("_body"))).withColumn("_file", F.concat("doc_id", F.lit(fixed.FILE_SUFFIX)))
    # Facts of the compact preamble come before those of tags, and these before the cover's.
    compact = None
    for pattern, groups in reversed(fixed.PREAMBLES):
        names = ("period", "amended", "year", "focus", "cik", "year_end")
        own = F.struct(*(F.regexp_extract("_lead", pattern, g).alias(n) for n, g in zip(names, groups)))
        compact = F.when(F.col("_lead").rlike(pattern), own) if compact is None else F.when(F.col("_lead").rlike(pattern), own).otherwise(compact)
    df = df.withColumn("_c", compact)
    # One pass of the tag patterns for texts that hold a tag at all.
    df = df.withColumns({f"_t_{f}": F.when(F.col("raw").contains(t), tag_value(F.col("raw"), t)) for t, f in fixed.TAG_FIELDS.items()})
    df = df.withColumns({f"_t_{f}": F.coalesce(without_tags(F.col(f"_t_{f}")), F.lit("")) for f in fixed.TAG_FIELDS.values()})
    full = lambda c: F.nullif(c, F.lit(""))
    pick = lambda *cs: F.coalesce(*(full(c) for c in cs), F.lit(""))
    h = lambda key: F.coalesce(F.col("_h")[key], F.lit(""))
    c, t = (lambda k: F.coalesce(F.col("_c")[k], F.lit(""))), (lambda f: F.col(f"_t_{f}"))
    had = F.col("_c").isNotNull()
    name = F.col("_file")
    facts = {
        "x_type": F.when(t("document_type") != "", pick(normal_form(t("document_type")), t("document_type"))).otherwise(""),
        "x_end": pick(iso_date(c("period")), t("document_period_end_date")),
        "x_year": F.coalesce(full(c("year")).cast("int"), F.expr("try_cast(_t_document_fiscal_year_focus as int)"), F.lit(0)),
        "x_focus": F.upper(pick(F.upper(c("focus")), t("document_fiscal_period_focus"))),
        "x_cik": pick(c("cik"), t("cik")),
        "x_year_end": pick(c("year_end"), t("current_fiscal_year_end_date")),
        "x_amended": F.when(had, truth(c("amended"))).otherwise(truth(t("amendment_flag"))),
        "x_state": pick(t("entity_incorporation_state_country_code"), strip(F.regexp_extract("_body", fixed.COVER_STATE, 1))),
        "x_shares": pick(t("entity_common_stock_shares_outstanding"), F.regexp_extract("_body", fixed.COVER_SHARES, 1)),
        "ticker": pick(h("Ticker"), t("trading_symbol"), file_part(name, 1)),
        "filing_date": pick(h("Filing Date"), file_part(name, 4)),
        "fiscal_period": pick(h("Quarter"), file_part(name, 3)),
    }
    df = df.withColumns(facts)
    df = df.withColumns({"form": pick(normal_form(h("Filing Type")), normal_form(F.col("x_type")), normal_form(file_part(name, 2))), "report_period": pick(h("Report Period"), F.col("x_end"))})
    df = df.withColumns({
        "year": F.when(F.col("x_year") != 0, F.col("x_year")).otherwise(year_of(F.col("fiscal_period"), F.col("report_period"), F.col("filing_date"))),
        "amended": F.col("x_amended") | is_amended(h("Filing Type"), F.col("doc_id")),
    })
    focus = F.col("x_focus")
    return df.select(
        "doc_id",
        pick(h("Company"), t("entity_registrant_name"), F.col("ticker")).alias("company"),
        "ticker",
        "form",
        "filing_date",
        F.col("_file").alias("source_file"),
        "report_period",
        "fiscal_period",
        "year",
        F.when(focus.rlike("^Q[1-4]$"), focus).when(focus == "FY", "").otherwise(quarter_of(F.col("fiscal_period"))).alias("quarter"),
        pick(h("CIK"), F.col("x_cik")).alias("cik"),
        h("URL").alias("source_url"),
        F.col("doc_id").alias("document_id"),
        pick(h("Source"), F.lit("SEC EDGAR")).alias("source"),
        sector_of(F.col("ticker")).alias("industry"),
        pick(h("Accession Number"), h("Accession")).alias("accession_number"),
        F.col("amended").alias("is_amended"),
        is_restated(h("Filing Type"), F.col("doc_id"), t("amendment_description")).alias("is_restated"),
        pick(t("entity_registrant_name"), h("Company"), F.col("ticker")).alias("entity_registrant_name"),
        pick(t("trading_symbol"), F.col("ticker")).alias("trading_symbol"),
        pick(F.col("x_type"), F.col("form")).alias("document_type"),
        pick(F.col("x_end"), F.col("report_period")).alias("document_period_end_date"),
        F.when(F.col("x_year") != 0, F.col("x_year")).otherwise(F.col("year")).alias("document_fiscal_year_focus"),
        focus.alias("document_fiscal_period_focus"),
        pick(F.col("x_year_end"), F.when(F.col("report_period").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(F.lit("--"), F.substring("report_period", 6, 5))).otherwise("")).alias("current_fiscal_year_end_date"),
        F.col("amended").alias("amendment_flag"),
        t("amendment_description").alias("amendment_description"),
        F.col("x_state").alias("entity_incorporation_state_country_code"),
        F.col("x_shares").alias("entity_common_stock_shares_outstanding"),
    )
