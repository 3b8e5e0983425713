"""Queries on filings that are made of the driver's documents, with SQL that knows how they were made."""

from __future__ import annotations

from pyspark.sql import functions as F

from filigree import fixed
from filigree.functions.metadata import build_metadata
from filigree.functions.text import clean
from filigree.operators.chunking import chunks
from filigree.operators.resolution import enrich, resolve
from filigree.operators.sections import sections
from filigree.plans.relation_queries import lit, listed
from filigree.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def _text(*parts) -> object:
    """Strings and columns put together."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


TICKERS = ("AAPL", "MSFT", "JNJ", "XOM", "ZZZZ")
_DAY = "DATE '2021-01-01' + CAST(doc_id % 3650 AS INTEGER)"
MADE = f"""made AS (SELECT doc_id AS id, {listed(TICKERS)}[doc_id % 5 + 1] || CASE WHEN doc_id >= 3650 THEN CAST(doc_id // 3650 AS VARCHAR) ELSE '' END AS tick, CASE WHEN doc_id % 2 = 0 THEN '10-K' ELSE '10-Q' END AS k,
  strftime({_DAY}, '%Y-%m-%d') AS day, year({_DAY}) AS y, 'Q' || quarter({_DAY}) AS q FROM documents),
named AS (SELECT *, tick || '_' || replace(k, '-', '') || '_' || CASE WHEN id % 7 = 0 THEN '' ELSE y || q || '_' END || day AS doc FROM made)"""


def _made(spark, d):
    """Filings in three shapes: with a header, with a compact preamble, with tagged facts."""
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select(i, F.date_add(F.lit("2021-01-01").cast("date"), (i % 3650).cast("int")).alias("day"))
    docs = docs.select(
        i.alias("id"),
        F.concat(F.element_at(F.array(*map(F.lit, TICKERS)), (i % 5 + 1).cast("int")), F.when(i >= 3650, F.floor(i / 3650).cast("string")).otherwise("")).alias("tick"),
        F.when(i % 2 == 0, "10-K").otherwise("10-Q").alias("k"),
        F.col("day").cast("string").alias("day"),
        F.year("day").alias("y"),
        _text("Q", F.quarter("day")).alias("q"),
    )
    i = F.col("id")
    period = F.when(i % 7 == 0, "").otherwise(_text(F.col("y"), F.col("q"), "_"))
    docs = docs.withColumn("doc_id", F.concat("tick", F.lit("_"), F.replace("k", F.lit("-"), F.lit("")), F.lit("_"), period, "day"))
    rule, anchor = "=" * 12 + "\n", "\nUNITED STATES\nSECURITIES AND EXCHANGE COMMISSION\nplain words\n"
    head = _text("Company: C", i, " Inc.\nTicker: ", F.col("tick"), "\nFiling Type: ", F.col("k"), F.when(i % 11 == 0, "/A").otherwise(""), " (Report)\nFiling Date: ", F.col("day"), "\nReport Period: ", F.col("y"), "-06-30\nQuarter: ", F.col("y"), F.col("q"), "\nCIK: 00", i, "\nSource: SRC\nURL: https://x/", i, "?a:b\nAccession Number: A-", i, "\n", rule, anchor)
    compact = _text("Company: C", i, " Inc.\n", rule, "x-", F.col("y"), "0630", F.when(i % 2 == 0, "true").otherwise("false"), F.col("y"), "FY", F.lpad(i.cast("string"), 10, "0"), "--12-31", anchor)
    tags = _text("no header line\n", rule, '<dei:EntityRegistrantName contextRef="c">R', i, " &amp; Co</dei:EntityRegistrantName><dei:DocumentType>10-K/A</dei:DocumentType><dei:DocumentFiscalYearFocus>2019</dei:DocumentFiscalYearFocus>", "<dei:DocumentFiscalPeriodFocus>q3</dei:DocumentFiscalPeriodFocus><dei:AmendmentFlag>true</dei:AmendmentFlag><dei:AmendmentDescription>restated <b>numbers</b></dei:AmendmentDescription>", anchor)
    return docs.withColumn("raw", F.when(i % 3 == 0, head).when(i % 3 == 1, compact).otherwise(tags))


_SECTOR = "CASE tick " + " ".join(f"WHEN '{t}' THEN {lit(fixed.SECTOR_OF[t])}" for t in TICKERS if t in fixed.SECTOR_OF) + " ELSE '' END"


@query(f"""WITH {MADE} SELECT doc AS doc_id, CASE id % 3 WHEN 2 THEN 'R' || id || ' & Co' ELSE 'C' || id || ' Inc.' END AS company, tick AS ticker, CASE WHEN id % 3 = 2 THEN '10-K' ELSE k END AS form, day AS filing_date,
CASE WHEN id % 3 = 2 THEN '' ELSE y || '-06-30' END AS report_period, CASE WHEN id % 3 <> 0 AND id % 7 = 0 THEN '' ELSE y || q END AS fiscal_period, CASE WHEN id % 3 = 2 THEN 2019 ELSE y END AS year,
CASE id % 3 WHEN 0 THEN q WHEN 1 THEN '' ELSE 'Q3' END AS quarter, CASE id % 3 WHEN 0 THEN '00' || id WHEN 1 THEN lpad(CAST(id AS VARCHAR), 10, '0') ELSE '' END AS cik, CASE WHEN id % 3 = 0 THEN 'https://x/' || id || '?a:b' ELSE '' END AS source_url,
CASE WHEN id % 3 = 0 THEN 'SRC' ELSE 'SEC EDGAR' END AS source, {_SECTOR} AS industry, CASE WHEN id % 3 = 0 THEN 'A-' || id ELSE '' END AS accession_number,
CASE id % 3 WHEN 0 THEN id % 11 = 0 WHEN 1 THEN id % 2 = 0 ELSE true END AS is_amended, id % 3 = 2 AS is_restated, CASE id % 3 WHEN 2 THEN 'R' || id || ' & Co' ELSE 'C' || id || ' Inc.' END AS entity_registrant_name,
CASE WHEN id % 3 = 2 THEN '10-K' ELSE k END AS document_type, CASE WHEN id % 3 = 2 THEN '' ELSE y || '-06-30' END AS document_period_end_date, CASE WHEN id % 3 = 2 THEN 2019 ELSE y END AS document_fiscal_year_focus,
CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN 'FY' ELSE 'Q3' END AS document_fiscal_period_focus, CASE id % 3 WHEN 0 THEN '--06-30' WHEN 1 THEN '--12-31' ELSE '' END AS current_fiscal_year_end_date, CASE WHEN id % 3 = 2 THEN 'restated numbers' ELSE '' END AS amendment_description FROM named""")
def filing_metadata(spark, d):
    names = "doc_id company ticker form filing_date report_period fiscal_period year quarter cik source_url source industry accession_number is_amended is_restated entity_registrant_name document_type document_period_end_date document_fiscal_year_focus document_fiscal_period_focus current_fiscal_year_end_date amendment_description"
    return build_metadata(_made(spark, d)).select(*names.split())


@query("""SELECT doc_id, 'Form 10-K of ' || doc_id || chr(10) || 'a b c' || chr(10) || 'x | y   z | w' || chr(10) || ' tabbed line' || chr(10) || 'kept as it is' || chr(10) || chr(10) || 'last 7' || chr(10) AS text FROM documents""")
def filing_cleaned(spark, d):
    raw = _text("h: x\n", "=" * 10, "\njunk before ", F.col("doc_id"), "\nForm 10-K of ", F.col("doc_id"), "\r\na  b   c  \n123456us-gaap:Member 7\nx | y   z | w\n  \t tabbed\tline  \n<xbrl a='1'>kept as it is</xbrl>\n\n", '<context id="1">\nno\n</context>\n\n\nlast 7\n\n')
    return table(spark, d, "documents").select("doc_id", clean(raw).alias("text"))


FILL = "word " * 120
_SECTION_TEXT = f"""'Cover ' || doc_id || chr(10) || 'Item 1.  BusinessThe company ' || doc_id || ' sells. {FILL}' || chr(10) || 'Item 1A.  Risk FactorsMany. {FILL}as described in Item 1A. Risk Factors above. {FILL}' || chr(10) || 'Item 3.  Legal Proceedings' || chr(10) || 'short' || chr(10) || 'Item 7.  Management Discussion 12' || chr(10) || '{FILL}'"""


@query(f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '10-K' ELSE '10-Q' END AS form, {_SECTION_TEXT} AS text FROM documents),
p AS (SELECT *, strpos(text, 'Item 1.') - 1 AS a, strpos(text, 'Item 1A.') - 1 AS b, strpos(text, 'Item 7.') - 1 AS c, length(text) AS n FROM t)
SELECT doc_id, 0 AS section_index, 'Other' AS section_name, '' AS item, '' AS part, 0 AS start, a AS "end" FROM p
UNION ALL SELECT doc_id, 1, 'Business', 'Item 1', CASE form WHEN '10-K' THEN 'Part I' ELSE '' END, a, b FROM p
UNION ALL SELECT doc_id, 2, 'Risk Factors', 'Item 1A', CASE form WHEN '10-K' THEN 'Part I' ELSE '' END, b, c FROM p
UNION ALL SELECT doc_id, 3, CASE form WHEN '10-K' THEN {lit(fixed.MDA)} ELSE 'Management Discussion' END, 'Item 7', CASE form WHEN '10-K' THEN 'Part II' ELSE '' END, c, n FROM p""")
def filing_sections(spark, d):
    i = F.col("doc_id")
    text = _text("Cover ", i, "\nItem 1.  BusinessThe company ", i, f" sells. {FILL}\nItem 1A.  Risk FactorsMany. {FILL}as described in Item 1A. Risk Factors above. {FILL}\nItem 3.  Legal Proceedings\nshort\nItem 7.  Management Discussion 12\n{FILL}")
    docs = table(spark, d, "documents").select("doc_id", F.when(i % 2 == 0, "10-K").otherwise("10-Q").alias("form"), text.alias("text"))
    return sections(docs)


_ROWS = 60
_CHUNK_ROWS = "lpad(CAST(r AS VARCHAR), 3, '0') || ' | ' || (3000 + r) || ' | ' || (4000 + r)"


@query(f"""WITH r AS (SELECT unnest(generate_series(1, {_ROWS})) AS r),
t AS (SELECT string_agg('row' || {_CHUNK_ROWS}, chr(10) ORDER BY r) FILTER (WHERE r <= 46) AS first, string_agg('row' || {_CHUNK_ROWS}, chr(10) ORDER BY r) FILTER (WHERE r > 46) AS second FROM r),
c AS (SELECT doc_id, 0 AS chunk_index, 'Risk Factors' AS section, 0 AS section_chunk_index, '__RiskFactors_c00' AS tail, 'Risk prose ' || doc_id || '.' AS text FROM documents
UNION ALL SELECT doc_id, 1, 'Results of the year', 0, '__ResultsOfTheYear_c00', 'Before the table.' || chr(10) || 'Amounts of ' || doc_id FROM documents
UNION ALL SELECT doc_id, 2, 'Results of the year', 1, '__ResultsOfTheYear_c01', 'Before the table.' || chr(10) || 'Amounts of ' || doc_id || chr(10) || 'Name | Left | Right' || chr(10) || first FROM documents, t
UNION ALL SELECT doc_id, 3, 'Results of the year', 2, '__ResultsOfTheYear_c02', 'Before the table.' || chr(10) || 'Amounts of ' || doc_id || chr(10) || 'Name | Left | Right' || chr(10) || second FROM documents, t)
SELECT doc_id || tail AS id, CAST(doc_id AS VARCHAR) AS doc_id, chunk_index, section, section_chunk_index, text, sha256(text) AS content_hash FROM c""")
def filing_chunks(spark, d):
    rows = "\n".join(f"row{r:03d} | {3000 + r} | {4000 + r}" for r in range(1, _ROWS + 1))
    i = F.col("doc_id")
    first, second = _text("Risk prose ", i, ".\n"), _text("Before the table.\nAmounts of ", i, f"\nName | Left | Right\n{rows}\n")
    docs = table(spark, d, "documents").select(i.cast("string").alias("doc_id"), first.alias("a"), F.concat(first, second).alias("text"))
    one = docs.select("doc_id", F.lit(0).alias("section_index"), F.lit("Risk Factors").alias("section_name"), F.lit(0).alias("start"), F.length("a").alias("end"))
    two = docs.select("doc_id", F.lit(1).alias("section_index"), F.lit("Results of the year").alias("section_name"), F.length("a").alias("start"), F.length("text").alias("end"))
    return chunks(docs, one.union(two), 1000, 100).select("id", "doc_id", "chunk_index", "section", "section_chunk_index", "text", "content_hash")


PHRASES = (
    "Item 1A. Risk Factors we face", "could adversely affect us", "item 7. management's discussion and analysis", "results of operations", "liquidity and capital resources today",
    "advertising sales grew and revenue increased", "Item 3. Legal Proceedings", "part ii item 1 legal proceedings", "a settlement of claims", "Item 1. Business", "overview of the business",
    "our customers and members", "Item 8. Financial Statements", "consolidated statements of income", "net sales | 12 | 13", "item 1c cybersecurity", "Item 7A. Quantitative and qualitative disclosures about market risk", "nothing here at all",
)
GIVEN = ("Other", "Business", "Risk Factors", "src", "Exhibits", fixed.MDA, "")
_ASCII = r"regexp_replace(text, '[^\x00-\x7F]', 'x', 'g')"
_RULES = ", ".join(f"({n}, {lit(section)}, {lit(signal)}, {lit('(?i)' + pattern)}, {confidence}, {lit(source)}, {fixed.SECTION_PRIORITY.get(section, 0)})" for n, (section, signal, pattern, confidence, source) in enumerate(fixed.SIGNALS))
_PRIORITY = "CASE {0} " + " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in fixed.SECTION_PRIORITY.items()) + " ELSE 50 END"
_OWN = f"CASE WHEN {{0}} IN ({', '.join(map(lit, fixed.WEAK_SECTIONS))}) THEN 0.35 WHEN {{0}} IN ({', '.join(map(lit, fixed.CANONICAL_SECTIONS))}) THEN 0.82 ELSE 0.55 END"
RESOLVED = rf"""rules(o, sec, sig, pat, conf, src, prio) AS (VALUES {_RULES}),
t AS (SELECT doc_id, lang, source, trim(regexp_replace({listed(PHRASES)}[doc_id % {len(PHRASES)} + 1] || ' ' || {_ASCII}, '\s+', ' ', 'g')) AS plain, {listed(GIVEN)}[doc_id // 3 % {len(GIVEN)} + 1] AS given FROM documents),
h AS (SELECT doc_id, list({{'c': -conf, 'p': -prio, 'o': o, 'sec': sec, 'sig': sig, 'src': src}} ORDER BY conf DESC, prio DESC, o) AS hits FROM t, rules WHERE regexp_matches(plain, pat) GROUP BY doc_id),
b AS (SELECT t.*, hits, hits[1] AS best, CASE WHEN given = '' THEN 'Other' ELSE given END AS now FROM t LEFT JOIN h USING (doc_id)),
s AS (SELECT *, {_OWN.format('now')} AS own, -best.c AS found FROM b),
w AS (SELECT *, coalesce(best IS NOT NULL AND (now IN ({', '.join(map(lit, fixed.WEAK_SECTIONS))}) OR best.sec = now OR found >= own + 0.08 OR {_PRIORITY.format('best.sec')} > {_PRIORITY.format('now')} + 20), false) AS switch FROM s),
z AS (SELECT doc_id, lang, source, CASE WHEN switch THEN best.sec ELSE now END AS section, round(CASE WHEN switch THEN found ELSE own END, 3) AS confidence, CASE WHEN switch THEN best.src ELSE 'initial_section' END AS origin,
  coalesce(array_to_string(list_transform(hits, lambda x: x.sig), '|'), '') AS signals FROM w)"""


def _resolved(spark, d):
    i = F.col("doc_id")
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))
    plain = F.concat(pick(PHRASES, i), F.lit(" "), F.regexp_replace("text", r"[^\x00-\x7F]", "x"))
    return resolve(table(spark, d, "documents").select("doc_id", "lang", "source", plain.alias("text"), pick(GIVEN, F.floor(i / 3)).alias("section")))


@query(f"WITH {RESOLVED} SELECT doc_id, section, confidence, origin, signals, contains(signals, 'risk') AS risk_heading, contains(signals, 'legal') AS legal_heading, contains(signals, 'revenue') AS revenue_table FROM z")
def resolve_section(spark, d):
    out = _resolved(spark, d)
    return out.select("doc_id", "section", F.col("section_confidence").alias("confidence"), F.col("section_source").alias("origin"), F.col("section_signals").alias("signals"), F.col("has_risk_heading").alias("risk_heading"), F.col("has_legal_heading").alias("legal_heading"), F.col("has_revenue_table").alias("revenue_table"))


@query(f"""WITH {RESOLVED} SELECT doc_id, sha256('Company: ' || lang || ' (' || source || ') | Filing: 10-K | Year: ' || CASE WHEN doc_id % 3 = 0 THEN '2020' WHEN doc_id % 3 = 1 THEN '2019' ELSE '2018' END || ' | Quarter: ' || CASE WHEN doc_id % 2 = 0 THEN 'Q1' ELSE 'FY' END
|| ' | Fiscal focus: ' || CASE WHEN doc_id % 2 = 0 THEN 'Q1' ELSE 'FY' END || ' | Period end: 2020-12-31 | CIK: 7 | Amended: ' || CASE WHEN doc_id % 5 = 0 THEN 'yes' ELSE 'no' END || ' | Section: ' || section || chr(10) || '---' || chr(10) || 'body') AS embed_text FROM z""")
def enriched_text(spark, d):
    i = F.col("doc_id")
    rows = _resolved(spark, d).select("doc_id", F.col("lang").alias("company"), F.col("source").alias("ticker"), F.lit("10-K").alias("form"), F.when(i % 3 == 0, 2020).otherwise(0).alias("year"), F.when(i % 3 == 1, "2019Q2").otherwise("").alias("fiscal_period"), F.lit("2018-02-03").alias("filing_date"), F.when(i % 2 == 0, "Q1").otherwise("").alias("quarter"), F.lit("").alias("document_fiscal_period_focus"), F.lit("").alias("document_period_end_date"), F.lit("2020-12-31").alias("report_period"), F.lit("7").alias("cik"), (i % 5 == 0).alias("amendment_flag"), F.lit(False).alias("is_amended"), "section", F.lit("body").alias("text"))
    return enrich(rows).select("doc_id", F.sha2("embed_text", 256).alias("embed_text"))
