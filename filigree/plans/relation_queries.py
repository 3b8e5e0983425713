"""Queries on questions, answers, reports and stored tables over the driver's tables, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from filigree import fixed
from filigree.functions import predicates as P
from filigree.functions import questions as Q
from filigree.operators import answers as A
from filigree.operators import metrics as M
from filigree.operators import search as R
from filigree.plans.offline import stage_report
from filigree.plans.online import boosted
from filigree.plans.ranking_queries import K, SCORED, _ranked, _show, _shown, docs_of, items
from filigree.session import shared_dir, table
from filigree.sources import corpus as C
from filigree.sources import logs as L
from filigree.sources.vectors import VectorTable, hydrate, index_join

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


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(lit, values)) + "]"


def sql_map(rows: dict) -> str:
    """A DuckDB map of names to lists."""
    return "MAP {" + ", ".join(f"{lit(k)}: {listed(v)}" for k, v in rows.items()) + "}"


def _list(values) -> object:
    return F.array(*map(F.lit, values))


def _scratch(spark) -> str:
    return f"{shared_dir(spark)}/query-{uuid.uuid4().hex}"


# --- questions -------------------------------------------------------------------------------

_NAMES = [(t, n) for t, names in fixed.ALIASES.items() for n in names if t not in ("GE", "BA", "BAC", "BRK", "V", "T")]
_SAFE = [(t, names[0]) for t, names in fixed.ALIASES.items() if len(names[0]) > 5]


@query(f"""WITH a AS (SELECT {listed(t for t, _ in _SAFE)} AS t, {listed(n for _, n in _SAFE)} AS n)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN t[doc_id % {len(_SAFE)} + 1] WHEN t[doc_id % {len(_SAFE)} + 1] = t[doc_id * 7 % {len(_SAFE)} + 1] THEN t[doc_id % {len(_SAFE)} + 1]
ELSE t[doc_id * 7 % {len(_SAFE)} + 1] || '|' || t[doc_id % {len(_SAFE)} + 1] END AS companies FROM documents, a""")
def company_matches(spark, d):
    names = _list(n for _, n in _SAFE)
    first, second = (F.element_at(names, (c % len(_SAFE) + 1).cast("int")) for c in (F.col("doc_id"), F.col("doc_id") * 7))
    one = F.concat(F.lit("What does "), F.upper(first), F.lit(" say about margins?"))
    two = F.concat(F.lit("Compare "), F.initcap(second), F.lit(" and ("), first, F.lit("), please"))
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, one).otherwise(two).alias("q"))
    return docs.select("doc_id", F.array_join(Q.companies(F.col("q")), "|").alias("companies"))


_FACETS, _SECTIONS = list(fixed.FACET_SECTIONS), [*fixed.EQUIVALENTS, "Exhibits"]


@query(f"""WITH m AS (SELECT {sql_map(fixed.FACET_SECTIONS)} AS fs, {sql_map(fixed.EQUIVALENTS)} AS eq, {listed(_FACETS)} AS f, {listed(_SECTIONS)} AS s),
p AS (SELECT p_partkey, f[p_partkey % {len(_FACETS)} + 1] AS a, f[p_size % {len(_FACETS)} + 1] AS b, s[p_partkey % {len(_SECTIONS)} + 1] AS target, fs, eq FROM part, m),
x AS (SELECT p_partkey, target, list_concat(fs[a], fs[b]) AS wanted, CASE WHEN eq[target] IS NULL THEN [target] ELSE eq[target] END AS base,
      list_concat(CASE WHEN list_contains(fs[a], target) THEN fs[a] ELSE [] END, CASE WHEN list_contains(fs[b], target) THEN fs[b] ELSE [] END) AS more FROM p),
y AS (SELECT p_partkey, target, wanted, list_concat(base, more) AS wide FROM x)
SELECT p_partkey, array_to_string(list_filter(wanted, lambda x, i: list_position(wanted, x) = i), '|') AS of_facets, array_to_string(list_filter(wide, lambda x, i: list_position(wide, x) = i), '|') AS equivalents,
CASE WHEN strpos(lower(target), 'risk') > 0 OR strpos('risk', lower(target)) > 0 THEN true ELSE false END AS near_risk FROM y""")
def section_lookups(spark, d):
    pick = lambda values, c: F.element_at(_list(values), (c % len(values) + 1).cast("int"))
    parts = table(spark, d, "part").select("p_partkey", F.array(pick(_FACETS, F.col("p_partkey")), pick(_FACETS, F.col("p_size"))).alias("f"), pick(_SECTIONS, F.col("p_partkey")).alias("s"))
    return parts.select(
        "p_partkey",
        F.array_join(Q.sections_of_facets(F.col("f")), "|").alias("of_facets"),
        F.array_join(Q.equivalents(F.col("s"), F.col("f")), "|").alias("equivalents"),
        Q.section_match(F.col("s"), F.lit("Risk")).alias("near_risk"),
    )


@query("""WITH o AS (SELECT o_orderkey, year(o_orderdate) AS y, 'Q' || quarter(o_orderdate) AS q FROM orders),
p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'company IN [AAPL, MSFT]' END AS a, CASE WHEN o_orderkey % 3 = 0 THEN 'year IN [' || y || ']' END AS b, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 = 0 THEN 'quarter IN [' || q || '] AND fiscal_period IN [' || y || q || ']' WHEN o_orderkey % 5 = 0 THEN 'quarter IN [' || q || ']' END AS c FROM o)
SELECT o_orderkey, CASE WHEN a IS NULL AND b IS NULL AND c IS NULL THEN '(no hard filter — search all filings)' ELSE concat_ws(' AND ', a, b, c) END AS filter FROM p""")
def filter_words(spark, d):
    none = F.array().cast("array<string>")
    key = F.col("o_orderkey")
    years = F.when(key % 3 == 0, F.array(F.year("o_orderdate"))).otherwise(F.array().cast("array<int>"))
    quarters = F.when(key % 5 == 0, F.array(F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")))).otherwise(none)
    cols = {"tickers": F.when(key % 2 == 0, _list(["AAPL", "MSFT"])).otherwise(none), "years": years, "quarters": quarters, "fiscal_periods": Q.fiscal_periods(years, quarters), "forms": none}
    return table(spark, d, "orders").select("o_orderkey", Q.describe(cols).alias("filter"))


# --- answers ---------------------------------------------------------------------------------


def _bodies(spark, d):
    """Answers made of turns: prose that cites evidence 1 to 4, and a listed citation."""
    said = table(spark, d, "conversations").where("text is not null")
    n = F.col("turn").cast("string")
    return said.select(
        F.concat_ws(":", "conv_id", "turn").alias("query_id"),
        F.concat(F.lit("- first [E"), n, F.lit("]\n- again [E2] [E"), n, F.lit("]")).alias("executive_summary"),
        F.when(F.col("turn") % 2 == 0, "").otherwise("a | b [E4]").alias("comparison"),
        F.lit("see E1").alias("supporting_evidence"),
        F.lit("").alias("limitations"),
        F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("E3"))).alias("citations"),
        F.when(F.col("turn") % 4 == 0, "").otherwise("High").alias("confidence"),
    )


def _used(spark, d):
    """Evidence E1 to E4 of each turn, placed in reverse."""
    said = table(spark, d, "conversations").where("text is not null").select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), "turn", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"))
    return said.select("query_id", (5 - F.col("k")).alias("place"), F.concat(F.lit("E"), F.col("k").cast("string")).alias("evidence_id"), F.concat(F.lit("[T"), F.col("k").cast("string"), F.lit("]")).alias("tag"), F.lit("T").alias("ticker"), F.lit("").alias("company"), F.lit("10-K").alias("form"), F.when(F.col("k") == 1, "2020Q1").otherwise("").alias("fiscal_period"), (F.when(F.col("k") == 2, 2021).otherwise(0)).alias("year"), F.lit("Business").alias("section"), F.lit("u").alias("source_url"))


UNIQUE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
BODIES = """b AS (SELECT conv_id || ':' || turn AS query_id, turn, '- first [E' || turn || ']' || chr(10) || '- again [E2] [E' || turn || ']' AS es, CASE WHEN turn % 2 = 0 THEN '' ELSE 'a | b [E4]' END AS co,
  CASE WHEN turn % 3 = 0 THEN [] ELSE ['E3'] END AS listed, CASE WHEN turn % 4 = 0 THEN '' ELSE 'High' END AS sure,
  list_concat(['E' || turn, 'E2', 'E' || turn], list_concat(CASE WHEN turn % 2 = 0 THEN [] ELSE ['E4'] END, ['E1'])) AS m FROM conversations WHERE text IS NOT NULL),
c AS (SELECT *, """ + UNIQUE.format("m") + """ AS ids FROM b),
r AS (SELECT *, list_concat(listed, list_filter(ids, lambda x: NOT list_contains(listed, x))) AS refs FROM c)"""


@query(f"""WITH {BODIES} SELECT query_id, array_to_string(ids, '|') AS inline, array_to_string(refs, '|') AS referenced,
array_to_string(list_concat(refs, list_filter(['E4', 'E3', 'E2', 'E1'], lambda x: NOT list_contains(refs, x))), '|') AS completed FROM r""")
def referenced_sources(spark, d):
    bodies = _bodies(spark, d)
    prose = [F.col(c) for c in A.PROSE]
    done = A.complete_sources(bodies, _used(spark, d)).select("query_id", F.array_join("citations", "|").alias("completed"))
    return bodies.select("query_id", F.array_join(A.inline_ids(*prose), "|").alias("inline"), F.array_join(A.referenced_ids(F.col("citations"), *prose), "|").alias("referenced")).join(done, "query_id")


@query(f"""WITH {BODIES}, u AS (SELECT query_id, unnest(refs) AS evidence_id, generate_subscripts(refs, 1) - 1 AS cite_no FROM r)
SELECT query_id, cite_no, evidence_id, '[T' || substr(evidence_id, 2) || ']' AS tag, CASE evidence_id WHEN 'E1' THEN '2020Q1' WHEN 'E2' THEN 'FY2021' ELSE '' END AS fiscal_period FROM u WHERE evidence_id IN ('E1', 'E2', 'E3', 'E4')""")
def mapped_citations(spark, d):
    return A.map_citations(_bodies(spark, d), _used(spark, d)).select("query_id", "cite_no", "evidence_id", "tag", "fiscal_period")


@query(f"""WITH {BODIES} SELECT query_id, concat_ws(chr(10) || chr(10), '## Executive Summary' || chr(10) || es, CASE WHEN co <> '' THEN '## Comparison' || chr(10) || co END, '## Supporting Evidence' || chr(10) || 'see E1',
CASE WHEN len(refs) > 0 THEN '## Citations' || chr(10) || array_to_string(list_transform(refs, lambda e: '[' || e || ']'), ', ') END, CASE WHEN sure <> '' THEN '**Confidence:** ' || sure END) AS text,
CASE WHEN turn % 2 = 0 THEN {lit(fixed.REFUSAL)} ELSE {lit(fixed.REFUSAL)} || chr(10) || chr(10) || 'why' END AS refusal FROM r""")
def rendered_answers(spark, d):
    ids = A.referenced_ids(F.col("citations"), *(F.col(c) for c in A.PROSE))
    why = F.when(F.col("comparison") == "", "").otherwise("why")
    return _bodies(spark, d).select("query_id", A.render_markdown(ids).alias("text"), A.refusal(why).alias("refusal"))


@query(f"""WITH {BODIES}, s AS (SELECT query_id, refs, CASE WHEN len(refs) = 0 THEN 0.0 ELSE len(list_filter(refs, lambda x: x IN ('E1', 'E2'))) / len(refs) END AS g, len(list_filter(['E1', 'E2'], lambda x: list_contains(refs, x))) / 2 AS c, turn FROM r)
SELECT query_id, round(g, 6) AS groundedness, round(c, 6) AS coverage, round(turn * 1000 / 1e6 * 2.5 + turn * 10 / 1e6 * 10.0, 6) AS cost FROM s""")
def citation_quality(spark, d):
    bodies = _bodies(spark, d).withColumn("turn", F.split("query_id", ":")[1].cast("int"))
    refs = A.referenced_ids(F.col("citations"), *(F.col(c) for c in A.PROSE))
    ground, cover = M.citation_scores(refs, _list(["E1", "E2"]))
    return bodies.select("query_id", F.round(ground, 6).alias("groundedness"), F.round(cover, 6).alias("coverage"), A.cost_usd(F.col("turn") * 1000, F.col("turn") * 10).alias("cost"))


@query("""WITH l AS (SELECT doc_id, list_concat(CASE WHEN quality = 1 THEN ['risk'] ELSE [] END, CASE WHEN toxic = 1 THEN ['legal'] ELSE [] END) AS met FROM labels),
d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['risk', 'legal'] ELSE ['legal', 'business'] END AS want FROM documents),
j AS (SELECT d.doc_id, want, coalesce(met, []) AS met FROM d LEFT JOIN l USING (doc_id))
SELECT doc_id, array_to_string(list_filter(want, lambda x: list_contains(met, x)), '|') AS covered, array_to_string(list_filter(want, lambda x: NOT list_contains(met, x)), '|') AS missing FROM j""")
def facets_covered(spark, d):
    asked = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 2 == 0, _list(["risk", "legal"])).otherwise(_list(["legal", "business"])).alias("facets"))
    met = F.array_compact(F.array(F.when(F.col("quality") == 1, "risk"), F.when(F.col("toxic") == 1, "legal")))
    evidence = table(spark, d, "labels").select(F.col("doc_id").alias("query_id"), met.alias("facets_met"))
    out = A.facet_coverage(asked, evidence)
    return out.select(F.col("query_id").alias("doc_id"), F.array_join("covered", "|").alias("covered"), F.array_join("missing", "|").alias("missing"))


@query("""WITH q AS (SELECT o_orderkey, o_custkey % 101 / 100.0 AS sim FROM orders),
e AS (SELECT l_orderkey, count(*) AS n, avg(l_quantity) AS mean, max(abs(l_quantity)) AS most, avg(CASE WHEN l_linenumber % 2 = 0 THEN 1.0 ELSE 0.0 END) AS m FROM lineitem GROUP BY 1),
j AS (SELECT o_orderkey, CASE WHEN n IS NULL THEN 0.0 WHEN o_orderkey % 2 = 0 THEN m ELSE 0.75 END AS a, CASE WHEN n IS NULL OR most = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, mean / most)) END AS b, CASE WHEN n IS NULL THEN 0.0 ELSE least(1.0, n / 8.0) END AS c, greatest(0.0, least(1.0, sim)) AS s, n FROM q LEFT JOIN e ON l_orderkey = o_orderkey),
t AS (SELECT o_orderkey, CASE WHEN n IS NULL THEN 0.0 ELSE 0.25 * (a + b + c + s) END AS total FROM j)
SELECT o_orderkey, CAST(round(total + 1e-7, 4) AS DOUBLE) AS score, CASE WHEN round(total, 9) >= 0.75 THEN 'High' WHEN round(total, 9) >= 0.55 THEN 'Medium' ELSE 'Low' END AS band FROM t""")
def retrieval_confidences(spark, d):
    none, numbers = F.array().cast("array<string>"), F.array().cast("array<int>")
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), none.alias("companies"), numbers.alias("years"), none.alias("facets"), none.alias("section_intent"), F.lit(8).alias("evidence_limit"), (F.col("o_custkey") % 101 / 100.0).alias("top_similarity"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_quantity").cast("double").alias("score"), F.lit("").alias("ticker"), F.lit(0).alias("year"), none.alias("facets_met"), none.alias("sections_met"), "l_linenumber")
    out = A.retrieval_confidence(asked, rows, F.col("query_id") % 2 == 0, F.col("l_linenumber") % 2 == 0)
    return out.select(F.col("query_id").alias("o_orderkey"), F.round(F.col("total") + 1e-7, 4).alias("score"), "band")


@query(f"""WITH q AS (SELECT item_id, text FROM benchmark)
SELECT item_id AS query_id, sha256('<context>' || chr(10) || 'E1: [T · Business] (chunk ' || item_id || ')' || chr(10) || text || chr(10) || '</context>' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || {lit(A.FORMAT)}) AS prompt, {lit(A.PROMPT_VERSION)} AS prompt_version FROM q""")
def built_prompts(spark, d):
    asked = items(spark, d)
    rows = asked.select("query_id", F.lit(1).alias("rank"), F.lit("T").alias("ticker"), F.lit("").alias("company"), F.lit("").alias("form"), F.lit(0).alias("year"), F.lit("").alias("fiscal_period"), F.lit("Business").alias("section"), F.col("query_id").cast("string").alias("chunk_id"), F.col("question").alias("text"))
    out = A.build_prompt(asked, A.render_context(A.build_evidence(rows)))
    return out.select("query_id", F.sha2("user", 256).alias("prompt"), "prompt_version")


# --- reports ---------------------------------------------------------------------------------


def _results(spark, d):
    """Lines of orders as ranked results, returned ones relevant."""
    lines = table(spark, d, "lineitem")
    return lines.select(F.col("l_orderkey").alias("case_id"), F.lit("m").alias("mode"), F.col("l_linenumber").alias("rank"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("chunk_id"), F.concat("l_returnflag", "l_linestatus").alias("ticker"), F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("form"), F.lit("").alias("section"), F.lit("").alias("section_signals"), (F.col("l_returnflag") == "R").cast("int").alias("rel"))


@query("""WITH t AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS total FROM lineitem GROUP BY 1)
SELECT l_orderkey AS case_id, round(CASE WHEN any_value(total) > 0 THEN count(*) FILTER (WHERE l_returnflag = 'R') / any_value(total) ELSE 0 END, 6) AS recall FROM lineitem JOIN t USING (l_orderkey) WHERE l_linenumber <= 3 GROUP BY 1""")
def recall_at_three(spark, d):
    rows = _results(spark, d)
    totals = rows.groupBy("case_id").agg(F.sum("rel").alias("total"))
    return M.recall_at_k(rows, totals, 3).select("case_id", F.round("recall", 6).alias("recall"))


@query("""WITH g AS (SELECT l_orderkey, list(DISTINCT l_returnflag || l_linestatus) AS got FROM lineitem GROUP BY 1)
SELECT o_orderkey AS case_id, round(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE len(list_filter(['AF', 'RF', 'NO'], lambda x: list_contains(coalesce(got, []), x))) / 3 END, 6) AS company_recall FROM orders LEFT JOIN g ON l_orderkey = o_orderkey""")
def expected_companies(spark, d):
    none = F.array().cast("array<string>")
    cases = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderkey") % 3 == 0, none).otherwise(_list(["AF", "RF", "NO", "AF"])).alias("companies"))
    return M.company_recall(_results(spark, d), cases).select("case_id", F.round("company_recall", 6).alias("company_recall"))


@query("""SELECT l_orderkey AS case_id, l_linenumber AS rank, CAST(CASE WHEN l_orderkey % 4 = 0 THEN l_linenumber = 1 ELSE l_returnflag || l_linestatus IN ('AF', 'NO') AND year(l_shipdate) IN (1995, 1996) END AS INTEGER) AS rel
FROM lineitem""")
def judged_relevance(spark, d):
    lines = _results(spark, d).drop("rel").withColumns({c: F.lit(False) for c in ("has_risk_heading", "has_mda_heading", "has_legal_heading", "has_business_heading", "has_financial_table", "has_revenue_table")})
    lines = lines.withColumn("chunk_id", F.concat_ws(":", "case_id", "rank"))
    key = F.col("o_orderkey")
    cases = table(spark, d, "orders").select(
        key.alias("case_id"),
        F.lit("anything").alias("question"),
        F.when(key % 2 >= 0, _list(["AF", "NO"])).alias("companies"),
        F.array(F.lit(1995), F.lit(1996)).alias("years"),
        F.array().cast("array<string>").alias("forms"),
        F.array().cast("array<string>").alias("sections"),
        F.when(key % 4 == 0, F.array(F.concat(key.cast("string"), F.lit(":1")))).otherwise(F.array().cast("array<string>")).alias("expected_chunk_ids"),
    )
    return M.relevance(lines, cases).select("case_id", "rank", "rel")


@query("""WITH s AS (SELECT avg(quality) AS q, avg(toxic) AS t, count(*) AS n FROM labels), l AS (SELECT unnest(['quality', 'toxic', 'n_cases']) AS metric, unnest([round(q, 4), round(t, 4), n]) AS value FROM s) SELECT metric, CAST(value AS DOUBLE) AS value FROM l""")
def report_summary(spark, d):
    return M.summary(table(spark, d, "labels").select(F.col("quality").cast("int"), F.col("toxic").cast("int")))


@query("SELECT conv_id || ':' || turn AS case_id FROM conversations WHERE (contains(lower(text), 'an') OR contains(lower(conv_id || ':' || turn), 'an')) AND turn % 2 = 0")
def found_cases(spark, d):
    cases = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("case_id"), F.col("text").alias("question"), (F.col("turn") % 2 == 0).alias("refused"))
    return M.find_cases(cases, "AN", True).select("case_id")


@query("""WITH c AS (SELECT l_returnflag AS form, 'I' || l_linenumber AS item, count(DISTINCT l_orderkey) AS docs FROM lineitem GROUP BY ALL)
SELECT form, item, docs, row_number() OVER (PARTITION BY form ORDER BY docs DESC, item) AS place FROM c QUALIFY place <= 4""")
def item_frequencies(spark, d):
    heads = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("form"), F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("I"), F.col("l_linenumber").cast("string")).alias("item"))
    return M.item_frequency(heads, 4)


@query("SELECT count(*) FILTER (WHERE doc_id % 2 = 0) AS \"Ticker\", count(*) FILTER (WHERE doc_id % 3 = 0) AS \"CIK\", 0 AS \"URL\" FROM documents")
def header_counts(spark, d):
    line = lambda n, label: F.when(F.col("doc_id") % n == 0, f"{label}: x\n").otherwise(f" {label}: x\n")
    raw = F.concat(F.lit("Company: y\n"), line(2, "Ticker"), line(3, "CIK"))
    return table(spark, d, "documents").select(raw.alias("raw")).agg(*M.header_coverage(F.col("raw"), ("Ticker", "CIK", "URL")))


@query("""WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 50 = 0) AS f, count(*) FILTER (WHERE doc_id % 7 = 0) AS s FROM documents)
SELECT 'no markup left' AS name, f = 0 AS ok, f || ' of ' || n AS detail FROM n UNION ALL SELECT 'metadata complete', s = 0, s || ' of ' || n FROM n
UNION ALL SELECT 'sections contiguous', f = 0, f || ' of ' || (2 * n) FROM n UNION ALL SELECT 'sections cover the text', true, '0 of ' || (2 * n) FROM n
UNION ALL SELECT 'a vector for each chunk', f = 0, f || ' of ' || (n - f) FROM n UNION ALL SELECT 'a chunk for each vector', true, '0 of ' || (n - f) FROM n""")
def corpus_integrity(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    bad = F.col("doc_id") % 50 == 0
    cleaned = docs.select("doc_id", F.when(bad, "a <xbrl> b").otherwise("plain text").alias("text"))
    metadata = docs.select("doc_id", F.when(F.col("doc_id") % 7 == 0, "").otherwise("T").alias("ticker"), F.lit("10-K").alias("form"), F.lit(2020).alias("year"))
    sections = cleaned.select("doc_id", F.lit(0).alias("start"), F.when(bad, 4).otherwise(5).alias("end")).unionByName(cleaned.select("doc_id", F.lit(5).alias("start"), F.length("text").alias("end")))
    chunks = docs.select(F.col("doc_id").alias("chunk_id"))
    return M.integrity(cleaned, metadata, sections, chunks, chunks.where("chunk_id % 50 <> 0"))


@query("SELECT 'clean' AS stage, status, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'failed' ELSE 'ok' END AS status FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)) GROUP BY status")
def stage_counts(spark, d):
    return stage_report(("clean", table(spark, d, "documents"), table(spark, d, "labels")))


# --- stored tables -----------------------------------------------------------------------------


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, sha256(text) AS content FROM documents WHERE lang IN ('en', 'fr')")
def stage_round_trip(spark, d):
    base = _scratch(spark)
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("lang").alias("ticker"))
    C.write_stage(docs.union(spark.createDataFrame([("_report", "x", "en")], docs.schema)), base, "chunks", "ticker")
    stage = C.read_stage(spark, base, "chunks")
    rows = C.only_tickers(stage, ["en", "fr"]).join(C.stage_ids(stage), "doc_id", "left_semi")
    return rows.select("doc_id", F.col("ticker").alias("lang"), F.sha2("text", 256).alias("content"))


@query("""WITH v AS (SELECT vec_id, vec_id % 40 AS doc, label FROM embeddings),
s AS (SELECT vec_id, 0 AS version FROM v WHERE doc % 4 <> 0 UNION ALL SELECT vec_id, 1 FROM v WHERE doc % 4 = 0 AND vec_id % 3 = 0)
SELECT 'c' || vec_id AS chunk_id, version, (SELECT count(*) FROM s) AS total FROM s WHERE vec_id % 5 = 0""")
def vector_upsert(spark, d):
    store = VectorTable(spark, _scratch(spark))
    rows = table(spark, d, "embeddings").select(F.lit("m").alias("model"), F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("chunk_id"), (F.col("vec_id") % 40).cast("string").alias("doc_id"), F.array(F.lit(0.0).cast("float")).alias("embedding"), "vec_id")
    store.upsert(rows.drop("vec_id"))
    again = rows.where("cast(doc_id as int) % 4 = 0 and vec_id % 3 = 0").withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    # A document that is written again without a chunk loses that chunk.
    gone = rows.where("cast(doc_id as int) % 4 = 0 and vec_id % 3 <> 0").select("doc_id").distinct().join(again.select("doc_id").distinct(), "doc_id", "left_anti")
    assert not gone.take(1)
    store.upsert(again.drop("vec_id"))
    wanted = rows.where("vec_id % 5 = 0").select("chunk_id")
    return store.get(wanted).select("chunk_id", F.col("embedding")[0].cast("int").alias("version"), F.lit(store.count()).cast("long").alias("total"))


@query("SELECT v.vec_id AS chunk_id, sha256(d.text) AS content, CASE WHEN v.vec_id % 2 = 0 THEN sha256('own') ELSE sha256(d.text) END AS hydrated FROM embeddings v JOIN documents d ON d.doc_id = v.vec_id")
def hydrated_chunks(spark, d):
    chunks = docs_of(spark, d).select("chunk_id", "text")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id")).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    joined = index_join(vectors, chunks).select("chunk_id", F.sha2("text", 256).alias("content"))
    ranked = vectors.withColumn("text", F.when(F.col("chunk_id") % 2 == 0, "own").otherwise(""))
    full = hydrate(ranked, chunks.where("chunk_id % 3 = 0"), chunks).select("chunk_id", F.sha2("text", 256).alias("hydrated"))
    return joined.join(full, "chunk_id")


@query(f"WITH {SCORED} {_show(_ranked())}")
def stored_bm25(spark, d):
    path = _scratch(spark)
    R.build_bm25(docs_of(spark, d)).save(path)
    return _shown(R.bm25_search(R.Bm25Index.load(spark, path), items(spark, d), K))


@query("""SELECT conv_id || ':' || turn AS query_id, text AS question, 'accept' AS action, turn * 100 AS input_tokens, turn AS output_tokens, round(turn * 100 / 1e6 * 2.5 + turn / 1e6 * 10.0, 6) AS cost_usd,
CASE WHEN turn % 2 = 0 THEN 'up' END AS rating FROM conversations WHERE role = 'user' AND text IS NOT NULL""")
def query_logs(spark, d):
    path = _scratch(spark)
    said = table(spark, d, "conversations").where("role = 'user' and text is not null")
    none = F.array().cast("array<string>")
    results = said.select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), F.col("text").alias("question"), F.lit("accept").alias("action"), (F.col("turn") * 100).cast("int").alias("input_tokens"), F.col("turn").cast("int").alias("output_tokens"), none.alias("evidence_ids"), none.alias("evidence_used"), F.lit("v").alias("prompt_version"))
    log = L.query_log(results).select("query_id", "question", "action", "input_tokens", "output_tokens", "cost_usd")
    L.append_jsonl(log.where("output_tokens % 2 = 0"), f"{path}/log")
    L.append_jsonl(log.where("output_tokens % 2 <> 0"), f"{path}/log")
    ratings = results.where("output_tokens % 2 = 0").select("query_id", F.lit("up").alias("rating"), F.lit(True).alias("citations_correct"), F.lit("").alias("comment"), F.lit("").alias("citation_correction"))
    L.append_jsonl(L.feedback_rows(results, ratings), f"{path}/feedback")
    rated = L.read_jsonl(spark, f"{path}/feedback", "query_id string, " + L.FEEDBACK).select("query_id", "rating")
    stored = L.read_jsonl(spark, f"{path}/log", "query_id string, question string, action string, input_tokens long, output_tokens long, cost_usd double")
    return stored.join(rated, "query_id", "left")


@query("SELECT CAST(item_id AS VARCHAR) AS case_id, text AS question, item_id % 2 = 0 AS expect_refusal FROM benchmark")
def golden_set(spark, d):
    path = _scratch(spark)
    rows = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), (F.col("item_id") % 2 == 0).alias("expect_refusal"))
    L.append_jsonl(rows, path)
    return L.golden_cases(spark, path).select("case_id", "question", "expect_refusal")


@query("SELECT 'quality' AS metric, round(avg(quality), 4) AS value FROM labels UNION ALL SELECT 'toxic', round(avg(toxic), 4) FROM labels UNION ALL SELECT 'n_cases', count(*) FROM labels")
def earlier_report(spark, d):
    path = _scratch(spark)
    assert L.previous_report(spark, path) is None
    L.append_jsonl(M.summary(table(spark, d, "labels").select(F.col("quality").cast("int"), F.col("toxic").cast("int"))), path)
    return L.previous_report(spark, path)


# --- predicates --------------------------------------------------------------------------------

_ASKED_FACETS = (("risk",), ("legal", "financial"), ("segments",), (), ("market_risk", "regulatory", "liquidity"))
_ASKED_SECTIONS = (("Risk Factors",), (fixed.MDA, "Business"), (), ("Exhibits", "Legal Proceedings"), (fixed.MARKET_RISK,))
_CHUNK_SECTIONS = ("Risk Factors", "business", "Financial Statements", "Other", "", "Legal Proceedings and more", "Properties")
_CHUNK_SIGNALS = ("", "risk_content|legal_content", "revenue_table", "mda_heading", "market data")
_HAS = ("has_risk_heading", "has_mda_heading", "has_legal_heading", "has_business_heading", "has_financial_table", "has_revenue_table")


def _nested(values) -> str:
    return "[" + ", ".join(listed(v) if v else "CAST([] AS VARCHAR[])" for v in values) + "]"


def _near_sql(section: str, others: str) -> str:
    return f"len(list_filter({others}, lambda o: contains(lower(o), lower({section})) OR contains(lower({section}), lower(o)))) > 0"


_TOLD = "(contains(lower(signals), {f}) OR list_has_any(flags, coalesce(ff[{f}], [])))"
_MEETS_FACET = "({near} OR {told})".format(near=_near_sql("section", "fs[{f}]"), told=_TOLD)
_SERVING = "list_concat(coalesce(eq[{t}], [{t}]), flatten(list_filter(list_transform(facets, lambda x: fs[x]), lambda s: list_contains(s, {t}))))"
_MEETS_SECTION = "({near} OR len(list_filter(list_concat(list_filter(map_keys(fs), lambda x: list_has_any(fs[x], {serving})), facets), lambda y: {told})) > 0)".format(near=_near_sql("section", _SERVING), serving=_SERVING, told=_TOLD.format(f="y"))
_FLAGGED = "list_has_any(flags, coalesce(sf[{t}], []))"
_WORDS = f"string_split(trim(replace(replace(lower({{t}}), {lit(fixed.MDA.lower())}, 'mda'), '&', ' ')), ' ')"
_LOOSE = "({0} OR {1} OR {2} OR len(list_filter({3}, lambda w: w <> '' AND contains(lower(signals), w))) > 0)".format(_MEETS_SECTION, _near_sql("section", "[{t}]"), _FLAGGED, _WORDS)
PREDICATES = f"""m AS (SELECT {sql_map(fixed.FACET_SECTIONS)} AS fs, {sql_map(fixed.FACET_FLAGS)} AS ff, {sql_map(fixed.EQUIVALENTS)} AS eq, {sql_map(fixed.SECTION_FLAGS)} AS sf),
r AS (SELECT p_partkey AS k, {listed(_CHUNK_SECTIONS)}[p_partkey % 7 + 1] AS section, {listed(_CHUNK_SIGNALS)}[p_size % 5 + 1] AS signals, CASE WHEN p_partkey % 4 = 0 THEN [{listed(_HAS)}[p_partkey // 4 % 6 + 1]] ELSE CAST([] AS VARCHAR[]) END AS flags,
  {_nested(_ASKED_FACETS)}[p_partkey // 7 % 5 + 1] AS facets, {_nested(_ASKED_SECTIONS)}[p_partkey // 35 % 5 + 1] AS boosts, p_size % 11 / 10.0 AS quality FROM part),
met AS (SELECT k, facets, boosts, quality, list_filter(facets, lambda f: {_MEETS_FACET.format(f='f')}) AS facets_met, list_filter(boosts, lambda t: {_MEETS_SECTION.format(t='t')}) AS sections_met,
  list_filter(boosts, lambda t: {_LOOSE.format(t='t')}) AS loosely_met, list_filter(boosts, lambda t: {_FLAGGED.format(t='t')}) AS flagged FROM r, m),
bo AS (SELECT *, CASE WHEN len(facets) = 0 AND len(boosts) = 0 THEN 0.0 ELSE greatest(CASE WHEN len(facets_met) > 0 THEN 0.07 ELSE 0 END, CASE WHEN len(sections_met) > 0 THEN 0.08 ELSE 0 END, CASE WHEN len(flagged) > 0 THEN 0.06 ELSE 0 END) + least(0.02, greatest(0.0, quality - 0.75) * 0.05) END AS bonus FROM met)"""


def _pool(spark, d):
    pick = lambda values, c: F.element_at(F.array(*(F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v)).cast("array<string>") for v in values)), (c % len(values) + 1).cast("int"))
    k = F.col("p_partkey")
    flag = F.when(k % 4 == 0, pick(_HAS, F.floor(k / 4))).otherwise("")
    return table(spark, d, "part").select(
        k.alias("k"),
        pick(_CHUNK_SECTIONS, k).alias("section"),
        pick(_CHUNK_SIGNALS, F.col("p_size")).alias("section_signals"),
        *((flag == name).alias(name) for name in _HAS),
        pick(_ASKED_FACETS, F.floor(k / 7)).alias("facets"),
        pick(_ASKED_SECTIONS, F.floor(k / 35)).alias("boosts"),
        (F.col("p_size") % 11 / 10.0).alias("metadata_quality"),
    )


@query(f"WITH {PREDICATES} SELECT k, array_to_string(facets_met, '|') AS facets_met, array_to_string(sections_met, '|') AS sections_met, array_to_string(loosely_met, '|') AS loosely_met, CAST(round(bonus, 6) AS DOUBLE) AS bonus FROM bo")
def chunk_predicates(spark, d):
    facets, boosts = F.col("facets"), F.col("boosts")
    met = {"facets_met": P.facets_met(facets), "sections_met": P.sections_met(boosts, facets), "loosely_met": P.sections_met(boosts, facets, loose=True)}
    return _pool(spark, d).select("k", *(F.array_join(c, "|").alias(name) for name, c in met.items()), F.round(P.bonus(boosts, facets), 6).alias("bonus"))


@query(f"""WITH {PREDICATES}, b AS (SELECT k % 20 AS query_id, k, round(bonus + 1.0 / (60 + k), 9) AS score, k AS before FROM bo)
SELECT query_id, k, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM b""")
def boosted_ranks(spark, d):
    rows = _pool(spark, d).withColumns({"query_id": F.col("k") % 20, "rank": F.col("k"), "score": 1.0 / (60 + F.col("k"))})
    return boosted(rows).select("query_id", "k", F.round("score", 6).alias("score"), "rank")
