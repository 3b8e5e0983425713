"""Queries on search, fusion, selection and metrics over the driver's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filigree.operators import answers as A
from filigree.operators import metrics as M
from filigree.operators import search as R
from filigree.operators import selection as S
from filigree.session import shared_table, table

K = 10
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


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source", "n_chars", "doc_id")


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


TOKENS = "unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))"
INDEX = f"""
post AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, {TOKENS} AS term FROM documents) GROUP BY ALL),
len AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl, lang FROM documents),
stat AS (SELECT count(*) AS N, avg(dl) AS avgdl FROM len),
raw AS (SELECT term, count(*) AS n, ln(any_value(N) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, stat GROUP BY term),
term AS (SELECT term, n, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
SCORED = f"""{INDEX},
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, {TOKENS} AS term FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT q.query_id, p.doc_id, l.lang, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM q JOIN term USING (term) JOIN post p USING (term) JOIN len l USING (doc_id), stat GROUP BY ALL
)"""


def _ranked(where: str = "true", limit: int = K, source: str = "scored") -> str:
    return f"SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {source} WHERE {where} QUALIFY rank <= {limit}"


def _shown(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


def _show(source: str) -> str:
    return f"SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ({source}) WHERE score > 0"


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {TOKENS} AS term FROM documents) GROUP BY ALL")
def tokenize_terms(spark, d):
    index = R.build_bm25(docs_of(spark, d))
    return index.postings.select(F.col("chunk_id").alias("doc_id"), "term", "tf")


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM documents")
def doc_lengths(spark, d):
    return R.build_bm25(docs_of(spark, d)).lengths.select(F.col("chunk_id").alias("doc_id"), "dl")


@query(f"WITH {INDEX} SELECT term, n, round(idf, 6) AS idf FROM term")
def term_stats(spark, d):
    return R.build_bm25(docs_of(spark, d)).terms.select("term", "n", F.round("idf", 6).alias("idf"))


@query(f"WITH {SCORED} {_show(_ranked())}")
def bm25_topk(spark, d):
    return _shown(R.bm25_search(R.build_bm25(docs_of(spark, d)), items(spark, d), K))


@query(f"""WITH {SCORED} {_show(_ranked("lang = 'en'"))}""")
def bm25_prefilter_topk(spark, d):
    index = R.build_bm25(docs_of(spark, d), keep=("lang",))
    return _shown(R.bm25_search(index, items(spark, d), K, F.col("lang") == "en"))


@query(f"""WITH {SCORED}, wide AS (SELECT r.*, lang FROM ({_ranked(limit=4 * K)}) r JOIN len USING (doc_id)), kept AS (SELECT query_id, doc_id, score FROM wide WHERE lang = 'fr')
{_show(_ranked(source="kept"))}""")
def bm25_overfetch_topk(spark, d):
    docs = docs_of(spark, d)
    return _shown(R.bm25_search(R.build_bm25(docs), items(spark, d), K, docs.where("lang = 'fr'").select("chunk_id"), overfetch=True))


def _vectors(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    return v, v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")


def _near(extra: str = "", part: str = "query_id", limit: int = K, more: str = "") -> str:
    return f"""WITH s AS (
  SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 {extra}
)
SELECT query_id, vec_id, {more} round(score, 6) AS score, row_number() OVER (PARTITION BY {part} ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= {limit}"""


def _hits(found: DataFrame, *more: str) -> DataFrame:
    return found.select("query_id", F.col("chunk_id").alias("vec_id"), *more, F.round("score", 6).alias("score"), "rank")


@query(_near())
def cosine_topk(spark, d):
    vectors, asked = _vectors(spark, d)
    return _hits(R.vector_search(vectors, asked, K))


@query(_near("AND v.label = 3"))
def cosine_filtered_topk(spark, d):
    vectors, asked = _vectors(spark, d)
    return _hits(R.vector_search(vectors.where("label = 3"), asked, K))


@query(_near(part="query_id, label", limit=2, more="label,"))
def cosine_topk_per_group(spark, d):
    vectors, asked = _vectors(spark, d)
    return _hits(R.vector_search(vectors, asked, 2, group="label"), "label")


def _two_lists(spark, d):
    index = R.build_bm25(docs_of(spark, d), keep=("lang",))
    asked = items(spark, d)
    return R.bm25_search(index, asked, 20), R.bm25_search(index, asked, 20, F.col("lang") == "en")


LISTS = f"""{SCORED}, a AS ({_ranked(limit=20)}), b AS ({_ranked("lang = 'en'", 20)}),
u AS (SELECT query_id, doc_id, rank, 0 AS list FROM a WHERE score > 0 UNION ALL SELECT query_id, doc_id, rank, 1 FROM b WHERE score > 0)"""
FUSED = f"""{LISTS}, f AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score, min(list * 1000000 + rank) AS first FROM u GROUP BY ALL),
fused AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM f)"""


@query(f"WITH {FUSED} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM fused WHERE rank <= 30")
def rrf_fusion(spark, d):
    return _shown(R.reciprocal_rank_fusion(list(_two_lists(spark, d)), 60, 30))


LANG_GROUPS = "SELECT 0 AS query_id, doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 10"


@query(f"SELECT doc_id, lang, row_number() OVER (ORDER BY rank, lang) AS rank FROM ({LANG_GROUPS})")
def interleave_entities(spark, d):
    docs = docs_of(spark, d)
    ranked = docs.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n_chars"), "chunk_id"))).where("rank <= 10")
    out = R.interleave(ranked.select(F.lit(0).alias("query_id"), "chunk_id", "lang", "rank"), "lang")
    return out.select(F.col("chunk_id").alias("doc_id"), "lang", "rank")


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1")
def dedup_exact_hash(spark, d):
    return docs_of(spark, d).groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


def _by_size(spark, d, most: int | None = 30):
    """For each source its texts, the longest first, as ranked lists: all, or pools of `most` rows."""
    order = W.partitionBy("source").orderBy(F.desc("n_chars"), "chunk_id")
    ranked = docs_of(spark, d).withColumn("rank", F.row_number().over(order))
    ranked = ranked if most is None else ranked.where(F.col("rank") <= most)
    return ranked.select(F.col("source").alias("query_id"), "rank", F.lit("").alias("ticker"), F.col("lang").alias("company"), F.col("lang").alias("section"), F.col("source").alias("doc_id"), "chunk_id", "text", F.sha2("text", 256).alias("content_hash"))


ALL = """sized AS (SELECT source, lang, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents)"""
SIZED = """sized AS (SELECT source, lang, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 30)"""


@query(f"""WITH {ALL}, h AS (SELECT *, row_number() OVER (PARTITION BY source, text ORDER BY rank) AS n FROM sized QUALIFY n = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY rank) AS m FROM h QUALIFY m <= 3)
SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY rank) AS rank FROM c""")
def dedup_section_cap(spark, d):
    return S.deduplicate_by_windows(_by_size(spark, d, None)).select("query_id", F.col("chunk_id").alias("doc_id"), "rank")


def _steps(rounds: int) -> str:
    """The rows of `sized`, and an empty list for the places behind a source's last row."""
    return f"steps AS (SELECT source, t, (t - 1) % 30 + 1 AS rank FROM (SELECT DISTINCT source FROM sized), (SELECT unnest(generate_series(1, {rounds * 30})) AS t))"


def _taken(chosen: str, place: str = "rank") -> str:
    return f"SELECT source AS query_id, unnest(taken) AS doc_id, generate_subscripts(taken, 1) AS {place} FROM {chosen}"


@query(f"""WITH RECURSIVE {SIZED}, st AS (
  SELECT DISTINCT source, 0 AS rank, []::BIGINT[] AS taken, []::VARCHAR[] AS texts, []::VARCHAR[] AS langs FROM sized
  UNION ALL
  SELECT st.source, st.rank + 1, CASE WHEN ok THEN list_append(taken, doc_id) ELSE taken END, CASE WHEN ok THEN list_append(texts, hash) ELSE texts END, CASE WHEN ok THEN list_append(langs, lang) ELSE langs END
  FROM st JOIN (SELECT source, rank AS r, doc_id, lang, sha256(text) AS hash FROM sized) s ON s.source = st.source AND s.r = st.rank + 1,
  LATERAL (SELECT NOT list_contains(texts, hash) AND len(list_filter(langs, lambda x: x = lang)) < 3 AS ok)
), last AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY source ORDER BY rank DESC) = 1) {_taken('last')}""")
def dedup_fold(spark, d):
    return S.deduplicate(_by_size(spark, d)).select("query_id", F.col("chunk_id").alias("doc_id"), "rank")


def _diverse(limit: str, section_cap: int, company_cap: int) -> str:
    """Three passes over each source's rows as a recursion; company and section are the language."""
    return f"""{SIZED}, {_steps(3)}, st AS (
  SELECT DISTINCT source, 0 AS t, []::BIGINT[] AS taken, []::VARCHAR[] AS langs FROM sized
  UNION ALL
  SELECT st.source, st.t + 1, CASE WHEN ok THEN list_append(taken, doc_id) ELSE taken END, CASE WHEN ok THEN list_append(langs, lang) ELSE langs END
  FROM st JOIN (SELECT steps.source, steps.t AS step, doc_id, lang FROM steps LEFT JOIN sized ON sized.source = steps.source AND sized.rank = steps.rank) s ON s.source = st.source AND s.step = st.t + 1,
  LATERAL (SELECT doc_id IS NOT NULL AND len(taken) < {limit} AND NOT list_contains(taken, doc_id) AND (st.t >= 60 OR CASE WHEN st.t < 30 THEN NOT list_contains(langs, lang) ELSE len(list_filter(langs, lambda x: x = lang)) < {min(section_cap, company_cap)} END) AS ok)
), last AS (SELECT * FROM st WHERE t = 90)"""


@query(f"WITH RECURSIVE {_diverse('12', 4, 6)} {_taken('last')}")
def diversify_full(spark, d):
    return S.diversify(_by_size(spark, d).withColumn("evidence_limit", F.lit(12))).select("query_id", F.col("chunk_id").alias("doc_id"), "rank")


@query(f"""WITH {ALL} SELECT source AS query_id, doc_id, rank FROM sized QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY rank) = 1""")
def diversify_pass1(spark, d):
    return S.unique_pairs(_by_size(spark, d, None)).select("query_id", F.col("chunk_id").alias("doc_id"), "rank")


@query(f"""WITH RECURSIVE {_diverse('30', 2, 4)}, n AS (SELECT source, doc_id AS id, place, length(text) // 4 + 30 AS cost FROM ({_taken('last', 'place')}) o JOIN (SELECT source, doc_id AS d, text FROM sized) s ON s.source = o.query_id AND s.d = o.doc_id),
b AS (
  SELECT DISTINCT source, 0 AS k, 300 + length('what is it about') // 4 + 80 AS used, []::BIGINT[] AS taken FROM sized
  UNION ALL
  SELECT b.source, b.k + 1, CASE WHEN len(taken) = 0 OR used + cost <= 7000 THEN used + cost ELSE used END, CASE WHEN len(taken) = 0 OR used + cost <= 7000 THEN list_append(taken, id) ELSE taken END
  FROM b JOIN n ON n.source = b.source AND n.place = b.k + 1
), done AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY source ORDER BY k DESC) = 1) {_taken('done', 'place')}""")
def fit_to_budget(spark, d):
    rows = _by_size(spark, d).withColumn("evidence_no", F.col("rank")).withColumn("question", F.lit("what is it about"))
    return S.fit_to_budget(rows, 300).select("query_id", F.col("chunk_id").alias("doc_id"), "place")


@query(f"""WITH {SIZED}, n AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY rank) AS m FROM sized)
SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = 'es' AND m <= 2 THEN 0 WHEN lang = 'fr' AND m = 1 THEN 1 WHEN lang = 'de' AND m = 1 THEN 2 ELSE 3 END, rank) AS rank FROM n""")
def coverage_first(spark, d):
    rows = _by_size(spark, d).withColumn("facets", F.array(F.lit("risk"))).withColumn("boosts", F.array(F.lit("fr"), F.lit("de")))
    rows = rows.withColumn("facets_met", F.when(F.col("section") == "es", F.array(F.lit("risk"))).otherwise(F.array().cast("array<string>"))).withColumn("sections_met", F.array("section"))
    return S.coverage_first(rows).select("query_id", F.col("chunk_id").alias("doc_id"), "rank")


EVIDENCE = f"""{ALL}, e AS (SELECT source AS query_id, doc_id, rank, 'E' || rank AS evidence_id, '[' || lang || ' FY2024 · ' || lang || ']' AS tag, text FROM sized)"""


def _evidence(spark, d):
    rows = _by_size(spark, d, None).withColumns({"form": F.lit(""), "year": F.lit(2024), "fiscal_period": F.lit("")})
    return A.build_evidence(rows)


@query(f"WITH {EVIDENCE} SELECT query_id, doc_id, evidence_id, tag FROM e")
def evidence_number(spark, d):
    return _evidence(spark, d).select("query_id", F.col("chunk_id").alias("doc_id"), "evidence_id", "tag")


@query(f"""WITH {EVIDENCE} SELECT query_id, string_agg(evidence_id || ': ' || tag || ' (chunk ' || doc_id || ')' || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM e GROUP BY query_id""")
def context_string_agg(spark, d):
    return A.render_context(_evidence(spark, d))


JUDGED = f"""{LISTS}, j AS (SELECT u.query_id AS case_id, CASE list WHEN 0 THEN 'all' ELSE 'en' END AS mode, rank, u.doc_id, coalesce(l.quality, 0) AS rel FROM u LEFT JOIN labels l ON l.doc_id = u.doc_id),
m AS (
  SELECT case_id, mode, sum(CASE WHEN rank <= 8 THEN rel ELSE 0 END) / 8.0 AS precision, max(CASE WHEN rank <= 8 THEN rel ELSE 0 END) AS hit,
         coalesce(1.0 / min(CASE WHEN rel = 1 THEN rank END), 0) AS mrr,
         CASE WHEN sum(rel) > 0 THEN sum(CASE WHEN rank <= 8 THEN rel / log2(rank + 1) ELSE 0 END)
              / list_sum(list_transform(range(1, CAST(least(sum(rel), 8) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg
  FROM j GROUP BY case_id, mode
),
pool AS (SELECT case_id, count(DISTINCT doc_id) AS pool FROM j WHERE rel = 1 GROUP BY case_id),
r AS (SELECT j.case_id, mode, CASE WHEN any_value(coalesce(pool, 0)) > 0 THEN sum(rel) / any_value(pool) ELSE 0.0 END AS recall FROM j LEFT JOIN pool USING (case_id) WHERE rank <= 8 GROUP BY j.case_id, mode)"""


def _judged(spark, d):
    a, b = _two_lists(spark, d)
    both = a.withColumn("mode", F.lit("all")).unionByName(b.withColumn("mode", F.lit("en")))
    good = table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"), F.col("quality").alias("rel"))
    both = shared_table(both, "lists")
    return both.join(good, "chunk_id", "left").select(F.col("query_id").alias("case_id"), "mode", "rank", "chunk_id", F.coalesce("rel", F.lit(0)).alias("rel"))


@query(f"WITH {JUDGED} SELECT case_id, mode, round(precision, 6) AS precision, CAST(hit AS DOUBLE) AS hit, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM m")
def precision_mrr_ndcg(spark, d):
    out = M.metrics_at_k(_judged(spark, d), 8)
    return out.select("case_id", "mode", *(F.round(c, 6).alias(c) for c in ("precision", "hit", "mrr", "ndcg")))


@query(f"WITH {JUDGED} SELECT case_id, mode, round(recall, 6) AS recall FROM r")
def pooled_recall(spark, d):
    return M.pooled_recall(_judged(spark, d), 8).select("case_id", "mode", F.round("recall", 6).alias("recall"))


MEANS = f"{JUDGED}, mm AS (SELECT mode, round(avg(precision), 4) AS precision, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, round(avg(recall), 4) AS recall, count(*) AS n_cases FROM m JOIN r USING (case_id, mode) GROUP BY mode)"


def _means(spark, d):
    j = _judged(spark, d)
    both = M.metrics_at_k(j, 8).join(M.pooled_recall(j, 8), ["case_id", "mode"])
    return M.mode_means(both.select("case_id", "mode", "precision", "mrr", "ndcg", "recall"))


@query(f"WITH {MEANS} SELECT * FROM mm")
def ab_mode_means(spark, d):
    return _means(spark, d)


@query(f"""WITH {MEANS}, l AS (UNPIVOT (SELECT mode, precision, mrr, ndcg, recall FROM mm) ON precision, mrr, ndcg, recall INTO NAME metric VALUE value),
cur AS (SELECT metric, value AS cur FROM l WHERE mode = 'en'), old AS (SELECT metric, value AS prev FROM l WHERE mode = 'all')
SELECT metric, prev, cur.cur AS cur, round(cur.cur - prev, 4) AS delta, CASE WHEN round(cur.cur - prev, 4) < -0.02 THEN 'regression' WHEN round(cur.cur - prev, 4) > 0.02 THEN 'improvement' END AS verdict FROM cur JOIN old USING (metric)""")
def regression_diff(spark, d):
    long = M.flatten_modes(_means(spark, d))
    part = lambda mode: long.where(F.col("metric").startswith(f"ab.{mode}.")).select(F.regexp_replace("metric", r"^ab\.\w+\.", "").alias("metric"), "value")
    return M.regressions(part("en"), part("all"))
