"""Answering a table of questions: retrieval to citations in set-wise steps.

Only chunk ids and scores travel until the pools are cut; text is joined to what is left.
The generator is called for accepted questions only, once for each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.config import SETTINGS, Settings
from filigree.functions import predicates as P
from filigree.functions import questions as Q
from filigree.operators import answers as A
from filigree.operators import selection as S
from filigree.operators.search import Bm25Index, bm25_search, embed, interleave, reciprocal_rank_fusion, rerank, sized, top_k, vector_search
from filigree.session import shared_table, ship_package

BODY = "query_id string, executive_summary string, comparison string, supporting_evidence string, citations array<string>, confidence string, limitations string, input_tokens int, output_tokens int"
UNSAFE = "The question contains instructions that try to override retrieval, citation or safety rules. Ask about the filings directly."
SCOPE = {"off_topic": "The question is outside the filings corpus.", "no_topic": "The question names no covered company, filing topic or filing concept."}


@dataclass
class Corpus:
    """What questions are answered from. vectors, index or embedder may be None: degraded search."""

    chunks: DataFrame
    index: Bm25Index | None
    vectors: DataFrame | None
    embedder: object | None


FILTERED = ("ticker", "year", "quarter", "form", "fiscal_period")


def keep_allowed(asked: DataFrame, chunks: DataFrame):
    """A function that keeps the hits (query_id, chunk_id, ...) that meet their question's hard filter."""
    cols = asked.select("query_id", "tickers", F.col("years").alias("q_years"), F.col("quarters").alias("q_quarters"), F.col("forms").alias("q_forms"), F.col("fiscal_periods").alias("q_periods"))
    test = Q.hard_filter(F.col("tickers"), F.col("q_years"), F.col("q_quarters"), F.col("q_forms"), F.col("q_periods"))

    def kept(hits: DataFrame) -> DataFrame:
        return hits.join(sized(cols), "query_id").join(chunks.select("chunk_id", *FILTERED), "chunk_id").where(test).select(*hits.columns)

    return kept


def filter_mask(questions: pa.Table, rows: pa.RecordBatch) -> np.ndarray:
    """The hard filter of every question over rows with the columns FILTERED, as one mask."""
    own = {c: pd.Series(rows.column(c).to_pylist(), dtype=object) for c in FILTERED}
    asked = list(zip(*(questions.column(c).to_pylist() for c in ("tickers", "years", "quarters", "forms", "fiscal_periods"))))
    masks: dict[tuple, np.ndarray] = {}
    for filters in asked:
        key = tuple(tuple(x or ()) for x in filters)
        if key not in masks:
            tickers, years, quarters, forms, periods = key
            inside = lambda values, c: own[c].isin(values).to_numpy() if values else np.ones(rows.num_rows, bool)
            span = inside(years, "year") & inside(quarters, "quarter")
            if periods:
                named = inside(periods, "fiscal_period")
                span = span | named if years and quarters else span & named
            masks[key] = inside(tickers, "ticker") & inside(forms, "form") & span
    return np.array([masks[tuple(tuple(x or ()) for x in f)] for f in asked], bool).reshape(len(asked), rows.num_rows)


def hybrid_search(asked: DataFrame, corpus: Corpus, s: Settings = SETTINGS) -> tuple[DataFrame | None, DataFrame | None]:
    """Ranked vector and BM25 lists. Questions on several companies are searched once for each
    company with their own k, and the lists interleaved."""
    none = F.array().cast("array<string>")
    single = F.col("mode") != "per_entity"
    fan = asked.withColumn("entity", F.explode(F.when(single | (F.size("companies") == 0), F.array(F.lit(""))).otherwise(F.col("companies"))))
    fan = fan.withColumn("tickers", F.when(F.col("entity") == "", F.coalesce("companies", none)).otherwise(F.array("entity")))
    fan = fan.withColumn("group_no", F.coalesce(F.array_position("companies", F.col("entity")), F.lit(0)).cast("int"))
    fan = fan.withColumn("sub", F.concat_ws("\x1f", "query_id", "entity"))
    spec = fan.select("sub", F.col("query_id").alias("query"), "group_no", "entity", "per_entity_k", "expanded")
    one = fan.drop("query_id").withColumnRenamed("sub", "query_id")
    most = max(s.vector_top_k, s.bm25_top_k, s.candidate_pool)

    def whole(found: DataFrame, k: int) -> DataFrame:
        rows = found.withColumnRenamed("query_id", "sub").join(sized(spec), "sub")
        rows = rows.where(F.col("rank") <= F.when(F.col("entity") == "", k).otherwise(F.col("per_entity_k")))
        return interleave(rows.select(F.col("query").alias("query_id"), "chunk_id", "rank", "score", "group_no")).select("query_id", "chunk_id", "rank", "score")

    vec = bm = None
    if corpus.vectors is not None and corpus.embedder is not None:
        filters = ("tickers", "years", "quarters", "forms", "fiscal_periods")
        asked_vectors = embed(one.select("query_id", F.col("expanded").alias("text"), *filters), corpus.embedder).drop("text")
        rows = corpus.vectors.select("chunk_id", "embedding").join(corpus.chunks.select("chunk_id", *FILTERED), "chunk_id")
        vec = whole(vector_search(rows, asked_vectors, most, test=filter_mask), s.vector_top_k)
    if corpus.index is not None:
        bm = whole(bm25_search(corpus.index, one.select("query_id", F.col("expanded").alias("question")), most, keep_allowed(one, corpus.chunks)), s.bm25_top_k)
    return vec, bm


def boosted(ranked: DataFrame) -> DataFrame:
    """Scores grown by the section and facet bonus, ranked anew."""
    out = ranked.withColumn("score", F.round(F.col("score") + P.bonus(F.col("boosts"), F.col("facets")), 9))
    return top_k(out.withColumnRenamed("rank", "_before"), 1 << 30, ["_before"]).drop("_before")


def retrieve(asked: DataFrame, corpus: Corpus, scorer=None, s: Settings = SETTINGS) -> tuple[DataFrame, DataFrame]:
    """Evidence rows and the best cosine (query_id, top_similarity) of understood questions."""
    vec, bm = hybrid_search(asked, corpus, s)
    lists = [x for x in (vec, bm) if x is not None]
    if not lists:
        raise ValueError("neither vectors nor an index to search")
    top = vec.groupBy("query_id").agg(F.max("score").alias("top_similarity")) if vec is not None else asked.select("query_id", F.lit(None).cast("double").alias("top_similarity"))
    pool = asked.select("query_id", "question", "boosts", "facets", "pool_size", "evidence_limit")
    fused = reciprocal_rank_fusion(lists, s.rrf_k).join(sized(pool), "query_id").where(F.col("rank") <= F.col("pool_size"))
    rows = shared_table(fused.join(corpus.chunks.drop("query_id", "rank", "score"), "chunk_id"), "pools")
    rows = boosted(rerank(boosted(rows), scorer))
    rows = rows.withColumns({"facets_met": P.facets_met(F.col("facets")), "sections_met": P.sections_met(F.col("boosts"), F.col("facets"), loose=True)})
    chosen = S.diversify(S.coverage_first(S.deduplicate(rows)))
    return A.build_evidence(chosen), top


def quoting_generator(prompts):
    """An offline generator: quotes the head of each evidence block with its id."""
    import re

    out = []
    for system, user in prompts:
        blocks = re.findall(r"(?m)^(E\d+): .*\n(.*)", user)
        bullets = "\n".join(f"- {text[:120]} [{eid}]" for eid, text in blocks[:4])
        out.append({"executive_summary": bullets, "comparison": "", "supporting_evidence": "", "citations": [e for e, _ in blocks[:4]], "confidence": "", "limitations": "", "input_tokens": (len(system) + len(user)) // 4, "output_tokens": len(bullets) // 4})
    return out


def generate(prompts: DataFrame, generator=quoting_generator) -> DataFrame:
    """One call of generator([(system, user)]) -> [dict] for each prompt."""
    names = [f.split()[0] for f in BODY.split(", ")]

    def run(frames):
        for frame in frames:
            bodies = [generator([(r.system, r.user)])[0] for r in frame.itertuples(index=False)]
            yield pd.DataFrame([{"query_id": q} | b for q, b in zip(frame.query_id, bodies)], columns=names)

    return prompts.mapInPandas(run, BODY)


@dataclass
class Answers:
    """Frames of one run: results (one row a question), evidence, citations."""

    results: DataFrame
    evidence: DataFrame
    citations: DataFrame


def answer(queries: DataFrame, corpus: Corpus, generator=quoting_generator, scorer=None, s: Settings = SETTINGS) -> Answers:
    """Answers to queries (query_id, question). Refusals never reach the generator."""
    ship_package(queries.sparkSession)
    understood = shared_table(Q.understand(queries, s), "questions")
    asked = understood.where("status = 'ok'")
    evidence, top = (shared_table(x, "evidence") for x in retrieve(asked, corpus, scorer, s))
    asked_top = asked.join(top, "query_id", "left")
    gate = A.guardrail(asked_top, evidence, s)
    sure = A.retrieval_confidence(
        asked_top.withColumn("top_similarity", F.coalesce("top_similarity", F.lit(s.min_similarity))),
        evidence.join(asked.select("query_id", F.col("companies").alias("tickers"), F.col("years").alias("q_years"), F.col("quarters").alias("q_quarters"), F.col("forms").alias("q_forms"), F.col("fiscal_periods").alias("q_periods")), "query_id"),
        (F.size("tickers") > 0) | (F.size("q_years") > 0) | (F.size("q_quarters") > 0) | (F.size("q_forms") > 0) | (F.size("q_periods") > 0),
        Q.hard_filter(F.col("tickers"), F.col("q_years"), F.col("q_quarters"), F.col("q_forms"), F.col("q_periods")),
    )
    passed = evidence.join(gate.where("ok").select("query_id"), "query_id", "left_semi")
    kept = shared_table(S.fit_to_budget(passed, S.tokens_of(len(A.SYSTEM))), "prompted")
    prompts = A.build_prompt(asked, A.render_context(kept, "place"))
    bodies = generate(prompts, generator).drop("confidence").join(sure.select("query_id", F.col("band").alias("confidence")), "query_id")
    inline = A.inline_ids(*(F.col(c) for c in A.PROSE))
    bodies = A.complete_sources(bodies.withColumn("inline_citations", inline), kept)
    ids = A.referenced_ids(F.col("citations"), *(F.col(c) for c in A.PROSE))
    bodies = shared_table(bodies.withColumn("text", A.render_markdown(ids)), "bodies")  # each prompt is sent once
    listed = lambda df, order, name: df.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "evidence_id"))), lambda x: x["evidence_id"]).alias(name))
    out = understood.join(gate.withColumnRenamed("reason", "gate_reason").withColumnRenamed("confidence", "gate_confidence"), "query_id", "left")
    out = out.join(sure.select("query_id", F.col("score").alias("retrieval_score")), "query_id", "left")
    out = out.join(bodies.select("query_id", "text", "confidence", "citations", "inline_citations", "input_tokens", "output_tokens"), "query_id", "left")
    out = out.join(listed(evidence, "evidence_no", "evidence_ids"), "query_id", "left").join(listed(kept, "place", "evidence_used"), "query_id", "left")
    scope = F.create_map(*(F.lit(x) for pair in SCOPE.items() for x in pair))
    why = F.when(F.col("status") == "invalid", F.concat(F.lit("Invalid query: "), "reason")).when(F.col("status") == "unsafe", UNSAFE).when(F.col("status") == "out_of_scope", scope[F.col("reason")])
    refused = F.coalesce(~F.col("ok"), F.lit(True))
    out = out.withColumns({"refused": refused, "answer": F.when(refused, A.refusal(F.coalesce(why, "gate_reason", F.lit("No relevant evidence was retrieved.")))).otherwise(F.col("text")), "prompt_version": F.when(~refused, A.PROMPT_VERSION)})
    names = {"tickers": F.col("companies"), "years": F.col("years"), "quarters": F.col("quarters"), "fiscal_periods": F.col("fiscal_periods"), "forms": F.col("forms")}
    return Answers(out.withColumn("filter", Q.describe(names)), kept, A.map_citations(bodies, kept))


def variants(asked: DataFrame, corpus: Corpus, scorer=None, s: Settings = SETTINGS) -> DataFrame:
    """(query_id, mode, rank, chunk_id, score): bm25, vector, hybrid and hybrid+rerank, without
    expansion, boosts or fan-out."""
    plain = asked.withColumn("expanded", F.col("question")).withColumn("mode", F.lit("global"))
    vec, bm = hybrid_search(plain, corpus, s)
    named = {"bm25": bm, "vector": vec}
    lists = {k: v for k, v in named.items() if v is not None}
    fused = reciprocal_rank_fusion([v for v in (vec, bm) if v is not None], s.rrf_k, s.candidate_pool)
    texts = corpus.chunks.select("chunk_id", "text")
    again = rerank(fused.join(texts, "chunk_id").join(sized(asked.select("query_id", "question")), "query_id"), scorer)
    lists |= {"hybrid": fused, "hybrid+rerank": again}
    out = None
    for name, rows in lists.items():
        one = rows.select("query_id", F.lit(name).alias("mode"), "rank", "chunk_id", "score")
        out = one if out is None else out.unionByName(one)
    return out
