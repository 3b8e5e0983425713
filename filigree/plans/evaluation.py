"""Evaluation of golden cases as one set-wise run."""

from __future__ import annotations

from time import perf_counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.config import SETTINGS, Settings
from filigree.functions import questions as Q
from filigree.operators import metrics as M
from filigree.plans.online import Answers, Corpus, answer, quoting_generator, variants
from filigree.session import shared_table
from filigree.sources.logs import previous_report


def evaluate(cases: DataFrame, corpus: Corpus, k: int = 8, generator=quoting_generator, scorer=None, s: Settings = SETTINGS) -> tuple[DataFrame, DataFrame, Answers]:
    """Case metrics, A/B means by mode, and the answers.

    Cases that expect a refusal are scored by the refusal alone; the others by retrieval and
    citations, and their strategies against a pool.
    """
    asked = cases.select(F.col("case_id").alias("query_id"), "question")
    got = answer(asked, corpus, generator, scorer, s)
    expects = F.coalesce("expect_refusal", F.lit(False))
    plain = cases.where(~expects)
    ranked = got.evidence.select(F.col("query_id").alias("case_id"), F.lit("answer").alias("mode"), F.col("evidence_no").alias("rank"), "chunk_id", "ticker", "year", "form", "section", "section_signals", *Q_FLAGS).join(plain.select("case_id"), "case_id", "left_semi")
    judged = M.relevance(ranked, plain)
    per = M.metrics_at_k(judged, k).drop("mode", "found")
    ground, cover = M.citation_scores(F.col("citations"), F.coalesce("evidence_used", F.array().cast("array<string>")))
    cited = got.results.select(F.col("query_id").alias("case_id"), "refused", ground.alias("groundedness"), cover.alias("coverage"))
    rows = cases.select("case_id", expects.alias("expect_refusal")).join(cited, "case_id", "left").join(per, "case_id", "left").join(M.company_recall(ranked, plain), "case_id", "left")
    keep = lambda c: F.when(~F.col("expect_refusal"), F.coalesce(c, F.lit(0.0)))
    rows = rows.select("case_id", (F.col("refused") == F.col("expect_refusal")).cast("double").alias("refusal_correct"), *(keep(F.col(c)).alias(c) for c in ("precision", "hit", "mrr", "ndcg", "company_recall", "groundedness", "coverage")))
    understood = shared_table(Q.understand(plain.select(F.col("case_id").alias("query_id"), "question")), "questions")
    ab = shared_table(variants(understood, corpus, scorer, s), "variants").withColumnRenamed("query_id", "case_id")
    ab = M.relevance(ab.join(corpus.chunks.select("chunk_id", "ticker", "year", "form", "section", "section_signals", *Q_FLAGS), "chunk_id"), plain)
    scores = M.metrics_at_k(ab, k).join(M.pooled_recall(ab, k), ["case_id", "mode"])
    return rows, M.mode_means(scores.select("case_id", "mode", "precision", "recall", "mrr", "ndcg")), got


def run_evaluation(cases: DataFrame, corpus: Corpus, path: str, part: int = 50, k: int = 8, generator=quoting_generator, scorer=None, s: Settings = SETTINGS, title: str = "Evaluation") -> dict[str, DataFrame]:
    """Evaluate cases in parts of about `part`, each written when it is done, and write the report.

    A run that was broken off goes on with the parts that are missing. latency_s of a case is
    its part's time over its cases. Tables: summary (metric, value), modes, cases; the report
    has them too, with the change against the summary that an earlier run left at `path`.
    """
    spark = cases.sparkSession
    before = previous_report(spark, f"{path}/summary")
    parts = max(1, -(-cases.count() // part))
    numbered = cases.withColumn("_part", F.pmod(F.xxhash64("case_id"), F.lit(parts)))
    for number in range(parts):
        at = f"{path}/parts/{number}"
        if _there(spark, f"{at}/modes/_SUCCESS"):
            continue
        own = numbered.where(F.col("_part") == number).drop("_part")
        n = own.count()
        if not n:
            continue
        began = perf_counter()
        rows, modes, _ = evaluate(own, corpus, k, generator, scorer, s)
        rows = shared_table(rows, "case-scores")
        latency = (perf_counter() - began) / n
        rows.withColumn("latency_s", F.lit(latency)).write.mode("overwrite").parquet(f"{at}/cases")
        modes.write.mode("overwrite").parquet(f"{at}/modes")
    done = [n for n in range(parts) if _there(spark, f"{path}/parts/{n}/modes/_SUCCESS")]
    rows = spark.read.parquet(*(f"{path}/parts/{n}/cases" for n in done))
    modes = spark.read.parquet(*(f"{path}/parts/{n}/modes" for n in done))
    names = [c for c in modes.columns if c not in ("mode", "n_cases")]
    modes = modes.groupBy("mode").agg(*(F.round(F.sum(F.col(c) * F.col("n_cases")) / F.sum("n_cases"), 4).alias(c) for c in names), F.sum("n_cases").alias("n_cases"))
    summary = shared_table(M.summary(rows.drop("case_id")).unionByName(M.flatten_modes(modes)), "summary")
    tables = {"summary": summary, "modes": modes, "cases": rows}
    if before is not None:
        tables["changes"] = shared_table(M.regressions(summary, before), "changes")
    M.write_report(spark, path, title, tables)
    summary.write.mode("overwrite").json(f"{path}/summary")
    return tables


def _there(spark, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


Q_FLAGS = ("has_risk_heading", "has_mda_heading", "has_legal_heading", "has_business_heading", "has_financial_table", "has_revenue_table", "metadata_quality")
