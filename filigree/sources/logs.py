"""Append-only JSON logs, golden cases and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators.answers import cost_usd

GOLDEN = "id string, question string, companies array<string>, sections array<string>, years array<int>, forms array<string>, expect_refusal boolean, expected_chunk_ids array<string>"
FEEDBACK = "timestamp timestamp, question string, rating string, citations_correct boolean, comment string, citation_correction string, retrieved_ids array<string>, evidence_used array<string>, prompt_version string"


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file or folder; blank lines are none, a malformed line stops the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, GOLDEN).withColumnRenamed("id", "case_id")


def query_log(results: DataFrame) -> DataFrame:
    """Log rows of answered questions; tokens and cost come from the generator's usage."""
    has = set(results.columns)
    names = ["query_id", "question", "intents", "companies", "years", "filter", "mode", "evidence_ids", "evidence_used", "prompt_version", "action", "status", "confidence", "latency_s"]
    tokens = [F.col(c) if c in has else F.lit(0).alias(c) for c in ("input_tokens", "output_tokens")]
    return results.select(*(c for c in names if c in has), *tokens, cost_usd(tokens[0], tokens[1]).alias("cost_usd"))


def feedback_rows(results: DataFrame, ratings: DataFrame) -> DataFrame:
    """Ratings (query_id, rating, citations_correct, comment, citation_correction) with the trace they rate."""
    found = results.select("query_id", "question", F.col("evidence_ids").alias("retrieved_ids"), "evidence_used", "prompt_version")
    return ratings.join(found, "query_id", "left").withColumn("timestamp", F.current_timestamp())


def previous_report(spark: SparkSession, path: str) -> DataFrame | None:
    """(metric, value) of an earlier run, or None where there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.schema("metric string, value double").json(path)
