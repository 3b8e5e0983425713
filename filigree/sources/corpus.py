"""Corpus scans and stage tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree import fixed


def check_token(token: str, name: str = "name") -> str:
    """A path part that stays where it is put."""
    if not token or "/" in token or "\\" in token or ".." in token:
        raise ValueError(f"unsafe {name}: {token!r}")
    return token


def manifest_files(spark: SparkSession, corpus: str) -> DataFrame:
    """(pos, file) of the files listed in the manifest, in its order."""
    manifest = spark.read.schema("files array<string>").option("multiLine", True).json(f"{corpus}/manifest.json")
    return manifest.select(F.posexplode("files").alias("pos", "file"))


def ingest(spark: SparkSession, corpus: str, prior: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Filings and dead letters of a corpus.

    Filings: doc_id, filename, raw, sha256, size, status, changed (new or other content than in
    the prior catalog). Dead letters: file and the first reason that holds.
    """
    listed = manifest_files(spark, corpus).withColumn("named", F.col("file").rlike(fixed.FILE_NAME))
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(corpus)
    there = there.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    joined = listed.join(there, "file", "left")
    text = F.col("content").cast("string")
    reason = F.when(~F.col("named"), "invalid filename").when(F.col("content").isNull(), "missing file").when(~F.is_valid_utf8(text), "not valid UTF-8")
    joined = joined.withColumn("reason", reason)
    dead = joined.where("reason is not null").select("file", "reason")
    good = joined.where("reason is null").select(F.regexp_replace("file", re.escape(fixed.FILE_SUFFIX) + "$", "").alias("doc_id"), F.col("file").alias("filename"), F.regexp_replace(text, "\r\n?", "\n").alias("raw"))
    good = good.withColumns({"sha256": F.sha2("raw", 256), "size": F.length("raw"), "status": F.lit("ok")})
    return changed(good, prior), dead


def changed(docs: DataFrame, prior: DataFrame | None) -> DataFrame:
    """docs (doc_id, sha256) with changed: not in the prior catalog, or with another hash."""
    if prior is None:
        return docs.withColumn("changed", F.lit(True))
    before = prior.select("doc_id", F.col("sha256").alias("_before"))
    return docs.join(before, "doc_id", "left").withColumn("changed", ~F.col("sha256").eqNullSafe(F.col("_before"))).drop("_before")


def write_stage(df: DataFrame, base: str, stage: str, partition_by: str | None = None) -> str:
    """One Parquet table for each stage, replaced as a whole."""
    path = f"{base}/{check_token(stage, 'stage')}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return path


def read_stage(spark: SparkSession, base: str, stage: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{check_token(stage, 'stage')}")


def stage_ids(stage: DataFrame) -> DataFrame:
    """Sorted ids of a stage without those that begin with an underscore."""
    return stage.select("doc_id").distinct().where(~F.col("doc_id").startswith("_")).orderBy("doc_id")


def only_tickers(chunks: DataFrame, tickers: list[str]) -> DataFrame:
    """Chunks of some issuers; a partition filter where the table is partitioned by ticker."""
    return chunks.where(F.col("ticker").isin(tickers))
