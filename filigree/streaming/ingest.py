"""Incremental ingest: new files of a landing folder become chunks and vectors batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree import fixed
from filigree.plans.offline import prepare
from filigree.session import shared_table
from filigree.sources.corpus import changed


BUCKETS = 64


def landing_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """(file, modified, doc_id, raw, sha256, reason) of files as they land; reason says why one is bad."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("modificationTime").alias("modified"), F.col("content").cast("string").alias("text"))
    reason = F.when(~F.col("file").rlike(fixed.FILE_NAME), "invalid filename").when(~F.is_valid_utf8("text"), "not valid UTF-8")
    raw = F.regexp_replace("text", "\r\n?", "\n")
    return files.select("file", "modified", F.regexp_extract("file", r"^(.*)_full\.txt$", 1).alias("doc_id"), raw.alias("raw"), F.sha2(raw, 256).alias("sha256"), reason.alias("reason"))


def start(stream: DataFrame, base: str, checkpoint: str):
    """Write each batch's chunks, dead letters and catalog under base, one folder per batch.

    A batch that is run again overwrites its own folders, so a lost driver repeats nothing.
    The catalog lies in buckets by document; a batch reads the buckets of its documents only
    and leaves out files with known content, without unbounded state. Of several versions of
    a document in a batch the last modified counts.
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            batch.where("reason is not null").select("file", "reason").write.mode("overwrite").parquet(f"{base}/dead/batch={number}")
            good = batch.where("reason is null").groupBy("doc_id").agg(F.max_by(F.struct("raw", "sha256"), F.struct("modified", "sha256")).alias("f")).select("doc_id", "f.raw", "f.sha256")
            good = good.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int"))
            known = spark.createDataFrame([], "doc_id string, sha256 string, bucket int, batch int")
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/catalog")
            if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                touched = [r.bucket for r in good.select("bucket").distinct().collect()]  # at most BUCKETS
                known = spark.read.schema("doc_id string, sha256 string, batch int, bucket int").parquet(f"{base}/catalog").where(F.col("bucket").isin(touched) & (F.col("batch") != number))
            last = known.groupBy("doc_id").agg(F.max_by("sha256", "batch").alias("sha256"))
            fresh = shared_table(changed(good, last).where("changed"), "fresh")
            prepare(fresh.select("doc_id", "raw")).write.mode("overwrite").parquet(f"{base}/chunks/batch={number}")
            fresh.select("doc_id", "sha256", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/catalog/batch={number}")
        finally:
            batch.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
