"""A vector table with keyed upsert. Rows of a document that is written again are replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.session import shared_table

SCHEMA = "model string, chunk_id string, doc_id string, embedding array<float>"


class VectorTable:
    """A Parquet table in buckets by document; an upsert writes a new version of the buckets it touches.

    Every bucket is read in its newest finished version. A bucket that is touched holds rows
    of the upsert, so no version of it is empty.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def _list(self, path: str) -> list[str]:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [x.getPath().getName() for x in fs.listStatus(target)] if fs.exists(target) else []

    def versions(self) -> dict[int, list[int]]:
        """The buckets of each finished version."""
        out = {}
        for name in self._list(self.path):
            inside = self._list(f"{self.path}/{name}") if name.startswith("v") else []
            if "_SUCCESS" in inside:
                out[int(name[1:])] = [int(x.removeprefix("bucket=")) for x in inside if x.startswith("bucket=")]
        return out

    def version(self) -> int:
        return max(self.versions(), default=-1)

    def read(self, only: set[int] | None = None) -> DataFrame:
        newest = {b: v for v, buckets in sorted(self.versions().items()) for b in buckets if only is None or b in only}
        paths = [f"{self.path}/v{v}/bucket={b}" for b, v in sorted(newest.items())]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def upsert(self, rows: DataFrame) -> None:
        """Replace all vectors of the documents in rows (model, chunk_id, doc_id, embedding)."""
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")
        rows = shared_table(rows.select("model", "chunk_id", "doc_id", "embedding", bucket.alias("bucket")), "upsert")
        touched = {r.bucket for r in rows.select("bucket").distinct().collect()}  # at most `buckets`
        if not touched:
            return
        kept = self.read(touched).join(rows.select("model", "doc_id").distinct(), ["model", "doc_id"], "left_anti")
        kept = kept.select("model", "chunk_id", "doc_id", "embedding", bucket.alias("bucket"))
        kept.unionByName(rows).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{self.version() + 1}")

    def count(self) -> int:
        return self.read().count()

    def get(self, ids: DataFrame) -> DataFrame:
        return self.read().join(ids.select(F.col("chunk_id")), "chunk_id", "left_semi")


def index_join(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors with their chunks' text; a vector without a chunk stops the job."""
    joined = vectors.join(chunks.withColumn("_there", F.lit(True)), "chunk_id", "left")
    return joined.withColumn("_ok", F.assert_true(F.coalesce("_there", F.lit(False)), F.concat(F.lit("no chunk for "), "chunk_id"))).where("_ok is null").drop("_there", "_ok")


def hydrate(ranked: DataFrame, *stores: DataFrame) -> DataFrame:
    """ranked with the text of chunk_id from the first store that has it."""
    out = ranked
    names = []
    for k, store in enumerate(stores):
        out = out.join(store.select("chunk_id", F.col("text").alias(f"_t{k}")), "chunk_id", "left")
        names.append(f"_t{k}")
    own = [F.nullif("text", F.lit(""))] if "text" in ranked.columns else []
    return out.withColumn("text", F.coalesce(*own, *names, F.lit(""))).drop(*names)
