"""The offline build: raw filings to chunks, vectors and an inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.config import SETTINGS, Settings
from filigree.functions.metadata import build_metadata
from filigree.functions.text import clean
from filigree.operators.chunking import chunks
from filigree.operators.resolution import enrich, resolve
from filigree.operators.search import Bm25Index, build_bm25, embed_with_cache
from filigree.operators.sections import sections


def cleaned(filings: DataFrame) -> DataFrame:
    """(doc_id, text, raw_chars, cleaned_chars)."""
    return filings.select("doc_id", clean(F.col("raw")).alias("text"), F.length("raw").alias("raw_chars")).withColumn("cleaned_chars", F.length("text"))


def prepare(filings: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Chunks of filings (doc_id, raw) with metadata, resolved sections and embed_text."""
    texts = cleaned(filings)
    meta = build_metadata(filings)
    spans = sections(texts.join(meta.select("doc_id", "form"), "doc_id"))
    parts = chunks(texts, spans, s.chunk_max_chars, s.chunk_overlap).withColumn("section_original", F.lit(""))
    return enrich(resolve(parts.join(meta, "doc_id"))).withColumn("chunk_id", F.col("id"))


def index(chunk_rows: DataFrame, embedder, model: str = SETTINGS.embedding_model, cache: DataFrame | None = None) -> tuple[Bm25Index, DataFrame, DataFrame]:
    """The BM25 index over all chunks, vectors with metadata, and new cache rows."""
    spark = chunk_rows.sparkSession
    cache = spark.createDataFrame([], "key string, embedding array<float>") if cache is None else cache
    vectors, gained = embed_with_cache(chunk_rows, cache, embedder, model)
    return build_bm25(chunk_rows), vectors, gained


def stage_report(*stages: tuple[str, DataFrame, DataFrame]) -> DataFrame:
    """(stage, status, n) from (name, ids that went in, ids that came out)."""
    out = None
    for name, went, came in stages:
        done = went.select("doc_id").join(came.select("doc_id").distinct().withColumn("_d", F.lit(True)), "doc_id", "left")
        rows = done.groupBy(F.when(F.col("_d"), "ok").otherwise("failed").alias("status")).agg(F.count("*").alias("n")).withColumn("stage", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out.select("stage", "status", "n")
