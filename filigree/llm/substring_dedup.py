"""Substring deduplication: repeated fixed-length word windows become removal intervals.

Method: Rabin-Karp hashes of every window of ``size`` words; windows are counted in Spark
by hash (smallest and largest document of each), and the repeated ones merge into maximal
intervals. A window goes if it also starts in a document with a smaller id, judged on the
input.

What keeps the shuffles small: equal windows have the same *anchor*, the least hash among
their half-windows. Anchors are a fourteenth of the windows; those found in one document
only rule out all windows around them. Repeated anchors go into a Bloom filter of bounded
size (``filter_bytes``); only windows it lets through are counted. A false hit costs a row
and never changes a result. In the same way only documents that may have something to
remove are joined with their intervals; the others are finished where they are read.

Hot windows: counts are combined before each shuffle, and the join of windows with their
first documents is between two plain exchanges, which adaptive execution can split.

Edge cases: null text has no words; a null id never removes and is never cut; documents
shorter than a window are kept; rows that repeat an id are judged apart (by id and text)
and never count against each other. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm import bloom
from filigree.llm.words import WINDOW_BASES, Words, frugal, mix, ramps, signed, slices, sliding_min, windows
from filigree.session import shared_table, ship_package, table


def _anchors(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The words where windows start, and each window's anchor."""
    starts = words.window_starts(size)
    half = size // 2
    least = sliding_min(windows(words.hashes, half), size - half + 1)
    return starts, least[starts] if len(starts) else least[:0]


def repeated_anchors(docs: DataFrame, size: int) -> DataFrame:
    """Anchors found in two or more documents, as one bigint column."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                words = Words(part.column(1))
                starts, anchor = _anchors(words, size)
                doc = part.column(0).to_numpy()[words.rows()[starts]] if len(starts) else np.empty(0, np.int64)
                new = np.ones(len(anchor), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                anchor, doc = anchor[new], doc[new]
                order = np.lexsort((doc, anchor))
                anchor, doc = anchor[order], doc[order]
                first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.empty(0, np.int64)
                last = np.r_[first[1:], len(anchor)] - 1 if len(first) else first
                yield pa.RecordBatch.from_arrays([pa.array(signed(anchor[first])), pa.array(doc[first]), pa.array(doc[last])], ["anchor", "low", "high"])

    counted = docs.select("doc", "text").mapInArrow(frugal(run), "anchor long, low long, high long")
    counted = counted.groupBy("anchor").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return counted.where("low < high").select("anchor")


def candidate_windows(docs: DataFrame, size: int, anchors) -> DataFrame:
    """Windows whose anchor may be repeated: two hashes, document, row key and first word."""

    def run(batches):
        keep = anchors.value
        for batch in batches:
            for part in slices(batch, 1):
                words = Words(part.column(1))
                starts, anchor = _anchors(words, size)
                if not len(starts):
                    continue
                new = np.r_[True, anchor[1:] != anchor[:-1]]
                runs = np.flatnonzero(new)
                ok = np.repeat(keep.has(anchor[runs]), np.diff(np.r_[runs, len(anchor)]))
                starts = starts[ok]
                if not len(starts):
                    continue
                row = words.rows()[starts]
                h1 = words.windows(size)[starts]
                h2 = words.windows(size, WINDOW_BASES[1])[starts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(h1)),
                        pa.array((h2 >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        pa.array(part.column(0).to_numpy()[row]),
                        pa.array(part.column(2).to_numpy()[row]),
                        pa.array((starts - words.at[row]).astype(np.int32)),
                    ],
                    ["h1", "h2", "doc", "key", "at"],
                )

    return docs.select("doc", "text", "key").mapInArrow(frugal(run), "h1 long, h2 int, doc long, key int, at int")


def intervals(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals [start, end) of words covered by windows starting at `at`."""
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.unique(np.asarray(at, np.int64))
    opens = np.flatnonzero(np.r_[True, at[1:] > at[:-1] + size])
    return at[opens], at[np.r_[opens[1:], len(at)] - 1] + size


def _cut(size: int, with_text: bool):
    """A function for mapInArrow over (doc, text, key, starts of windows that go)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                words = Words(part.column(1))
                ats = part.column(3) if part.num_columns > 3 else None
                n, removed, sha, texts, spans = [], [], [], [], []
                data = words.data.tobytes()
                for i in range(part.num_rows):
                    a, b = int(words.at[i]), int(words.at[i + 1])
                    at = ats[i].values.to_numpy(zero_copy_only=False) if ats is not None and ats[i].is_valid else ()
                    low, high = intervals(at, size)
                    own = data[words.bytes_at[i] : words.bytes_at[i + 1]].split()
                    kept, to = [], 0
                    for s, e in zip(low, high):
                        kept += own[to:s]
                        to = e
                    text = b" ".join(kept + own[to:])
                    n.append(b - a)
                    removed.append(int((high - low).sum()))
                    sha.append(hashlib.sha256(text).hexdigest())
                    spans.append([[int(x), int(y)] for x, y in zip(low, high)])
                    texts.append(text.decode() if with_text else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(texts, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "removed", "kept_text"],
                )

    return run


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<array<long>>, kept_text string"


def remove_repeats(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = 32 << 20, with_text: bool = True) -> DataFrame:
    """Each document with its removal intervals (word numbers) and the text that is left.

    Returns doc_id, n_words, n_removed, kept_sha256, removed (pairs [start, end)), and
    kept_text (null unless with_text).
    """
    if size < 2:
        raise ValueError("a window has two words at least")
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("key", F.hash("text"))
    whole = docs.where("doc is not null")
    anchors = shared_table(repeated_anchors(whole, size), "anchors")
    found = spark.sparkContext.broadcast(bloom.build(anchors, anchors.count(), filter_bytes))
    rows = candidate_windows(whole, size, found)
    first = rows.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("h1", "h2", "first")
    first = shared_table(first, "windows")
    gone = rows.join(first.hint("shuffle_merge"), ["h1", "h2"]).where("doc > first").select("doc", "key", "at")
    gone = shared_table(gone.groupBy("doc", "key").agg(F.collect_list("at").alias("ats")), "removals")
    ids = gone.select("doc").distinct()
    cut = spark.sparkContext.broadcast(bloom.build(ids, ids.count(), filter_bytes))

    def side(inside: bool):
        def run(batches):
            for batch in batches:
                has = cut.value.has(batch.column(0).fill_null(0).to_numpy().view(np.uint64))
                has &= ~batch.column(0).is_null().to_numpy(zero_copy_only=False)
                part = batch.filter(pa.array(has if inside else ~has))
                if part.num_rows:
                    yield from (_cut(size, with_text)([part]) if not inside else [part])

        return run

    untouched = docs.mapInArrow(frugal(side(False)), SCHEMA)
    touched = docs.mapInArrow(frugal(side(True)), docs.schema).join(gone.hint("shuffle_merge"), ["doc", "key"], "left")
    touched = touched.select("doc", "text", "key", "ats").mapInArrow(frugal(_cut(size, with_text)), SCHEMA)
    return untouched.unionByName(touched)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


#: The whole operator in SQL: windows as joined words, told apart by their text.
OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), g AS (
  SELECT doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) AS win
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 49)) AS i FROM w WHERE len(words) >= 50)
), f AS (
  SELECT win, min(doc_id) AS first FROM g GROUP BY win HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT g.doc_id, g.i + k.k AS i
  FROM g JOIN f ON g.win = f.win AND g.doc_id > f.first CROSS JOIN (SELECT unnest(generate_series(0, 49)) AS k) k
), e AS (
  SELECT doc_id, i, words[i] AS word
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words))) AS i FROM w)
), k AS (
  SELECT e.doc_id, count(gone.i) AS n_removed,
         string_agg(e.word, ' ' ORDER BY e.i) FILTER (WHERE gone.i IS NULL) AS kept
  FROM e LEFT JOIN gone ON e.doc_id = gone.doc_id AND e.i = gone.i GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
