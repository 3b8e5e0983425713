"""Quality by compression: zstandard dictionaries of good and bad labelled text.

A text is compressed with a dictionary trained on good texts and with one trained on bad
texts. The difference of the two sizes over the larger of them says which it is more like.
This normalised difference, the mean over pairs of dictionaries of several sizes, is all
that a score is made of: a logistic curve over it (with knots, and slopes by the text's
size, since the difference of a short text says less) turns it into a probability. Whole
texts are compressed.

Fitting uses a bounded sample: at most ``sample`` labelled rows (held-out rows never). Of
their texts up to ``dict_bytes`` a class train the dictionaries; of a text longer than
TEXT_BYTES that many bytes do, in pieces spaced evenly over all of it. Differences for the
curve are cross-fitted: a text is compressed with dictionaries that were trained without
its fold of FOLDS, so no text is judged by a dictionary that holds it. Scoring is one pass
without a shuffle; each task holds the dictionaries.

Edge cases: null and empty texts are scored as empty; without labels of both classes every
score is the smoothed share of label 1; null ids are scored and count as not held out; of
several labels of an id the larger counts, and of several texts of a labelled id the least
is learned from; equal rows are scored alike. Only the id, text and label columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm.calibrate import Logistic, held_out, labelled, training_ids
from filigree.llm.words import frugal, raw, slices
from filigree.session import ship_package, table

LEVEL = 3
DICT_SIZES = (16 << 10, 32 << 10, 64 << 10)
PIECE, TEXT_BYTES = 2048, 65536
FOLDS = 4
QUANTILES = (0.02, 0.05, 0.1, 0.15, 0.25, 0.5)

#: Dictionaries of good and of bad text, one pair for each of DICT_SIZES.
Pairs = list[tuple[bytes, bytes]]


def train_dictionary(texts: list[bytes], size: int) -> bytes:
    """A dictionary from pieces of texts; raw content where there is too little to train on."""
    import zstandard

    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


def train_pairs(good: list[bytes], bad: list[bytes]) -> Pairs:
    return [(train_dictionary(good, size), train_dictionary(bad, size)) for size in DICT_SIZES]


class Compressors:
    """The normalised difference of a text's sizes under pairs of dictionaries."""

    def __init__(self, pairs: Pairs) -> None:
        import zstandard

        def made(data: bytes):
            own = zstandard.ZstdCompressionDict(data) if data else None
            if own is not None:
                own.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_dict_id=False)

        self.pairs = [(made(good), made(bad)) for good, bad in pairs]

    def difference(self, text: bytes) -> float:
        """Above 0 if bad text's dictionaries serve the text better."""
        total = 0.0
        for good, bad in self.pairs:
            a, b = len(good.compress(text)), len(bad.compress(text))
            total += (a - b) / max(a, b)
        return total / len(self.pairs)


class Curve:
    """A probability from the difference; the size only sets how steep it is."""

    def __init__(self, ridge: float = 1.0) -> None:
        self.logistic = Logistic(ridge)
        self.knots = np.zeros(len(QUANTILES))

    def _features(self, difference: np.ndarray, size: np.ndarray) -> np.ndarray:
        over = [np.maximum(difference - k, 0) for k in self.knots]
        scale = np.log(size + 1.0)
        return np.c_[(difference, *over, difference * scale, *(x * scale for x in over[1::2]))]

    def fit(self, difference: np.ndarray, size: np.ndarray, y: np.ndarray) -> Curve:
        if len(difference):
            self.knots = np.quantile(difference, QUANTILES)
        self.logistic.fit(self._features(difference, size), y)
        return self

    def __call__(self, difference: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.logistic(self._features(difference, size))


def differences(rows: DataFrame, folds: list[Pairs]) -> DataFrame:
    """(id, y, difference, size) of rows (id, y, fold, text), each under the pairs of its fold."""
    shared = rows.sparkSession.sparkContext.broadcast(folds)  # pairs of DICT_SIZES bytes

    def run(batches):
        own = [Compressors(pairs) for pairs in shared.value]
        for batch in batches:
            for part in slices(batch, 3):
                data, at = raw(part.column(3))
                data = data.tobytes()
                found = [own[f].difference(data[at[i] : at[i + 1]]) for i, f in enumerate(part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.float64()), pa.array(np.diff(at))], ["id", "y", "difference", "size"])

    return rows.mapInArrow(frugal(run), "id long, y int, difference double, size long")


def _for_dictionaries(rows: DataFrame, dict_bytes: int) -> list[tuple[int, int, int, bytes]]:
    """(id, class, fold, text) of what trains the dictionaries: about dict_bytes a class."""
    sizes = rows.select("id", "y", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), "fold").orderBy(F.xxhash64("id"), "id").collect()
    room = {0: dict_bytes, 1: dict_bytes}
    chosen = []
    for r in sizes:
        n = min(r.n, TEXT_BYTES)
        if 0 < n <= room[r.y]:
            room[r.y] -= n
            chosen.append((r.id,))
    spark = rows.sparkSession
    count = TEXT_BYTES // PIECE
    text = F.col("text")
    spaced = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.substring(text, (1 + F.floor(i * (F.length(text) - PIECE) / (count - 1))).cast("int"), F.lit(PIECE)))
    short = F.when(F.length(text) > TEXT_BYTES, F.array_join(spaced, "")).otherwise(text)
    wanted = rows.join(F.broadcast(spark.createDataFrame(chosen, "id long")), "id").select("id", "y", "fold", short.alias("text"))
    return sorted((r.id, r.y, r.fold, r.text.encode()) for r in wanted.collect())


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 4000, dict_bytes: int = 3 << 20) -> tuple[Pairs, Curve]:
    """Dictionaries of good and bad text and the calibration; docs has columns id and text."""
    pairs = training_ids(labels, label, sample)
    if len({v for _, v in pairs}) < 2:
        return train_pairs([], []), Curve().fit(np.empty(0), np.empty(0), np.array([v for _, v in pairs], float))
    fold = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    rows = labelled(docs, pairs).select("id", "y", fold.alias("fold"), "text")
    texts = _for_dictionaries(rows, dict_bytes)

    def trained(without: int | None) -> Pairs:
        own = [(y, t) for _, y, f, t in texts if f != without]
        return train_pairs([t for y, t in own if y], [t for y, t in own if not y])

    found = sorted(differences(rows, [trained(k) for k in range(FOLDS)]).collect())
    x = np.array([(r.difference, r.size) for r in found], float).reshape(-1, 2)
    return trained(None), Curve().fit(x[:, 0], x[:, 1], np.array([r.y for r in found], float))


def score(docs: DataFrame, model: tuple[Pairs, Curve]) -> DataFrame:
    """doc_id, score for each row of docs (columns id and text)."""
    pairs, curve = model

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(curve(batch.column(2).to_numpy(), batch.column(3).to_numpy().astype(float)))], ["doc_id", "score"])

    zero = F.lit(0)
    return differences(docs.select("id", zero.alias("y"), zero.alias("fold"), "text"), [pairs]).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", sample: int = 4000) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    ship_package(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = score(docs, fit(docs, labels, label, sample))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
