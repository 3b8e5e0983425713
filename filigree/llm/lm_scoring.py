"""Language-model scores from log-frequency Bloom filters of quantised n-gram counts.

Training counts words, word pairs and triples (with start and end marks) of every training
text; no n-gram is left out, whatever its count. A log-frequency Bloom filter holds pairs
and triples: a count c has the level 1 + floor(log(c) / log(STEP)) (1, 2 and 3 have levels of
their own), and an n-gram of level q is put in as (n-gram, 1) to (n-gram, q). Repeated
membership probes, level after level until one fails, give the level back, and the middle of
the counts of that level stands for the count. A failed probe is certain; a false one lifts
a level with probability 0.1 %. Word counts are exact.

The filter grows with the corpus, so it has no size that could be proven small enough to be
broadcast whole. It is cut into shards by the n-grams' hash, whose number grows with the
texts, and a shard is sent no further than the one task that builds it: texts are read in
slices, a slice sends its distinct n-grams, with their counts in its training texts, to the
shards; a shard's task adds up, builds the filter, probes it for every slice and answers with
levels; a slice meets its answers and its texts again and is scored. Nothing that grows with
the input is broadcast or reaches the driver. Texts are read twice in the same order: a
slice whose answers are not those of its own n-grams is an error.

The model backs a triple with its pair and a pair with its word (hierarchical Dirichlet
smoothing): p1 = (c(w) + 1) / (N + V + 1), p2 = (c(vw) + PAIR * p1) / (c(v) + PAIR),
p3 = (c(uvw) + TRIPLE * p2) / (c(uv) + TRIPLE). The score sums log10 p3 over a text's tokens.

Edge cases: null and empty texts are the end mark alone; a null id is trained on, and is not
held out; without training texts every count is 0; equal rows count twice in training and
are scored alike; very long texts are scored whole, a slice of their own; no rows, no result.
Columns other than id and text are not read.
"""

from __future__ import annotations

from zlib import compress, crc32, decompress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm.bloom import home
from filigree.llm.words import U, Words, frugal, mix, release, signed, slices
from filigree.session import shared_table, ship_package, table

END, START, BEGIN = U(0x1F83D9ABFB41BD6B), U(0x5BE0CD19137E2179), U(0x3C6EF372FE94F82B)
_SALT, _LEFT, _RIGHT = U(0x9AE16A3B2F90404F), U(0xC949C7DEFA1B9E35), U(0xFF51AFD7ED558CCD)
SLICE = 8 << 20
#: Bytes of text whose n-grams make about one shard.
SHARD = 6 << 20
STEP = 1.5
BITS, PROBES = 16, 6
PAIR, TRIPLE = 300.0, 5.0


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all rows (each row ends with END), their contexts and row offsets."""
    words = Words(texts, lower=True)
    n = words.counts + 1
    at = np.r_[0, np.cumsum(n)]
    token = np.full(at[-1], END, np.uint64)
    inner = np.ones(at[-1], bool)
    inner[at[1:] - 1] = False
    token[inner] = words.hashes
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[at[:-1]] = START
    return token, context, at


def word_key(token: np.ndarray) -> np.ndarray:
    return mix(token ^ _SALT)


def pair_key(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(context * _LEFT + token * _RIGHT)


class Ngrams:
    """The distinct n-grams of the rows of a slice, and how tokens and n-grams refer to each other.

    words: keys of the distinct words and, last, of START; longer: keys of the distinct pairs,
    then of the distinct triples; word, pair and triple: of each token its place among its kind.
    """

    def __init__(self, texts: pa.Array) -> None:
        token, context, self.at = tokens(texts)
        first = self.at[:-1]
        own, self.word = np.unique(token, return_inverse=True)
        self.words = word_key(np.r_[own, START])
        before = np.r_[len(own), self.word[:-1]]
        before[first] = len(own)
        pairs, at_pair, self.pair = np.unique(pair_key(context, token), return_index=True, return_inverse=True)
        key = pairs[self.pair]
        history = np.r_[BEGIN, key[:-1]]
        history[first] = BEGIN
        triples, at_triple, self.triple = np.unique(pair_key(history, token), return_index=True, return_inverse=True)
        self.longer = np.r_[pairs, triples]
        self.pairs = len(pairs)
        # Of each distinct pair its words, of each distinct triple its last and its first pair.
        self.pair_word, self.pair_context = self.word[at_pair], before[at_pair]
        self.triple_pair = self.pair[at_triple]
        starts = np.zeros(len(token), bool)
        starts[first] = True
        self.triple_opens = starts[at_triple]
        self.triple_history = np.where(self.triple_opens, 0, self.pair[np.maximum(at_triple - 1, 0)])

    def counts(self, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often the words and the longer n-grams stand in the rows that are trained on."""
        of = np.repeat(trained, np.diff(self.at)).astype(float)
        words = np.r_[np.bincount(self.word, of, len(self.words) - 1), trained.sum()]
        longer = np.r_[np.bincount(self.pair, of, self.pairs), np.bincount(self.triple, of, len(self.longer) - self.pairs)]
        return words.astype(np.int64), longer.astype(np.int64)


# --- the filter ----------------------------------------------------------------------------


def levels(count: np.ndarray) -> np.ndarray:
    """The level of each count; 0 for a count of 0."""
    bounds = [STEP**k for k in range(110)]
    return np.searchsorted(np.ceil(bounds[1:]), count, "right") + (count > 0)


def middles() -> np.ndarray:
    """The count that stands for each level: the mean of the least and the largest it holds."""
    least = np.ceil([STEP**k for k in range(111)])
    least[0] = 1
    return np.r_[0.0, (least[:-1] + np.maximum(least[1:] - 1, least[:-1])) / 2]


class LogFrequencyFilter:
    """A Bloom filter of (n-gram, level) entries, sized by their number."""

    def __init__(self, keys: np.ndarray, level: np.ndarray, bits: int = BITS) -> None:
        self.size = max(64, int(level.sum()) * bits)
        self.bits = np.zeros(self.size, bool)
        now = 1
        while len(keys):
            for at in self._places(keys, now):
                self.bits[at] = True
            now += 1
            stay = level >= now
            keys, level = keys[stay], level[stay]

    def _places(self, keys: np.ndarray, level: int):
        a = mix(keys ^ U(level * 0x9E3779B97F4A7C15 % 2**64))
        step = (a >> U(32)) | U(1)
        for i in range(PROBES):
            yield ((a + step * U(i)) % U(self.size)).astype(np.int64)

    def level(self, keys: np.ndarray) -> np.ndarray:
        """How many levels are found, one after the other, for each key."""
        out = np.zeros(len(keys), np.int64)
        live = np.arange(len(keys))
        now = 1
        while len(live):
            hit = np.ones(len(live), bool)
            for at in self._places(keys[live], now):
                hit &= self.bits[at]
            live = live[hit]
            out[live] = now
            now += 1
        return out


# --- slices and shards ---------------------------------------------------------------------


class Dealt:
    """Keys by shard: their order, and for each run its shard and bounds."""

    def __init__(self, keys: np.ndarray, shards: int, short: bool) -> None:
        # Within a shard 40 bits tell n-grams apart better than the filter does.
        self.own = mix(keys ^ _SALT) >> U(24) if short else keys
        shard = home(keys, shards)
        self.order = np.lexsort((self.own, shard))
        self.own, shard = self.own[self.order], shard[self.order]
        cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(keys) else np.empty(0, np.int64)
        self.shard, self.ends = shard[cuts], np.r_[cuts, len(keys)]
        self.short = short

    def runs(self):
        return zip(self.shard.tolist(), self.ends, self.ends[1:])

    def packed(self, a: int, b: int) -> bytes:
        """The keys of a run: steps between sorted keys, as planes of bytes."""
        steps = np.diff(np.r_[U(0), self.own[a:b]])
        return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, : 5 if self.short else 8].T).tobytes()

    def check(self, a: int, b: int) -> int:
        return int(np.add.reduce(self.own[a:b]).view(np.int64))


def unpacked(planes: bytes, n: int) -> np.ndarray:
    raw = np.zeros((n, 8), np.uint8)
    held = np.frombuffer(planes, np.uint8).reshape(-1, n)
    raw[:, : len(held)] = held.T
    return np.cumsum(raw.reshape(-1).view(np.uint64))


def small(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0)).tobytes()


def large(values: bytes, n: int) -> np.ndarray:
    return np.frombuffer(values, f"<u{len(values) // n}").astype(np.int64) if n else np.empty(0, np.int64)


def cut(batches):
    """(number, ids, texts) of consecutive slices; a slice's number is that of its first row."""
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        for piece in slices(batch, 1, SLICE):
            yield number, piece.column(0), piece.column(1)
            number += len(piece)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def in_held_out(ids: pa.Array) -> np.ndarray:
    """`held_out` of each id of an Arrow column."""
    return np.array([i is not None and crc32(str(i).encode()) % 7 == 2 for i in ids.to_pylist()], bool)


ANSWERS = "slice long, kind int, shard int, check long, n long, found binary, tokens long, types long"


def gathered(docs: DataFrame, shards: int, bits: int = BITS) -> DataFrame:
    """Answers to each slice: of kind 0 exact counts of its words, of kind 1 levels of its longer n-grams.

    tokens and types: training tokens and distinct training words of the shard, once in each.
    """

    def ask(batches):
        for number, ids, texts in cut(batches):
            grams = Ngrams(texts)
            rows: list[tuple] = []
            for kind, (keys, count) in enumerate(zip((grams.words, grams.longer), grams.counts(~in_held_out(ids)))):
                dealt = Dealt(keys, shards, bool(kind))
                count = count[dealt.order]
                rows += [(number, kind, shard, int(b - a), dealt.packed(a, b), small(count[a:b])) for shard, a, b in dealt.runs()]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["slice", "kind", "shard", "n", "keys", "counts"])

    start = word_key(np.array([START]))[0]

    def answer(group: pa.Table) -> pa.Table:
        n = group.column("n").to_pylist()
        asked = [unpacked(k, size) for k, size in zip(group.column("keys").to_pylist(), n)]
        checks = [int(np.add.reduce(k).view(np.int64)) for k in asked]
        own, back = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(back, np.concatenate([large(c, size) for c, size in zip(group.column("counts").to_pylist(), n)]), len(own)).astype(np.int64)
        exact = group.column("kind")[0].as_py() == 0
        types = tokens_ = 0
        if exact:
            words = total[own != start]
            tokens_, types, value = int(words.sum()), int((words > 0).sum()), total
        else:
            seen = total > 0
            value = LogFrequencyFilter(own[seen], levels(total[seen]), bits).level(own)
        ends = np.r_[0, np.cumsum(n)]
        found = [compress(small(value[back[a:b]]), 1) for a, b in zip(ends, ends[1:])]
        once = [1] + [0] * (len(n) - 1)
        out = pa.table(
            {
                "slice": group.column("slice"),
                "kind": group.column("kind"),
                "shard": group.column("shard"),
                "check": pa.array(checks, pa.int64()),
                "n": group.column("n"),
                "found": pa.array(found, pa.binary()),
                "tokens": pa.array([tokens_ * k for k in once], pa.int64()),
                "types": pa.array([types * k for k in once], pa.int64()),
            }
        )
        release()
        return out

    asked = docs.mapInArrow(frugal(ask), "slice long, kind int, shard int, n long, keys binary, counts binary")
    return asked.groupBy("kind", "shard").applyInArrow(answer, ANSWERS)


def values_of(keys: np.ndarray, shards: int, kind: int, answers: pa.Table) -> np.ndarray:
    """What the shards answered for each key of a slice."""
    dealt = Dealt(keys, shards, bool(kind))
    own = answers.filter(pa.compute.equal(answers.column("kind"), kind)).sort_by("shard")
    told = list(zip(*(own.column(c).to_pylist() for c in ("shard", "check", "n"))))
    if told != [(shard, dealt.check(a, b), b - a) for shard, a, b in dealt.runs()]:
        raise RuntimeError("the texts were read in another order than before")
    out = np.empty(len(keys), np.int64)
    for (_, a, b), found in zip(dealt.runs(), own.column("found").to_pylist()):
        out[dealt.order[a:b]] = large(decompress(found), b - a)
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pair: float = PAIR, triple: float = TRIPLE, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    shards = max(8, -(-size // SHARD))
    answers = shared_table(gathered(docs, shards, bits), "ngram-answers")
    n, v = map(int, answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first())
    unit = float(n + v + 1)
    counts = middles()

    def whole(batches):
        for number, ids, texts in cut(batches):
            one = pa.array([0, len(ids)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, texts)], ["slice", "ids", "texts"])

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        ids, text = (texts.column(k).combine_chunks().flatten() for k in ("ids", "texts"))
        grams = Ngrams(text)
        word = values_of(grams.words, shards, 0, answers)
        longer = counts[values_of(grams.longer, shards, 1, answers)]
        two, three = longer[: grams.pairs], longer[grams.pairs :]
        p1 = (word[:-1] + 1) / unit
        p2 = (two + pair * p1[grams.pair_word]) / (word[grams.pair_context] + pair)
        history = np.where(grams.triple_opens, word[-1], two[grams.triple_history])
        p3 = (np.minimum(three, history) + triple * p2[grams.triple_pair]) / (history + triple)
        rows = np.repeat(np.arange(len(ids)), np.diff(grams.at))
        columns = {
            "doc_id": ids,
            "n_tokens": pa.array(np.diff(grams.at)),
            "n_known": pa.array(np.bincount(rows, word[grams.word] > 0, len(ids)).astype(np.int64)),
            "base_score": pa.array(np.bincount(rows, np.log10(p1)[grams.word], len(ids))),
            "score": pa.array(np.bincount(rows, np.log10(p3)[grams.triple], len(ids))),
        }
        release()
        return pa.table(columns)

    texts = docs.mapInArrow(frugal(whole), "slice long, ids array<long>, texts array<string>")
    out = texts.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
