"""Benchmark decontamination: BM25 over test items, searched by block-max WAND.

The inverted index holds test items; its queries are all passages of all training texts.
Passages are windows of twice the longest item with a stride of one, so that an item lies
whole in some passage. An item's score for a passage is the BM25 sum of the distinct terms
they share, over the item's sum for all its own terms: 1 if all are there. Retrieved is
every item with a score of ``threshold`` or more, exactly.

WAND asks where the sum of the terms' largest impacts can reach the threshold, and skips
what lies before that place. Here all passages of a slice of texts move through the items at
once. Items stand in blocks of BLOCK, by size, so that their impacts are alike; blocks stand
in intervals of FAN, those in larger ones, up to one interval of all items. For a term each
interval has its largest impact (the block maxima). A passage opens an interval only if its
terms' maxima there sum up to the threshold, and skips it with all its postings else; items
of the blocks that are opened are scored exactly. This goes the same way for any number of
items; only the number of levels grows, as the logarithm of the items.

Retrieved items are verified: the shares of the item's question and of its answer (the last
sentence) that stand in the passage as runs of GRAM tokens must reach ``question`` and
``answer``. Items of less than MIN_TOKENS tokens must be there whole. Items longer than
LONGEST tokens are retrieved in equal parts; shares and score are those of the whole item,
parts that are not retrieved counting nothing.

The index is sent to workers in shards of at most ``shard_tokens`` tokens, each a pass over
the texts; its maxima take at most 4 * FAN bytes a token. A document is judged within its
row: no shuffle.

Edge cases: null and empty texts match nothing; items without tokens match nothing; a null
id stays null; equal rows are reported alike, and so are equal items; without items nothing
is reported; very long texts are searched whole. Other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm.words import PUNCTUATION, U, Words, frugal, ramps, slices, windows
from filigree.session import ship_package, table

K1, B = 1.2, 0.75
BLOCK, FAN = 8, 64
GRAM = 3
LONGEST = 256
MIN_TOKENS = 5
_SENTENCE = re.compile(r"[.?!\n]+\s*(?=\S)")


def _grams(h: np.ndarray) -> np.ndarray:
    size = min(GRAM, len(h))
    return np.unique(windows(h, size)) if size else np.empty(0, np.uint64)


def _halves(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of an item's question and of its answer."""
    cuts = [m.end() for m in _SENTENCE.finditer(text)]
    cut = cuts[-1] if cuts else 0
    head, tail = (Words(pa.array([t]), True, PUNCTUATION).hashes for t in (text[:cut], text[cut:]))
    if not len(head):  # one sentence: its last third stands for the answer
        third = len(tail) // 3
        head, tail = tail[: len(tail) - third], tail[len(tail) - third :]
    return head, tail


class ItemIndex:
    """Impact-normalised BM25 postings of items or their parts, with maxima of nested intervals."""

    def __init__(self, items: list[tuple[int, str]], threshold: float) -> None:
        self.threshold = threshold
        self.number: list = []  # of each item
        self.sizes: list[tuple[int, int, int]] = []  # of each item: question grams, answer grams, tokens
        found = []  # of each part: its item's place, tokens, question grams, answer grams
        for number, text in items:
            head, tail = _halves(text)
            whole = np.r_[head, tail]
            if not len(whole):
                continue
            start, own = 0, []
            for part in np.array_split(whole, -(-len(whole) // LONGEST)):
                cut = min(max(len(head) - start, 0), len(part))
                own.append((len(self.number), part, _grams(part[:cut]), _grams(part[cut:])))
                start += len(part)
            self.number.append(number)
            self.sizes.append((sum(len(x[2]) for x in own), sum(len(x[3]) for x in own), len(whole)))
            found += own
        found.sort(key=lambda x: len(x[1]))  # blocks of like impacts
        self.item, parts = np.array([x[0] for x in found], np.int64), [x[1] for x in found]
        self.question, self.answer = [x[2] for x in found], [x[3] for x in found]
        self.size = np.array([len(p) for p in parts], np.int64)
        self.n = n = len(parts)
        self.width = int(self.size.max()) if n else 1
        own = [np.unique(p, return_counts=True) for p in parts]
        term = np.concatenate([t for t, _ in own]) if n else np.empty(0, np.uint64)
        tf = np.concatenate([c for _, c in own]).astype(float) if n else np.empty(0)
        part = np.repeat(np.arange(n), [len(t) for t, _ in own]) if n else np.empty(0, np.int64)
        self.vocabulary, term, df = np.unique(term, return_inverse=True, return_counts=True)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        length = self.size[part] / max(self.size.mean(), 1) if n else tf
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))
        impact /= np.bincount(part, impact, n)[part]
        order = np.lexsort((part, term))
        self.key, self.impact = (term * max(n, 1) + part)[order], impact[order]
        self.most = np.zeros(len(self.vocabulary))
        np.maximum.at(self.most, term, impact)
        # Levels from the blocks up; each holds the maxima of the children of its intervals.
        self.levels: list[_Level] = []
        place = part // BLOCK
        while n and (not self.levels or self.levels[-1].parents > 1):
            self.levels.append(_Level(term, place, impact))
            place = place // FAN
        # Two bytes of a token's hash tell most words that no item holds.
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.vocabulary >> U(48)).astype(np.int64)] = True

    def terms(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens that some item holds, and their numbers."""
        place = np.flatnonzero(self.seen[(token >> U(48)).astype(np.int64)])
        if not len(self.vocabulary):
            return place[:0], place[:0]
        at = np.searchsorted(self.vocabulary, token[place])
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == token[place]
        return place[known], at[known]

    def search(self, passage: np.ndarray, term: np.ndarray, n_passages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, part, score) of every pair with a score of at least the threshold.

        passage and term: the numbers of known terms in each passage; they may repeat.
        """
        limit = self.threshold - 1e-9
        terms = max(len(self.vocabulary), 1)
        # Two looks at all items as one interval: with repeated terms, then with each once.
        both = passage * terms + term
        for distinct in (False, True):
            if distinct:
                both = np.sort(both)
                both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
            p, t = both // terms, both % terms
            bound = np.bincount(p, self.most[t], n_passages)
            both = both[bound[p] >= limit]
        p, t = both // terms, both % terms
        start = np.searchsorted(p, np.arange(n_passages + 1))
        live = np.flatnonzero(np.diff(start))
        interval = np.zeros(len(live), np.int64)
        for level in reversed(self.levels):
            live, interval = level.open(live, interval, t, start, limit)
        found = [(live[:0], interval[:0], np.empty(0))]
        for a in range(0, len(live), STEP):
            own, block = live[a : a + STEP], interval[a : a + STEP]
            n = start[own + 1] - start[own]
            pair = np.repeat(np.arange(len(own)), n)
            terms = t[np.repeat(start[own], n) + ramps(n)]
            part = block[pair, None] * BLOCK + np.arange(BLOCK)
            wanted = terms[:, None] * self.n + part
            at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            score = np.where((self.key[at] == wanted) & (part < self.n), self.impact[at], 0.0)
            score = np.add.reduceat(score, np.cumsum(n) - n, axis=0)
            k, j = np.nonzero(score >= limit)
            found.append((own[k], block[k] * BLOCK + j, score[k, j]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def verify(self, part: int, tokens: np.ndarray) -> tuple[int, int]:
        """How many of the part's question and answer grams stand in a run of tokens."""
        out = []
        for own in (self.question[part], self.answer[part]):
            sizes = {min(GRAM, int(self.size[part])), 1, 2}
            out.append(max(int(np.isin(own, windows(tokens, k)).sum()) for k in sizes) if len(own) else 0)
        return out[0], out[1]


#: Pairs of a passage and an interval that are looked at together.
STEP = 2000


class _Level:
    """For each term and interval of a level the maxima of its FAN children, where not all 0."""

    def __init__(self, term: np.ndarray, child: np.ndarray, impact: np.ndarray) -> None:
        self.children = int(child.max()) + 1
        self.parents = -(-self.children // FAN)
        key, at = np.unique(term * self.parents + child // FAN, return_inverse=True)
        self.key = key
        # The last row is for terms that the interval does not hold.
        self.most = np.zeros((len(key) + 1, min(FAN, self.children)), np.float32)
        np.maximum.at(self.most, (at, child % FAN), np.nextafter(impact.astype(np.float32), np.float32(2)))

    def open(self, passage: np.ndarray, interval: np.ndarray, term: np.ndarray, start: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """The children, of intervals that passages have opened, where the terms' maxima reach the limit."""
        found = [(passage[:0], interval[:0])]
        for a in range(0, len(passage), STEP):
            own, inside = passage[a : a + STEP], interval[a : a + STEP]
            n = start[own + 1] - start[own]
            wanted = term[np.repeat(start[own], n) + ramps(n)] * self.parents + np.repeat(inside, n)
            if self.parents == 1 and len(self.key) == self.key[-1] + 1:
                at = wanted
            else:
                at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
                at = np.where(self.key[at] == wanted, at, len(self.key))
            upper = np.add.reduceat(self.most[at], np.cumsum(n) - n, axis=0)
            k, child = np.nonzero(upper >= limit - 1e-4)  # sums of 32-bit numbers
            found.append((own[k], inside[k] * FAN + child))
        return tuple(np.concatenate(x) for x in zip(*found))


def judge(index: ItemIndex, texts: pa.Array, question: float, answer: float) -> dict[tuple[int, int], tuple[float, float, float]]:
    """For (row, item): the score and the question and answer shares of items that pass."""
    words = Words(texts, True, PUNCTUATION)
    stride = index.width
    n = np.where(words.counts > 0, np.maximum(-(-words.counts // stride) - 1, 1), 0)
    row = np.repeat(np.arange(len(n)), n)
    first = words.at[row] + ramps(n) * stride
    last = np.minimum(first + 2 * stride, words.at[row + 1])
    place, term = index.terms(words.hashes)
    low, high = np.searchsorted(place, first), np.searchsorted(place, last)
    passage = np.repeat(np.arange(len(row)), high - low)
    term = term[np.repeat(low, high - low) + ramps(high - low)]
    best: dict[tuple[int, int], tuple[float, int, int, float]] = {}  # of each row and part its best passage
    for p, part, score in zip(*index.search(passage, term, len(row))):
        q, a = index.verify(int(part), words.hashes[first[p] : last[p]])
        worse = min(q / max(len(index.question[part]), 1), a / max(len(index.answer[part]), 1)) if len(index.answer[part]) and len(index.question[part]) else float(q + a)
        key = (int(row[p]), int(part))
        best[key] = max(best.get(key, (-1.0, 0, 0, 0.0)), (worse, q, a, float(score)))
    sums: dict[tuple[int, int], np.ndarray] = {}
    for (r, part), (_, q, a, score) in best.items():
        at = (r, int(index.item[part]))
        sums[at] = sums.get(at, np.zeros(3)) + (q, a, score * index.size[part])
    out: dict[tuple[int, int], tuple[float, float, float]] = {}
    for (r, k), (q, a, score) in sums.items():
        asked, answered, tokens = index.sizes[k]
        shares = q / asked if asked else 1.0, a / answered if answered else 1.0
        score = score / tokens
        whole = tokens < MIN_TOKENS
        if score >= index.threshold - 1e-9 and shares[0] >= (1.0 if whole else question) and shares[1] >= (1.0 if whole else answer):
            key = (r, index.number[k])
            out[key] = max(out.get(key, (0.0, 0.0, 0.0)), (float(score), float(shares[0]), float(shares[1])))
    return out


def shards(benchmark: DataFrame, id_col: str, text_col: str, shard_tokens: int, threshold: float) -> Iterator[ItemIndex]:
    """Indexes over all items, each of a bounded number of tokens."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    held: list[tuple[int, str]] = []
    size = 0
    for r in items.orderBy("id", "text").toLocalIterator():
        n = len(r.text.split()) + 1
        if held and size + n > shard_tokens:
            yield ItemIndex(held, threshold)
            held, size = [], 0
        held.append((r.id, r.text))
        size += n
    if held:
        yield ItemIndex(held, threshold)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, question: float = 0.5, answer: float = 0.5, shard_tokens: int = 250_000, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of each document and item found."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = None
    for index in shards(benchmark, item_id, item_text, shard_tokens, threshold):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                for part in slices(batch, 1, 2 << 20):
                    found = judge(shared.value, part.column(1), question, answer)
                    ids = part.column(0).to_pylist()
                    rows = [(ids[r], item, *shares) for (r, item), shares in sorted(found.items(), key=lambda x: (x[0][0], x[0][1] is None, x[0][1] or 0))]
                    columns = [pa.array([r[k] for r in rows], pa.int64() if k < 2 else pa.float64()) for k in range(5)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = docs.mapInArrow(frugal(run), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, question: float = 0.5, answer: float = 0.5, shard_tokens: int = 250_000, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs, all columns, without the rows that hold a test item."""
    spark = docs.sparkSession
    ship_package(spark)
    at = docs.columns.index(text_col)
    for index in shards(benchmark, item_id, item_text, shard_tokens, threshold):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                for part in slices(batch, at, 2 << 20):
                    keep = np.ones(part.num_rows, bool)
                    keep[[r for r, _ in judge(shared.value, part.column(at), question, answer)]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(frugal(run), docs.schema)
    return docs


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
