"""Toxicity from a lexicon trie met by Levenshtein automata, scored in context.

Learning (at most ``sample`` labelled rows, held-out rows never, near copies once,
written once to the shared folder): for every lower-cased word
and every word beginning of STEMS characters, Spark counts how many toxic and how many other
texts hold it. Terms whose toxic share is beyond chance (a Chernoff bound of a binomial
tail) enter the lexicon: whole words, and stems that stand for inflected forms. The lexicon
is a trie of at most ``max_terms`` entries, those of most evidence (tables here give some
hundred).

Matching: a word becomes a Levenshtein automaton of distance 1 (0 for short words), whose
states are walked along the trie, so only live prefixes are visited; stems stand for what
follows them and are met as they are. Misspelled hits weigh less. Spellings that other texts
of the sample use do not count; a term with NEIGHBOURS of them or more is common language's
neighbour and met as it is only. Words are matched once per task through a bounded cache.

Context: a hit weighs its evidence, less inside quotation marks or after a reporting word;
the densest window of WINDOW words tells abuse from mention. A logistic curve over these
sums makes the score, fitted on the same sample. Scoring is one pass without a shuffle.

Edge cases: null and empty texts are scored as having no hits; without toxic and other
labelled texts every score is the smoothed share of label 1; null ids are scored and not
held out; of several labels of an id the larger counts, and of several texts of a labelled
id the least is learned from; equal rows are scored alike; very long texts are scored whole.
Only id, text and labels are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm.calibrate import Logistic, held_out, labelled, training_ids
from filigree.llm.near_dedup import shingle_sets
from filigree.llm.words import Words, frugal, mix, signed, slices
from filigree.session import shared_table, ship_package, table

WORD = re.compile(r"\w+")
STEMS = (4, 5, 6, 7)
WINDOW = 12
FUZZY_FROM = 5
FUZZY_WEIGHT = 0.5
CACHE = 150_000
NEIGHBOURS = 3
QUOTES = re.compile("[\"“”«»„]")
#: Reporting words: a hit right after one is a mention.
REPORTING = frozenset("said says wrote writes called quoted term word phrase dijo escribió dit écrit sagte schrieb wort mot palabra".split())


class Automaton:
    """Levenshtein automaton of a word: states are sets of (position, edits), sparse rows."""

    def __init__(self, word: str, edits: int) -> None:
        self.word, self.edits = word, edits

    def start(self) -> tuple[tuple[int, int], ...]:
        return tuple((i, i) for i in range(min(self.edits, len(self.word)) + 1))

    def step(self, state: tuple[tuple[int, int], ...], char: str) -> tuple[tuple[int, int], ...]:
        """The state after reading a character of a term; empty when no term can match."""
        out: list[tuple[int, int]] = []
        if state and state[0][0] == 0 and state[0][1] < self.edits:
            out.append((0, state[0][1] + 1))
        for k, (i, cost) in enumerate(state):
            if i == len(self.word):
                break
            least = cost + (self.word[i] != char)
            if out and out[-1][0] == i:
                least = min(least, out[-1][1] + 1)
            if k + 1 < len(state) and state[k + 1][0] == i + 1:
                least = min(least, state[k + 1][1] + 1)
            if least <= self.edits:
                out.append((i + 1, least))
        return tuple(out)

    def distance(self, state: tuple[tuple[int, int], ...]) -> int | None:
        return state[-1][1] if state and state[-1][0] == len(self.word) else None


class Lexicon:
    """A trie of words and stems with evidence.

    Words of `exact` are never met misspelled; spellings of `common` are no misspellings.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float], exact: frozenset[str] = frozenset(), common: frozenset[str] = frozenset()) -> None:
        self.words, self.stems, self.exact, self.common = words, stems, exact, common
        self.root: dict = {}
        for kind, terms in (("word", words), ("stem", stems)):
            for term, weight in terms.items():
                node = self.root
                for c in term:
                    node = node.setdefault(c, {})
                node["", kind] = (term, weight)
        # One edit leaves the first or the last half of a term as it is.
        self.halves: dict[int, set[tuple[bool, str]]] = {}
        for w in words:
            if len(w) >= FUZZY_FROM and w not in exact:
                for n in (len(w) - 1, len(w), len(w) + 1):
                    self.halves.setdefault(n, set()).update({(True, w[: len(w) // 2]), (False, w[-(len(w) // 2) :])})
        self.half_sizes = {n: sorted({len(h) for _, h in own}) for n, own in self.halves.items()}
        self.stem_sizes = sorted({len(s) for s in stems})

    def match(self, word: str) -> tuple[str, float, int] | None:
        """The best (term, evidence, edits) for a lower-cased word, or None."""
        best = (word, self.words[word], 0) if word in self.words else None
        for n in self.stem_sizes:
            if len(word) > n and word[:n] in self.stems and (best is None or self.stems[word[:n]] > best[1]):
                best = (word[:n], self.stems[word[:n]], 0)
        own = self.halves.get(len(word))
        if best or own is None or word in self.common or not any((True, word[:k]) in own or (False, word[-k:]) in own for k in self.half_sizes[len(word)]):
            return best
        automaton = Automaton(word, 1)
        found = None
        stack = [(self.root, automaton.start())]
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if isinstance(c, tuple):
                    distance = automaton.distance(state)
                    if c[1] == "word" and distance is not None and len(child[0]) >= FUZZY_FROM and child[0] not in self.exact and (found is None or child[1] * FUZZY_WEIGHT > found[1]):
                        found = (child[0], child[1] * FUZZY_WEIGHT, distance)
                    continue
                following = automaton.step(state, c)
                if following:
                    stack.append((child, following))
        return found


class Scanner:
    """Features of texts under a lexicon, with a bounded cache of words."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[str, float, int]] = {}

    def _learn(self, words: set[str]) -> None:
        new = words - self.seen
        if len(self.seen) + len(new) > CACHE:
            self.seen.clear()
            self.hits.clear()
            new = words
        for w in new:
            found = self.lexicon.match(w)
            if found:
                self.hits[w] = found
        self.seen |= new

    def features(self, text: str) -> tuple[float, float, float, float, float, int]:
        """Evidence, densest window, terms, share of words, misspelled share, whether any."""
        words = WORD.findall(text.lower())
        distinct = set(words)
        self._learn(distinct)
        if self.hits.keys().isdisjoint(distinct):
            return 0.0, 0.0, 0.0, 0.0, 0.0, 0
        quoted = self._quoted(text) if QUOTES.search(text) else None
        places, weights, terms, fuzzy = [], [], set(), 0
        for i, w in enumerate(words):
            hit = self.hits.get(w)
            if hit is None:
                continue
            mention = (quoted is not None and quoted[i]) or (i and words[i - 1] in REPORTING)
            places.append(i)
            weights.append(hit[1] * (0.3 if mention else 1.0))
            terms.add(hit[0])
            fuzzy += hit[2] > 0
        total = sum(weights)
        densest, now, a = 0.0, 0.0, 0
        for b, weight in enumerate(weights):
            now += weight
            while places[b] - places[a] >= WINDOW:
                now -= weights[a]
                a += 1
            densest = max(densest, now)
        return total, densest, float(len(terms)), total / len(words), fuzzy / len(places), 1

    def _quoted(self, text: str) -> list[bool]:
        """For each word whether it stands between quotation marks."""
        out: list[bool] = []
        parts = QUOTES.split(text)
        for k, part in enumerate(parts):
            out += [bool(k % 2) and k < len(parts) - 1] * len(WORD.findall(part.lower()))
        return out


def vector(found: list[tuple]) -> np.ndarray:
    x = np.array(found, float).reshape(-1, 6)
    return np.c_[x[:, 5], np.log1p(x[:, 0]), np.log1p(x[:, 1]), np.log1p(x[:, 2]), np.log1p(100 * x[:, 3]), x[:, 4]]


def without_copies(rows: DataFrame, keys: int = 3) -> DataFrame:
    """The rows (id, y, text) that are no near copies of one with a smaller id.

    Copies would make the words of one text look like evidence of many. Two texts count as
    copies if one of `keys` MinHash values over their shingles is the same.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                h, at = shingle_sets(Words(part.column(1), lower=True))
                full = np.flatnonzero(np.diff(at))
                least = [np.minimum.reduceat(mix(h ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)), at[full]) if len(full) else h for k in range(keys)]
                ids = part.column(0).to_numpy()[full]
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids, keys)), pa.array(np.repeat(np.arange(keys), len(full))), pa.array(signed(np.concatenate(least)))], ["id", "k", "key"])

    values = shared_table(rows.select("id", "text").mapInArrow(frugal(run), "id long, k long, key long"), "label-keys")
    first = values.groupBy("k", "key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = values.join(first, ["k", "key"]).where("id > first").select("id").distinct()
    return shared_table(rows.join(gone, "id", "left_anti"), "labelled")


def _units(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, toxic, other): texts of either label that hold a word or, with *, a stem."""

    def run(batches):
        for part in (p for batch in batches for p in slices(batch, 1, 4 << 20)):
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for y, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                counts[y].update(_units(text or ""))
            # A term that no toxic text of the slice holds is counted too: it may be toxic elsewhere.
            terms = list(counts[1].keys() | counts[0].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([counts[y][t] for t in terms], pa.int64()) for y in (1, 0))], ["term", "toxic", "other"])

    return rows.mapInArrow(frugal(run), "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def learn_lexicon(rows: DataFrame, share: float, max_terms: int, evidence: float = 9.0) -> Lexicon:
    """Terms whose toxic texts are more than chance, by n * KL(p, share) >= evidence."""
    n = F.col("toxic") + F.col("other")
    p = F.col("toxic") / n
    q = F.lit(share)
    kl = p * F.log(p / q) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - q))).otherwise(0.0)
    counts = term_counts(rows)
    found = counts.where((F.col("toxic") >= 3) & (p >= 0.8)).withColumn("g", n * kl).where(F.col("g") >= evidence)
    top = found.orderBy(F.desc("g"), "term").limit(max_terms).collect()
    stems: dict[str, float] = {}
    words: dict[str, float] = {}
    for r in sorted(top, key=lambda r: (not r.term.endswith("*"), len(r.term), r.term)):
        weight = math.log((r.toxic + 0.5) / (r.other + 0.5)) - math.log(share / (1 - share))
        if r.term.endswith("*"):
            stems[r.term[:-1]] = weight
        else:
            words[r.term] = weight
    # A stem that one word accounts for says nothing about other words.
    by_stem = {r.term: r.toxic for r in top}
    for w in words:
        for n_ in STEMS:
            s = w[:n_]
            if s in stems and by_stem[s + "*"] <= by_stem.get(w, 0) * 1.1:
                del stems[s]
    return Lexicon(words, stems)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 30_000, max_terms: int = 50_000) -> tuple[Lexicon, Logistic]:
    """A lexicon and a calibration; docs has columns id and text."""
    pairs = training_ids(labels, label, sample)
    y = np.array([v for _, v in pairs], float)
    if not len(y) or y.min() == y.max():
        return Lexicon({}, {}), Logistic().fit(np.zeros((len(y), 6)), y)
    rows = without_copies(labelled(docs, pairs)).select("y", "text")
    share = rows.agg(F.avg("y")).first()[0]
    if share in (None, 0.0, 1.0):  # labelled ids without a row, or rows of one class only
        kept = np.full(rows.count(), share or 0.0)
        return Lexicon({}, {}), Logistic().fit(np.zeros((len(kept), 6)), kept)
    lexicon = learn_lexicon(rows, float(share), max_terms)
    near: dict[str, set[str]] = {}
    for r in _measured(rows, lexicon):
        for pair in () if r.y else r.near.split():
            term, spelling = pair.split("/")
            near.setdefault(term, set()).add(spelling)
    exact = frozenset(t for t, own in near.items() if len(own) >= NEIGHBOURS)
    lexicon = Lexicon(lexicon.words, lexicon.stems, exact, frozenset(x for t, own in near.items() if t not in exact for x in own))
    measured = _measured(rows, lexicon)
    x = vector([r[1:7] for r in measured])
    order = np.lexsort(tuple(x.T))
    return lexicon, Logistic(0.3).fit(x[order], np.array([r.y for r in measured], float)[order])


def _measured(rows: DataFrame, lexicon: Lexicon) -> list:
    """For each row of the sample its label, features and what it holds misspelled (term/spelling)."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)  # at most max_terms entries

    def run(batches):
        own = Scanner(shared.value)
        for part in (p for batch in batches for p in slices(batch, 1, 4 << 20)):
            labels, found, near = part.column(0).to_pylist(), [], []
            for text in part.column(1).to_pylist():
                found.append(own.features(text or ""))
                words = set(WORD.findall((text or "").lower())) if found[-1][5] else set()
                near.append(" ".join(sorted(f"{own.hits[w][0]}/{w}" for w in words if w in own.hits and own.hits[w][2])))
            x = np.array(found, float).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), *(pa.array(x[:, k]) for k in range(6)), pa.array(near, pa.string())], ["y", *(f"x{k}" for k in range(6)), "near"])

    schema = "y int, " + ", ".join(f"x{k} double" for k in range(6)) + ", near string"
    return rows.mapInArrow(frugal(run), schema).collect()


def _scores(model: tuple[Lexicon, Logistic], texts: list, own: Scanner) -> np.ndarray:
    return model[1](vector([own.features(t or "") for t in texts])) if texts else np.empty(0)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", sample: int = 30_000) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(fit(docs, labels, label, sample))

    def run(batches):
        own = Scanner(shared.value[0])
        for part in (p for batch in batches for p in slices(batch, 1, 4 << 20)):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_scores(shared.value, part.column(1).to_pylist(), own))], ["doc_id", "score"])

    out = docs.mapInArrow(frugal(run), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", sample: int = 30_000) -> DataFrame:
    """docs, all columns, without the rows whose score reaches the threshold.

    Edge cases are those of the module: null and empty texts have no hits; equal rows go or
    stay together; a table without rows gives none; columns may have any names and types.
    Without labelled rows of both classes nothing can be told apart and all rows stay.
    """
    spark = docs.sparkSession
    ship_package(spark)
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    model = fit(named, labels, label, sample)
    if model[1].w is None:
        return docs
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        own = Scanner(shared.value[0])
        for part in (p for batch in batches for p in slices(batch, at, 4 << 20)):
            yield part.filter(pa.array(_scores(shared.value, part.column(at).to_pylist(), own) < threshold))

    return docs.mapInArrow(frugal(run), docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
