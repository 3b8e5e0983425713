"""Classifiers and the pipeline against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import zstandard
from edge_cases import edge_rows, prose
from pyspark.sql import functions as F

from filigree.llm import quality_classifier as QC
from filigree.llm import toxicity as TX


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.fixture(scope="module")
def judged(spark):
    """Texts, some of them rude or bad, with labels; edge rows without."""
    rng = random.Random(21)
    rude = ["nastyfool", "vilescum", "rottenrat", "nastyfolk"]
    rows, labels = [], []
    for i in range(400):
        toxic, good = i % 4 == 0, i % 3 != 0
        text = prose(rng, rng.randint(20, 80)).split()
        if toxic:
            at = rng.randrange(len(text))
            text[at:at] = [rng.choice(rude) for _ in range(rng.randint(1, 3))]
        if rng.random() < 0.1:
            text.insert(3, '"you rottenrat"')
        if i % 40 == 1:
            text.insert(2, "vilescun")  # a clean text's own spelling
        rows.append((1000 + i, " ".join(text if good else [w.upper() + "!!" for w in text])))
        labels.append((1000 + i, int(good), int(toxic)))
    odd = [(2000, "nastyfol nastyf00l vilescam"), (2001, "said vilescum, said"), (2002, "nasty fool"), (2003, "“vilescum” vilescums NASTYFOOLISH"), (2004, "word " * 3000 + "vilescum")]
    docs = spark.createDataFrame(rows + odd + edge_rows(), "doc_id long, text string").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows + odd + edge_rows(), labels


def brute_match(lexicon, word):
    """The best hit of a word over all terms, by edit distances."""
    exact = [(w, 0) for w in ([lexicon.words[word]] if word in lexicon.words else [])]
    exact += [(v, 0) for s, v in lexicon.stems.items() if len(word) > len(s) and word.startswith(s)]
    if exact:
        return max(exact)
    if word in lexicon.common:
        return None
    near = [(v * TX.FUZZY_WEIGHT, 1) for t, v in lexicon.words.items() if len(t) >= TX.FUZZY_FROM and t not in lexicon.exact and distance(t, word) == 1]
    return max(near, default=None)


def brute_features(lexicon, text):
    words = list(re.finditer(r"\w+", text.lower()))
    quotes = [m.start() for m in re.finditer("[\"“”«»„]", text)]
    hits = []
    for i, m in enumerate(words):
        hit = brute_match(lexicon, m.group())
        if hit:
            before = sum(q < m.start() for q in quotes)
            mention = (before % 2 == 1 and before < len(quotes)) or (i and words[i - 1].group() in TX.REPORTING)
            hits.append((i, hit[0] * (0.3 if mention else 1.0), m.group(), hit[1]))
    if not hits:
        return [0.0] * 6
    total = sum(h[1] for h in hits)
    densest = max(sum(h[1] for h in hits if i <= h[0] < i + TX.WINDOW) for i in range(len(words)))
    return [total, densest, None, total / len(words), sum(h[3] for h in hits) / len(hits), 1]


def test_toxicity_by_brute_force(spark, judged):
    docs, labels, rows, _ = judged
    lexicon, curve = TX.fit(docs.select(F.col("doc_id").alias("id"), "text"), labels)
    assert {"nastyfool", "vilescum"} <= set(lexicon.words) and "vilescun" in lexicon.common
    scanner = TX.Scanner(lexicon)
    for _, text in rows:
        want = brute_features(lexicon, text or "")
        got = scanner.features(text or "")
        assert all(w is None or math.isclose(w, g, abs_tol=1e-9) for w, g in zip(want, got)), text
    got = {(r.doc_id, round(r.score, 9)) for r in TX.classify(docs, labels).collect()}
    x = TX.vector([scanner.features(t or "") for _, t in rows])
    assert got == {(d, round(float(s), 9)) for (d, _), s in zip(rows, curve(x))}


def test_term_counts_by_brute_force(spark, judged):
    _, _, rows, labels = judged
    toxic = {d: t for d, _, t in labels}
    own = [(toxic[d], t) for d, t in rows if d in toxic]
    counts = (Counter(), Counter())
    for y, text in own:
        words = set(re.findall(r"\w+", text.lower()))
        counts[y].update(words | {w[:n] + "*" for w in words for n in TX.STEMS if len(w) > n})
    got = {r.term: (r.toxic, r.other) for r in TX.term_counts(spark.createDataFrame(own, "y int, text string").repartition(4)).collect()}
    assert got == {t: (counts[1][t], counts[0][t]) for t in counts[0] | counts[1]}


def test_quality_by_brute_force(judged):
    docs, labels, rows, _ = judged
    pairs, curve = QC.fit(docs.select(F.col("doc_id").alias("id"), "text"), labels)

    def size(dictionary, text):
        own = zstandard.ZstdCompressionDict(dictionary)
        return len(zstandard.ZstdCompressor(level=QC.LEVEL, dict_data=own, write_content_size=False, write_dict_id=False).compress(text))

    want = set()
    for d, t in rows:
        text = (t or "").encode()
        x = 0.0
        for good, bad in pairs:
            a, b = size(good, text), size(bad, text)
            x += (a - b) / max(a, b)
        x /= len(pairs)
        z = [x, *(max(x - k, 0) for k in curve.knots)]
        scale = math.log(len(text) + 1)
        z += [x * scale, *(max(x - k, 0) * scale for k in curve.knots[1::2])]
        z = (np.array(z) - curve.logistic.mean) / curve.logistic.scale
        want.add((d, round(1 / (1 + math.exp(-max(-30.0, min(30.0, float(curve.logistic.w[0] + z @ curve.logistic.w[1:]))))), 6)))
    assert {(r.doc_id, round(r.score, 6)) for r in QC.classify(docs, labels).collect()} == want


def test_quality_of_long_texts_trains_with_spaced_pieces(spark):
    long = "".join(f"{i:07d} " for i in range(20_000))
    rows = spark.createDataFrame([(1, 1, 0, long), (2, 0, 0, "short"), (3, 0, 1, None)], "id long, y int, fold int, text string")
    got = {i: t for i, _, _, t in QC._for_dictionaries(rows, 1 << 20)}
    assert got[2] == b"short" and 3 not in got and len(got[1]) == QC.TEXT_BYTES
    assert got[1].startswith(long[: QC.PIECE].encode()) and got[1].endswith(long[-QC.PIECE :].encode())
    assert {i for i, _, _, _ in QC._for_dictionaries(rows, 100)} == {2}


def test_pipeline_run(spark, judged, tmp_path):
    """run() is the stages in turn; an empty table and clashing columns pass through all of them."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels, _, _ = judged
    base = str(tmp_path)
    docs.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars").write.parquet(base + "/documents.parquet")
    labels.write.parquet(base + "/labels.parquet")
    spark.createDataFrame([(1, "no such passage of words stands in any of these texts at all")], "item_id long, text string").write.parquet(base + "/benchmark.parquet")
    read = spark.read.parquet(base + "/documents.parquet")
    now = read
    for name, stage in pipeline.STAGES:
        stage(spark, now, base).write.parquet(f"{base}/out-{name}")
        now = spark.read.parquet(f"{base}/out-{name}")
    whole = lambda df: sorted(map(repr, df.groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens")).collect()))
    out = pipeline.run(spark, base)
    assert whole(out) == whole(now)
    empty = read.where("false").selectExpr("*", "'x' as _spans", "map('a', 1) as key")
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, base).count() == 0
