"""BM25 search against loops, and what it shuffles."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filigree.operators import search as R
from filigree.plans import ranking_queries

WORDS = "a b c d e f g h i j k l".split()


def loop(texts, questions, k, may=lambda i: True):
    """(question, rank) -> (chunk, score) by a loop over all pairs."""
    docs = [t.split() for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {w: sum(w in t for t in docs) for t in docs for w in t}
    idf = {w: math.log(n - x + 0.5) - math.log(x + 0.5) for w, x in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    out = {}
    for q, question in questions:
        scores = [(-round(sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in question.split() if w in t), 9), i) for i, t in enumerate(docs) if may(i)]
        out |= {(q, rank + 1): (i, -s) for rank, (s, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k])}
    return out


def test_search_matches_a_loop(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 6)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    texts += texts[:30]  # copies tie, and the least id comes first
    questions = [(f"q{i}", " ".join(rng.choice([*WORDS, "zz"]) for _ in range(rng.randint(0, 6)))) for i in range(12)]
    rows = [(i, t, i % 3) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    chunks = spark.createDataFrame(rows, "chunk_id long, text string, kind int").repartition(5)
    asked = spark.createDataFrame(questions, "query_id string, question string")
    index = R.build_bm25(chunks, keep=("kind",))
    index.save(f"{tmp_path}/index")
    ones = chunks.where("kind = 1").select("chunk_id")
    pairs = asked.select("query_id").crossJoin(ones)
    kind = F.col("kind") == 1
    for held, filters in ((index, (None, kind, ones, pairs, lambda hits: hits.where("chunk_id % 3 = 1"))), (R.Bm25Index.load(spark, f"{tmp_path}/index"), (None, kind))):
        for allowed in filters:
            got = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in R.bm25_search(held, asked, 4, allowed).collect()}
            want = loop(texts, questions, 4, (lambda i: True) if allowed is None else (lambda i: i % 3 == 1))
            assert got.keys() == want.keys()
            assert all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-8 for x in want)
    wide = {(r.query_id, r.chunk_id) for r in R.bm25_search(index, asked, 2, kind, overfetch=True).collect()}
    want = {}
    for (q, _), (i, _) in sorted(loop(texts, questions, 8).items()):
        want.setdefault(q, []).extend([i] * (i % 3 == 1))
    assert wide == {(q, i) for q, ids in want.items() for i in ids[:2]}


def test_scores_in_small_steps(monkeypatch):
    """Cuts between chunks, and first places that are cut down on the way, change nothing."""
    rng = random.Random(6)
    asked = pa.table({"query_id": [q for q in range(7) for _ in range(3)], "term": [t for _ in range(7) for t in rng.sample(WORDS, 3)], "weight": [float(rng.randint(1, 4)) for _ in range(21)]}).sort_by("term")
    rows = [(i, [rng.choice(WORDS) for _ in range(rng.randint(0, 4))]) for i in range(300)]
    rng.shuffle(rows)
    kinds = pa.schema([("chunk_id", pa.int64()), ("dl", pa.int32()), ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int64()))])
    batches = [pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([i for i, _ in part], [len(t) for _, t in part], [t for _, t in part], [None] * len(part)), kinds)], schema=kinds) for part in (rows[:130], rows[130:])]
    found = {}
    for cells in (1 << 18, 40):
        monkeypatch.setattr(R, "MOST_CELLS", cells)
        for k in (5, None):
            found[cells, k] = sorted((r["query_id"], -r["score"], r["chunk_id"]) for b in R._bm25_batches(batches, asked, 2.0, k) for r in b.to_pylist())
    assert found[40, None] == found[1 << 18, None] and found[40, 5] == found[1 << 18, 5]
    assert found[40, 5] == [x for q in range(7) for x in [y for y in found[40, None] if y[0] == q][:5]]


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """600 questions that share words with all of 600 texts: 360,000 pairs."""
    d, rng = tmp_path_factory.mktemp("crowd"), random.Random(7)
    texts = [(i, " ".join(rng.choice(WORDS) for _ in range(20)) + f" own{i}", "en" if i % 2 else "fr", "s", 40) for i in range(600)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, " ".join(rng.sample(WORDS, 4))) for i in range(600)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, i % 3 == 0, 0) for i in range(600)], "doc_id long, quality boolean, toxic int").withColumn("quality", F.col("quality").cast("int")).write.parquet(f"{d}/labels.parquet")
    return str(d)


def shuffled(spark) -> int:
    """Bytes that all tasks so far have written to shuffles."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    found = context.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


@pytest.mark.parametrize("name", ["rrf_fusion", "precision_mrr_ndcg", "regression_diff", "ab_mode_means", "pooled_recall", "bm25_prefilter_topk"])
def test_pairs_are_not_shuffled(spark, crowd, name):
    before = shuffled(spark)
    assert ranking_queries.QUERIES[name](spark, crowd).collect()
    spent = shuffled(spark) - before
    assert spent < 4 * 360_000


@pytest.fixture(scope="module")
def scattered(spark, tmp_path_factory):
    """300 questions that share words with all of 1,200 texts in 300 files."""
    d, rng = tmp_path_factory.mktemp("scattered"), random.Random(8)
    texts = [(i, " ".join(rng.choice(WORDS) for _ in range(20)) + f" own{i}", "en" if i % 2 else "fr", "s", 40) for i in range(1200)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").repartition(300).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, " ".join(rng.sample(WORDS, 4))) for i in range(300)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(1200)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["ab_mode_means", "pooled_recall"])
def test_lists_do_not_grow_with_files(spark, scattered, monkeypatch, name):
    """A task sends 20 rows a question, so 300 tasks would send all pairs."""
    monkeypatch.setattr(R, "MOST_TASKS", 4, raising=False)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # what opening a file counts as: a task for each
    try:
        before = shuffled(spark)
        assert ranking_queries.QUERIES[name](spark, scattered).collect()
        spent = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert spent < 3_000_000


def test_tokens_are_written_tightly(spark):
    index = R.build_bm25(spark.createDataFrame([(1, "a b c")], "chunk_id long, text string"))
    assert all(f.endswith(".zstd.parquet") for f in index.tokens.inputFiles())


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """3,000 questions of 10 texts, whose words stand in other orders, on 1,200 texts in 16 files."""
    d, rng = tmp_path_factory.mktemp("repeated"), random.Random(9)
    texts = [(i, " ".join(rng.choice(WORDS) for _ in range(20)) + f" own{i}", "en" if i % 2 else "fr", "s", 40) for i in range(1200)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").repartition(16).write.parquet(f"{d}/documents.parquet")
    kinds = [rng.sample(WORDS, 4) for _ in range(10)]
    spark.createDataFrame([(i, " ".join(rng.sample(kinds[i % 10], 4))) for i in range(3000)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(1200)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_equal_questions_are_scored_once(spark, repeated):
    """16 tasks of 75 texts would send 20 rows for each of 3,000 questions, twice."""
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        before = shuffled(spark)
        got = {(r.case_id, r.mode): r.recall for r in ranking_queries.QUERIES["pooled_recall"](spark, repeated).collect()}
        spent = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert len(got) == 6000 and all(got[i, mode] == got[i % 10, mode] for i in range(3000) for mode in ("all", "en"))
    assert spent < 3_000_000


def test_equal_questions_keep_their_ids(spark):
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "a a c", "b c", "a a c", "d", "e", "f"])], "chunk_id long, text string")
    index = R.build_bm25(chunks)
    asked = [("x", "c a"), ("y", "A, c"), (None, "a c"), ("z", "a c c"), ("v", "d"), (None, "zz"), ("w", "")]
    one = lambda rows, **how: sorted(((r.query_id or "", r.rank, r.chunk_id, r.score) for r in R.bm25_search(index, spark.createDataFrame(rows, "query_id string, question string"), 3, **how).collect()))
    for how in ({}, {"allowed": chunks.where("chunk_id < 3").select("chunk_id")}, {"allowed": chunks.where("chunk_id < 3").select("chunk_id"), "overfetch": True}):
        alone = [r for q in ("x", "y", None, "z", "v", "w") for r in one([a for a in asked if a[0] == q], **how)]
        assert one(asked, **how) == sorted(alone) and len(alone) > 8
