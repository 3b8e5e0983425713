import json
import os
import shutil

import pytest
from filings import annual
from pyspark.sql import functions as F

from filigree.config import Settings
from filigree.operators import metrics as M
from filigree.sources import corpus as C
from filigree.sources import logs as L
from filigree.sources.vectors import VectorTable, hydrate, index_join
from filigree.streaming.ingest import landing_stream, start

NAME = "AAPL_10K_2022Q3_2022-10-28_full.txt"


@pytest.fixture
def landing(tmp_path):
    tmp_path = tmp_path / "landing"
    tmp_path.mkdir()
    (tmp_path / NAME).write_text(annual(), encoding="utf-8")
    (tmp_path / "TSLA_10K_2022-10-28_full.txt").write_bytes(b"\xff\xfe bad")
    (tmp_path / "notes.txt").write_text("x")
    files = [NAME, "TSLA_10K_2022-10-28_full.txt", "notes.txt", "KO_10Q_2022-10-28_full.txt"]
    (tmp_path / "manifest.json").write_text(json.dumps({"corpus": "c", "files": files}))
    return tmp_path


def test_ingest(spark, landing):
    good, dead = C.ingest(spark, str(landing))
    assert [r.doc_id for r in good.collect()] == ["AAPL_10K_2022Q3_2022-10-28"] and good.first().changed
    assert {r.file: r.reason for r in dead.collect()} == {"TSLA_10K_2022-10-28_full.txt": "not valid UTF-8", "notes.txt": "invalid filename", "KO_10Q_2022-10-28_full.txt": "missing file"}
    again, _ = C.ingest(spark, str(landing), good.select("doc_id", "sha256"))
    assert not again.first().changed


def test_stage_tables(spark, tmp_path):
    C.write_stage(spark.createDataFrame([("b",), ("_x",), ("a",)], "doc_id string"), str(tmp_path), "raw")
    assert [r.doc_id for r in C.stage_ids(C.read_stage(spark, str(tmp_path), "raw")).collect()] == ["a", "b"]
    for bad in ("", "a/b", "..", "a\\b"):
        with pytest.raises(ValueError):
            C.check_token(bad)


def test_vector_table_replaces_documents(spark, tmp_path):
    t = VectorTable(spark, str(tmp_path / "v"))
    row = lambda c, d, x: ("m", c, d, [float(x)])
    cols = "model string, chunk_id string, doc_id string, embedding array<float>"
    assert t.count() == 0
    t.upsert(spark.createDataFrame([row("a1", "a", 1), row("a2", "a", 2), row("b1", "b", 3)], cols))
    t.upsert(spark.createDataFrame([row("a1", "a", 9)], cols))
    assert sorted((r.chunk_id, r.embedding[0]) for r in t.read().collect()) == [("a1", 9.0), ("b1", 3.0)]
    assert len(t.versions()[1]) == 1  # only the bucket of the document that was written again
    chunks = spark.createDataFrame([("a1", "text"), ("b1", "more")], "chunk_id string, text string")
    assert index_join(t.read(), chunks).count() == 2
    assert {r.chunk_id: r.text for r in hydrate(t.read().select("chunk_id"), chunks.limit(0), chunks).collect()} == {"a1": "text", "b1": "more"}
    with pytest.raises(Exception, match="no chunk for"):
        index_join(t.read(), chunks.where("chunk_id = 'a1'")).collect()


def test_logs(spark, tmp_path):
    path = str(tmp_path / "golden")
    os.makedirs(path)
    with open(path + "/g.jsonl", "w") as f:
        f.write('{"id": "q1", "question": "x", "companies": ["A"]}\n\n{"id": "q2", "question": "y", "expect_refusal": true}\n')
    assert {r.case_id: r.expect_refusal for r in L.golden_cases(spark, path).collect()} == {"q1": None, "q2": True}
    rows = L.query_log(spark.createDataFrame([("q", "x", 1_000_000, 100_000)], "query_id string, question string, input_tokens int, output_tokens int"))
    assert rows.first().cost_usd == 3.5
    for _ in range(2):
        L.append_jsonl(rows, str(tmp_path / "log"))
    assert L.read_jsonl(spark, str(tmp_path / "log"), "query_id string, cost_usd double").count() == 2
    assert L.previous_report(spark, str(tmp_path / "none")) is None
    with open(path + "/bad.jsonl", "w") as f:
        f.write('{"id": broken\n')
    with pytest.raises(Exception):
        L.golden_cases(spark, path).collect()


def test_incremental_ingest(spark, landing, tmp_path):
    base, mark = str(tmp_path / "base"), str(tmp_path / "mark")
    start(landing_stream(spark, str(landing)), base, mark).awaitTermination()
    first = spark.read.parquet(base + "/chunks")
    assert first.count() > 3 and first.select("doc_id").distinct().count() == 1
    shutil.copy(landing / NAME, landing / "TSLA_10K_2022Q3_2022-10-28_full.txt")
    start(landing_stream(spark, str(landing)), base, mark).awaitTermination()
    assert spark.read.parquet(base + "/catalog").count() == 2
    dead = {r.file: r.reason for r in spark.read.parquet(base + "/dead").collect()}
    assert dead == {"TSLA_10K_2022-10-28_full.txt": "not valid UTF-8", "notes.txt": "invalid filename", "manifest.json": "invalid filename"}


def test_settings():
    assert Settings().chunk_max_chars == 3000
    for bad in ({"chunk_max_chars": 10}, {"chunk_overlap": 900, "chunk_max_chars": 800}, {"min_similarity": 2.0}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_metrics(spark):
    rows = [("c", "m", r, f"x{r}", int(r in (2, 4))) for r in range(1, 6)]
    got = M.metrics_at_k(spark.createDataFrame(rows, "case_id string, mode string, rank int, chunk_id string, rel int"), 3).first()
    import math

    assert abs(got.precision - 1 / 3) < 1e-9 and got.hit == 1.0 and got.mrr == 0.5
    assert abs(got.ndcg - (1 / math.log2(3)) / (1 + 1 / math.log2(3))) < 1e-9
    now = spark.createDataFrame([("p", 0.5), ("latency_s", 2.0), ("same", 1.0)], "metric string, value double")
    before = spark.createDataFrame([("p", 0.6), ("latency_s", 1.0), ("same", 1.01)], "metric string, value double")
    assert {r.metric: r.verdict for r in M.regressions(now, before).collect()} == {"p": "regression", "latency_s": "regression", "same": None}
    page = M.html_report("t<", {"a": now})
    assert "t&lt;" in page and page.count("<tr>") == 4


def test_report_views(spark):
    rows = spark.createDataFrame([("ndcg", 0.1), ("mrr", 0.2), ("other", 0.3)], "metric string, value double")
    assert [r.metric for r in M.headlines(rows).collect()] == ["mrr", "ndcg"]
    means = spark.createDataFrame([("hybrid", 0.5), ("bm25", 0.25)], "mode string, recall double")
    assert M.recall_by_mode(means).first().mode == "bm25" and M.mode_table(means, "recall").first().asDict() == {"bm25": 0.25, "hybrid": 0.5}
    cases = spark.createDataFrame([("q1", "About Apple", True), ("q2", "apple pie", None)], "case_id string, question string, refused boolean")
    assert M.find_cases(cases, "APPLE").count() == 2 and M.find_cases(cases, refused=True).first().case_id == "q1" and M.find_cases(cases, "q2").count() == 1


def test_integrity(spark):
    cleaned = spark.createDataFrame([("d", "abc"), ("e", "xyz xmlns:a")], "doc_id string, text string")
    meta = spark.createDataFrame([("d", "T", "10-K", 2022)], "doc_id string, ticker string, form string, year int")
    spans = spark.createDataFrame([("d", 0, 2), ("d", 2, 3), ("e", 0, 4)], "doc_id string, start int, end int")
    chunks = spark.createDataFrame([("c1",)], "chunk_id string")
    got = {r.name: (r.ok, r.detail) for r in M.integrity(cleaned, meta, spans, chunks, chunks.limit(0)).collect()}
    assert got["no markup left"] == (False, "1 of 2") and got["metadata complete"][0] and got["sections contiguous"][0]
    assert not got["sections cover the text"][0] and got["a vector for each chunk"] == (True, "pending")
    assert F is not None
