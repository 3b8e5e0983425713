"""Models on the workers, a service that fails at first, and runs that go on where they stopped."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from filings import annual
from pyspark.sql import functions as F

from filigree.functions import questions as Q
from filigree.operators import metrics as M
from filigree.operators import plugins as PL
from filigree.operators import search as R
from filigree.operators.sections import checked_spans
from filigree.plans import offline, online
from filigree.plans.evaluation import run_evaluation


@pytest.fixture
def service():
    """Answers every second call; the others fail."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body)
            if len(seen) % 2:
                self.send_response(503)
                self.end_headers()
                return
            if "input" in body:
                out = {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]}
            else:
                out = {"choices": [{"message": {"content": json.dumps({"executive_summary": "- x [E1]", "citations": ["E1"]})}}], "usage": {"prompt_tokens": 7, "completion_tokens": 3}}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", seen
    server.shutdown()


def test_service_embedder_on_workers(spark, service):
    url, seen = service
    texts = spark.createDataFrame([(1, "abc"), (2, None), (3, "de")], "id int, text string").coalesce(1)
    got = {r.id: r.embedding for r in R.embed(texts, PL.embedder("service", url=url, model="m", wait=0.01), batch=2).collect()}
    assert got == {1: [3.0, 1.0], 2: [0.0, 1.0], 3: [2.0, 1.0]} and [len(b["input"]) for b in seen] == [2, 2, 1, 1]
    with pytest.raises(ValueError, match="no embedder"):
        PL.embedder("other")


def test_service_generator(spark, service):
    url, _ = service
    prompts = spark.createDataFrame([("q", "rules", "question")], "query_id string, system string, user string")
    row = online.generate(prompts, PL.PerWorker(PL.service_generator, url=url, model="m", wait=0.01)).first()
    assert (row.executive_summary, row.citations, row.input_tokens, row.output_tokens) == ("- x [E1]", ["E1"], 7, 3)


def test_retries_end():
    calls = []

    def fails():
        calls.append(1)
        raise OSError("down")

    with pytest.raises(OSError):
        PL.with_retries(fails, 2, 0.001)()
    assert len(calls) == 3


def test_vector_search_in_blocks(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rng.integers(-3, 4, (300, 4)))] + [(900, None), (901, [0.0] * 4), (902, [1.0])]
    asked = [(f"q{i}", [float(x) for x in v]) for i, v in enumerate(rng.integers(-3, 4, (50, 4)) + 0.5)]
    v = spark.createDataFrame(vectors, "chunk_id int, embedding array<float>").repartition(3)
    a = spark.createDataFrame(asked, "query_id string, embedding array<float>")
    want = {}
    for q, x in asked:
        scores = [(round(float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y))), 9), c) for c, y in vectors[:300] if any(y)]
        want[q] = [c for s, c in sorted(scores, key=lambda t: (-t[0], t[1]))[:7]]
    for block in (1000, 8):
        found = R.vector_search(v, a, 7, block=block)
        plan = found._jdf.queryExecution().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.chunk_id)
        assert got == want
    pairs = spark.createDataFrame([(q, c) for q, own in want.items() for c in own[:2]], "query_id string, chunk_id int")
    got = {(r.query_id, r.chunk_id) for r in R.vector_search(v, a, 7, pairs).collect()}
    assert got == {(q, c) for q, own in want.items() for c in own[:2]}


def test_filter_mask_is_the_hard_filter(spark):
    rows = [(c, t, y, q, f, f"{y}{q}") for c, (t, y, q, f) in enumerate((t, y, q, f) for t in "AB" for y in (2020, 2021) for q in ("Q1", "Q2") for f in ("10-K", "10-Q"))] + [(99, None, None, None, None, None)]
    chunks = spark.createDataFrame(rows, "chunk_id int, ticker string, year int, quarter string, form string, fiscal_period string").coalesce(1)
    filters = [([], [], [], [], []), (["A"], [2020], [], [], []), ([], [2020], ["Q1"], [], ["2020Q1"]), ([], [2020], ["Q1"], [], ["2021Q2"]), ([], [], ["Q2"], ["10-K"], ["2021Q2"]), (["B", "C"], [], [], ["10-Q"], [])]
    asked = spark.createDataFrame([(i, *f) for i, f in enumerate(filters)], "query_id int, tickers array<string>, years array<int>, quarters array<string>, forms array<string>, fiscal_periods array<string>")
    hits = asked.select("query_id").crossJoin(chunks.select("chunk_id"))
    want = {(r.query_id, r.chunk_id) for r in online.keep_allowed(asked, chunks)(hits).collect()}
    mask = online.filter_mask(asked.orderBy("query_id").toArrow(), chunks.toArrow().to_batches()[0])
    assert {(q, rows[c][0]) for q, c in zip(*np.nonzero(mask))} == want and len(want) > 30
    assert Q is not None


def test_checked_spans(spark):
    good = spark.createDataFrame([("d", 0, 0), ("d", 0, 5)], "doc_id string, start int, end int")
    assert checked_spans(good).count() == 2
    with pytest.raises(Exception, match="bad span in e"):
        checked_spans(good.union(spark.createDataFrame([("e", 3, 2)], good.schema))).collect()


def test_profile(spark):
    raw = [("a", "Company: x\nTicker: T\n" + "=" * 10 + "\nFORM 10-K\nwords\n\nmore words"), ("b", "no header")]
    got = {r.metric: r.value for r in M.corpus_profile(spark.createDataFrame(raw, "doc_id string, raw string")).collect()}
    assert got["filings"] == 2 and got["header.Ticker"] == 1 and got["header.URL"] == 0 and got["without_anchor"] == 1
    assert got["paragraphs.mean"] == 1.5 and got["lines"] == 7 and got["lines.longest"] == 10 and got["offset.p50"] == raw[0][1].index("FORM")


def test_judged_mean(spark):
    cases = spark.createDataFrame([("q1", "a", "c"), ("q2", "", "c")], "question string, answer string, context string")
    judge = lambda rows: [{"faithfulness": float(len(a))} if a else {} for _, a, _ in rows]
    assert {r.metric: r.value for r in M.judged_mean(cases, judge).collect()} == {"faithfulness": 1.0}
    assert M.judged_mean(cases, None).count() == 0


def test_evaluation_goes_on_where_it_stopped(spark, tmp_path):
    filings = spark.createDataFrame([("AAPL_10K_2022Q3_2022-10-28", annual())], "doc_id string, raw string")
    chunks = offline.prepare(filings).cache()
    index = R.build_bm25(chunks)
    cases = spark.createDataFrame([("c1", "What are the risk factors of Apple?", ["AAPL"], False), ("c2", "what is the weather", None, True)], "case_id string, question string, companies array<string>, expect_refusal boolean")
    cases = cases.withColumns({"sections": F.array().cast("array<string>"), "years": F.array().cast("array<int>"), "forms": F.array().cast("array<string>"), "expected_chunk_ids": F.array().cast("array<string>")})
    calls = []
    generator = lambda prompts: calls.append(1) or online.quoting_generator(prompts)
    base = str(tmp_path / "run")
    tables = run_evaluation(cases, online.Corpus(chunks, index, None, None), base, part=2, k=4, generator=online.quoting_generator)
    first = {r.metric: r.value for r in tables["summary"].collect()}
    assert first["n_cases"] == 2 and first["latency_s"] > 0 and "changes" not in tables and not calls and generator
    report = json.loads((tmp_path / "run" / "report.json").read_text())
    assert {r["case_id"] for r in report["tables"]["cases"]} == {"c1", "c2"} and "<table>" in (tmp_path / "run" / "report.html").read_text()
    again = run_evaluation(cases, online.Corpus(chunks, None, None, None), base, part=2, k=4)  # nothing is computed anew
    assert {r.metric: r.value for r in again["summary"].collect()} == first and again["changes"].where("verdict is not null").count() == 0
