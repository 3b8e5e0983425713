import pytest
from filings import PAD, annual, corpus_rows, filing
from pyspark.sql import functions as F

from filigree.functions import metadata as M
from filigree.functions import text as T
from filigree.operators import chunking as C
from filigree.operators import sections as S
from filigree.operators.resolution import resolve
from filigree.plans.offline import cleaned, prepare


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first().y


@pytest.fixture(scope="module")
def filings(spark):
    return spark.createDataFrame(corpus_rows(), "doc_id string, raw string").cache()


def test_clean(spark):
    raw = "A: b\n============\n0000320193us-gaap:X\r\nFORM 10-K\r\nsome   prose\twith gaps \n\n\n\na | b   c\n  000032019311us-gaap:CommonStockMember\n<?xml version='1'?>left <xbrli:context id='a'>gone</xbrli:context> id=\"z\"\n"
    assert one(spark, raw, T.clean) == "FORM 10-K\nsome prose with gaps\n\na | b   c\nleft\n"
    assert one(spark, "plain", T.clean) == "plain\n"
    assert one(spark, "no separator\n\n\n\nx", T.clean) == "no separator\n\nx\n"


def test_match_positions(spark):
    text = "😀 Item 1. Alpha beta\nxx Item 2. Gamma"
    import re

    want = [(m.start(), m.group()) for m in re.finditer(r"Item \d", text)]
    assert [tuple(r) for r in one(spark, text, lambda c: T.match_positions(c, r"Item \d"))] == want
    assert one(spark, "none", lambda c: T.match_positions(c, "zz")) == []


def test_metadata(spark, filings):
    rows = {r.ticker: r for r in M.build_metadata(filings).collect()}
    a = rows["AAPL"]
    assert (a.company, a.form, a.year, a.quarter, a.fiscal_period, a.cik) == ("Apple Inc.", "10-K", 2022, "", "2022Q3", "0000320193")
    assert (a.industry, a.document_fiscal_period_focus, a.current_fiscal_year_end_date) == ("Information Technology", "FY", "--09-24")
    assert a.entity_incorporation_state_country_code == "California" and a.entity_common_stock_shares_outstanding == "15,908,118,000"
    assert not a.is_amended and not a.is_restated and a.source_file == "AAPL_10K_2022Q3_2022-10-28_full.txt"
    assert all(v is not None for v in a)
    other = M.build_metadata(spark.createDataFrame([("KO_10Q_2023-04-01", "Filing Type: 10-Q/A restated\n==========\n<dei:TradingSymbol x='1'>K&amp;O <b>x</b></dei:TradingSymbol>")], "doc_id string, raw string")).first()
    assert (other.ticker, other.form, other.year, other.filing_date) == ("K&O x", "10-Q", 2023, "2023-04-01")
    assert other.is_amended and other.is_restated and other.report_period == ""


def test_header_map_last_wins(spark):
    assert one(spark, "A: 1\nB : x:y\nA: 2\n: none\n==========\nC: 3", M.header_map) == {"A": "2", "B": "x:y"}


def test_sections(spark, filings):
    texts = cleaned(filings).withColumn("form", F.lit("10-K"))
    spans = S.sections(texts).where("doc_id like 'AAPL%'").orderBy("section_index").collect()
    assert [s.item for s in spans] == ["", "Item 1", "Item 1A", "Item 3", "Item 7", "Item 8"]
    assert [s.section_name for s in spans][:3] == ["Other", "Business", "Risk Factors"]
    assert [s.part for s in spans] == ["", "Part I", "Part I", "Part I", "Part II", "Part II"]
    n = texts.where("doc_id like 'AAPL%'").select(F.length("text")).first()[0]
    assert spans[0].start == 0 and spans[-1].end == n
    assert all(a.end == b.start for a, b in zip(spans, spans[1:]))
    bare = S.sections(spark.createDataFrame([("a", "", "nothing here"), ("b", "", "")], "doc_id string, form string, text string")).collect()
    assert [(r.doc_id, r.section_name, r.start, r.end) for r in bare] == [("a", "Other", 0, 12)]


def test_rising_equals_a_loop(spark):
    import random

    rng = random.Random(4)
    rows = [(f"d{d}", "10-K", 10_000, p * 600, f"Item {rng.randint(1, 9)}{rng.choice(['', 'A'])}", "t") for d in range(30) for p in range(8)]
    df = spark.createDataFrame(rows, "doc_id string, form string, n int, pos int, item string, title string")
    got = {(r.doc_id, r.pos) for r in S.rising(df).collect()}
    want = set()
    for d in range(30):
        last = -1
        for r in sorted(x for x in rows if x[0] == f"d{d}"):
            rank = int(r[4][5]) * 10 + r[4].endswith("A")
            if rank > last:
                want.add((r[0], r[3]))
                last = rank
    assert got == want


def test_splitter():
    s = C.Splitter(120, 20)
    text = "\n\n".join("alpha beta gamma delta. " * 6 for _ in range(4))
    parts = s.split(text)
    assert all(0 < len(p) <= 120 for p in parts) and len(parts) > 4
    assert C.Splitter(10, 0).split("abcdefghijklmnopqrst") == ["abcdefghij", "klmnopqrst"]
    assert C.Splitter(3000, 300).split("short") == ["short"]


def test_tables_keep_rows_whole():
    rows = "Year | 2022 | 2021 |\n" + "\n".join(f"Row {i} | {i}00 | {i}01 |" for i in range(12))
    parts = C.split_section("In millions\n" + rows, C.Splitter(70, 10))
    assert parts[0] == "In millions"
    assert all(line in ("In millions", *rows.split("\n")) for p in parts for line in p.split("\n"))
    assert all("Year | 2022" in p for p in parts[1:])


def test_prepare(spark, filings):
    got = prepare(filings).where("doc_id like 'AAPL%'").orderBy("chunk_index").collect()
    assert [r.chunk_index for r in got] == list(range(len(got))) and len({r.id for r in got}) == len(got)
    by = {r.section for r in got}
    assert {"Business", "Risk Factors", "Legal Proceedings"} <= by
    risk = next(r for r in got if r.section == "Risk Factors")
    assert risk.has_risk_heading and "Section: Risk Factors" in risk.embed_text and risk.embed_text.endswith(risk.text)
    assert 0 < risk.metadata_quality <= 1 and risk.id.startswith("AAPL_10K_2022Q3_2022-10-28__RiskFactors_c")


def test_resolution(spark):
    rows = [
        ("ITEM 1A. RISK FACTORS We face risks", "Exhibits", "Risk Factors", "heading"),
        ("nothing of note", "Business", "Business", "initial_section"),
        ("nothing of note", "", "Other", "initial_section"),
        ("results of operations and liquidity", "Business", "Management's Discussion and Analysis", "heading"),
        ("our customers", "Properties", "Business", "content"),
    ]
    got = resolve(spark.createDataFrame([(i, t, s) for i, (t, s, _, _) in enumerate(rows)], "i int, text string, section string")).orderBy("i").collect()
    assert [(r.section, r.section_source) for r in got] == [(w, k) for _, _, w, k in rows]
    assert got[0].section_signals.split("|")[0] == "item_1a_risk_factors" and got[0].section_original == "Exhibits"


def test_fixture_is_long_enough():
    assert len(PAD) > 500 and "Item 1A" in annual() and filing().count("=") >= 40
