"""Operators that keep all columns, on columns named like their own and of types that cannot be compared."""

import pytest
from edge_cases import edge_rows

from filigree.llm.decontamination import drop_contaminated
from filigree.llm.near_dedup import drop_near_duplicates, near_duplicates
from filigree.llm.packing import pack, tokenizer_file
from filigree.llm.quality_rules import filter_documents, judge
from filigree.llm.secret_scan import redact, scan
from filigree.llm.substring_dedup import remove_repeats
from filigree.llm.toxicity import classify, drop_toxic

NAMES = "_spans _key _doc spans key doc id y row kind start end m n i j node component centre rep part parts score predicted kept held_out bands set1 rejected_by n_words base_failed".split()


@pytest.fixture(scope="module")
def wide(spark):
    """Edge rows with a map, an array and a struct, and many names."""
    rows = [(d, f"{t} password=abcdef{k:06d}" if t and k % 5 == 0 else t) for k, (d, t) in enumerate(edge_rows())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    more = [f"'x' as `{name}`" for name in NAMES]
    return df.selectExpr(*more[:15], "text", "map('a', doc_id) as tags", "array(doc_id) as list", "doc_id", "named_struct('a', map(1, text)) as deep", *more[15:])


def test_operators_that_keep_columns(spark, wide, labels):
    bench = spark.createDataFrame([(1, "no such passage in any text at all here")], "item_id long, text string")
    n = wide.count()
    for out, least in ((redact(wide), n), (drop_near_duplicates(wide), 30), (drop_toxic(wide, labels.selectExpr("doc_id", "cast(doc_id % 5 = 0 as int) as toxic")), 1), (drop_contaminated(wide, bench), n), (filter_documents(wide), 1)):
        rows = out.collect()
        assert out.columns == wide.columns and dict(out.dtypes) == dict(wide.dtypes) and least <= len(rows) <= n
        assert all(r.tags == {"a": r.doc_id} and r["_key"] == "x" for r in rows)
    assert "abcdef000005" not in {w for r in redact(wide).collect() for w in (r.text or "").split("=")}
    for f in (redact, drop_near_duplicates, filter_documents):
        assert f(wide.where("false")).count() == 0


def test_operators_that_return_their_own_columns(wide, labels):
    plain = wide.select("doc_id", "text")
    key = lambda rows: sorted(map(repr, rows))
    for f in (scan, judge, near_duplicates, remove_repeats, lambda d: classify(d, labels)):
        assert key(f(wide).collect()) == key(f(plain).collect())
    assert pack(wide, tokenizer_file()).agg({"length": "sum"}).first() == pack(plain, tokenizer_file()).agg({"length": "sum"}).first()
