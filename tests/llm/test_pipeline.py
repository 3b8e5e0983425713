"""The pipeline's stages on a small folder of tables."""

import os
import random

import pytest
from edge_cases import edge_rows, prose

from filigree.llm.near_dedup import drop_near_duplicates


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(9)
    rows = [(i, t, "en", "s", len(t) if t else 0) for i, t in edge_rows()]
    clean = [(500 + i, prose(rng, 70), "en", "s", 0) for i in range(80)]
    toxic = [(700 + i, prose(rng, 30) + " nastyfool vilescum nastyfool " + prose(rng, 30), "en", "s", 0) for i in range(40)]
    leak = [(900, prose(rng, 30) + " which bridge leads to the seventh harbour of glass? the northern one " + prose(rng, 30), "en", "s", 0)]
    secret = [(901, prose(rng, 40) + " password=abcdef123456 " + prose(rng, 40), "en", "s", 0)]
    docs = spark.createDataFrame(rows + clean + toxic + leak + secret, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(d + "/documents.parquet")
    labels = [(r[0], 1, 0) for r in clean] + [(r[0], 1, 1) for r in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(d + "/labels.parquet")
    spark.createDataFrame([(1, "Which bridge leads to the seventh harbour of glass? The northern one")], "item_id long, text string").coalesce(1).write.parquet(d + "/benchmark.parquet")
    return d


def test_stages(spark, folder):
    pipeline = pytest.importorskip("corpus_pipeline")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]
    docs = spark.read.parquet(folder + "/documents.parquet")
    columns, ids = docs.columns, []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, folder)
        path = f"{folder}/out-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if k < 4:
            assert docs.columns == columns
            ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert not any(700 <= i < 740 for i in ids[0] if i) and {500 + i for i in range(80)} <= ids[0]
    assert 1 in ids[1] and not {2, 3} & ids[1] and {500 + i for i in range(80)} <= ids[1]
    assert ids[1] - ids[2] == {900} and ids[3] == ids[2]
    hidden = spark.read.parquet(folder + "/out-secrets").where("doc_id = 901").first()
    assert "abcdef123456" not in hidden.text and hidden.n_chars == len(hidden.text)
    packed = docs.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).where("doc_id is not null").collect()
    assert {r.doc_id for r in packed} == ids[3] - {None} and os.path.isdir(folder)


def test_near_dedup_stage_takes_pairs_from_080(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    base = [f"word{i}" for i in range(204)]
    near = [f"other{i}" if i in (30, 80, 130, 180) else w for i, w in enumerate(base)]  # 180 of 220 shingles: 0.818
    far = [f"third{i}" if i in (20, 50, 80, 110, 140, 170) else w for i, w in enumerate(base)]  # 170 of 230: 0.739
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert {r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect()} == {1, 3}
    assert {r.doc_id for r in drop_near_duplicates(docs).collect()} == {1, 2, 3}
