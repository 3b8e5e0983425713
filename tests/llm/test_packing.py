import zlib

import numpy as np
import pyarrow as pa
import pytest

from filigree.llm.packing import Packer, WordIds, pack, tokenizer_file


def _check(rows, docs, length):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokenizer_file())
    want = {d: tok.encode(t or "", add_special_tokens=False).ids + [2] for d, t in docs}
    by_doc, by_seq = {}, {}
    for r in rows:
        ids = np.array(want[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(ids.tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(want[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(want)
    for d, pieces in by_doc.items():
        at = 0
        for s, n in sorted(pieces):
            assert s == at
            at += n
        assert at == len(want[d])
    for pieces in by_seq.values():
        at = 0
        for s, n in sorted(pieces):
            assert s == at
            at += n
        assert at <= length and at & (at - 1) == 0


def test_pack_covers_every_id(spark):
    rng = np.random.default_rng(3)
    words = ["Été", "idiot's", "a b", "x́y", "<|endoftext|>", "12,5", "«Ça»", "don't", "\x85q", "ſtraße", "İI"]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 400)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, " \n\t"), (103, "word " * 9000)]
    rows = pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), tokenizer_file(), length=256, with_ids=False).collect()
    _check(rows, docs, 256)


def test_pack_other_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, start long, sequence_id long")
    assert [(r.doc_id, r.start, r.ids[-1]) for r in pack(df, tokenizer_file()).collect() if r.start + r.length == r.doc_tokens] == [(1, 2, 2)]
    assert pack(df.where("false"), tokenizer_file()).count() == 0


def test_level_is_the_least_sum_of_squares():
    rng = np.random.default_rng(1)
    p = Packer(64)
    for _ in range(500):
        size = int(rng.integers(1, 64))
        n = p.count[1:64].copy()
        best = None
        for at in range(0, 64 - size + 1):
            if at and not n[at - 1]:
                continue
            after = n.copy()
            if at:
                after[at - 1] -= 1
            if at + size < 64:
                after[at + size - 1] += 1
            cost = int((after**2).sum())
            best = cost if best is None else min(best, cost)
        p.put((0, 0, np.zeros(size, np.uint32), size))
        assert int((p.count[1:64] ** 2).sum()) == best


def test_word_caches_are_bounded(monkeypatch):
    import filigree.llm.packing as packing

    monkeypatch.setattr(packing, "CACHE", 5)
    monkeypatch.setattr(packing, "MOST_PRETOKENS", 4)
    monkeypatch.setattr(packing, "WARM", 2)
    w = WordIds(tokenizer_file(), 2)
    texts = ["one two three", "four five six seven", "", None, "one", "don't 12ab \u00d7 \u00fcber-\u00dcber <|x|> a|b", "\x7f \u0130I"]
    for t in texts * 2:
        ids, at = w.encode(pa.array([t, t], pa.string()))
        want = w.tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        assert ids.tolist() == want * 2 and at.tolist() == [0, len(want), 2 * len(want)]
        assert len(w.words.keys) <= 8
        w.forget()
        assert len(w.words.keys) <= 2 and len(w.pieces.keys) <= 2


def test_open_windows_are_placed_again(spark):
    rng = np.random.default_rng(5)
    docs = [(i % 50 if i % 7 else None, "word " * int(rng.integers(1, 200))) for i in range(2400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    rows = pack(df, tokenizer_file(), length=256).collect()
    assert sum(r.length for r in rows) == sum(len(t.split()) + 1 for _, t in docs)
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    share = lambda kind: sum(r.length for r in rows if r.filled == kind) / sum(r.length for r in rows)
    assert share("placement") > 0.7 and share("end") < 0.3
    whole = {r.sequence_id for r in rows}
    assert sum(256 == sum(r.length for r in rows if r.sequence_id == s) for s in whole) >= len(whole) - 8


def test_length_must_be_a_power_of_two(spark):
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "{}", length=100)
