"""Toxicity, quality and URL filters: parts by brute force, wholes by held-out accuracy."""

import random
import zlib

import pytest

from filigree.llm import quality_classifier as QC
from filigree.llm import toxicity as TX
from filigree.llm.url_filter import HOST_RULES, RuleIndex, UrlRule, filter_urls, parse_rules, split_url


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_edit_distance():
    rng = random.Random(3)
    for _ in range(2000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(2))
        m = TX.Automaton(a, 1)
        state = m.start()
        for c in b:
            state = m.step(state, c)
        d = m.distance(state) if state else None
        assert d == (distance(a, b) if distance(a, b) <= 1 else None), (a, b)


def test_lexicon_matches():
    lexicon = TX.Lexicon({"idiot": 4.0, "scum": 3.0}, {"lowei": 2.0}, frozenset())
    assert lexicon.match("idiot") == ("idiot", 4.0, 0) and lexicon.match("id1ot")[0] == "idiot" and lexicon.match("idiots")[2] == 1
    assert lexicon.match("scums") is None and lexicon.match("loweischaft") == ("lowei", 2.0, 0) and lexicon.match("lowei") is None
    assert TX.Lexicon({"idiot": 4.0}, {}, frozenset({"idiot"})).match("id1ot") is None
    s = TX.Scanner(lexicon)
    plain, quoted = s.features("you idiot idiot"), s.features('he said "you idiot idiot" today')
    assert plain[0] > quoted[0] > 0 and s.features("")[5] == 0 and s.features("fine words")[0] == 0


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(7)
    words = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(600):
        toxic, good = i % 4 == 0, i % 3 != 0
        text = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        if toxic:
            text[5:5] = [rng.choice(["nastyfool", "vilescum", "rottenrat"]) for _ in range(3)]
        if not good:
            text = [w.upper() + "!!" for w in text]
        docs.append((i, " ".join(text)))
        labels.append((i, int(good), int(toxic)))
    docs += [(1000, None), (1001, ""), (None, "x")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {d: (g, t) for d, g, t in labels}


@pytest.mark.parametrize("module,place", [(QC, 0), (TX, 1)])
def test_held_out_accuracy(judged, module, place):
    docs, labels, truth = judged
    rows = module.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert len(held) > 60 and sum(r.predicted == truth[r.doc_id][place] for r in held) / len(held) > 0.95
    assert all(r.predicted == (r.score >= (0.5 if place else 0.3)) for r in rows)


@pytest.mark.parametrize("module", [QC, TX])
def test_edges(edges, labels, module):
    rows = module.classify(edges, labels).collect()
    assert len(rows) == edges.count() and all(0 <= r.score <= 1 for r in rows)
    none = module.classify(edges, labels.where("false")).collect()
    assert {round(r.score, 6) for r in none} == {0.5}
    assert module.classify(edges.where("false"), labels).count() == 0


def test_drop_toxic(judged):
    docs, labels, truth = judged
    wide = docs.selectExpr("text as score", "doc_id", "text")
    left = TX.drop_toxic(wide, labels)
    ids = {r.doc_id for r in left.collect()}
    assert left.columns == wide.columns and {1000, 1001, None} <= ids
    assert sum(truth[i][1] for i in ids if i in truth) <= 3 and sum(not truth[i][1] for i in ids if i in truth) >= 445


URLS = [None, "", "no scheme", "http://A.Example.COM/en/70?x", "https://x.net/de/1#y", "HTTP://example.net/de/8", "ftp://org/es/", "https://spam-farm.org/a", "http://h", "http://h?x=/en/", "x://y://com/en/", "http://evilcom/en/", "http://a.com/EN/"]


def test_urls(spark):
    def want(url):
        host, path = split_url(url)
        fits = [r for r in HOST_RULES for h, p in [(r.name[: r.name.index("/")], r.name[r.name.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        verdict = best.verdict if best else "block" if url and "spam-farm" in url else "allow"
        return host, path, best and best.name, verdict

    pages = spark.createDataFrame(list(enumerate(URLS)) + [(3, URLS[3]), (None, URLS[4])], "page_id long, url string")
    got = filter_urls(pages).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        url = URLS[r.page_id] if r.page_id is not None else URLS[4]
        assert (r.host, r.path, r.rule, r.verdict) == want(url), url
    assert filter_urls(pages.where("false")).count() == 0


def test_index_uses_the_rarest_token():
    rules = (UrlRule("a", "common.*rare", "block", ("common", "rare")), UrlRule("any", "zzz", "block"))
    index = RuleIndex(rules, {"common": 9, "rare": 1})
    assert index.by_token == {"rare": [0]} and index.candidates("http://common/") == [1] and index.candidates("http://common/rare") == [0, 1]
    assert index.decide("http://common/rare", "common/rare", None, None, None) == (None, None, "block") and not index.__getstate__()["_compiled"]


def test_many_rules_in_shards(spark):
    lines = ["! a list", "", *(f"||host{i}.com/a/" for i in range(20_000)), "@@||host5.com/a/b", "||x.host5.com/a/b", "some phrase", "@@Other Words", "---"]
    rules = list(parse_rules(lines))
    assert len(rules) == 20_004
    urls = ["http://host7.com/a/1", "http://www.host7.com/b", "http://host5.com/a/bc", "http://x.host5.com/a/b", "http://y/some-phrase", "http://y/other_words/some-phrase", "http://y/" + "long/" * 50_000 + "some-phrase", None]
    pages = spark.createDataFrame([(k, u, "x", "y", "z") for k, u in enumerate(urls)], "page_id long, url string, rule string, host string, pattern string")
    want = {0: ("host7.com/a/", "block"), 1: (None, "allow"), 2: ("host5.com/a/b", "allow"), 3: ("x.host5.com/a/b", "block"), 4: (None, "block"), 5: (None, "block"), 6: (None, "block"), 7: (None, "allow")}
    for shard in (100_000, 7_000):
        assert {r.page_id: (r.rule, r.verdict) for r in filter_urls(pages, rules, shard=shard).collect()} == want


def test_the_first_of_equally_long_rules_decides(spark):
    pages = spark.createDataFrame([(1, "http://a.bc/d/")], "page_id long, url string")
    rules = [UrlRule("a.bc/d", r"^a\.bc/d", "allow", (), True), UrlRule("bc/d/ ", r"bc/d/", "block", (), True)]
    assert filter_urls(pages, rules).first().verdict == "allow" and filter_urls(pages, rules[::-1]).first().verdict == "block"
    assert filter_urls(pages, []).first().verdict == "allow"
