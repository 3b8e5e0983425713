"""Near-duplicate documents by one-permutation MinHash, bands and star-shaped edges.

1. A document's set is its distinct word shingles (64-bit hashes; with fewer words than a
   shingle the whole sequence is one). Documents with equal sets (128-bit sum) form a class,
   represented by its least id.
2. One permutation: the hash range is cut into BINS equal bins, a bin's value is its least
   hash; empty bins copy the value of the first non-empty bin that a fixed probing order
   meets (optimal densification). ROWS bins make a band.
3. Representatives with an equal band value meet in a bucket; each bucket gives star edges
   to its least id, so edges are at most bands times representatives.
4. Edges are not links yet. A document is first compared, on full sets, with the one centre
   it shares most buckets with. What is linked so forms settled components.
5. A star's centre can be unlike two members that are alike, so buckets that hold more than
   one settled component are looked at again: members outside the bucket's largest
   component are compared with all its members, by matrix product, and only a spanning star
   of each linked set is returned. Buckets with the same members count once. Nothing is
   dropped: every pair that shares a bucket is settled or compared.
6. Components of all confirmed links are the result.

Members of a centre or bucket are dealt to blocks of at most about ``block`` members and
BLOCK_HASHES shingles, and each pair of blocks is a task of its own, so no group, however
large, meets in one task.

A pair at similarity 0.85 shares no band with probability (1 - 0.85**5)**32 = 7e-9, one
at 0.80 (the pipeline's stage) with probability 3e-6.

Edge cases: null and empty texts have an empty set and are linked with nothing; a null id
is returned with a null component and kept; equal rows fall in one class and are all kept
or all dropped (``drop_near_duplicates`` keeps one); rows that repeat an id with another
text are judged by their own sets; very long texts are compared whole; no rows, no result.
Only the id and text columns are read, so other columns may have any name and type.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm import bloom
from filigree.llm.components import connected_components
from filigree.llm.words import U, Words, frugal, mix, ramps, signed, slices, windows
from filigree.session import shared_table, ship_package, table

BINS, ROWS = 160, 5
BANDS = BINS // ROWS
PROBES = 1 << 12
SHINGLE = 5
BLOCK_HASHES = 1 << 20
_PROBE = np.random.default_rng(7).integers(0, BINS, (PROBES, BINS))
_ODD = np.random.default_rng(11).integers(0, 2**63, BINS, dtype=np.uint64) * U(2) + U(1)


def shingle_sets(words: Words, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and row offsets into them."""
    n = words.counts
    starts = words.window_starts(shingle)
    row = words.rows()[starts] if len(starts) else np.empty(0, np.int64)
    h = windows(words.hashes, shingle)[starts] if len(starts) else np.empty(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < shingle))
    if len(short):
        whole = [windows(words.hashes[words.at[i] : words.at[i + 1]], int(n[i]), 0xD1B54A32D192ED03)[0] for i in short]
        h, row = np.r_[h, np.array(whole, np.uint64)], np.r_[row, short]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(n) + 1))


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Densified one-permutation signatures, a row of BINS values for each non-empty set."""
    n = np.diff(at)
    full = np.flatnonzero(n)
    value = np.zeros((len(full), BINS), np.uint64)
    filled = np.zeros((len(full), BINS), bool)
    if not len(full):
        return value
    number = np.repeat(np.cumsum(n > 0) - 1, n)
    bins = (((h >> U(32)) * U(BINS)) >> U(32)).astype(np.int64)
    first = np.ones(len(h), bool)
    first[1:] = (bins[1:] != bins[:-1]) | (number[1:] != number[:-1])
    value[number[first], bins[first]] = h[first]
    filled[number[first], bins[first]] = True
    had, source = filled.copy(), value.copy()
    for attempt in range(PROBES):
        r, b = np.nonzero(~filled)
        if not len(r):
            break
        donor = _PROBE[attempt, b]
        ok = had[r, donor]
        value[r[ok], b[ok]] = source[r[ok], donor[ok]]
        filled[r[ok], b[ok]] = True
    for r in np.flatnonzero(~filled.all(1)):  # as good as never: a bin that no probe served
        value[r, ~filled[r]] = source[r, np.flatnonzero(had[r])[0]]
    return value


def bands(signature: np.ndarray) -> np.ndarray:
    mixed = (mix(signature) * _ODD).reshape(len(signature), BANDS, ROWS)
    return mix(mixed.sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc, n, set1, set2, bands) of each row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                h, at = shingle_sets(Words(part.column(1), lower=True), shingle)
                n = np.diff(at)
                keys = signed(bands(signatures(h, at)).reshape(-1))
                sums = []
                for salt in (U(0), U(0x2545F4914F6CDD1D)):
                    total = np.r_[U(0), np.cumsum(mix(h ^ salt))]
                    sums.append(signed(total[at[1:]] - total[at[:-1]]))
                offsets = np.r_[0, np.cumsum((n > 0) * BANDS)].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))],
                    ["doc", "n", "set1", "set2", "bands"],
                )

    return docs.mapInArrow(frugal(run), "doc long, n long, set1 long, set2 long, bands array<long>")


def _sets_of(docs: DataFrame, chosen: bloom.Bloom, shingle: int) -> DataFrame:
    """(node, set1, hashes) of the documents that may be in `chosen`."""
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def run(batches):
        for batch in batches:
            part = batch.filter(pa.array(shared.value.has(batch.column(0).to_numpy().view(np.uint64))))
            for part in slices(part, 1, 4 << 20):
                h, at = shingle_sets(Words(part.column(1), lower=True), shingle)
                total = np.r_[U(0), np.cumsum(mix(h))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(signed(total[at[1:]] - total[at[:-1]])), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(signed(h)))],
                    ["node", "set1", "hashes"],
                )

    return docs.mapInArrow(frugal(run), "node long, set1 long, hashes array<long>")


def linked(h: np.ndarray, at: np.ndarray, percent: int, width: int = 4096) -> np.ndarray:
    """For each set the least index of a set it is linked with, over any number of links.

    Sets are linked if 100 * intersection >= percent * union. Counts come from a product of
    incidence matrices, `width` shingles at a time; shingles of one set alone are left out.
    """
    n = np.diff(at)
    m = len(n)
    row = np.repeat(np.arange(m), n)
    order = np.argsort(h, kind="stable")
    hs, rows = h[order], row[order]
    new = np.ones(len(hs), bool)
    new[1:] = hs[1:] != hs[:-1]
    column = np.cumsum(new) - 1
    often = np.bincount(column, minlength=1) > 1 if len(column) else np.zeros(1, bool)
    keep = often[column] if len(column) else np.zeros(0, bool)
    column = (np.cumsum(often) - 1)[column[keep]]
    rows = rows[keep]
    both = np.zeros((m, m), np.float64)
    last = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, last, width):
        a, b = np.searchsorted(column, (start, start + width))
        block = np.zeros((m, min(width, last - start)), np.float32)
        block[rows[a:b], column[a:b] - start] = 1
        both += block @ block.T
    link = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    np.fill_diagonal(link, True)
    label = np.arange(m)
    while True:
        least = np.where(link, label[None, :], m).min(1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _flat(lists: pa.Array, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of lists in an order, one after the other, and the sizes of the lists."""
    start = lists.offsets.to_numpy()
    n = np.diff(start)[order]
    return lists.values.to_numpy().view(np.uint64)[np.repeat(start[:-1][order], n) + ramps(n)], n


def _parts(block: int, rows: Column, hashes: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / block), F.ceil(hashes / BLOCK_HASHES)).cast("int")


def _settled(met: DataFrame, full: DataFrame, percent: int, block: int) -> DataFrame:
    """(node, to): each document of `met` (key, doc, n, centre) that is linked with its likeliest centre."""
    shared = met.where("doc > centre").groupBy("doc", "centre").agg(F.count("*").alias("times"), F.max("n").alias("n"))
    best = shared.groupBy("doc").agg(F.max_by("centre", F.struct("times", -F.col("centre"))).alias("centre"), F.max("n").alias("n"))
    best = shared_table(best, "best-centres")
    sizes = best.groupBy("centre").agg(_parts(block, F.count("*"), F.sum("n")).alias("parts"))
    sizes = shared_table(sizes, "centre-sizes")
    part = F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")
    own = best.join(sizes.hint("shuffle_merge"), "centre").select("centre", part.alias("part"), F.col("doc").alias("node"))
    middle = sizes.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("centre").alias("node"))
    dealt = own.union(middle).join(full.hint("shuffle_merge"), "node")

    def confirm(group: pa.Table) -> pa.Table:
        node, centre = group.column("node").to_numpy(), group.column("centre")[0].as_py()
        lists = group.column("hashes").combine_chunks()
        middles, rest = np.flatnonzero(node == centre), np.flatnonzero(node != centre)
        h, n = _flat(lists, rest)
        ends = np.r_[0, np.cumsum(n)]
        linked = np.zeros(len(rest), bool)
        for k in middles:  # one, unless rows repeat an id with other texts
            c, _ = _flat(lists, np.array([k]))
            at = np.searchsorted(c, h)
            at[at == len(c)] = 0
            both = np.diff(np.r_[0, np.cumsum(c[at] == h)][ends])
            linked |= 100 * both >= percent * (n + len(c) - both)
        found = np.unique(node[rest[linked]])
        return pa.table({"node": found, "to": np.full(len(found), centre, np.int64)})

    return dealt.groupBy("centre", "part").applyInArrow(confirm, "node long, to long")


def _unsettled(met: DataFrame, settled: DataFrame, full: DataFrame, percent: int, block: int) -> DataFrame:
    """(node, to): links within buckets of `met` that hold several settled components."""
    known = settled.select(F.col("node").alias("doc"), F.col("component"))
    of = met.join(known.hint("shuffle_merge"), "doc", "left").select("key", "doc", "n", F.coalesce("component", "doc").alias("own"))
    of = shared_table(of, "met-components")
    mark = (F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y"))
    counts = of.groupBy("key", "own").agg(F.count("*").alias("m"), *mark)
    mains = counts.groupBy("key").agg(F.max_by("own", F.struct("m", -F.col("own"))).alias("main"), F.count("*").alias("kinds"), F.sum("m").alias("m"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    mains = mains.where("kinds > 1").groupBy("m", "x", "y").agg(F.min(F.struct("key", "main")).alias("k")).select("k.key", "k.main")
    mixed = of.join(shared_table(mains, "mixed-buckets").hint("shuffle_merge"), "key").select("key", "doc", "n", (F.col("own") != F.col("main")).alias("apart"))
    mixed = shared_table(mixed, "mixed")
    sizes = mixed.groupBy("key").agg(
        _parts(block, F.count_if("apart"), F.sum(F.when(F.col("apart"), F.col("n")).otherwise(0))).alias("a"),
        _parts(block, F.count_if(~F.col("apart")), F.sum(F.when(F.col("apart"), 0).otherwise(F.col("n")))).alias("m"),
    )
    # Blocks 0 to a-1 hold what stands apart, blocks a to a+m-1 the main component.
    h = F.xxhash64("doc", F.lit(2))
    own = F.when(F.col("apart"), F.pmod(h, F.col("a"))).otherwise(F.col("a") + F.pmod(h, F.col("m"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("apart"), F.col("a") + F.col("m")).otherwise(F.col("a")) - 1)
    pairs = F.transform(others, lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    dealt = mixed.join(shared_table(sizes, "bucket-sizes").hint("shuffle_merge"), "key").withColumn("own", own).withColumn("ij", F.explode(pairs))
    dealt = dealt.select("key", "ij.i", "ij.j", F.col("doc").alias("node")).join(full.hint("shuffle_merge"), "node")

    def confirm(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        order = np.argsort(node, kind="stable")
        h, n = _flat(group.column("hashes").combine_chunks(), order)
        node = node[order]
        to = node[linked(h, np.r_[0, np.cumsum(n)], percent)]
        own = node != to
        return pa.table({"node": node[own], "to": to[own]})

    return dealt.groupBy("key", "i", "j").applyInArrow(confirm, "node long, to long")


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = SHINGLE, block: int = 256, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id is its component's least) per row."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    whole = docs.where("doc is not null")
    sig = shared_table(_signed(whole, shingle), "signatures")
    sets = sig.where("n > 0")
    classes = shared_table(sets.groupBy("set1", "set2").agg(F.min("doc").alias("rep")), "classes")
    members = sets.select("doc", "n", "set1", "set2").join(classes.hint("shuffle_merge"), ["set1", "set2"]).select("doc", "n", "rep")
    reps = sets.join(classes.select("set1", "set2", F.col("rep").alias("doc")).hint("shuffle_merge"), ["set1", "set2", "doc"])
    buckets = shared_table(reps.select("doc", F.col("n").cast("int"), F.explode("bands").alias("key")), "buckets")
    centres = buckets.groupBy("key").agg(F.min("doc").alias("centre"), F.max("doc").alias("last")).where("centre < last").select("key", "centre")
    met = shared_table(buckets.join(shared_table(centres, "centres").hint("shuffle_merge"), "key").distinct(), "met")
    nodes = shared_table(met.select("doc").distinct(), "nodes")
    found = bloom.build(nodes, nodes.count(), filter_bytes)
    full = shared_table(_sets_of(whole, found, shingle).dropDuplicates(["node", "set1"]).select("node", "hashes"), "sets")
    links = shared_table(_settled(met, full, percent, block), "settled-links")
    settled = shared_table(connected_components(links), "settled")
    more = shared_table(_unsettled(met, settled, full, percent, block), "further-links")
    final = shared_table(connected_components(links.union(more)).select(F.col("node").alias("rep"), "component"), "components")
    out = members.join(final.hint("shuffle_merge"), "rep", "left")
    out = out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    alone = sig.where("n = 0").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("doc").alias("component_id"))
    nameless = _signed(docs.where("doc is null"), shingle).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("doc").alias("component_id"))
    return out.union(alone).union(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, with one document of each component.

    Rows with equal id and text count once: the one whose JSON is least stays. Rows without
    an id stay, as do null and empty texts. Columns may have any names and types.
    """
    found = near_duplicates(docs, **options)
    name, text = options.get("id_col", "doc_id"), options.get("text_col", "text")
    gone = shared_table(found.where("not kept").select("doc_id").distinct(), "near-copies")
    again = shared_table(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    left = bloom.exclude(docs, gone, name)
    once = bloom.exclude(left, again, name)
    rows = left.select(F.struct("*").alias("row")).select("row", F.col("row").getField(name).alias("id"), F.col("row").getField(text).alias("text"))
    twice = rows.join(again.withColumnRenamed("doc_id", "id").hint("shuffle_merge"), "id", "left_semi").groupBy("id", "text").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return once.unionByName(twice.select("row.*"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The whole operator in SQL for small tables: all pairs that share a shingle, then closure.
OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(words[i : i + 4], ' ')) AS g
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(1, len(words) - 4))) AS i FROM w WHERE len(words) > 0)
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS MATERIALIZED (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
    FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
  ) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * p.c >= 85 * (na.n + nb.n - p.c)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM w
  UNION
  SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN c ON c.doc_id = w.doc_id
"""
