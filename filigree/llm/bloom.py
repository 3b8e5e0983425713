"""Bloom filters of 64-bit keys, built in Spark by segments and broadcast.

A key's segment is chosen by its hash, so segments are built by independent tasks and the
driver only joins their bytes. The total size is bounded by ``max_bytes`` whatever the
number of keys: beyond it the filter lets more through, and callers treat a hit as "maybe".
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.llm.words import U, frugal, mix

SEGMENT_BITS = 1 << 20


class Bloom:
    """Segments of SEGMENT_BITS bits in one byte array."""

    def __init__(self, bits: np.ndarray, segments: int, probes: int) -> None:
        self.bits, self.segments, self.probes = bits, segments, probes

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key], np.int64).view(np.uint64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        """For uint64 keys, whether each may be in the filter."""
        base = home(keys, self.segments) * SEGMENT_BITS
        found = np.ones(len(keys), bool)
        live = np.arange(len(keys))
        for at in places(keys, self.probes):
            p = base[live] + at[live]
            hit = (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
            found[live[~hit]] = False
            live = live[hit]
            if not len(live):
                break
        return found


def home(keys: np.ndarray, segments: int) -> np.ndarray:
    """The segment of each key: pmod(key, segments) as Spark has it for the signed key."""
    return keys.view(np.int64) % segments


def places(keys: np.ndarray, probes: int):
    """Bit places within a segment, one array for each probe."""
    a = mix(keys ^ U(0x5851F42D4C957F2D))
    step = (a >> U(32)) | U(1)
    for i in range(probes):
        yield ((a + step * U(i)) % U(SEGMENT_BITS)).astype(np.int64)


def segment(keys: np.ndarray, probes: int) -> bytes:
    bits = np.zeros(SEGMENT_BITS, bool)
    for at in places(keys, probes):
        bits[at] = True
    return np.packbits(bits, bitorder="little").tobytes()


def build(keys: DataFrame, n: int, max_bytes: int = 32 << 20, bits_per_key: int = 12, probes: int = 4) -> Bloom:
    """A filter over the one bigint column of `keys`, of which there are about n.

    n = 0 gives an empty filter. At most max_bytes reach the driver, as bytes of segments.
    """
    most = max(1, max_bytes * 8 // SEGMENT_BITS)
    segments = int(min(most, max(1, -(-n * bits_per_key // SEGMENT_BITS))))
    bits = np.zeros(segments * SEGMENT_BITS // 8, np.uint8)
    name = keys.columns[0]

    def parts(batches):
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            seg = home(k, segments)
            order = np.argsort(seg, kind="stable")
            k, seg = k[order], seg[order]
            cuts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]]) if len(seg) else []
            for i, c in enumerate(cuts):
                own = k[c : cuts[i + 1] if i + 1 < len(cuts) else len(k)]
                have = seen.setdefault(int(seg[c]), np.zeros(SEGMENT_BITS // 8, np.uint8))
                have |= np.frombuffer(segment(own, probes), np.uint8)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array([v.tobytes() for v in seen.values()], pa.binary())], ["seg", "bits"])

    if n:
        # Each task holds whole segments: keys meet by the JVM's hash of the segment's number.
        routed = keys.select(F.col(name).alias("k")).withColumn("s", F.pmod(F.col("k"), F.lit(segments)))
        rows = routed.repartition("s").select("k").mapInArrow(frugal(parts), "seg long, bits binary")
        for row in rows.toLocalIterator():
            at = row.seg * SEGMENT_BITS // 8
            bits[at : at + SEGMENT_BITS // 8] |= np.frombuffer(row.bits, np.uint8)
    return Bloom(bits, segments, probes)


def exclude(rows: DataFrame, ids: DataFrame, name: str, max_bytes: int = 32 << 20) -> DataFrame:
    """Rows, all columns, whose `name` is not among the bigint column of `ids` (null: stays).

    Rows that the filter rules out pass where they are read; only the others are shuffled
    for the exact anti join.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(build(ids, ids.count(), max_bytes))
    at = rows.columns.index(name)

    def side(inside: bool):
        def run(batches):
            for batch in batches:
                column = batch.column(at).cast(pa.int64())
                has = shared.value.has(column.fill_null(0).to_numpy().view(np.uint64))
                has &= ~column.is_null().to_numpy(zero_copy_only=False)
                part = batch.filter(pa.array(has if inside else ~has))
                if part.num_rows:
                    yield part

        return run

    maybe = rows.mapInArrow(frugal(side(True)), rows.schema)
    key = ids.columns[0]
    return rows.mapInArrow(frugal(side(False)), rows.schema).unionByName(maybe.join(ids.hint("shuffle_merge"), maybe[name] == ids[key], "left_anti"))
