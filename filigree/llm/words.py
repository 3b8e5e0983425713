"""Vectorised words and hashes of Arrow text columns.

A word is a maximal run of bytes other than space and 0x09-0x0D, as in
``[^\\x20\\x09-\\x0D]+``. Word hashes are polynomial (Rabin-Karp) sums modulo 2**64 over
a random byte table; hashes of word windows are the same sums over word hashes. Both come
from running sums, so the cost is a few vector operations per byte or word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

U = np.uint64
CHUNK = (1 << 18) - 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: For tokens: every ASCII character that is no letter or digit separates.
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_RNG = np.random.default_rng(20_240_607)
BYTES = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BYTES_LOWER = BYTES.copy()
BYTES_LOWER[65:91] = BYTES[97:123]
WORD_BASE = 0x9E3779B97F4A7C15
WINDOW_BASES = (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 2**64)):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        out.append(p)
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; tables of up to 2**20 are kept for a task."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        held = _powers(base, 1 << max(10, int(n - 1).bit_length()))
        if len(held[0]) <= 1 << 20:
            _POWERS[base] = held
    return held[0][:n], held[1][:n]


def release() -> None:
    """Give back what a task leaves in its worker: tables, Arrow's and the C library's free memory."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, a function over batches, that leaves a small worker behind for the next task."""

    def guarded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return guarded


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits depend on all bits."""
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def slices(batch: pa.RecordBatch, text: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices holding at most `limit` bytes of text, or one row."""
    column = batch.column(text)
    if not len(column):
        return
    sizes = np.nan_to_num(np.asarray(pa.compute.binary_length(column).to_numpy(zero_copy_only=False), float))
    total, start = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and its row offsets into them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("") if texts.null_count else texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """Words of each row: byte bounds, hashes, and row offsets into them."""

    def __init__(self, texts: pa.Array, lower: bool = False, space: np.ndarray = SPACE) -> None:
        self.space = space
        self.data, self.bytes_at = raw(texts)
        table = BYTES_LOWER if lower else BYTES
        starts, ends, hashes = [], [], []
        at, n = 0, len(self.data)
        while at < n:
            to = min(n, at + CHUNK)
            if to < n:
                to = self._cut(at, to)
            s, e, h = self._chunk(at, to, table)
            starts.append(s)
            ends.append(e)
            hashes.append(h)
            at = to
        none = np.empty(0, np.int64)
        self.starts = np.concatenate([none, *starts])
        self.ends = np.concatenate([none, *ends])
        self.hashes = np.concatenate([np.empty(0, np.uint64), *hashes])
        self.at = np.searchsorted(self.starts, self.bytes_at)
        self.counts = np.diff(self.at)

    def _cut(self, at: int, to: int) -> int:
        """A place in or after [at, to) where no word goes across."""
        back = np.flatnonzero(self.space[self.data[at:to]])
        if len(back):
            return at + int(back[-1]) + 1
        while to < len(self.data):
            ahead = np.flatnonzero(self.space[self.data[to : to + CHUNK]])
            if len(ahead):
                return to + int(ahead[0]) + 1
            to += CHUNK
        return len(self.data)

    def _chunk(self, at: int, to: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = self.data[at:to]
        full = ~self.space[b]
        bound = np.zeros(len(b) + 1, bool)
        rows = self.bytes_at[np.searchsorted(self.bytes_at, at) : np.searchsorted(self.bytes_at, to, "right")]
        bound[rows - at] = True
        bound[[0, -1]] = True
        opens, closes = bound[:-1].copy(), bound[1:].copy()
        opens[1:] |= ~full[:-1]
        closes[:-1] |= ~full[1:]
        s = np.flatnonzero(full & opens)
        e = np.flatnonzero(full & closes) + 1
        up, down = powers(WORD_BASE, len(b) + 1)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(table[b] * up[:-1], out=total[1:])
        return s + at, e + at, mix((total[e] - total[s]) * down[s])

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, size: int, base: int = WINDOW_BASES[0]) -> np.ndarray:
        """Hashes of the windows of `size` words that start at each word, rows ignored."""
        return windows(self.hashes, size, base)

    def window_starts(self, size: int) -> np.ndarray:
        """The words at which a window of `size` words of one row starts."""
        n = np.maximum(self.counts - size + 1, 0)
        return np.repeat(self.at[:-1], n) + ramps(n)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def windows(h: np.ndarray, size: int, base: int = WINDOW_BASES[0]) -> np.ndarray:
    if len(h) < size:
        return np.empty(0, np.uint64)
    up, down = powers(base, len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:-1], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[: len(h) - size + 1])


def ramps(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ..."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n, n)


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """min(a[i : i + width]) for each i with a whole window."""
    if len(a) < width:
        return a[:0]
    out, have = a, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(a) - width + 1], out[width - have :][: len(a) - width + 1])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
