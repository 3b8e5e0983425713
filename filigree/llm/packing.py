"""Packing documents into fixed-length token sequences by the sum-of-squares rule.

A document's ids are cut into whole windows of ``length`` and a remainder. Remainders are
placed online: among the fill levels that have an open window (and an empty one), the
document goes where the sum of squared counts of partially filled windows becomes least.
Counts per level are one array, so a placement is one vector operation.

Each input partition is packed by itself, in the order it is read. Pieces of windows that
stay open at its end go on to a second placement by the same rule, over the open windows of
many partitions (``rest_tokens`` tokens a task); only what is open there is closed: the
emptiest windows are cut up to top off the fullest, and the last remainder becomes sequences
whose lengths are powers of two. Nothing is padded. ``filled`` says how a sequence came
about: by one document (whole), by placement, or at the end. A task that is run again gives
the same sequences; their numbers are made of the task's and a number in it.

Tokenising: the tokenizer's own splitting never crosses ASCII white space, so ids are made
for words, once for each distinct word of a slice, and kept under the word's 64-bit hash.
New words of plain letters, digits and signs are split into the tokenizer's pretokens, of
which there are fewer; the tokenizer encodes new pretokens, and all other words as they are.
Both caches have a bound, drop what is used least, and shrink to WARM entries after a task.

Edge cases: null or empty text is a document of the closing id alone; a null id stays null;
equal rows are packed apart; a very long text is cut into whole windows as it comes; without
rows there are no pieces. Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm.words import Words, frugal, ramps, slices
from filigree.session import shared_table, ship_package, table

#: Bounds of the caches of a worker, and what of them outlives a task.
CACHE = 500_000
MOST_PRETOKENS = 250_000
WARM = 40_000
#: Pretokens of plain words in lower case, and the newline that ends a word.
_PIECES = re.compile(r"[a-z\u00df-\u017f]+|[0-9]|\n|[^a-z0-9\u00df-\u017f\n]+").findall
_BLANK = np.arange(256) == 32


def _plain_bytes() -> tuple[np.ndarray, np.ndarray]:
    """Bytes, and second bytes after 0xC3 to 0xC5, of words that are split into pretokens here.

    ASCII but the apostrophe and what special tokens need, and letters of Latin-1 and Latin
    Extended-A (without U+0130, whose lower case is two characters).
    """
    one = np.zeros(256, bool)
    one[0x21:0x7F] = True
    one[[ord("'"), ord("|")]] = False
    one[0xC3:0xC6] = True
    two = np.zeros((3, 256), bool)
    two[:, 0x80:0xC0] = True
    two[0, [0x97, 0xB7]] = False
    two[1, 0xB0] = False
    return one, two


_ONE, _TWO = _plain_bytes()


def _unplain(data: np.ndarray) -> np.ndarray:
    """Whether each byte makes its word one for the tokenizer's own splitting."""
    bad = ~_ONE[data]
    for lead in range(3):
        at = np.flatnonzero(data[:-1] == 0xC3 + lead) + 1
        bad[at] = ~_TWO[lead, data[at]]
    return bad


class _Rows:
    """Growing rows of ids, by number."""

    def __init__(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size, self.rows = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Rows of `sizes` ids each, one after the other in `ids`."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.rows + len(sizes) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[self.rows : self.rows + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[self.rows : self.rows + len(sizes)] = sizes
        self.used += len(ids)
        self.rows += len(sizes)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows, one after the other, and their sizes."""
        size = self.size[rows]
        return self.flat[np.repeat(self.at[rows], size) + ramps(size)], size


class _Cache:
    """Ids of words or pretokens by 64-bit hash; the least used go when there are too many."""

    def __init__(self, most: int) -> None:
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.keys, self.row = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.rows = _Rows()
        self.used = np.empty(0, np.int64)

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Places of the distinct keys that are not held."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))

    def add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """New keys and their ids, in the same order."""
        row = np.arange(self.rows.rows, self.rows.rows + len(keys))
        self.rows.add(ids, sizes)
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.row, self.used = (np.insert(x, at, y) for x, y in ((self.keys, keys[order]), (self.row, row[order]), (self.used, np.zeros(len(keys), np.int64))))

    def place(self, keys: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The rows of distinct keys, all of them held, which were used so many times."""
        at = np.searchsorted(self.keys, keys)
        self.used[at] += times
        return self.row[at]

    def keep(self, most: int) -> None:
        """Keep the `most` most used keys."""
        if len(self.keys) <= most:
            return
        at = np.sort(np.argpartition(self.used, len(self.used) - most)[len(self.used) - most :])
        keys, used = self.keys[at], self.used[at] // 2
        ids, sizes = self.rows.take(self.row[at])
        self._clear()
        self.add(keys, ids, sizes)
        self.used = used

    def room(self, n: int) -> None:
        """Make room for n more keys."""
        if len(self.keys) + n > self.most:
            self.keep(self.most // 2)


class WordIds:
    """Token ids of texts by way of bounded caches of words and of pretokens."""

    def __init__(self, tokenizer_json: str, closing: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.closing = closing
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words, self.pieces = _Cache(CACHE), _Cache(MOST_PRETOKENS)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many pretokens are encoded as one text; each ends with a token of its own kind."""
        out, size = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for start in range(0, len(pieces), 2000):
            part = pieces[start : start + 2000]
            ids = self._ids(" ".join(part))
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(part) and last[-1] == len(ids) - 1:
                size.append(np.diff(np.r_[-1, last]))
            else:
                own = [self._ids(one) for one in part]
                ids = np.concatenate(own)
                size.append(np.array([len(x) for x in own], np.int64))
            out.append(ids)
        return np.concatenate(out), np.concatenate(size)

    def _of_plain(self, words: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain words, which end with a newline each."""
        pieces = Words(pa.array([" ".join(_PIECES(words.decode().lower()))], pa.large_string()), space=_BLANK)
        closes = pieces.data[pieces.starts] == 10
        part = np.flatnonzero(~closes)
        own, first, back, times = np.unique(pieces.hashes[part], return_index=True, return_inverse=True, return_counts=True)
        self.pieces.room(len(own))
        new = self.pieces.missing(own)
        ids, size = self._of_pieces([pieces.text(i).decode() for i in part[first[new]].tolist()])
        self.pieces.add(own[new], ids, size)
        ids, size = self.pieces.rows.take(self.pieces.place(own, times)[back])
        last = np.flatnonzero(closes) - np.arange(1, closes.sum() + 1)
        return ids, np.diff(np.r_[0, np.cumsum(size)[last]])

    def _learn(self, words: Words, at: np.ndarray, keys: np.ndarray) -> None:
        """Add the words at these places, all different, with these keys."""
        bad = np.r_[0, np.cumsum(_unplain(words.data))]
        plain = bad[words.ends[at]] == bad[words.starts[at]]
        for part in np.array_split(at[plain], -(-int(plain.sum()) // 100_000) or 1):
            if len(part):
                size = words.ends[part] - words.starts[part] + 1
                place = np.repeat(words.starts[part], size) + ramps(size)
                text = words.data[np.minimum(place, len(words.data) - 1)]
                text[np.cumsum(size) - 1] = 10
                ids, count = self._of_plain(text.tobytes())
                self.words.add(words.hashes[part], ids, count)
        odd = at[~plain]
        if len(odd):
            own = [self._ids(words.text(i).decode()) for i in odd.tolist()]
            self.words.add(words.hashes[odd], np.concatenate(own), np.array([len(x) for x in own], np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the closing id, and the offsets of the texts in them."""
        words = Words(texts)
        own, first, back, times = np.unique(words.hashes, return_index=True, return_inverse=True, return_counts=True)
        self.words.room(len(own))
        new = self.words.missing(own)
        if len(new):
            self._learn(words, first[new], own[new])
        rows = self.words.place(own, times)[back]
        size = self.words.rows.size[rows]
        total = np.r_[0, np.cumsum(size)]
        at = total[words.at] + np.arange(len(words.at))
        ids = np.full(at[-1], self.closing, np.uint32)
        held = np.ones(at[-1], bool)
        held[at[1:] - 1] = False
        ids[held] = self.words.rows.take(rows)[0]
        return ids, at

    def forget(self) -> None:
        """Keep only what is most used, for the next task of this worker."""
        self.words.keep(WARM)
        self.pieces.keep(WARM)


_KEPT: dict[tuple[int, int], WordIds] = {}


def _word_ids(tokenizer_json: str, closing: int) -> WordIds:
    """The worker's tokenizer; of its caches only the most used WARM entries outlive a task."""
    key = (hash(tokenizer_json), closing)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = WordIds(tokenizer_json, closing)
    return _KEPT[key]


class Packer:
    """Sum-of-squares placement; pieces are (document, start, ids, tokens of the document)."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.count = np.zeros(length + 1, np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)

    def level(self, size: int) -> int:
        """The fill level (0: a new window) to put a piece of `size` < length at."""
        n = self.count
        before, after = n[: self.length - size + 1], n[size:]
        change = 2 * (after - before) + 2
        change[0] = 2 * n[size] + 1
        change[-1] = 1 - 2 * n[self.length - size]
        change[1:][before[1:] == 0] = np.iinfo(np.int64).max
        return int(np.argmin(change))

    def put(self, piece: tuple) -> list | None:
        """Place a piece; the window it fills, if it does."""
        size = len(piece[2])
        at = self.level(size)
        window = self.open[at].pop() if at else []
        if at:
            self.count[at] -= 1
        window.append(piece)
        if at + size == self.length:
            return window
        self.count[at + size] += 1
        self.open[at + size].append(window)
        return None

    def windows(self) -> list[list]:
        """The open windows, the fullest first; none is open then."""
        rest = [w for at in sorted(self.open, reverse=True) for w in self.open[at]]
        self.open.clear()
        self.count[:] = 0
        return rest

    def close(self) -> list[list]:
        """What is open becomes full windows and, last, windows of power-of-two lengths."""
        rest = self.windows()
        out, low = [], len(rest)
        loose: list = []  # pieces of the window that is being cut up, last first
        for i in range(len(rest)):
            if i >= low:
                break
            window = rest[i]
            need = self.length - sum(len(p[2]) for p in window)
            while need:
                if not loose:
                    if low - 1 <= i:
                        break
                    low -= 1
                    loose = rest[low][::-1]
                head, tail = _split(loose.pop(), need)
                window.append(head)
                need -= len(head[2])
                if tail is not None:
                    loose.append(tail)
            out.append(window)
        left = (out.pop() if out and sum(len(p[2]) for p in out[-1]) < self.length else []) + loose[::-1]
        total = sum(len(p[2]) for p in left)
        left = left[::-1]
        while total:
            size = min(self.length, 1 << (total.bit_length() - 1))
            window, need = [], size
            while need:
                head, tail = _split(left.pop(), need)
                window.append(head)
                need -= len(head[2])
                if tail is not None:
                    left.append(tail)
            out.append(window)
            total -= size
        return out


def _split(piece: tuple, size: int) -> tuple[tuple, tuple | None]:
    doc, start, ids, tokens = piece
    if len(ids) <= size:
        return piece, None
    return (doc, start, ids[:size], tokens), (doc, start + size, ids[size:], tokens)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, filled string"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "filled", "ids"]
#: How a sequence was filled: by one document, by placement, or from what was open at the end.
WHOLE, PLACED, CLOSED = "whole", "placement", "end"


class _Out:
    """Rows of pieces on their way out."""

    def __init__(self, base: int, with_ids: bool) -> None:
        self.base, self.with_ids, self.number = base, with_ids, 0
        self.rows: list[list] = [[] for _ in NAMES]

    def _add(self, *values) -> None:
        for c, v in zip(self.rows, values):
            c.append(v)

    def window(self, pieces: list, filled: str) -> None:
        """A finished sequence."""
        offset = 0
        for doc, start, ids, tokens in pieces:
            self._add(doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens, self.base + self.number, offset, filled, ids.view(np.int32) if self.with_ids else None)
            offset += len(ids)
        self.number += 1

    def rest(self, piece: tuple) -> None:
        """A piece without a sequence so far."""
        doc, start, ids, tokens = piece
        self._add(doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens, None, None, None, ids.view(np.int32))

    def take(self) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string(), pa.list_(pa.int32())]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.rows, kinds)], NAMES)
        for c in self.rows:
            c.clear()
        return batch


def _place(docs: DataFrame, tokenizer_json: str, length: int, closing: int, with_ids: bool) -> DataFrame:
    """The pieces of docs (doc, text); those of windows that stay open have no sequence yet."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one file of a fixed vocabulary

    def run(batches):
        words = _word_ids(shared.value, closing)
        packer = Packer(length)
        out = _Out(TaskContext.get().partitionId() << 33, with_ids)
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                flat, at = words.encode(part.column(1))
                flat = flat.astype("<u4")
                for doc, a, b in zip(part.column(0).to_pylist(), at.tolist(), at[1:].tolist()):
                    whole = b - (b - a) % length
                    for s in range(a, whole, length):
                        out.window([(doc, s - a, flat[s : s + length], b - a)], WHOLE)
                    if whole < b:
                        full = packer.put((doc, whole - a, flat[whole:b].copy(), b - a))
                        if full:
                            out.window(full, PLACED)
                    if len(out.rows[0]) >= 5000:
                        yield out.take()
        words.forget()
        for window in packer.windows():
            for piece in window:
                out.rest(piece)
        yield out.take()

    return docs.mapInArrow(frugal(run), PIECES + ", ids array<int>")


def _place_rest(rest: DataFrame, length: int, tasks: int, with_ids: bool) -> DataFrame:
    """Pieces of open windows, placed again among those of many partitions, then closed."""

    def run(batches):
        packer = Packer(length)
        out = _Out(1 << 62 | TaskContext.get().partitionId() << 33, with_ids)
        for batch in batches:
            flat = batch.column(3).flatten().to_numpy().astype("<u4")
            at = np.cumsum(batch.column(4).to_numpy()).tolist()
            for doc, start, tokens, a, b in zip(*(batch.column(k).to_pylist() for k in range(3)), [0, *at], at):
                full = packer.put((doc, start, flat[a:b], tokens))
                if full:
                    out.window(full, PLACED)
            yield out.take()
        for window in packer.close():
            out.window(window, CLOSED)
        yield out.take()

    by = rest.select("doc_id", "start", "doc_tokens", "ids", "length", "ids_crc32").repartition(tasks, "doc_id", "start", "ids_crc32")
    by = by.sortWithinPartitions(F.xxhash64("doc_id", "start", "ids_crc32"), "doc_id", "start", "ids_crc32")
    return by.mapInArrow(frugal(run), PIECES + ", ids array<int>")


def pack(docs: DataFrame, tokenizer_json: str, length: int = 4096, closing: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, rest_tokens: int = 1 << 22) -> DataFrame:
    """One row per piece of a document, with its ids unless with_ids is False.

    Pieces of a sequence lie without gaps from offset 0; those of a document cover it.
    """
    if length < 2 or length & (length - 1):
        raise ValueError("length must be a power of two")
    ship_package(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    first = shared_table(_place(docs, tokenizer_json, length, closing, with_ids), "pieces")
    rest = first.where("sequence_id is null")
    open_tokens = rest.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first().n
    second = _place_rest(rest, length, max(1, -(-open_tokens // rest_tokens)), with_ids)
    out = first.where("sequence_id is not null").unionByName(second)
    return out if with_ids else out.drop("ids")


def tokenizer_file(path: str | None = None) -> str:
    """The JSON of a public tokenizer; by default the 49k word BPE that is installed."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file(), with_ids=False)
