"""Chunks of sections: a recursive splitter and table packing behind one table function.

Packing depends on what was packed before, so it is the one stage of text preparation that
runs in Python: a mapInPandas over (doc_id, section) rows, with no shuffle of its own.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate, groupby, takewhile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filigree import fixed
from filigree.config import SETTINGS
from filigree.session import ship_package

SEPARATORS, CONTEXT = fixed.SPLIT_AT, fixed.CAPTION_CHARS
_NUMBER, _GAP, _PERIOD, _FOOTER = map(re.compile, (fixed.TABLE_NUMBER, fixed.TABLE_GAP, fixed.TABLE_PERIOD, fixed.PAGE_FOOTER))


class Splitter:
    """Packs pieces up to `size` characters, with `overlap` carried into the next piece."""

    def __init__(self, size: int = SETTINGS.chunk_max_chars, overlap: int = SETTINGS.chunk_overlap) -> None:
        self.size, self.overlap = size, overlap

    def split(self, text: str, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
        level = next(k for k, s in enumerate(separators) if s == "" or s in text)
        separator, finer = separators[level], separators[level + 1 :]
        pieces = list(text) if separator == "" else self._cut(text, separator)
        out: list[str] = []
        small: list[str] = []
        for piece in pieces:
            if len(piece) < self.size:
                small.append(piece)
                continue
            out += self._pack(small)
            small = []
            out += self.split(piece, finer) if finer else [piece]
        return out + self._pack(small)

    @staticmethod
    def _cut(text: str, separator: str) -> list[str]:
        """Pieces that begin with the separator, but for the first."""
        first, *rest = text.split(separator)
        return [p for p in [first, *(separator + r for r in rest)] if p]

    def _pack(self, pieces: list[str]) -> list[str]:
        out: list[str] = []
        held: list[str] = []
        total = 0
        for piece in pieces:
            if held and total + len(piece) > self.size:
                out.append("".join(held).strip())
                while held and (total > self.overlap or total + len(piece) > self.size):
                    total -= len(held.pop(0))
            held.append(piece)
            total += len(piece)
        if held:
            out.append("".join(held).strip())
        return [p for p in out if p]


def is_table_line(line: str) -> bool:
    line = line.strip()
    if line.count("|") >= 2:
        return True
    return bool(line) and len(_NUMBER.findall(line)) >= 3 and len(_GAP.findall(line)) >= 2


def spans_that_fit(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive spans of rows, each as long as `most` characters with line breaks allow.

    A row longer than that is a span of its own. The ends come from running lengths.
    """
    upto = [0, *accumulate(n + 1 for n in sizes)]
    at = 0
    while at < len(sizes):
        end = max(at + 1, bisect_right(upto, upto[at] + most + 1) - 1)
        yield at, end
        at = end


def pack_table(rows: list[str], splitter: Splitter) -> list[str]:
    """Spans of whole rows; each but the first has the head rows above it where they fit.

    Head rows are the first two at most, while they hold no number or name a period.
    """
    rows = [r.rstrip() for r in rows if r.strip()]
    heads = list(takewhile(lambda r: not _NUMBER.search(r) or _PERIOD.search(r), rows[:2]))
    out: list[str] = []
    for at, end in spans_that_fit([len(r) for r in rows], splitter.size):
        if len(rows[at]) > splitter.size:
            out += splitter.split(rows[at])
            continue
        bare = "\n".join(rows[at:end])
        topped = "\n".join(heads + rows[at:end])
        out.append(bare if rows[at:end][: len(heads)] == heads or len(topped) > splitter.size + CONTEXT else topped)
    return [p for p in map(str.strip, out) if p]


def caption(lines: list[str]) -> str:
    """What stands above a table: the last prose line, with the one before it if there is room."""
    tail = [x.strip() for x in lines if x.strip()][-5:]
    prose = [x[-CONTEXT:].strip() for x in tail if not is_table_line(x) and not _FOOTER.search(x)]
    return "\n".join(prose[-1:] if prose and len(prose[-1]) >= CONTEXT else prose[-2:])


def split_section(text: str, splitter: Splitter) -> list[str]:
    """Chunks of one section: its lines as runs of table lines and of others, each cut by its own rule."""
    runs = [(table, list(lines)) for table, lines in groupby(text.splitlines(), is_table_line)]
    # The caption of a run of table lines is that of the nearest run before it that has one.
    captions = list(accumulate(("" if table else caption(lines) for table, lines in runs), lambda last, own: own or last))
    out: list[str] = []
    for (table, lines), above in zip(runs, captions):
        if not table:
            out += splitter.split("\n".join(lines)) if any(lines) else []
            continue
        for piece in pack_table(lines, splitter):
            fits = above and above not in piece and len(above) + 1 + len(piece) <= splitter.size + CONTEXT
            out.append(f"{above}\n{piece}" if fits else piece)
    return [p for p in map(str.strip, out) if p]


def slug(name: Column) -> Column:
    words = F.regexp_extract_all(name, F.lit("[A-Za-z0-9]+"), F.lit(0))
    joined = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")
    return F.coalesce(F.nullif(F.substring(joined, 1, 30), F.lit("")), F.lit("Section"))


def chunks(cleaned: DataFrame, sections: DataFrame, size: int = SETTINGS.chunk_max_chars, overlap: int = SETTINGS.chunk_overlap) -> DataFrame:
    """(id, doc_id, chunk_index, section, section_index, section_chunk_index, text, content_hash)."""
    ship_package(cleaned.sparkSession)
    parts = cleaned.select("doc_id", "text").join(sections, "doc_id")
    parts = parts.select("doc_id", "section_index", F.col("section_name").alias("section"), F.expr("substring(text, start + 1, end - start)").alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter = Splitter(size, overlap)
        for frame in frames:
            rows = [(d, s, name, k, p) for d, s, name, text in frame.itertuples(index=False) for k, p in enumerate(split_section(text, splitter))]
            yield pd.DataFrame(rows, columns=["doc_id", "section_index", "section", "section_chunk_index", "text"])

    out = parts.mapInPandas(run, "doc_id string, section_index int, section string, section_chunk_index int, text string")
    doc = W.partitionBy("doc_id").orderBy("section_index", "section_chunk_index")
    out = out.withColumn("chunk_index", F.row_number().over(doc) - 1)
    plain = F.concat_ws("", "doc_id", F.lit("__"), slug(F.col("section")), F.lit("_c"), F.lpad(F.col("section_chunk_index").cast("string"), 2, "0"))
    plain = F.when(F.col("section_chunk_index") > 99, F.concat_ws("", "doc_id", F.lit("__"), slug(F.col("section")), F.lit("_c"), F.col("section_chunk_index").cast("string"))).otherwise(plain)
    out = out.withColumn("_id", plain)
    again = F.row_number().over(W.partitionBy("doc_id", "_id").orderBy("chunk_index")) > 1
    out = out.withColumn("id", F.when(again, F.concat_ws("_", "_id", "chunk_index")).otherwise(F.col("_id")))
    return out.select("id", "doc_id", "chunk_index", "section", "section_index", "section_chunk_index", "text", F.sha2("text", 256).alias("content_hash"))
