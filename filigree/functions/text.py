"""Text expressions: tokens, trimming, positions, cleaning. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filigree import fixed


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokenize(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def squeeze(text: Column) -> Column:
    """White space runs become one space; none is left at the ends."""
    return strip(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def unique(items: Column) -> Column:
    """In order of first appearance, without empty strings."""
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def match_positions(text: Column, pattern: str) -> Column:
    """Array of (start, match) of every match, start in code points from 0."""
    pieces = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def of(zipped: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,match:string>>").alias("out"))

        def step(a: Column, x: Column) -> Column:
            here = a["at"] + x["before"]
            entry = F.struct(here.cast("int").alias("start"), x["match"].alias("match"))
            return F.struct((here + F.length(x["match"])).alias("at"), F.concat(a["out"], F.array(entry)).alias("out"))

        return F.aggregate(zipped, start, step, lambda a: a["out"])

    zipped = F.arrays_zip(pieces.alias("before"), found.alias("match"))
    return of(F.filter(zipped, lambda x: x["match"].isNotNull()))


# --- cleaning ------------------------------------------------------------------------------


def header_of(raw: Column) -> Column:
    """What stands before the separator; empty without one."""
    parts = F.split(raw, fixed.HEADER_END, 2)
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(0))).otherwise(F.lit(""))


def body_of(raw: Column) -> Column:
    """What stands behind the separator; everything without one."""
    parts = F.split(raw, fixed.HEADER_END, 2)
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(1))).otherwise(raw)


def from_anchor(body: Column) -> Column:
    """From the first prose anchor on; everything without one."""
    at = F.regexp_instr(body, F.lit(fixed.PROSE_ANCHOR))
    return F.when(at > 0, F.substring(body, at, F.length(body))).otherwise(body)


def is_tabular(line: Column) -> Column:
    return line.contains("|") | line.contains("/s/") | (F.regexp_count(line, F.lit(r"(?U)\S {2,}\S")) >= 2)


def normal_line(line: Column) -> Column:
    """Tabs become spaces, the end is trimmed; outside tables space runs become one."""
    plain = F.regexp_replace(F.translate(line, "\t", " "), r"(?U)[\s\x1c-\x1f]+$", "")
    return F.when(is_tabular(plain), plain).otherwise(F.regexp_replace(plain, " {2,}", " "))


def strip_markup(text: Column) -> Column:
    for pattern in fixed.XBRL_STRIP:
        text = F.regexp_replace(text, pattern, "")
    return text


def clean(raw: Column) -> Column:
    """The normalised prose of a raw filing, ending in one newline."""
    body = F.regexp_replace(body_of(raw), "\r\n?", "\n")
    lines = F.split(strip_markup(from_anchor(body)), "\n", -1)
    kept = F.filter(lines, lambda x: ~x.rlike(fixed.DROPPED_LINE[0]) & ~x.rlike(fixed.DROPPED_LINE[1]))
    text = F.array_join(F.transform(kept, normal_line), "\n")
    return F.concat(strip(F.regexp_replace(text, "\n{3,}", "\n\n")), F.lit("\n"))
