"""Section detection as window functions over heading candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filigree import fixed
from filigree.functions.text import match_positions, squeeze, strip


def item_name(raw: Column) -> Column:
    """'1a' becomes 'Item 1A'."""
    number = F.regexp_extract(raw, r"^(\d+)", 1).cast("int").cast("string")
    return F.concat(F.lit("Item "), number, F.upper(F.regexp_extract(raw, r"^\d+([A-Za-z]?)", 1)))


def item_number(item: Column) -> Column:
    return F.regexp_extract(item, r"Item (\d+)", 1).cast("int")


def item_rank(item: Column) -> Column:
    """Item 1 < 1A < 1B < 2."""
    letter = F.regexp_extract(item, r"Item \d+([A-Z]?)", 1)
    return item_number(item) * 10 + F.when(letter != "", F.ascii(letter) - F.ascii(F.lit("A")) + 1).otherwise(0)


def clean_title(raw: Column) -> Column:
    """Cut where the title runs into the body; without page number and end signs."""
    head = F.get(F.split(raw, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", 2), F.lit(0))
    text = F.regexp_replace(squeeze(F.translate(head, "|", " ")), r"^[ .:\-)]+|[ .:\-)]+$", "")
    text = strip(F.regexp_replace(text, r"(?U)\s*\d+$", ""))
    return F.when((F.length(text) >= 3) & ~text.rlike(r"(?U)^\d+$"), text).otherwise("")


def is_cross_reference(text: Column, start: Column) -> Column:
    """Whether the last word of the 20 characters before is a connector."""
    size = F.least(start, F.lit(20))
    words = F.regexp_extract_all(F.substring(text, start - size + 1, size), F.lit("[A-Za-z]+"), F.lit(0))
    last = F.lower(F.get(words, F.size(words) - 1))
    return F.coalesce(last.isin(*fixed.CROSS_REFERENCE), F.lit(False))


def canonical_name(form: Column, item: Column, fallback: Column) -> Column:
    """An annual report's item by number; else by words of the title; else the title."""
    low = F.lower(fallback)
    by_title = F.when(F.lit(False), "")
    for words, name in fixed.TITLE_NAMES:
        test = low.contains(words[0])
        for w in words[1:]:
            test &= low.contains(w)
        by_title = by_title.when(test, name)
    by_title = by_title.when(strip(low) == "business", "Business").otherwise(fallback)
    names = F.create_map(*(F.lit(x) for pair in fixed.ITEM_NAMES.items() for x in pair))
    return F.coalesce(F.when(form == "10-K", F.get(F.array(names[item]), F.lit(0))), by_title)


def part_of(item: Column) -> Column:
    n = item_number(item)
    out = F.when(F.lit(False), "")
    for name, low, high in fixed.PARTS:
        out = out.when(n.between(low, high), name)
    return out.otherwise("")


def heading_candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, form, n, pos, item, title) of headings that are no cross references.

    docs has doc_id, form and text.
    """
    found = docs.select("doc_id", "form", "text", F.length("text").alias("n"), F.explode(match_positions(F.col("text"), fixed.HEADING)).alias("m"))
    found = found.where(~is_cross_reference(F.col("text"), F.col("m.start")))
    raw = F.regexp_extract("m.match", fixed.HEADING, 1)
    return found.select("doc_id", "form", "n", F.col("m.start").alias("pos"), item_name(raw).alias("item"), clean_title(F.regexp_extract("m.match", fixed.HEADING, 2)).alias("title"))


def with_bodies(heads: DataFrame, least: int = fixed.LEAST_SECTION) -> DataFrame:
    """Headings whose next candidate, or the end, is far enough away."""
    following = F.lead("pos", 1).over(W.partitionBy("doc_id").orderBy("pos"))
    return heads.withColumn("gap", F.coalesce(following, F.col("n")) - F.col("pos")).where(F.col("gap") >= least).drop("gap")


def without_repeats(heads: DataFrame) -> DataFrame:
    """The first of each run of one item."""
    before = F.lag("item", 1).over(W.partitionBy("doc_id").orderBy("pos"))
    return heads.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col("item"))).drop("_b")


def from_lowest(heads: DataFrame) -> DataFrame:
    """From the first heading with the document's lowest item number on."""
    doc = W.partitionBy("doc_id")
    out = heads.withColumn("_n", item_number(F.col("item"))).withColumn("_low", F.min("_n").over(doc))
    out = out.withColumn("_at", F.min(F.when(F.col("_n") == F.col("_low"), F.col("pos"))).over(doc))
    return out.where("pos >= _at").drop("_n", "_low", "_at")


def rising(heads: DataFrame) -> DataFrame:
    """In annual reports only headings above every earlier one."""
    before = F.max("_r").over(W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    out = heads.withColumn("_r", item_rank(F.col("item"))).withColumn("_m", before)
    return out.where((F.col("form") != "10-K") | (F.col("_r") > F.coalesce("_m", F.lit(-1)))).drop("_r", "_m")


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section_index, section_name, item, part, start, end) covering each text.

    docs has doc_id, form and text; an empty text has no section.
    """
    docs = docs.select("doc_id", "form", "text")
    kept = rising(from_lowest(without_repeats(with_bodies(heading_candidates(docs)))))
    spans = kept.select(
        "doc_id",
        canonical_name(F.col("form"), F.col("item"), F.when(F.col("title") != "", F.col("title")).otherwise(F.col("item"))).alias("section_name"),
        "item",
        F.when(F.col("form") == "10-K", part_of(F.col("item"))).otherwise("").alias("part"),
        F.col("pos").alias("start"),
        "n",
    )
    ends = spans.groupBy("doc_id").agg(F.min("start").alias("first"))
    other = docs.select("doc_id", F.length("text").alias("n")).where("n > 0").join(ends, "doc_id", "left").where("first is null or first > 0")
    other = other.select("doc_id", F.lit("Other").alias("section_name"), F.lit("").alias("item"), F.lit("").alias("part"), F.lit(0).alias("start"), F.col("n"))
    both = spans.unionByName(other)
    order = W.partitionBy("doc_id").orderBy("start")
    return both.select("doc_id", (F.row_number().over(order) - 1).alias("section_index"), "section_name", "item", "part", "start", F.coalesce(F.lead("start").over(order), F.col("n")).alias("end"))


def checked_spans(spans: DataFrame) -> DataFrame:
    """spans as they are; a row that does not have 0 <= start <= end stops the job."""
    ok = (F.col("start") >= 0) & (F.col("end") >= F.col("start"))
    told = F.concat(F.lit("bad span in "), F.col("doc_id").cast("string"))
    return spans.where(F.assert_true(F.coalesce(ok, F.lit(False)), told).isNull())
