"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is a predicate that rejects a document. Cost and selectivity of each are measured
on a sample of about ``sample`` rows, drawn over all partitions and written once: the time
of a job that evaluates this rule alone (the second of two, less the time of a job without
a rule) and its rejections. Rules are then ordered by rejections per second and become one
CASE expression, which stops at the first rule that rejects, so later rules are not
evaluated. The order changes how much is computed and which rule is named, never whether a
document is kept.

``filter_documents`` evaluates rules on texts. ``judge`` returns base counts of every row in
any case; its cascade runs on these columns, and its rules are measured as they run there:
what is left to compute from the text is computed only for rows that get so far.

One pass over the documents without a shuffle; a document's windows are compared within its
row, by 64-bit hashes.

Edge cases: null text has no words, lines or symbols and fails the base rules; a null id
stays null; equal rows are judged alike; very long texts are judged whole; no rows, no
result. Columns other than id and text are not read by the query; ``filter_documents`` keeps
all columns, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from time import perf_counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm.native import WHITE, count_of, let, without, words_of
from filigree.session import shared_table, table

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def repeated_words(words: Column, size: int = 3) -> Column:
    """Words covered by windows of `size` words that are in the array twice or more."""

    def covered(at: Column) -> Column:
        zero = F.struct(F.lit(-size).alias("before"), F.lit(0).alias("n"))
        step = lambda a, x: F.struct(x.alias("before"), (a["n"] + F.least(F.lit(size), x - a["before"])).alias("n"))
        return F.aggregate(at, zero, step, lambda a: a["n"])

    def of_sorted(s: Column) -> Column:
        twin = lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"]))
        return covered(F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"])))

    def of_hashes(h: Column) -> Column:
        marked = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(marked), of_sorted))

    def of_words(w: Column) -> Column:
        window = lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, size)))
        hashes = F.slice(F.transform(w, window), 1, F.size(w) - (size - 1))
        return F.when(F.size(w) < size, F.lit(0)).otherwise(let(hashes, of_hashes))

    return let(words, of_words)


def filled_lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "")


@dataclass(frozen=True)
class Rule:
    """A named predicate that rejects a document."""

    name: str
    rejects: Column


def rules(text: Column) -> list[Rule]:
    """The default rules over a text; thresholds are ratios, so they hold at any length."""
    t = F.coalesce(text, F.lit(""))
    n, chars = F.size(words_of(t)), F.length(without(t, WHITE))
    return [
        Rule("too_short", n < 50),
        Rule("repetition", let(words_of(t), lambda w: 100 * repeated_words(w) > 50 * F.size(w))),
        Rule("symbols", 10 * count_of(t, SYMBOLS) > chars),
        Rule("shouting", 2 * count_of(t, CAPITALS) > chars),
        Rule("word_length", (chars > 15 * n) | (chars < 2 * n)),
        Rule("duplicate_lines", let(filled_lines(t), lambda l: 2 * (F.size(l) - F.size(F.array_distinct(l))) > F.size(l))),
    ]


def counted_rules() -> list[Rule]:
    """The same rules over the columns of `counted`; only capitals are still to be counted."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return [
        Rule("too_short", n < 50),
        Rule("repetition", 100 * F.col("n_repeat_words") > 50 * n),
        Rule("symbols", 10 * F.col("n_symbols") > chars),
        Rule("shouting", 2 * count_of(F.col("text"), CAPITALS) > chars),
        Rule("word_length", (chars > 15 * n) | (chars < 2 * n)),
        Rule("duplicate_lines", 2 * F.col("n_dup_lines") > F.col("n_lines")),
    ]


def drawn(docs: DataFrame, sample: int) -> DataFrame:
    """About `sample` rows of docs from all its partitions, written once."""
    share = min(1.0, sample / max(docs.count(), 1))
    return shared_table(docs.sample(share, 7) if share < 1 else docs, "rule-sample")


def measured(rows: DataFrame, given: list[Rule]) -> list[tuple[float, int]]:
    """For each rule the seconds that it takes on a small table, and how many rows it rejects."""

    def timed(column: Column) -> tuple[float, int]:
        job = rows.agg(F.count_if(column).alias("n"))
        job.first()  # compiles
        began = perf_counter()
        n = job.first().n
        return perf_counter() - began, n

    idle = timed(F.lit(False))[0]
    return [(max(seconds - idle, 1e-4), n) for seconds, n in (timed(r.rejects) for r in given)]


def ordered(rows: DataFrame, given: list[Rule]) -> list[Rule]:
    """Rules by rejections per second on the rows of a sample, the best first."""
    found = measured(rows, given)
    return [given[k] for k in sorted(range(len(given)), key=lambda k: (-found[k][1] / found[k][0], found[k][0]))]


def cascade(given: list[Rule]) -> Column:
    """The name of the first rule that rejects, else null; later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for r in reversed(given):
        out = F.when(r.rejects, F.lit(r.name)).otherwise(out)
    return out


def filter_documents(docs: DataFrame, text_col: str = "text", sample: int = 1000) -> DataFrame:
    """docs, all columns, without the rows that a rule rejects."""
    texts = drawn(docs.select(F.col(text_col).cast("string").alias("text")), sample)
    order = [r.name for r in ordered(texts, rules(F.col("text")))]
    own = {r.name: r for r in rules(F.col(text_col).cast("string"))}
    return docs.where(cascade([own[name] for name in order]).isNull())


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the counts of each text. Words and lines are cut once a row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    cut = docs.select("doc_id", "text", words_of(F.col("text")).alias("words"), filled_lines(F.col("text")).alias("lines"))
    return cut.select(
        "doc_id",
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
    )


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 1000) -> DataFrame:
    """Base counts of each text, base_failed, kept, and rejected_by (null: kept)."""
    rows = drawn(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), sample)
    order = ordered(shared_table(counted(rows), "rule-sample"), counted_rules())
    base = [r.rejects for r in counted_rules() if r.name in ("too_short", "repetition")]
    out = counted(docs, id_col, text_col).withColumns({"base_failed": base[0] | base[1], "rejected_by": cascade(order)})
    return out.withColumn("kept", F.col("rejected_by").isNull()).drop("text", "n_lines")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("rejected_by")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS MATERIALIZED (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), g AS MATERIALIZED (
  SELECT doc_id, i, md5(words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS g
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w WHERE len(words) > 2)
), t AS (
  SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1
), c AS (
  SELECT g.doc_id, count(DISTINCT g.i + k.k) AS n
  FROM g JOIN t ON g.doc_id = t.doc_id AND g.g = t.g CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) k GROUP BY g.doc_id
), b AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS capitals, len(lines) AS n_lines
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > word_chars OR 2 * capitals > word_chars OR word_chars > 15 * n_words
            OR word_chars < 2 * n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM f
"""
