"""Retrieval metrics over ranked relations (case_id, mode, rank, chunk_id, rel) and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree import fixed
from filigree.functions import predicates as P
from filigree.functions import questions as Q
from filigree.operators.search import sized

_KEY = ("case_id", "mode")


def relevance(results: DataFrame, cases: DataFrame) -> DataFrame:
    """results (case_id, mode, rank, chunk rows) with rel 0/1.

    cases: case_id, question, companies, years, forms, sections, expected_chunk_ids. Given ids
    decide alone; else every given condition must hold.
    """
    df = results.join(sized(cases), "case_id")
    none = F.array().cast("array<string>")
    ids = F.coalesce("expected_chunk_ids", none)
    sections = F.coalesce("sections", none)
    names = Q.facets(F.col("question"), none, sections)
    inside = lambda values, c: (F.size(F.coalesce(values, F.array().cast(values_type[c]))) == 0) | F.array_contains(values, F.col(c))
    values_type = {"ticker": "array<string>", "year": "array<int>", "form": "array<string>"}
    by_data = inside(F.col("companies"), "ticker") & inside(F.col("years"), "year") & inside(F.col("forms"), "form")
    by_data &= (F.size(sections) == 0) | (F.size(P.sections_met(sections, names)) > 0)
    rel = F.when(F.size(ids) > 0, F.array_contains(ids, F.col("chunk_id"))).otherwise(by_data)
    return df.withColumn("rel", F.coalesce(rel, F.lit(False)).cast("int"))


def metrics_at_k(ranked: DataFrame, k: int, by: tuple[str, ...] = _KEY) -> DataFrame:
    """precision@k (over k, not over what came back), hit@k, mrr (no cut), ndcg@k (own ideal)."""
    top = F.when(F.col("rank") <= k, F.col("rel"))
    gain = lambda place: F.log2(F.lit(2.0)) / F.log2(place + 1)
    dcg = F.sum(F.when(F.col("rank") <= k, F.col("rel") * gain(F.col("rank"))).otherwise(0.0))
    total = F.least(F.sum("rel"), F.lit(k))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(total, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + 1))
    best = F.min(F.when(F.col("rel") == 1, F.col("rank")))
    return ranked.groupBy(*by).agg(
        (F.coalesce(F.sum(top), F.lit(0)) / k).alias("precision"),
        F.coalesce(F.max(top), F.lit(0)).cast("double").alias("hit"),
        F.coalesce(1.0 / best, F.lit(0.0)).alias("mrr"),
        F.when(F.sum("rel") > 0, dcg / ideal).otherwise(0.0).alias("ndcg"),
        F.coalesce(F.sum(top), F.lit(0)).alias("found"),
    )


def pooled_recall(ranked: DataFrame, k: int) -> DataFrame:
    """recall@k of each mode against the relevant chunks that any mode found."""
    pool = ranked.where("rel = 1").groupBy("case_id").agg(F.count_distinct("chunk_id").alias("pool"))
    found = ranked.where((F.col("rank") <= k)).groupBy(*_KEY).agg(F.sum("rel").alias("found"))
    return found.join(pool, "case_id", "left").select(*_KEY, F.when(F.coalesce("pool", F.lit(0)) > 0, F.col("found") / F.col("pool")).otherwise(0.0).alias("recall"))


def recall_at_k(ranked: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """recall@k against known totals (case_id, total); 0 without any."""
    found = ranked.where(F.col("rank") <= k).groupBy(*_KEY).agg(F.sum("rel").alias("found"))
    return found.join(totals, "case_id", "left").select(*_KEY, F.when(F.coalesce("total", F.lit(0)) > 0, F.col("found") / F.col("total")).otherwise(0.0).alias("recall"))


def mode_means(scores: DataFrame) -> DataFrame:
    """The mean of every metric for each mode, to four places."""
    names = [c for c in scores.columns if c not in (*_KEY, "found")]
    return scores.groupBy("mode").agg(*(F.round(F.avg(c), 4).alias(c) for c in names), F.count("*").alias("n_cases"))


def company_recall(results: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, company_recall): the share of expected companies among the results."""
    got = results.groupBy("case_id").agg(F.collect_set("ticker").alias("got"))
    want = F.array_distinct(F.coalesce("companies", F.array().cast("array<string>")))
    hit = F.size(F.array_intersect(want, F.coalesce("got", F.array().cast("array<string>"))))
    return cases.join(got, "case_id", "left").select("case_id", F.when(F.size(want) > 0, hit / F.size(want)).otherwise(0.0).alias("company_recall"))


def citation_scores(cited: Column, evidence: Column) -> tuple[Column, Column]:
    """Groundedness (cited that are evidence) and coverage (evidence that is cited)."""
    ground = F.size(F.filter(cited, lambda c: F.array_contains(evidence, c))) / F.nullif(F.size(cited), F.lit(0))
    cover = F.size(F.array_intersect(F.array_distinct(cited), evidence)) / F.nullif(F.size(F.array_distinct(evidence)), F.lit(0))
    return F.coalesce(ground, F.lit(0.0)), F.coalesce(cover, F.lit(0.0))


def summary(cases: DataFrame) -> DataFrame:
    """(metric, value): means over the cases that have the metric, and n_cases."""
    names = [c for c, t in cases.dtypes if t in ("double", "float", "int", "bigint")]
    row = cases.agg(*(F.round(F.avg(c), 4).alias(c) for c in names), F.count("*").cast("double").alias("n_cases"))
    return unpivot(row, [*names, "n_cases"])


def unpivot(row: DataFrame, names: list[str]) -> DataFrame:
    return row.select(*(F.col(f"`{n}`").cast("double").alias(n) for n in names)).unpivot([], [f"`{n}`" for n in names], "metric", "value").where("value is not null")


def flatten_modes(means: DataFrame) -> DataFrame:
    """Mode means as (metric, value) rows named ab.<mode>.<metric>."""
    names = [c for c in means.columns if c not in ("mode", "n_cases")]
    long = means.unpivot(["mode"], names, "m", "value")
    return long.select(F.concat(F.lit("ab."), "mode", F.lit("."), "m").alias("metric"), "value")


def regressions(now: DataFrame, before: DataFrame, tolerance: float = fixed.REGRESSION_TOLERANCE) -> DataFrame:
    """(metric, prev, cur, delta, verdict) of metrics in both runs; verdict null within tolerance."""
    both = now.select("metric", F.col("value").alias("cur")).join(before.select("metric", F.col("value").alias("prev")), "metric")
    delta = F.round(F.col("cur") - F.col("prev"), 4)
    worse = F.when(F.col("metric").rlike(fixed.LOWER_IS_BETTER), delta).otherwise(-delta)
    return both.select("metric", "prev", "cur", delta.alias("delta"), F.when(worse > tolerance, "regression").when(worse < -tolerance, "improvement").alias("verdict"))


# --- views of a report -----------------------------------------------------------------------

HEADLINES = ("precision", "mrr", "ndcg", "company_recall", "ab.hybrid.recall", "faithfulness", "answer_relevancy")


def headlines(rows: DataFrame, names: tuple[str, ...] = HEADLINES) -> DataFrame:
    """The (metric, value) rows that head a report, in a fixed order."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col("metric"))
    return rows.where(F.col("metric").isin(*names)).orderBy(place)


def recall_by_mode(means: DataFrame) -> DataFrame:
    return means.select("mode", "recall").orderBy("mode")


def mode_table(means: DataFrame, metric: str) -> DataFrame:
    """One row with a column for each mode."""
    modes = [r.mode for r in means.select("mode").distinct().orderBy("mode").collect()]  # a handful
    return means.groupBy().pivot("mode", modes).agg(F.first(metric))


def find_cases(cases: DataFrame, text: str = "", refused: bool | None = None) -> DataFrame:
    """Cases whose id or question holds a text, in any case, and that were refused or not."""
    low = F.lower(F.lit(text))
    found = cases.where(F.lower(F.col("case_id").cast("string")).contains(low) | F.lower("question").contains(low))
    return found if refused is None else found.where(F.coalesce("refused", F.lit(False)) == refused)


# --- profiles and checks ---------------------------------------------------------------------


def percentiles(df: DataFrame, column: str, ps: tuple[float, ...] = (0.1, 0.5, 0.9, 0.99)) -> DataFrame:
    """(p, value): exact percentiles by linear interpolation, cut to whole numbers."""
    values = df.agg(F.percentile(column, F.array(*map(F.lit, ps))).alias("v"))
    pairs = F.arrays_zip(F.array(*map(F.lit, ps)).alias("p"), F.col("v").alias("v"))
    return values.select(F.explode(pairs).alias("x")).select(F.col("x.p").alias("p"), F.floor("x.v").alias("value"))


def header_coverage(raw: Column, labels: tuple[str, ...]) -> list[Column]:
    """For each label the count of texts with a line that starts with it."""
    return [F.count_if(raw.rlike(rf"(?m)^{label}:")).alias(label) for label in labels]


def item_frequency(heads: DataFrame, most: int = 12) -> DataFrame:
    """(form, item, docs): the items found in the most documents of each form."""
    from pyspark.sql import Window as W

    counts = heads.select("form", "doc_id", "item").distinct().groupBy("form", "item").agg(F.count("*").alias("docs"))
    return counts.withColumn("place", F.row_number().over(W.partitionBy("form").orderBy(F.desc("docs"), "item"))).where(F.col("place") <= most)


def integrity(cleaned: DataFrame, metadata: DataFrame, sections: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(name, ok, detail) of the corpus checks; a stage without rows is pending and passes."""
    from pyspark.sql import Window as W

    order = W.partitionBy("doc_id").orderBy("start")
    spans = sections.withColumn("_before", F.lag("end").over(order)).where(F.coalesce("_before", F.lit(0)) != F.col("start"))
    ends = sections.groupBy("doc_id").agg(F.max("end").alias("end")).join(cleaned.select("doc_id", F.length("text").alias("n")), "doc_id").where("end <> n")

    def row(name: str, bad: DataFrame, whole: DataFrame) -> DataFrame:
        counts = whole.agg(F.count("*").alias("all")).crossJoin(bad.agg(F.count("*").alias("bad")))
        ok = (F.col("all") == 0) | (F.col("bad") == 0)
        return counts.select(F.lit(name).alias("name"), ok.alias("ok"), F.when(F.col("all") == 0, "pending").otherwise(F.concat(F.col("bad").cast("string"), F.lit(" of "), F.col("all").cast("string"))).alias("detail"))

    checks = [
        row("no markup left", cleaned.where(F.col("text").rlike(r"(?i)</?(?:[a-z0-9_-]+:)?xbrl\b|xmlns:|contextRef=")), cleaned),
        row("metadata complete", metadata.where("ticker = '' or form = '' or year = 0"), metadata),
        row("sections contiguous", spans, sections),
        row("sections cover the text", ends, sections),
        row("a vector for each chunk", chunks.select("chunk_id").join(vectors.select("chunk_id"), "chunk_id", "left_anti"), vectors),
        row("a chunk for each vector", vectors.select("chunk_id").join(chunks.select("chunk_id"), "chunk_id", "left_anti"), vectors),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def paragraphs(text: Column) -> Column:
    """How many runs of lines a text has between blank lines."""
    return F.size(F.split(text, r"\n[ \t]*\n"))


def prose_offset(raw: Column) -> Column:
    """Where the prose of a raw filing starts, from 0; -1 without an anchor."""
    return F.regexp_instr(raw, F.lit(fixed.PROSE_ANCHOR)) - 1


def line_profile(docs: DataFrame, by: tuple[str, ...] = (), text_col: str = "text") -> DataFrame:
    """(by..., lines, longest, mean) of the characters of non-blank lines."""
    lines = docs.select(*by, F.explode(F.split(text_col, "\n")).alias("_line")).select(*by, F.length("_line").alias("_n")).where("_n > 0")
    return lines.groupBy(*by).agg(F.count("*").alias("lines"), F.max("_n").alias("longest"), F.avg("_n").alias("mean"))


def corpus_profile(filings: DataFrame, labels: tuple[str, ...] = ("Company", "Ticker", "Filing Type", "Filing Date", "Report Period", "Quarter", "CIK", "URL")) -> DataFrame:
    """(metric, value) of raw filings (doc_id, raw): sizes, prose offsets, lines, paragraphs, header coverage.

    Percentiles are of the histogram that percentile_approx keeps, whose size is fixed.
    """
    ps = (0.5, 0.9)
    sized = filings.select("raw", F.length("raw").alias("chars"), prose_offset(F.col("raw")).alias("offset"), paragraphs(F.col("raw")).alias("paragraphs"))
    aggregates = [F.count("*").alias("filings"), F.min("chars").alias("chars.min"), F.max("chars").alias("chars.max"), F.avg("paragraphs").alias("paragraphs.mean"), F.count_if(F.col("offset") < 0).alias("without_anchor")]
    for name in ("chars", "offset"):
        value = F.when(F.col(name) >= 0, F.col(name))
        aggregates += [F.percentile_approx(value, p, 10_000).alias(f"{name}.p{int(100 * p)}") for p in ps]
    aggregates += [c.alias(f"header.{label}") for c, label in zip(header_coverage(F.col("raw"), labels), labels)]
    row = sized.agg(*aggregates)
    lines = line_profile(filings.select(F.col("raw").alias("text"))).toDF("lines", "lines.longest", "lines.mean")
    names = [c for df in (row, lines) for c in df.columns]
    return unpivot(row.crossJoin(lines), names)  # two single rows


# --- reports ---------------------------------------------------------------------------------


def json_report(title: str, tables: dict[str, DataFrame]) -> str:
    """A report as JSON: for each small DataFrame all its rows."""
    import json

    rows = {name: [r.asDict(recursive=True) for r in df.collect()] for name, df in tables.items()}
    return json.dumps({"title": title, "tables": rows}, default=str, ensure_ascii=False, indent=1)


def html_report(title: str, tables: dict[str, DataFrame], most: int = 1000) -> str:
    """A page of its own with one table for each small DataFrame; it says where it shows `most` rows only."""
    import html as h

    def cell(x, tag: str = "td") -> str:
        return f"<{tag}>{h.escape('' if x is None else str(x))}</{tag}>"

    parts = [f"<!doctype html><meta charset='utf-8'><title>{h.escape(title)}</title><h1>{h.escape(title)}</h1>"]
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        head = "".join(cell(c, "th") for c in df.columns)
        body = "".join("<tr>" + "".join(map(cell, r)) + "</tr>" for r in rows[:most])
        more = f"<p>The first {most} rows.</p>" if len(rows) > most else ""
        parts.append(f"<h2>{h.escape(name)}</h2>{more}<table><tr>{head}</tr>{body}</table>")
    return "".join(parts)


def write_report(spark, path: str, title: str, tables: dict[str, DataFrame]) -> None:
    """report.json and report.html in a folder of any file system that Spark reaches."""
    jvm = spark._jvm
    for name, text in (("report.json", json_report(title, tables)), ("report.html", html_report(title, tables))):
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
        out.write(bytearray(text.encode()))
        out.close()


def judged_mean(cases: DataFrame, judge, names: tuple[str, ...] = ("faithfulness", "answer_relevancy"), batch: int = 16) -> DataFrame:
    """(metric, value): means of what judge([(question, answer, context)]) -> [dict] says of cases.

    The judge runs on the workers, `batch` cases at a time; a value that it does not give
    counts for nothing, and without a judge there are no rows.
    """
    import pandas as pd

    schema = ", ".join(f"{n} double" for n in names)
    if judge is None:
        return cases.sparkSession.createDataFrame([], "metric string, value double")

    def run(frames):
        for frame in frames:
            rows = list(zip(frame["question"], frame["answer"], frame["context"]))
            told = [t for i in range(0, len(rows), batch) for t in judge(rows[i : i + batch])]
            yield pd.DataFrame([{n: t.get(n) for n in names} for t in told], columns=list(names), dtype=float)

    scores = cases.select("question", "answer", "context").mapInPandas(run, schema)
    return unpivot(scores.agg(*(F.round(F.avg(n), 4).alias(n) for n in names)), list(names))
