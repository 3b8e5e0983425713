"""Questions understood by expressions: one row per question, any number at once."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree import fixed
from filigree.config import SETTINGS, Settings
from filigree.functions.text import match_positions, squeeze, unique

_MEAN = "(?U)"


def _found(test: Column, label: str) -> Column:
    return F.when(test, F.lit(label))


def _labels(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def validate(text: Column, s: Settings = SETTINGS) -> Column:
    """The reason a question is refused, or null."""
    q = squeeze(text)
    return (
        F.when(text.isNull(), "query must be a string")
        .when(text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), "query contains invalid control characters")
        .when(q == "", "query is empty")
        .when(F.length(q) < s.min_query_chars, F.lit(f"query too short (minimum {s.min_query_chars} characters)"))
        .when(F.length(q) > s.max_query_chars, F.lit(f"query too long (maximum {s.max_query_chars} characters)"))
        .when(~q.rlike("[A-Za-z0-9]"), "query has no alphanumeric content")
    )


def classify(question: Column) -> Column:
    low = F.lower(question)
    labels = _labels(*(_found(low.rlike(_MEAN + p), name) for name, p in fixed.INTENTS.items()))
    return F.when(F.size(labels) == 0, F.array(F.lit("General"))).otherwise(labels)


def years(question: Column) -> Column:
    found = F.regexp_extract_all(question, F.lit(r"(?U)\b(?:19|20)\d{2}\b"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def quarters(question: Column) -> Column:
    numbers = F.transform(F.regexp_extract_all(question, F.lit(r"(?iU)\bQ([1-4])\b"), F.lit(1)), lambda x: F.concat(F.lit("Q"), x))
    table = F.create_map(*(F.lit(x) for pair in fixed.QUARTER_WORDS.items() for x in pair))
    words = F.regexp_extract_all(question, F.lit(r"(?iU)\b(first|second|third|fourth)\s+quarter\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(numbers, F.transform(words, lambda x: table[F.lower(x)]))))


def forms(question: Column) -> Column:
    return _labels(*(_found(F.lower(question).rlike(_MEAN + p), form) for form, p in fixed.FORM_WORDS.items()))


def section_intents(question: Column) -> Column:
    return _labels(*(_found(F.lower(question).rlike(_MEAN + p), s) for s, p in fixed.SECTION_INTENTS.items()))


def companies(question: Column) -> Column:
    """Tickers by their first place: aliases in any case, groups, and symbols in capitals."""
    low = F.lower(question)
    hits = []

    def place(text: Column, pattern: str) -> Column:
        return F.regexp_instr(text, F.lit(pattern))

    order = 0
    for ticker, names in fixed.ALIASES.items():
        for name in names:
            # "apple" is part of the test for "apple inc"; instr is cheap where nothing fits
            at = F.when(F.instr(low, name) > 0, place(low, r"(?<![a-z0-9])" + re.escape(name) + r"(?![a-z0-9])")).otherwise(0)
            hits.append(F.when(at > 0, F.struct(at.alias("at"), F.lit(order).alias("o"), F.lit(ticker).alias("t"))))
            order += 1
    for pattern, tickers in fixed.COMPANY_GROUPS:
        at = place(low, _MEAN + pattern)
        for k, ticker in enumerate(tickers):
            hits.append(F.when(at > 0, F.struct((at + k).alias("at"), F.lit(order).alias("o"), F.lit(ticker).alias("t"))))
            order += 1
    for ticker in sorted((t for t in fixed.SECTOR_OF if len(t) > 1), key=len, reverse=True):
        at = F.when(F.instr(question, ticker) > 0, place(question, r"(?<![A-Za-z0-9])" + ticker + r"(?![A-Za-z0-9])")).otherwise(0)
        hits.append(F.when(at > 0, F.struct(at.alias("at"), F.lit(order).alias("o"), F.lit(ticker).alias("t"))))
        order += 1
    found = F.sort_array(F.array_compact(F.array(*hits)))
    return F.array_distinct(F.transform(found, lambda x: x["t"]))


def facets(question: Column, intents: Column, sections: Column) -> Column:
    low = F.lower(question)
    has, sec = (lambda x: F.array_contains(intents, x)), (lambda x: F.array_contains(sections, x))
    plain = _labels(*(_found(low.rlike(_MEAN + p), name) for name, p in fixed.FACETS.items()))
    financial = has("Financial") | sec(fixed.STATEMENTS)
    implied = _labels(
        _found(has("Risk") | sec(fixed.RISK), "risk"),
        _found(financial, "financial"),
        _found((has("Trend") | has("Temporal")) & (financial | F.array_contains(plain, "financial")), "revenue_trend"),
        _found(sec(fixed.LEGAL), "legal"),
        _found(sec(fixed.BUSINESS), "business"),
    )
    return F.array_distinct(F.concat(plain, implied))


def _table(rows: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*(x for name, values in rows.items() for x in (F.lit(name), F.array(*map(F.lit, values)))))


def _lookup(table: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.get(F.array(table[key]), F.lit(0)), default)


def listed_under(rows: dict[str, tuple[str, ...]], key: Column) -> Column:
    """The list that a table of fixed values has for a name; empty if it has none."""
    return _lookup(_table(rows), key, F.array().cast("array<string>"))


def sections_of_facets(names: Column) -> Column:
    empty = F.array().cast("array<string>")
    return unique(F.flatten(F.transform(names, lambda f: _lookup(_table(fixed.FACET_SECTIONS), f, empty))))


def equivalents(section: Column, names: Column) -> Column:
    """Sections that serve for one, widened by the facets that hold it."""
    base = _lookup(_table(fixed.EQUIVALENTS), section, F.array(section))
    empty = F.array().cast("array<string>")
    own = F.transform(names, lambda f: _lookup(_table(fixed.FACET_SECTIONS), f, empty))
    return unique(F.concat(base, F.flatten(F.filter(own, lambda s: F.array_contains(s, section)))))


def fiscal_periods(ys: Column, qs: Column) -> Column:
    return F.flatten(F.transform(ys, lambda y: F.transform(qs, lambda q: F.concat(y.cast("string"), q))))


def unsafe_category(question: Column) -> Column:
    """The category of the first unsafe pattern, or null."""
    out = F.when(F.lit(False), "")
    for category, pattern in fixed.UNSAFE:
        out = out.when(question.rlike("(?iUd)" + pattern), category)
    return out


def out_of_scope(question: Column, tickers: Column, sections: Column) -> Column:
    """'off_topic', 'no_topic' or null."""
    low = F.lower(question)
    known = (F.size(tickers) > 0) | (F.size(sections) > 0) | low.rlike(_MEAN + fixed.ON_TOPIC)
    return F.when(low.rlike(_MEAN + fixed.OFF_TOPIC), "off_topic").when(~known, "no_topic")


def describe(df_cols: dict[str, Column]) -> Column:
    """A filter in words; df_cols has tickers, years, quarters, fiscal_periods and forms."""
    labels = {"tickers": "company", "years": "year", "quarters": "quarter", "fiscal_periods": "fiscal_period", "forms": "form"}
    parts = [F.when(F.size(df_cols[k]) > 0, F.concat(F.lit(f"{name} IN ["), F.array_join(df_cols[k].cast("array<string>"), ", "), F.lit("]"))) for k, name in labels.items()]
    return F.coalesce(F.nullif(F.concat_ws(" AND ", *parts), F.lit("")), F.lit("(no hard filter — search all filings)"))


def plan(df: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """df of understood questions with mode, per_entity_k, pool_size, boosts and evidence_limit."""
    has = lambda x: F.array_contains("intents", x)
    n = F.size("companies")
    many = has("Comparison") | (n >= 2)
    moving = has("Trend") | has("Temporal")
    each = F.greatest(n, F.lit(1))
    per = F.greatest(F.floor(F.lit(s.vector_top_k) / each), F.ceil(F.lit(s.candidate_pool) / each)).cast("int")
    money = F.array(F.lit(fixed.MDA), F.lit(fixed.STATEMENTS))
    none = F.array().cast("array<string>")
    first = F.array_distinct(F.concat("section_intent", sections_of_facets(F.col("facets")), F.when(moving | has("Financial"), money).otherwise(none)))
    boosts = F.when(F.size(first) > 0, first).when(has("Risk"), F.array(F.lit(fixed.RISK))).otherwise(none)
    return df.withColumns(
        {
            "mode": F.when(many, "per_entity").when(moving, "per_period").otherwise("global"),
            "per_entity_k": F.when(many, per).otherwise(0),
            "pool_size": F.when(many, per * each).otherwise(s.candidate_pool),
            "boosts": boosts,
            "evidence_limit": F.when(many, 12).when(moving, 10).when(n == 1, 6).otherwise(s.rerank_top_k),
        }
    )


def understand(queries: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """queries (query_id, question) with everything that follows from the text alone.

    status: ok, invalid, unsafe or out_of_scope; reason says why.
    """
    df = queries.withColumn("error", validate(F.col("question"), s)).withColumn("question", F.coalesce(squeeze(F.col("question")), F.lit("")))
    q = F.col("question")
    df = df.withColumns({"companies": companies(q), "years": years(q), "quarters": quarters(q), "forms": forms(q), "section_intent": section_intents(q), "_i": classify(q)})
    size = F.size("companies")
    count = _labels(_found(size >= 2, "MultiCompany"), _found(size == 1, "SingleCompany"))
    df = df.withColumn("intents", F.concat("_i", count)).drop("_i")
    df = df.withColumns({"facets": facets(q, F.col("intents"), F.col("section_intent")), "fiscal_periods": fiscal_periods(F.col("years"), F.col("quarters")), "unsafe": unsafe_category(q), "scope": out_of_scope(q, F.col("companies"), F.col("section_intent"))})
    status = F.when(F.col("error").isNotNull(), "invalid").when(F.col("unsafe").isNotNull(), "unsafe").when(F.col("scope").isNotNull(), "out_of_scope").otherwise("ok")
    df = df.withColumn("status", status).withColumn("reason", F.coalesce("error", "unsafe", "scope", F.lit("")))
    df = plan(df, s)
    table = F.create_map(*(F.lit(x) for pair in fixed.EXPANSIONS.items() for x in pair))
    more = F.array_compact(F.transform("boosts", lambda b: F.get(F.array(table[b]), F.lit(0))))
    return df.withColumn("expanded", F.concat_ws(" ", "question", F.when(F.size(more) > 0, F.array_join(more, " "))))


# --- predicates over chunk rows and question rows ----------------------------------------------


def hard_filter(tickers: Column, ys: Column, qs: Column, fs: Column, periods: Column) -> Column:
    """Whether a chunk (ticker, year, quarter, form, fiscal_period) meets a question's filter.

    With years, quarters and periods all given a period may stand for year and quarter.
    """
    inside = lambda values, col: (F.size(values) == 0) | F.array_contains(values, F.col(col))
    split = inside(ys, "year") & inside(qs, "quarter")
    only = F.size(periods) > 0
    both = (F.size(ys) > 0) & (F.size(qs) > 0)
    period = F.when(only & both, split | F.array_contains(periods, F.col("fiscal_period"))).when(only & ~both, split & F.array_contains(periods, F.col("fiscal_period"))).otherwise(split)
    return inside(tickers, "ticker") & inside(fs, "form") & period


def section_match(a: Column, b: Column) -> Column:
    """Equal, or one within the other, in any case; an empty section is within all."""
    left, right = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    return left.contains(right) | right.contains(left)
