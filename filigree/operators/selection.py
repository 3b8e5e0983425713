"""Order-dependent selection over each question's short ranked list.

What a row adds depends on the rows taken before it, so these are folds. They run on one
question's pool at a time (30 rows, or per-entity k times the entities) in applyInPandas;
pools are cut by rank before they get here, so a group has a bound.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filigree import fixed


def _fold(ranked: DataFrame, choose, order: str = "rank") -> DataFrame:
    """Rows in the order of choose(rows by rank) -> positions, ranked anew."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(order, kind="stable").reset_index(drop=True)
        out = rows.iloc[choose(rows)].reset_index(drop=True)
        out[order] = range(1, len(out) + 1)
        return out

    return ranked.groupBy("query_id").applyInPandas(run, ranked.schema)


def dedup_positions(rows: pd.DataFrame, most: int) -> list[int]:
    """First of each id and text; at most `most` of a document's section."""
    ids, texts, filled, out = set(), set(), Counter(), []
    for k, r in enumerate(rows.itertuples(index=False)):
        text, place = r.content_hash or r.text, (r.doc_id, r.section)
        if r.chunk_id in ids or text in texts or filled[place] >= most:
            continue
        ids.add(r.chunk_id)
        texts.add(text)
        filled[place] += 1
        out.append(k)
    return out


def deduplicate(ranked: DataFrame, most_per_section: int = 3) -> DataFrame:
    """ranked has chunk_id, content_hash, text, doc_id, section; a row dropped by the cap leaves its text free."""
    return _fold(ranked, lambda rows: dedup_positions(rows, most_per_section))


def deduplicate_by_windows(ranked: DataFrame, most_per_section: int = 3) -> DataFrame:
    """The same in plain windows: a row dropped by the cap still holds its text."""
    text = F.coalesce(F.nullif("content_hash", F.lit("")), F.col("text"))
    n = lambda *keys: F.row_number().over(W.partitionBy("query_id", *keys).orderBy("rank"))
    out = ranked.withColumn("_t", text).withColumn("_a", n("chunk_id")).where("_a = 1").withColumn("_b", n("_t")).where("_b = 1")
    out = out.withColumn("_c", n("doc_id", "section")).where(F.col("_c") <= most_per_section)
    return out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).drop("_t", "_a", "_b", "_c")


def coverage_positions(rows: pd.DataFrame) -> list[int]:
    """First facets up to their quotas, then one row for each section, then the rest."""
    taken: list[int] = []
    facets = list(rows.facets.iloc[0]) if len(rows) else []
    boosts = list(rows.boosts.iloc[0]) if len(rows) else []
    for facet in facets:
        fits = [k for k in range(len(rows)) if k not in taken and facet in rows.facets_met.iloc[k]]
        taken += fits[: fixed.FACET_QUOTAS.get(facet, 1)]
    for section in boosts:
        taken += [k for k in range(len(rows)) if k not in taken and section in rows.sections_met.iloc[k]][:1]
    return taken + [k for k in range(len(rows)) if k not in taken]


def coverage_first(ranked: DataFrame) -> DataFrame:
    """ranked has the question's facets and boosts, and each row's facets_met and sections_met."""
    return _fold(ranked, coverage_positions)


def diverse_positions(rows: pd.DataFrame, limit: int, section_cap: int, company_cap: int) -> list[int]:
    """One of each company and section; then up to the caps; then whatever is left."""
    out: list[int] = []
    pairs, sections, companies = set(), Counter(), Counter()
    keys = [((r.ticker or r.company or ""), (r.section or ""), r.chunk_id) for r in rows.itertuples(index=False)]
    used = set()

    def passes(test) -> None:
        for k, (company, section, chunk) in enumerate(keys):
            if len(out) < limit and chunk not in used and test(company, section):
                out.append(k)
                used.add(chunk)
                pairs.add((company, section))
                sections[section] += 1
                companies[company] += 1

    passes(lambda c, s: (c, s) not in pairs)
    passes(lambda c, s: sections[s] < section_cap and companies[c] < company_cap)
    passes(lambda c, s: True)
    return out


def diversify(ranked: DataFrame) -> DataFrame:
    """At most evidence_limit rows of each question, spread over companies and sections."""

    def choose(rows: pd.DataFrame) -> list[int]:
        limit = int(rows.evidence_limit.iloc[0])
        return diverse_positions(rows, limit, max(2, limit // 3), max(2, limit // 2))

    return _fold(ranked, choose)


def unique_pairs(ranked: DataFrame) -> DataFrame:
    """Only the first pass of diversify: the best row of each company and section."""
    first = W.partitionBy("query_id", "ticker", "section").orderBy("rank")
    return ranked.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def tokens_of(chars: int) -> int:
    return chars // 4


def budget_positions(rows: pd.DataFrame, fixed_tokens: int, most: int) -> list[int]:
    """In diverse order, every row that still fits; the first always."""
    used = fixed_tokens + tokens_of(len(rows.question.iloc[0])) + 80
    out: list[int] = []
    for k in diverse_positions(rows, len(rows), 2, 4):
        cost = tokens_of(len(rows.text.iloc[k])) + 30
        if out and used + cost > most:
            continue
        out.append(k)
        used += cost
    return out


def fit_to_budget(evidence: DataFrame, fixed_tokens: int, most: int = 7000) -> DataFrame:
    """The evidence rows that go into the prompt; place is their order there."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("evidence_no", kind="stable").reset_index(drop=True)
        out = rows.iloc[budget_positions(rows, fixed_tokens, most)].reset_index(drop=True)
        out["place"] = range(1, len(out) + 1)
        return out

    from pyspark.sql import types as T

    schema = T.StructType([*evidence.schema.fields, T.StructField("place", T.IntegerType())])
    return evidence.groupBy("query_id").applyInPandas(run, schema)
