"""The library's queries over the driver's tables, and their SQL."""

from filigree.plans import filing_queries, ranking_queries, relation_queries, text_queries

_MODULES = (ranking_queries, text_queries, relation_queries, filing_queries)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
