"""Operators for preparing language-model training data, and their registered queries.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries if it is there.
"""
