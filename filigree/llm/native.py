"""Small helpers for array expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Space and 0x09-0x0D.
WHITE = " \t\n\x0b\f\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE_RUN), "")


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def count_of(text: Column, chars: str) -> Column:
    """How many characters of text are among chars."""
    return F.length(text) - F.length(without(text, chars))
