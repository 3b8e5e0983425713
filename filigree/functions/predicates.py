"""What a chunk serves: facets and sections that are asked for and that it meets.

Tables of fixed values are map literals, so all of it is expressions over the chunk's
columns (section, section_signals, flags) and the arrays of what is asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from filigree import fixed
from filigree.functions.questions import listed_under
from filigree.functions.text import let, strip

FLAGS = ("has_risk_heading", "has_mda_heading", "has_legal_heading", "has_business_heading", "has_financial_table", "has_revenue_table")


def _section() -> Column:
    return F.lower(F.coalesce("section", F.lit("")))


def _signals() -> Column:
    return F.lower(F.coalesce("section_signals", F.lit("")))


def _flags() -> Column:
    return F.array_compact(F.array(*(F.when(F.col(n), F.lit(n)) for n in FLAGS)))


def near_any(section: Column, others: Column) -> Column:
    """Equal to one of the others, or one within the other, in lower case; an empty section is within all."""
    return F.exists(F.transform(others, F.lower), lambda o: o.contains(section) | section.contains(o))


def _told(facet: Column) -> Column:
    """Whether the signals name a facet or a flag stands for it."""
    return _signals().contains(facet) | F.arrays_overlap(_flags(), listed_under(fixed.FACET_FLAGS, facet))


def meets_facet(facet: Column) -> Column:
    return near_any(_section(), listed_under(fixed.FACET_SECTIONS, facet)) | _told(facet)


def serving(target: Column, facets: Column) -> Column:
    """The sections that stand in for one, widened by the facets that are asked for and hold it."""
    own = F.transform(facets, lambda f: listed_under(fixed.FACET_SECTIONS, f))
    base = listed_under(fixed.EQUIVALENTS, target)
    return F.concat(F.when(F.size(base) == 0, F.array(target)).otherwise(base), F.flatten(F.filter(own, lambda s: F.array_contains(s, target))))


def meets_section(target: Column, facets: Column) -> Column:
    """The chunk's section serves, or a facet that bears on the serving sections, or is asked for, is told."""

    def of(sections: Column) -> Column:
        every = F.array(*map(F.lit, fixed.FACET_SECTIONS))
        bearing = F.concat(F.filter(every, lambda f: F.arrays_overlap(listed_under(fixed.FACET_SECTIONS, f), sections)), facets)
        return near_any(_section(), sections) | F.exists(bearing, _told)

    return let(serving(target, facets), of)


def has_flag_of(target: Column) -> Column:
    return F.arrays_overlap(_flags(), listed_under(fixed.SECTION_FLAGS, target))


def meets_loosely(target: Column, facets: Column) -> Column:
    """meets_section, or a flag of the section, or a word of its name in the signals."""
    name = F.replace(F.replace(F.lower(target), F.lit(fixed.MDA.lower()), F.lit("mda")), F.lit("&"), F.lit(" "))
    words = F.filter(F.split(strip(name), r"(?U)\s+"), lambda w: w != "")
    return meets_section(target, facets) | near_any(_section(), F.array(target)) | has_flag_of(target) | F.exists(words, lambda w: _signals().contains(w))


def _those(asked: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(F.coalesce(asked, F.array().cast("array<string>")), test)


def facets_met(facets: Column) -> Column:
    """The facets asked for that the chunk's columns meet, in the order asked."""
    return _those(facets, meets_facet)


def sections_met(targets: Column, facets: Column, loose: bool = False) -> Column:
    return _those(targets, lambda t: (meets_loosely if loose else meets_section)(t, facets))


def bonus(boosts: Column, facets: Column) -> Column:
    """What a chunk's score gains for the facets and sections that are asked for."""
    best = F.greatest(
        F.when(F.exists(facets, meets_facet), fixed.BONUS_FACET).otherwise(0.0),
        F.when(F.exists(boosts, lambda t: meets_section(t, facets)), fixed.BONUS_SECTION).otherwise(0.0),
        F.when(F.exists(boosts, has_flag_of), fixed.BONUS_FLAG).otherwise(0.0),
    )
    quality = F.least(F.lit(0.02), F.greatest(F.lit(0.0), F.coalesce("metadata_quality", F.lit(0.0)) - 0.75) * 0.05)
    return F.when((F.size(boosts) == 0) & (F.size(facets) == 0), 0.0).otherwise(best + quality)
