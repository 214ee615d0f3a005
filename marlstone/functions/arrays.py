"""Array functions: ordered difference, overlap measures, votes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_difference(a: Column, b: Column) -> Column:
    """elements of ``a`` that ``b`` lacks, order and duplicates kept; null if either is null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.filter(a, lambda x: ~F.coalesce(F.array_contains(b, x), F.lit(False))))


def ordered_intersection(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.filter(a, lambda x: F.coalesce(F.array_contains(b, x), F.lit(False))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; null where both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def char_jaccard(a: Column, b: Column) -> Column:
    """of the sets of characters; an empty string has none."""
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    return jaccard(chars(a), chars(b))


def containment(a: Column, b: Column, least: int = 0) -> Column:
    """V8: intersection over the smaller set; null where that has fewer than ``least`` elements or none."""
    small = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(small >= least, F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), small))


VOTE_SCALE = 1_000_000_000_000


def scaled_vote(k: Column) -> Column:
    """1/k as an integer at VOTE_SCALE, rounded half up, so that sums don't depend on order."""
    return F.call_function("div", F.lit(2 * VOTE_SCALE) + k.cast("long"), 2 * k.cast("long"))


def votes(scaled_sum: Column, digits: int = 6) -> Column:
    """A sum of scaled votes as a number with the residue of rounding removed."""
    return F.round(scaled_sum.cast("decimal(38,0)") / F.lit(VOTE_SCALE).cast("decimal(20,0)"), digits).cast("double")
