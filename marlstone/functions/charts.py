"""padded logarithmic domains and their ticks, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Padding of a domain in log space, and its limit as a share of the value.
PAD, LIMIT = 0.08, 0.15


def domain(low: Column, high: Column) -> Column:
    """(lo, hi) around the values: padded in log space, clamped in linear space; flat series are spread around their value."""
    flat = F.greatest(F.lit(1.0), high * 0.1)
    a, b = F.log1p(F.greatest(low, F.lit(0.0))), F.log1p(high)
    pad = (b - a) * PAD
    top = F.least(F.expm1(b + pad), high * (1 + LIMIT))
    bottom = F.when(low <= 0, 0.0).otherwise(F.greatest(F.expm1(F.greatest(F.lit(0.0), a - pad)), low * (1 - LIMIT)))
    spread = F.struct(F.greatest(F.lit(0.0), high - flat).alias("lo"), (high + flat).alias("hi"))
    return F.when(high.isNull() | (high <= 0), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))).when(low == high, spread).otherwise(F.struct(bottom.cast("double").alias("lo"), top.cast("double").alias("hi")))


def ticks(d: Column, count: int) -> Column:
    """``count`` + 1 values, even in log space; below 1000 whole and distinct, unless fewer than two would be left."""
    a, b = F.log1p(d["lo"]), F.log1p(d["hi"])
    exact = F.transform(F.sequence(F.lit(0), F.lit(count)), lambda i: F.expm1(a + (b - a) * i / count))
    whole = F.array_distinct(F.transform(exact, lambda x: F.floor(x + 0.5).cast("double")))
    return F.when((d["hi"] >= 1000) | (F.size(whole) < 2), exact).otherwise(whole)
