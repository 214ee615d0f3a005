"""Window composites: record setters, spans, islands, delta sweeps, moving median."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def record_setters(df: DataFrame, by: list[str], order: list, value: str) -> DataFrame:
    """Rows whose ``value`` exceeds every earlier one."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("__top", F.max(value).over(w)).where(F.col("__top").isNull() | (F.col(value) > F.col("__top"))).drop("__top")


def best_so_far(df: DataFrame, by: list[str], order: list, rank: str, name: str) -> DataFrame:
    """Running minimum of ``rank``, the current row included."""
    return df.withColumn(name, F.min(rank).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def spans(df: DataFrame, by: list[str], order: list, start: str, value: str, only_changes: bool = True) -> DataFrame:
    """[valid_from, valid_to) of contiguous runs of one ``value``; the last span is open (null)."""
    w = W.partitionBy(*by).orderBy(*order)
    if only_changes:
        df = df.withColumn("__was", F.lag(value).over(w)).withColumn("__n", F.row_number().over(w)).where((F.col("__n") == 1) | ~F.col(value).eqNullSafe(F.col("__was"))).drop("__was", "__n")
    return df.withColumn("valid_from", F.col(start)).withColumn("valid_to", F.lead(start).over(w))


def islands(df: DataFrame, by: list[str], start: str = "start_index", end: str = "end_index") -> DataFrame:
    """The union of nested, overlapping and adjacent [start, end) intervals of each group; null bounds come last, so they join an island."""
    w = W.partitionBy(*by).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    flagged = df.select(*by, start, end).withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    numbered = flagged.withColumn("__island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def deltas(df: DataFrame, by: list[str], start: str = "start_index", end: str = "end_index", weight: Column | int = 1) -> DataFrame:
    """+weight at each start and -weight at each end, net of one index; zero nets go."""
    w = F.lit(weight) if isinstance(weight, int) else weight
    rows = df.select(*by, F.explode(F.array(F.struct(F.col(start).alias("index"), w.alias("delta")), F.struct(F.col(end).alias("index"), (-w).alias("delta")))).alias("e")).select(*by, "e.*")
    return rows.groupBy(*by, "index").agg(F.sum("delta").alias("delta")).where("delta <> 0")


def running(events: DataFrame, by: list[str], close: Column | int, index: str = "index", delta: str = "delta", name: str = "active") -> DataFrame:
    """[start_index, end_index) with the running sum; the last interval ends at ``close``; empty and zero ones go."""
    w = W.partitionBy(*by).orderBy(index)
    end = F.lit(close) if isinstance(close, int) else close
    return (
        events.withColumn(name, F.sum(delta).over(w.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("end_index", F.coalesce(F.lead(index).over(w), end))
        .select(*by, F.col(index).alias("start_index"), "end_index", name)
        .where((F.col(name) != 0) & (F.col("start_index") < F.col("end_index")))
    )


def densify(df: DataFrame, start: str = "start_index", end: str = "end_index", name: str = "index") -> DataFrame:
    """One row for each index of [start, end)."""
    return df.where(F.col(start) < F.col(end)).withColumn(name, F.explode(F.sequence(F.col(start), F.col(end) - 1)))


def moving_median(df: DataFrame, by: list[str], order: list, value: str, each_side: int, name: str) -> DataFrame:
    """Exact centred median of 2 * each_side + 1 rows."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(-each_side, each_side)
    return df.withColumn(name, F.percentile(value, F.lit(0.5)).over(w))


def previous_delta(df: DataFrame, by: list[str], order: list, value: str) -> DataFrame:
    """Of each group's two latest rows (``order`` newest first), the latest with the difference to the other."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn <= 2").withColumn(f"{value}_delta", F.col(value) - F.lead(value).over(w)).where("__rn = 1").drop("__rn")


def coverage_faults(df: DataFrame, by: list[str], first: int, last: int, start: str = "start_index", end: str = "end_index") -> DataFrame:
    """Q7: groups whose intervals leave a gap, overlap, or don't span [first, last)."""
    w = W.partitionBy(*by).orderBy(start, end)
    marked = df.withColumn("__gap", F.coalesce(F.lag(end).over(w) != F.col(start), F.lit(False)) | (F.col(start) >= F.col(end)))
    return marked.groupBy(*by).agg(F.bool_or("__gap").alias("broken"), F.min(start).alias("low"), F.max(end).alias("high")).where(F.col("broken") | (F.col("low") != first) | (F.col("high") != last))
