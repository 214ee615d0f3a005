"""Relational helpers that Spark lacks: first row of a group, as-of joins, interval joins, filled grids, top k with rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def qualify_first(df: DataFrame, by: list, order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group in a total order. Spark prunes groups before the shuffle."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def best(value: str | Column, *order: str | Column) -> Column:
    """The value at the greatest ``order``, ties by the value: one aggregate, no sort."""
    v = F.col(value) if isinstance(value, str) else value
    return F.max(F.struct(*order, v.alias("__v")))["__v"]


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str], take: list[str], direction: str = "backward", strict: bool = False, tolerance: Column | None = None, tie: list[str] | None = None) -> DataFrame:
    """Each left row with columns ``take`` of the nearest right row at or before it (``backward``) or after it (``forward``).

    One union, one shuffle by ``by`` and one sort, instead of a nested loop. Among right rows of one time the last by ``tie`` wins
    (``take`` if not given), forward the first. ``tolerance`` is the greatest distance (an interval or a number).
    """
    time = F.col(left_on)
    here = left.select(*by, time.alias("__t"), F.lit(None).alias("__r"), F.struct(*left.columns).alias("__l"))
    order = [F.col(c) for c in (tie or take)]
    there = right.select(*by, F.col(right_on).alias("__t"), F.struct(F.col(right_on).alias("__at"), *order, *[F.col(c).alias(f"__v{i}") for i, c in enumerate(take)]).alias("__r"))
    kind = there.schema["__r"].dataType
    here = here.withColumn("__r", F.lit(None).cast(kind))
    both = here.unionByName(there.withColumn("__l", F.lit(None).cast(here.schema["__l"].dataType)))
    right_first = (direction == "backward") != strict
    side = F.when(F.col("__l").isNull(), 0 if right_first else 2).otherwise(1)
    w = W.partitionBy(*by).orderBy("__t", side, F.col("__r"))
    if direction == "backward":
        found = F.last("__r", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    else:
        found = F.first("__r", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    out = both.withColumn("__f", found).where(F.col("__l").isNotNull())
    if tolerance is not None:
        gap = (F.col("__t") - F.col("__f.__at")) if direction == "backward" else (F.col("__f.__at") - F.col("__t"))
        out = out.withColumn("__f", F.when(gap <= tolerance, F.col("__f")))
    return out.select("__l.*", F.col("__f.__at").alias(f"matched_{right_on}"), *[F.col(f"__f.__v{i}").alias(c) for i, c in enumerate(take)])


def point_in_interval(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Points with the spans [start, end) that hold them; a null end is open. An equi join with the range as residual."""
    return points.join(spans, by).where((F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) < F.col(end))))


def binned_interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """J7 without a key: spans are dealt into bins of ``width``, so that it is an equi join and no nested loop. Numbers only; ends excluded."""
    binned = spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    return points.withColumn("__bin", F.floor(F.col(at) / width)).join(binned, "__bin").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__bin")


def overlap_join(births: DataFrame, spans: DataFrame, by: list[str], birth: str, start: str = "start_index", end: str = "end_index") -> DataFrame:
    """What is left of each span once its partner is born: [greatest(birth, start), end) where that isn't empty."""
    return births.join(spans, by).withColumn(start, F.greatest(birth, start)).where(F.col(start) < F.col(end))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equal nulls match; still a hash-partitioned join. Right keys are dropped."""
    renamed = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    on = [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def filled_grid(facts: DataFrame, *axes: DataFrame, measures: list[str]) -> DataFrame:
    """Every combination of the axes' rows, with 0 where ``facts`` has none. The grid is the result, so its size is what was asked for; the engine sees which axis is small."""
    grid = axes[0]
    for axis in axes[1:]:
        grid = grid.crossJoin(axis)
    keys = grid.columns
    return grid.join(facts, keys, "left").select(*keys, *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in measures])


def projected(df: DataFrame, exclude: tuple[str, ...] = (), replace: dict[str, Column] | None = None) -> DataFrame:
    """All columns but ``exclude``, some replaced in their places; a column that isn't there is an error."""
    replace = replace or {}
    absent = [c for c in (*exclude, *replace) if c not in df.columns]
    if absent:
        raise ValueError(f"no such columns: {absent}")
    return df.select(*[replace[c].alias(c) if c in replace else df[c] for c in df.columns if c not in exclude])


def guarded_sum(value: Column, most: int = 2**63 - 1) -> Column:
    """A sum in wide decimals, as a 64-bit integer; an error if it exceeds ``most`` either way, null without values."""
    total = F.sum(value.cast("decimal(38,0)"))
    return F.when(F.abs(total) > F.lit(most), F.raise_error(F.concat(F.lit("sum out of range: "), total.cast("string")))).otherwise(total.cast("long"))


def partials(df: DataFrame, by: list[str], value: str, part: Column) -> DataFrame:
    """What :func:`merged_partials` needs of each ``part`` of the rows (a file, a day): rows, values, sum, least, greatest and a sketch of distinct values."""
    v = F.col(value)
    return df.groupBy(part.alias("part"), *by).agg(F.count("*").alias("n"), F.count(v).alias("n_values"), F.sum(v.cast("decimal(38,4)")).alias("total"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.hll_sketch_agg(v).alias("sketch"))


def merged_partials(parts: DataFrame, by: list[str]) -> DataFrame:
    """The aggregates over all parts, from partials that may come from different runs."""
    distinct = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), distinct.alias("about_distinct"))


def share_of_group(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Value over its group's sum; null where the sum is 0."""
    return df.withColumn(name, F.try_divide(F.col(value).cast("double"), F.sum(value).over(W.partitionBy(*by))))


def top_with_rest(df: DataFrame, by: list[str], label: str, value: str, k: int = 5, rest: str = "etc", order: list | None = None) -> DataFrame:
    """The ``k`` greatest of each group, and one row ``rest`` that sums what is left."""
    w = W.partitionBy(*by).orderBy(*(order or [F.desc(value), F.col(label)]))
    ranked = df.withColumn("__rn", F.row_number().over(w))
    named = ranked.withColumn(label, F.when(F.col("__rn") <= k, F.col(label)).otherwise(F.lit(rest))).withColumn("rank", F.least("__rn", F.lit(k + 1)))
    return named.groupBy(*by, label, "rank").agg(F.sum(value).alias(value))


def top_targets(df: DataFrame, target: str, order: list, n: int) -> DataFrame:
    """L4: all rows of the ``n`` first targets."""
    return df.join(df.select(target, *[c for c in df.columns if c != target]).groupBy(target).agg(*[F.min(o).alias(f"__{i}") for i, o in enumerate(order)]).orderBy(*[f"__{i}" for i in range(len(order))], target).limit(n).select(target), target, "left_semi")


def reconcile(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of either side with in_a and in_b."""
    x = a.select(*keys).distinct().withColumn("in_a", F.lit(True))
    y = b.select(*keys).distinct().withColumn("in_b", F.lit(True))
    return x.join(y, keys, "full").select(*keys, F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))


def multiset_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """U4, Q9: rows that one side has more often, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def dense_ids(df: DataFrame, order: list[str], name: str = "id", start: int = 0) -> DataFrame:
    """Ids start + 1, start + 2, ... in a total order, without sorting everything in one task.

    Range partitions are numbered within themselves; offsets come from the counts of partitions, a small table.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    counts = dealt.groupBy("__p").count()
    offsets = counts.select("__p", (F.coalesce(F.sum("count").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + start).alias("__o"))
    return dealt.join(F.broadcast(offsets), "__p").withColumn(name, F.col("__o") + F.col("__i") + 1).drop("__p", "__i", "__o")


def stable_ids(names: DataFrame, known: DataFrame, key: str, name: str = "id") -> DataFrame:
    """``known`` (key, id) unchanged, and new keys numbered on from its greatest id."""
    top = known.agg(F.coalesce(F.max(name), F.lit(0))).first()[0]
    fresh = names.select(key).distinct().join(known, key, "left_anti")
    return known.select(key, name).unionByName(dense_ids(fresh, [key], name, top).select(key, F.col(name).cast(known.schema[name].dataType)))


def dictionary(df: DataFrame, column: str, expression, name: str) -> DataFrame:
    """``expression`` worked out once for each distinct value and joined back."""
    table = df.select(column).distinct().withColumn(name, expression(F.col(column)))
    return null_safe_join(df, table, [column], "left")


def balanced_sample(df: DataFrame, predicate: Column, n: int, seed: int = 0, key: str | None = None) -> DataFrame:
    """``n`` rows for which ``predicate`` holds and ``n`` for which it doesn't; by hash of ``key`` where repeatability matters."""
    order = [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)] if key else [F.rand(seed)]
    return df.where(predicate).orderBy(*order).limit(n).unionByName(df.where(~predicate).orderBy(*order).limit(n))


def sample_with_closure(df: DataFrame, fraction: float, seed: int, references: dict[str, tuple[DataFrame, str]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """A random sample, and of each referenced table the rows that the sample refers to."""
    picked = df.sample(fraction, seed)
    return picked, {c: t.join(picked.select(F.col(c).alias(k)).distinct(), k, "left_semi") for c, (t, k) in references.items()}
