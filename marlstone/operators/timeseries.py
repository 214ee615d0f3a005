"""Calendars, intervals, weekly series and repository timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .relational import asof_join, best, qualify_first
from .windows import moving_median, spans

WEEK = 7


def calendar(snapshots: DataFrame, at: str = "snapshot_timestamp") -> DataFrame:
    """Snapshots with previous instant and interval; a calendar is a small table, so one task orders it."""
    w = W.orderBy(at)
    return snapshots.select(at).distinct().withColumn("slot", F.row_number().over(w) - 1).withColumn("previous_at", F.lag(at).over(w)).withColumn("interval_days", F.datediff(at, "previous_at"))


def doubled_days(snapshots: DataFrame, at: str = "snapshot_timestamp") -> DataFrame:
    """UTC days with two instants; must be empty."""
    return snapshots.select(at).distinct().groupBy(F.to_date(at).alias("day")).count().where("count > 1")


def monday_on_or_after(d: Column) -> Column:
    """F18."""
    return F.next_day(F.date_sub(d, 1), "MON")


def interval_sums(targets: DataFrame, daily: DataFrame, start: Column, end: Column, key: str = "name", day: str = "day", value: str = "downloads", gap: str | None = None, failed: str | None = None) -> DataFrame:
    """Sums on [start, end) with status COMPLETE, PARTIAL or UNAVAILABLE and an array of reasons.

    Unavailable sums are null, not 0. ``gap`` marks imputed days; ``failed`` is a column of ``targets`` with a reason not to count.
    """
    inside = daily.where((F.col(day) >= start) & (F.col(day) < end))
    facts = inside.groupBy(key).agg(
        F.sum(F.col(value).cast("decimal(38,0)")).alias("total"), F.countDistinct(F.when(F.col(value).isNotNull(), F.col(day))).alias("observed_days"),
        F.count_if(F.coalesce(F.col(gap), F.lit(False)) if gap else F.lit(False)).alias("imputed_days"),
    )
    days = F.datediff(end, start)
    out = targets.join(facts, key, "left").withColumn("expected_days", days).withColumn("observed_days", F.coalesce("observed_days", F.lit(0))).withColumn("imputed_days", F.coalesce("imputed_days", F.lit(0)))
    bad = F.col(failed).isNotNull() if failed else F.lit(False)
    status = F.when(bad | (F.col("observed_days") == 0), "UNAVAILABLE").when((F.col("observed_days") < days) | (F.col("imputed_days") > 0), "PARTIAL").otherwise("COMPLETE")
    reasons = F.filter(
        F.array(F.when(bad, F.col(failed) if failed else F.lit("")), F.when(F.col("observed_days") == 0, "NO_OBSERVATION"), F.when((F.col("observed_days") > 0) & (F.col("observed_days") < days), "MISSING_DAYS"), F.when(F.col("imputed_days") > 0, "IMPUTED_DAYS")),
        lambda x: x.isNotNull(),
    )
    return out.withColumn("status", status).withColumn("reasons", reasons).withColumn("total", F.when(F.col("status") != "UNAVAILABLE", F.col("total")))


def day_grid(targets: DataFrame, daily: DataFrame, start: Column, end: Column, key: str = "name", day: str = "day", value: str = "downloads") -> DataFrame:
    """Every target x day of [start, end) with MISSING or OBSERVED."""
    grid = targets.select(key, F.explode(F.sequence(start, F.date_sub(end, 1))).alias(day))
    return grid.join(daily.select(key, day, value), [key, day], "left").withColumn("quality", F.when(F.col(value).isNull(), "MISSING").otherwise("OBSERVED"))


def unmatched(targets: DataFrame, facts: DataFrame, key: str = "name") -> DataFrame:
    """D34."""
    return targets.join(facts.select(key), key, "left_anti")


def outages(daily: DataFrame, key: str = "name", day: str = "day", value: str = "downloads", each_side: int = 7, least: float = 1000) -> DataFrame:
    """A zero among busy days (centred median of 15 at least ``least``) is null and flagged."""
    rows = moving_median(daily, [key], [day], value, each_side, "__median")
    out = F.coalesce((F.col(value) == 0) & (F.col("__median") >= least), F.lit(False))
    return rows.withColumn("imputed_gap", out).withColumn(value, F.when(~out, F.col(value))).drop("__median")


def weekly(intervals: DataFrame, first: Column, last: Column, key: str = "name", start: str = "previous_at", end: str = "snapshot_at", value: str = "value") -> DataFrame:
    """Values of irregular [start, end) day intervals on weeks that end on Mondays, by days of overlap.

    Only weeks of which every day is covered; shares are decimals rounded half up at 6 digits and then to whole numbers. The window
    should be read some weeks wider than shown, so that its edge weeks are whole.
    """
    days = F.datediff(end, start)
    near = (F.col(start) < F.date_add(last, 1)) & (F.col(end) > F.date_sub(first, WEEK))
    rows = intervals.where((days > 0) & near).withColumn("monday", F.explode(F.sequence(F.next_day(start, "MON"), F.next_day(F.date_sub(end, 1), "MON"), F.expr("interval 7 days"))))
    overlap = F.datediff(F.least(F.col(end), F.col("monday")), F.greatest(F.col(start), F.date_sub("monday", WEEK)))
    part = F.round((F.col(value).cast("decimal(20,0)") * overlap.cast("decimal(4,0)")).cast("decimal(26,0)") / days.cast("decimal(8,0)"), 6).cast("decimal(32,6)")
    sums = rows.where(overlap > 0).groupBy(key, "monday").agg(F.sum(overlap).alias("covered"), F.sum(part).alias("total"))
    return sums.where((F.col("covered") == WEEK) & F.col("monday").between(first, last)).select(key, "monday", F.round("total", 0).cast("long").alias("value"))


def interpolated(observations: DataFrame, first: Column, last: Column, by: list[str], at: str = "snapshot_at", value: str = "value") -> DataFrame:
    """Linear interpolation onto Mondays between each series' first and last observation, half up by decimals.

    Each observation makes the Mondays up to the next one: a window and an explode, no join.
    """
    w = W.partitionBy(*by).orderBy(at)
    rows = observations.withColumn("__to", F.lead(at).over(w)).withColumn("__next", F.lead(value).over(w))
    stop = F.coalesce(F.date_sub("__to", 1), F.col(at))
    some = rows.withColumn("__m", monday_on_or_after(F.col(at))).where(F.col("__m") <= stop).withColumn("monday", F.explode(F.sequence(F.col("__m"), stop, F.expr("interval 7 days"))))
    delta = F.round(((F.col("__next") - F.col(value)) * F.datediff("monday", at)).cast("decimal(26,0)") / F.datediff("__to", at).cast("decimal(8,0)"), 6)
    exact = F.when(F.col("monday") == F.col(at), F.col(value).cast("long")).otherwise(F.round(F.col(value).cast("decimal(26,6)") + delta, 0).cast("long"))
    return some.where(F.col("monday").between(first, last)).select(*by, "monday", exact.alias("value"))


def without_leading_zeros(df: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Rows from each series' first positive value on."""
    since = F.min(F.when(F.col(value) > 0, F.col(at))).over(W.partitionBy(*by))
    return df.withColumn("__since", since).where(F.col(at) >= F.col("__since")).drop("__since")


def month_grid(spans_: DataFrame, first: Column, last: Column, by: list[str]) -> DataFrame:
    """The span in force at each month's start, for spans of [valid_from, valid_to); spans make their own months, no grid join."""
    start = F.greatest(first, F.to_date(F.when(F.date_trunc("month", "valid_from") == F.col("valid_from"), F.col("valid_from")).otherwise(F.add_months(F.date_trunc("month", "valid_from"), 1))))
    end = F.least(last, F.coalesce(F.to_date(F.date_sub("valid_to", 0)), last))
    rows = spans_.withColumn("__a", start).withColumn("__b", end).where("__a <= __b").withColumn("month", F.explode(F.expr("sequence(__a, __b, interval 1 month)")))
    return rows.where(F.col("valid_to").isNull() | (F.col("month").cast("timestamp") < F.col("valid_to"))).drop("__a", "__b")


def alias_distance(series: DataFrame, pairs: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Mean absolute relative difference of two series over their common instants."""
    a = series.select(F.col(key).alias("a"), at, F.col(value).alias("va"))
    b = series.select(F.col(key).alias("b"), at, F.col(value).alias("vb"))
    return pairs.select("a", "b").join(a, "a").join(b, ["b", at]).groupBy("a", "b").agg(F.count("*").alias("n"), F.avg(F.try_divide(F.abs(F.col("va") - F.col("vb")).cast("double"), F.greatest("va", "vb"))).alias("distance"))


def best_repository(versions: DataFrame, name: str = "name", ordinal: str = "ordinal", url: str = "url") -> DataFrame:
    """The valid URL of each package's greatest ordinal."""
    return versions.where(F.col(url).isNotNull()).groupBy(name).agg(best(url, ordinal).alias(url))


def matched_metrics(repositories: DataFrame, metrics: DataFrame, instant: Column, key: str = "url", at: str = "snapshot_at", values: tuple[str, ...] = ("stars", "open_issues")) -> DataFrame:
    """Metrics of exactly one instant; conflicting duplicates give null with CONFLICT, none gives UNMAPPED."""
    exact = metrics.where(F.col(at) == instant).select(key, *values).distinct()
    one = exact.groupBy(key).agg(F.count("*").alias("__n"), *[F.max(v).alias(v) for v in values])
    out = repositories.join(one, key, "left").withColumn("metric_status", F.when(F.col("__n").isNull(), "UNMAPPED").when(F.col("__n") > 1, "CONFLICT").otherwise("MATCHED"))
    return out.select(*[c for c in out.columns if c not in (*values, "__n")], *[F.when(F.col("metric_status") == "MATCHED", F.col(v)).alias(v) for v in values])


def repository_timeline(candidates: DataFrame, by: list[str], at: str, rank: str, value: str) -> DataFrame:
    """Spans of the best-ranked value so far: change points of a running minimum of (rank, value)."""
    w = W.partitionBy(*by).orderBy(at, rank, value)
    top = candidates.withColumn("best", F.min(F.struct(rank, value)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    last = top.withColumn("__rn", F.row_number().over(W.partitionBy(*by, at).orderBy(F.asc("best")))).where("__rn = 1").withColumn("__value", F.col(f"best.{value}"))
    return spans(last, by, [at], at, "__value").select(*by, F.col("__value").alias(value), "valid_from", "valid_to")


def snapshot_at(packages: DataFrame, timeline: DataFrame, daily: DataFrame, metrics: DataFrame, instant: Column, previous: Column, key: str = "name", born: str = "first_published_at") -> DataFrame:
    """One row a package that was published by ``instant``: the repository in force then, daily sums since the ``previous`` date, and the
    repository's metrics of exactly that instant.

    ``timeline``: key, url, valid_from, valid_to; ``daily``: key, day, downloads; ``metrics``: url, snapshot_at, stars, open_issues.
    The reason of missing metrics tells a package without a repository from one without an observation or with conflicting ones.
    """
    alive = packages.where(F.col(born) <= instant).select(key).distinct()
    current = timeline.where((F.col("valid_from") <= instant) & (F.col("valid_to").isNull() | (instant < F.col("valid_to")))).select(key, "url")
    sums = interval_sums(alive, daily, previous.cast("date"), instant.cast("date"), key)
    out = matched_metrics(sums.join(current, key, "left"), metrics, instant)
    reason = F.when(F.col("url").isNull(), "NO_VALID_REPOSITORY").when(F.col("metric_status") == "CONFLICT", "PROJECT_METRIC_CONFLICT").when(F.col("metric_status") == "UNMAPPED", "NO_EXACT_OBSERVATION").otherwise("SELECTED")
    return out.withColumn("repository_reason", reason).drop("metric_status")


def integrated(population: DataFrame, key: str, **parts: DataFrame) -> DataFrame:
    """``population`` with the columns of each part; the parts must have exactly its keys, once each, else it is an error (one count a part)."""
    from .relational import reconcile

    keys, out = population.select(key), population
    for name, part in parts.items():
        differ = reconcile(keys, part, [key]).where("not (in_a and in_b)")
        twice = part.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
        wrong = differ.select(key).unionByName(twice).agg(F.count("*").alias("n")).first()["n"]
        if wrong:
            raise ValueError(f"{wrong} keys of {name} are missing, strange or repeated")
        out = out.join(part, key)
    return out


def inherited(new: DataFrame, old: DataFrame, by: list[str], ordinal: str, take: list[str]) -> DataFrame:
    """Each new version with the metadata of the nearest version of lower ordinal."""
    return asof_join(new, old, ordinal, ordinal, by, take, strict=True)


def json_normal(text: Column) -> Column:
    """JSON text with sorted keys and array order kept; text that isn't JSON stays as it is."""
    parsed = F.to_json(F.try_parse_json(text))
    return F.coalesce(parsed, text)


def change_set(old: DataFrame, new: DataFrame, keys: list[str], plain: list[str], json: list[str] = ()) -> DataFrame:
    """INSERT, UPDATE and MISSING by key; JSON columns are compared by meaning."""
    a = old.select(*keys, *[F.col(c).alias(f"__{c}") for c in (*plain, *json)], F.lit(True).alias("__old"))
    b = new.select(*keys, *plain, *json, F.lit(True).alias("__new"))
    both = a.join(b, keys, "full")
    same = F.lit(True)
    for c in plain:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    for c in json:
        same = same & json_normal(F.col(c)).eqNullSafe(json_normal(F.col(f"__{c}")))
    action = F.when(F.col("__old").isNull(), "INSERT").when(F.col("__new").isNull(), "MISSING").when(~same, "UPDATE")
    return both.withColumn("action", action).where("action is not null").select(*keys, *plain, *json, "action")


def sessions(df: DataFrame, by: list[str], at: str, gap_days: int = 8) -> DataFrame:
    """A new segment wherever more than ``gap_days`` lie between neighbours."""
    w = W.partitionBy(*by).orderBy(at)
    return df.withColumn("__new", F.coalesce((F.datediff(at, F.lag(at).over(w)) > gap_days).cast("int"), F.lit(0))).withColumn("segment", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def indexed_to_100(df: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Series rebased to 100 at their first non-zero value."""
    base = qualify_first(df.where(F.col(value) != 0), by, [F.col(at)]).select(*by, F.col(value).alias("__base"))
    return df.join(base, by, "left").withColumn("indexed", F.try_divide(F.col(value) * 100.0, "__base")).drop("__base")
