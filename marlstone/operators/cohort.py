"""Who stays, joins and leaves: representative releases and five-way classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import filled_grid
from .windows import record_setters

#: Counts of a classification, in order (fixed values).
COUNTS = ("retained", "inflow", "inflow_new", "outflow", "unobserved", "unobserved_recent", "unobserved_stale", "unobserved_dormant")


def period_starts(t2: Column, years=(1, 3, 5)) -> Column:
    """array of (period, t1), each a whole number of years before t2 to the second."""
    return F.array(*[F.struct(F.lit(f"{n}y").alias("period"), (t2 - F.expr(f"INTERVAL {n} YEAR")).alias("t1")) for n in years])


def representatives(releases: DataFrame, name: str = "name", ordinal: str = "ordinal", at: str = "published_at") -> DataFrame:
    """Releases that set a new greatest ordinal in order of publication."""
    return record_setters(releases, [name], [at, ordinal], ordinal)


def representative_at(reps: DataFrame, points: DataFrame, name: str = "name", ordinal: str = "ordinal", at: str = "published_at", version: str = "version") -> DataFrame:
    """(name, point, version) of the greatest ordinal at or before each point. ``points``: point, t; a few rows."""
    return reps.join(points, F.col(at) <= F.col("t")).groupBy(name, "point").agg(F.max_by(version, F.struct(ordinal, version)).alias(version))


def declared_at(rep_points: DataFrame, declared: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Distinct (dependent, point, target, kind) declared by the representatives. ``declared``: name, version, target, kind.

    Probes are made distinct before the join, and targets are semi-joined first.
    """
    if targets is not None:
        declared = declared.join(targets.select(F.col("name").alias("target")), "target", "left_semi")
    probes = rep_points.groupBy("name", "version").agg(F.collect_set("point").alias("points"))  # points are the few ends of periods
    return probes.join(declared, ["name", "version"]).select(F.col("name").alias("dependent"), F.explode("points").alias("point"), "target", "kind").distinct()


def moved(reps: DataFrame, periods: DataFrame, t2: Column) -> DataFrame:
    """(dependent, period) with a representative release in (t1, t2]."""
    return reps.join(periods, (F.col("published_at") > F.col("t1")) & (F.col("published_at") <= t2)).select(F.col("name").alias("dependent"), "period").distinct()


def classify(declared: DataFrame, moved_: DataFrame, lives: DataFrame, periods: DataFrame, stale: Column, dormant: Column) -> DataFrame:
    """(period, target, kind, dependent, a, b, moved, is_new, freshness).

    ``declared``: dependent, point (a period's name, or t2), target, kind; ``lives``: dependent, first_release, last_release;
    ``periods``: period, t1. a and b: declared at t1 and at t2. Freshness is one exclusive CASE, so its parts add up.
    """
    # a period meets its own point and the common end
    each = periods.select("period", "t1", F.explode(F.array(F.col("period"), F.lit("t2"))).alias("point"))
    states = declared.join(each, "point").groupBy("period", "t1", "target", "kind", "dependent").agg(F.bool_or(F.col("point") == F.col("period")).alias("a"), F.bool_or(F.col("point") == "t2").alias("b"))
    went = moved_.select("dependent", "period").distinct().withColumn("moved", F.lit(True))
    rows = states.join(went, ["dependent", "period"], "left").join(lives, "dependent", "left")
    fresh = F.when(F.col("last_release") > stale, "recent").when(F.col("last_release") > dormant, "stale").otherwise("dormant")
    return rows.select("period", "target", "kind", "dependent", "a", "b", F.coalesce("moved", F.lit(False)).alias("moved"), (F.col("first_release") > F.col("t1")).alias("is_new"), fresh.alias("freshness"))


def counted(classes: DataFrame, targets: DataFrame, kinds: DataFrame, periods: DataFrame) -> DataFrame:
    """Counts for every target x kind x period, zeros included."""
    a, b, went, fresh = F.col("a"), F.col("b"), F.col("moved"), F.col("freshness")
    still = a & b & ~went
    conditions = dict(zip(COUNTS, (a & b & went, ~a & b, ~a & b & F.col("is_new"), a & ~b, still, still & (fresh == "recent"), still & (fresh == "stale"), still & (fresh == "dormant")), strict=True))
    facts = classes.groupBy("target", "kind", "period").agg(*[F.count_if(c).alias(k) for k, c in conditions.items()])
    return filled_grid(facts, targets.select(F.col("name").alias("target")), kinds.select("kind"), periods.select("period"), measures=list(COUNTS))


def conservation_faults(classes: DataFrame, counts: DataFrame) -> DataFrame:
    """One row of counts that must all be 0: changes without a move, sums that differ, new inflow above inflow."""
    active = classes.where("moved").groupBy("period", "target", "kind").agg(F.count_if("b").alias("at_t2"), F.count_if("a").alias("at_t1"))
    both = counts.join(active, ["period", "target", "kind"], "left").agg(
        F.count_if(F.col("retained") + F.col("inflow") != F.coalesce("at_t2", F.lit(0))).alias("t2_mismatch"),
        F.count_if(F.col("retained") + F.col("outflow") != F.coalesce("at_t1", F.lit(0))).alias("t1_mismatch"),
        F.count_if(F.col("inflow_new") > F.col("inflow")).alias("new_exceeds_inflow"),
    )
    return both.crossJoin(F.broadcast(classes.agg(F.count_if((F.col("a") != F.col("b")) & ~F.col("moved")).alias("change_without_move"))))


def reverse_dependents(declared: DataFrame, targets: DataFrame, kinds: DataFrame) -> DataFrame:
    """For each target and kind, the count of distinct dependents and their sorted array; zero rows are kept."""
    facts = declared.join(targets.select(F.col("name").alias("target")), "target", "left_semi").select("target", "kind", "dependent").distinct().groupBy("target", "kind").agg(F.count("*").alias("n_dependents"), F.array_sort(F.collect_list("dependent")).alias("dependents"))
    grid = targets.select(F.col("name").alias("target")).crossJoin(kinds.select("kind"))
    empty = F.array().cast(facts.schema["dependents"].dataType)
    return grid.join(facts, ["target", "kind"], "left").select("target", "kind", F.coalesce("n_dependents", F.lit(0)).alias("n_dependents"), F.coalesce("dependents", empty).alias("dependents"))
