"""Queries of the cohort family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort as c
from .fixtures import REL, TARGETS, declared, releases, table
from .migration_queries import PERIODS, periods
from .registry import register

COHORT = f"""WITH {REL}, {PERIODS},
rep AS (
  SELECT name, version, published_at, ordinal FROM (
    SELECT *, max(ordinal) OVER (PARTITION BY name ORDER BY published_at, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM rel)
  WHERE top IS NULL OR ordinal > top),
points AS (SELECT period AS point, t1 AS t FROM periods UNION ALL SELECT 't2', t2 FROM ends),
rep_at AS (SELECT name, point, arg_max(version, ordinal) AS version FROM rep JOIN points ON published_at <= t GROUP BY 1, 2),
decl AS (SELECT DISTINCT o_custkey AS name, o_orderkey AS version, l_suppkey % {TARGETS} AS target, l_returnflag AS kind FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
at_points AS (SELECT r.name AS dependent, r.point, d.target, d.kind FROM rep_at r JOIN decl d ON d.name = r.name AND d.version = r.version),
went AS (SELECT DISTINCT name AS dependent, period FROM rep JOIN periods ON published_at > t1 AND published_at <= t2),
lives AS (SELECT rel.name AS dependent, min(published_at) AS first_release FROM rel GROUP BY 1),
lasts AS (SELECT name AS dependent, max(published_at) AS last_release FROM rep GROUP BY 1),
states AS (
  SELECT p.period, p.t1, a.target, a.kind, a.dependent, bool_or(a.point = p.period) AS a, bool_or(a.point = 't2') AS b
  FROM at_points a JOIN periods p ON a.point IN (p.period, 't2') GROUP BY 1, 2, 3, 4, 5),
cuts AS (SELECT max(t1) FILTER (WHERE period = '3y') AS stale, max(t1) FILTER (WHERE period = '5y') AS dormant FROM periods),
classes AS (
  SELECT s.period, s.target, s.kind, s.dependent, s.a, s.b, w.dependent IS NOT NULL AS moved, first_release > s.t1 AS is_new,
         CASE WHEN last_release > stale THEN 'recent' WHEN last_release > dormant THEN 'stale' ELSE 'dormant' END AS freshness
  FROM states s CROSS JOIN cuts LEFT JOIN went w USING (dependent, period) LEFT JOIN lives USING (dependent) LEFT JOIN lasts USING (dependent))"""


def _parts(spark, d):
    rels = releases(spark, d)
    reps = c.representatives(rels)
    per = periods(spark, d)
    points = per.select(F.col("period").alias("point"), F.col("t1").alias("t")).unionByName(per.select(F.lit("t2").alias("point"), F.col("t2").alias("t")).distinct())
    at = c.representative_at(reps, points)
    decl = c.declared_at(at, declared(spark, d).distinct())
    lives = rels.groupBy(F.col("name").alias("dependent")).agg(F.min("published_at").alias("first_release")).join(reps.groupBy(F.col("name").alias("dependent")).agg(F.max("published_at").alias("last_release")), "dependent", "left")
    ends = {r["period"]: r["t1"] for r in per.collect()}
    went = reps.join(F.broadcast(per), (F.col("published_at") > F.col("t1")) & (F.col("published_at") <= F.col("t2"))).select(F.col("name").alias("dependent"), "period").distinct()
    classes = c.classify(decl, went, lives, per.select("period", "t1"), F.lit(ends["3y"]), F.lit(ends["5y"]))
    return reps, at, decl, classes, per


def _grid(spark):
    return spark.range(TARGETS).select(F.col("id").alias("name")), spark.createDataFrame([("A",), ("N",), ("R",)], "kind string")


@register("representatives", COHORT + " SELECT name, version, published_at FROM rep")
def representatives(spark, d):
    return c.representatives(releases(spark, d)).select("name", "version", "published_at")


@register("representatives_at", COHORT + " SELECT name, point, version FROM rep_at")
def representatives_at(spark, d):
    return _parts(spark, d)[1].select("name", "point", "version")


@register("declared_at_points", COHORT + " SELECT dependent, point, target, kind FROM at_points")
def declared_at_points(spark, d):
    return _parts(spark, d)[2]


@register("cohort_classes", COHORT + " SELECT * FROM classes")
def cohort_classes(spark, d):
    return _parts(spark, d)[3]


COUNTS = COHORT + f""",
grid AS (SELECT t.range AS target, k.kind, p.period FROM range({TARGETS}) t CROSS JOIN (VALUES ('A'), ('N'), ('R')) k(kind) CROSS JOIN periods p),
counts AS (
  SELECT g.target, g.kind, g.period, count_if(a AND b AND moved) AS retained, count_if(NOT a AND b) AS inflow, count_if(NOT a AND b AND is_new) AS inflow_new, count_if(a AND NOT b) AS outflow,
         count_if(a AND b AND NOT moved) AS unobserved, count_if(a AND b AND NOT moved AND freshness = 'recent') AS unobserved_recent,
         count_if(a AND b AND NOT moved AND freshness = 'stale') AS unobserved_stale, count_if(a AND b AND NOT moved AND freshness = 'dormant') AS unobserved_dormant
  FROM grid g LEFT JOIN classes c ON c.target = g.target AND c.kind = g.kind AND c.period = g.period GROUP BY 1, 2, 3)"""


@register("cohort_counts", COUNTS + " SELECT * FROM counts")
def cohort_counts(spark, d):
    _, _, _, classes, per = _parts(spark, d)
    targets, kinds = _grid(spark)
    return c.counted(classes, targets, kinds, per.select("period"))


@register("cohort_conservation", "SELECT CAST(0 AS BIGINT) AS t2_mismatch, CAST(0 AS BIGINT) AS t1_mismatch, CAST(0 AS BIGINT) AS new_exceeds_inflow, CAST(0 AS BIGINT) AS change_without_move")
def cohort_conservation(spark, d):
    _, _, _, classes, per = _parts(spark, d)
    targets, kinds = _grid(spark)
    return c.conservation_faults(classes, c.counted(classes, targets, kinds, per.select("period")))


@register("reverse_dependents", f"""WITH d AS (SELECT DISTINCT l_suppkey % {TARGETS} AS target, l_returnflag AS kind, o_custkey AS dependent FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
g AS (SELECT t.range AS target, k.kind FROM range({TARGETS + 5}) t CROSS JOIN (VALUES ('A'), ('N'), ('R')) k(kind))
SELECT g.target, g.kind, count(dependent) AS n_dependents, coalesce(array_to_string(list_sort(list(dependent) FILTER (WHERE dependent IS NOT NULL)), '|'), '') AS dependents FROM g LEFT JOIN d ON d.target = g.target AND d.kind = g.kind GROUP BY 1, 2""")
def reverse_dependents(spark, d):
    items, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    decl = items.join(orders, items.l_orderkey == orders.o_orderkey).select((F.col("l_suppkey") % TARGETS).alias("target"), F.col("l_returnflag").alias("kind"), F.col("o_custkey").alias("dependent"))
    targets, kinds = spark.range(TARGETS + 5).select(F.col("id").alias("name")), _grid(spark)[1]
    return c.reverse_dependents(decl, targets, kinds).withColumn("dependents", F.array_join(F.col("dependents").cast("array<string>"), "|"))
