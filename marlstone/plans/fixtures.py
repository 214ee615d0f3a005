"""The ecosystem's shapes read from the driver's star schema, as DataFrames and as the same CTEs in DuckDB SQL.

Releases are orders of a customer (name = o_custkey, ordinal = o_orderkey); their declarations are line items (target = supplier
number modulo TARGETS, kind = l_returnflag).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGETS = 40


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def releases(spark: SparkSession, d: str) -> DataFrame:
    """name, ordinal, version, published_at, line, publisher, deps (sorted set), others (targets of other kinds)."""
    orders, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    target = F.col("l_suppkey") % TARGETS
    sets = items.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set(F.when(F.col("l_returnflag") != "R", target))).alias("deps"), F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == "R", target))).alias("others")
    )
    people = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("publisher"))
    rows = orders.join(sets, orders.o_orderkey == sets.l_orderkey).join(people, orders.o_custkey == people.c_custkey)
    return rows.select(
        F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("published_at"),
        (F.col("o_orderkey") % 2).alias("line"), "publisher", "deps", "others",
    )


REL = f"""
sets AS (
  SELECT l_orderkey,
         list_sort(list(DISTINCT l_suppkey % {TARGETS}) FILTER (WHERE l_returnflag <> 'R')) AS deps_,
         list_sort(list(DISTINCT l_suppkey % {TARGETS}) FILTER (WHERE l_returnflag = 'R')) AS others_
  FROM lineitem GROUP BY l_orderkey),
rel AS (
  SELECT o_custkey AS name, o_orderkey AS ordinal, o_orderkey AS version, o_orderdate AS published_at, o_orderkey % 2 AS line,
         c_nationkey AS publisher, coalesce(deps_, []::BIGINT[]) AS deps, coalesce(others_, []::BIGINT[]) AS others
  FROM orders JOIN sets ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey),
pre AS (
  SELECT *, lag(deps) OVER line_order AS was, lag(version) OVER line_order AS from_version, row_number() OVER line_order AS nth
  FROM rel WINDOW line_order AS (PARTITION BY name, line ORDER BY published_at, ordinal)),
trans AS (
  SELECT name, line, publisher, from_version, version AS to_version, published_at AS to_ts,
         list_filter(was, lambda x: NOT list_contains(deps, x) AND NOT list_contains(others, x)) AS removed,
         list_filter(was, lambda x: NOT list_contains(deps, x) AND list_contains(others, x)) AS reclassified,
         list_filter(deps, lambda x: NOT list_contains(was, x)) AS added
  FROM pre WHERE nth > 1)"""


def transitions(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import migration

    return migration.transitions(releases(spark, d), ["name", "line"], ["published_at", "ordinal"], others="others", keep=["publisher"])


def declared(spark: SparkSession, d: str) -> DataFrame:
    """name, version, target, kind."""
    orders, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("version"), (F.col("l_suppkey") % TARGETS).alias("target"), F.col("l_returnflag").alias("kind"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    """name (event type), day, downloads: counts scaled so that busy days pass 1000, and 0 on every eleventh day."""
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("name"), F.to_date("ts").alias("day")).agg((F.count("*") * 1000).alias("n"))
    return e.select("name", "day", F.when(F.dayofyear("day") % 11 == 0, F.lit(0)).otherwise(F.col("n")).cast("long").alias("downloads"))


DAILY = """
daily AS (
  SELECT event_type AS name, CAST(ts AS DATE) AS day, CASE WHEN dayofyear(CAST(ts AS DATE)) % 11 = 0 THEN 0 ELSE count(*) * 1000 END AS downloads
  FROM events GROUP BY 1, 2)"""
