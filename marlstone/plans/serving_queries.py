"""Serving and load queries (SQ1-SQ17, LD1-LD3) and the streaming shapes in batch (ST1-ST9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import serving as s
from ..streaming import streams as st
from .fixtures import table
from .registry import register

FACTS = "facts AS (SELECT l_suppkey AS name, CAST(l_partkey % 12 AS VARCHAR) || '.' || l_linenumber AS version, CAST(date_trunc('month', l_shipdate) AS DATE) AS snapshot_at, count(*) AS dependents FROM lineitem GROUP BY 1, 2, 3)"


def _facts(spark, d):
    i = table(spark, d, "lineitem")
    return i.groupBy(F.col("l_suppkey").alias("name"), F.concat_ws(".", F.col("l_partkey") % 12, "l_linenumber").alias("version"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("snapshot_at")).agg(F.count("*").alias("dependents"))


@register("serve_overview", """WITH v AS (SELECT o_custkey AS name, arg_max(o_orderpriority, o_orderkey) AS version FROM orders WHERE o_custkey IN (1, 2, 4, 5, 7, 8) GROUP BY 1),
m AS (SELECT o_custkey AS name, o_orderdate AS snapshot_at, o_totalprice AS stars, row_number() OVER w AS rn, o_totalprice - lead(o_totalprice) OVER w AS stars_delta FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC))
SELECT v.name, version, snapshot_at, stars, stars_delta FROM v LEFT JOIN m ON m.name = v.name AND rn = 1""")
def serve_overview(spark, d):
    o = table(spark, d, "orders")
    versions = o.select(F.col("o_custkey").alias("name"), F.col("o_orderpriority").alias("version"), F.array("o_orderstatus").alias("licenses"), F.col("o_orderkey").alias("ordinal"))
    return s.overview(versions, o.select(F.col("o_custkey").alias("name"), F.col("o_orderdate").alias("snapshot_at"), F.col("o_totalprice").alias("stars")), [1, 2, 4, 5, 7, 8]).drop("licenses")


@register("serve_downloads_trend", """WITH f AS (SELECT l_suppkey AS name, CAST(date_trunc('month', l_shipdate) AS DATE) AS snapshot_at, count(*) AS downloads FROM lineitem GROUP BY 1, 2), c AS (SELECT snapshot_at, lag(snapshot_at) OVER (ORDER BY snapshot_at) AS previous_at FROM (SELECT DISTINCT snapshot_at FROM f))
SELECT name, snapshot_at, downloads, previous_at FROM f JOIN c USING (snapshot_at) WHERE name IN (1, 2) AND snapshot_at BETWEEN DATE '1994-01-01' AND DATE '1995-12-31'""")
def serve_downloads_trend(spark, d):
    f = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("name"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("snapshot_at")).agg(F.count("*").alias("downloads"))
    return s.downloads_trend(f, [1, 2], F.lit("1994-01-01").cast("date"), F.lit("1995-12-31").cast("date"))


@register("serve_dependents_trend", f"""WITH {FACTS}, a AS (SELECT name, split_part(version, '.', 1) AS major, snapshot_at, CAST(sum(dependents) AS BIGINT) AS dependents FROM facts WHERE name IN (1, 3) GROUP BY 1, 2, 3) SELECT * FROM a""")
def serve_dependents_trend(spark, d):
    return s.dependents_trend(_facts(spark, d), [1, 3], F.lit("1900-01-01").cast("date"), F.lit("2100-01-01").cast("date"))


@register("serve_version_share", f"""WITH {FACTS}, n AS (SELECT * FROM facts WHERE name IN (1, 2, 3)), h AS (SELECT name, snapshot_at, split_part(version, '.', 1) AS major, CAST(sum(dependents) AS BIGINT) AS dependents FROM n WHERE snapshot_at = (SELECT max(snapshot_at) FROM n) GROUP BY 1, 2, 3)
SELECT *, dependents::DOUBLE / sum(dependents) OVER (PARTITION BY name) AS share FROM h""")
def serve_version_share(spark, d):
    return s.version_share(_facts(spark, d), [1, 2, 3])


@register("serve_search", """WITH p AS (SELECT CASE p_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN upper(p_name) ELSE 'x-' || p_name END AS name, p_retailprice AS downloads FROM part),
m AS (SELECT *, CASE WHEN lower(name) = 'red' THEN 0 WHEN starts_with(lower(name), 'red') THEN 1 ELSE 2 END AS tier FROM p WHERE contains(lower(name), 'red'))
SELECT name, downloads, CAST(tier AS INTEGER) AS tier FROM m ORDER BY tier, downloads DESC NULLS LAST, name LIMIT 150""")
def serve_search(spark, d):
    """Names equal to the query, names that begin with it, and names that have it within."""
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.split_part("p_name", F.lit(" "), F.lit(1))).when(k == 1, F.upper("p_name")).otherwise(F.concat(F.lit("x-"), "p_name"))
    return s.search(table(spark, d, "part").select(name.alias("name"), F.col("p_retailprice").alias("downloads")), "red", 150)


@register("serve_recent_versions", "WITH n(at_, name) AS (VALUES (0, 7), (1, 4), (2, 1)), r AS (SELECT at_, o_custkey AS name, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders JOIN n ON name = o_custkey) SELECT at_, name, o_orderkey FROM r WHERE rn <= 3")
def serve_recent_versions(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("name"), "o_orderkey", F.col("o_orderkey").alias("ordinal"), F.col("o_orderkey").alias("version"))
    return s.recent_versions(o, ["7", "4", "1"], 3).select(F.col("at").alias("at_"), F.col("name").cast("int").alias("name"), "o_orderkey")


@register("serve_best_of_majors", f"WITH {FACTS}, b AS (SELECT name, regexp_extract(version, '^[0-9]+') AS major, max(version) AS version, max(ord) AS ord FROM (SELECT name, version, hash_ AS ord FROM (SELECT DISTINCT name, version, CAST(split_part(version, '.', 1) AS BIGINT) * 100 + CAST(split_part(version, '.', 2) AS BIGINT) AS hash_ FROM facts)) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ord DESC) AS rn FROM b) SELECT name, major, version FROM r WHERE rn <= 4 AND name BETWEEN 1 AND 5")
def serve_best_of_majors(spark, d):
    v = _facts(spark, d).select("name", "version").distinct().withColumn("ordinal", F.split_part("version", F.lit("."), F.lit(1)).cast("long") * 100 + F.split_part("version", F.lit("."), F.lit(2)).cast("long"))
    return s.best_of_majors(v, [1, 2, 3, 4, 5], 4).select("name", "major", "version")


@register("serve_scope_flags", "SELECT c_custkey AS name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders, EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey) AS has_events FROM customer")
def serve_scope_flags(spark, d):
    name = lambda t, c: table(spark, d, t).select(F.col(c).alias("name"))
    return s.scope_flags(name("customer", "c_custkey"), has_orders=name("orders", "o_custkey"), has_events=name("events", "user_id"))


@register("serve_environments", "SELECT o_custkey AS name, o_orderkey AS version, at_ FROM orders JOIN (VALUES (0, 1, 1), (1, 2, 2)) v(at_, n, k) ON o_orderkey % 10 = n AND o_custkey % 10 = k")
def serve_environments(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 10).cast("string").alias("name"), (F.col("o_custkey") % 10).cast("string").alias("version"), "o_orderkey", "o_custkey")
    return s.environments(o, ["1", "2"], ["1", "2"]).select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("version"), F.col("at").alias("at_"))


@register("load_ranked_pairs", """WITH raw AS (SELECT l_orderkey % 40 AS a, l_suppkey % 45 AS b, min(l_linenumber * 1000 + l_partkey % 1000) AS rank FROM lineitem GROUP BY 1, 2), k AS (SELECT * FROM raw WHERE a < 38 AND b < 38 AND a <> b), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY rank, b) AS rn FROM k) SELECT a AS a_id, b AS b_id, CAST(rn AS INTEGER) AS rank FROM r WHERE rn <= 10""")
def load_ranked_pairs(spark, d):
    raw = table(spark, d, "lineitem").select((F.col("l_orderkey") % 40).cast("string").alias("a_name"), (F.col("l_suppkey") % 45).cast("string").alias("b_name"), (F.col("l_linenumber") * 1000 + F.col("l_partkey") % 1000).alias("rank"))
    packages = spark.range(38).select(F.col("id").cast("string").alias("name"), F.col("id").alias("package_id"))
    return s.ranked_pairs(raw, packages, 10).select("a_id", "b_id", "rank")


@register("load_counters", "SELECT count(DISTINCT o_custkey) FILTER (WHERE o_custkey > 1000 OR o_custkey < 1) AS unresolved, count(DISTINCT o_custkey) FILTER (WHERE o_custkey BETWEEN 501 AND 1000) AS out_of_scope, count(DISTINCT o_custkey) FILTER (WHERE o_custkey BETWEEN 1 AND 500) AS matched FROM orders")
def load_counters(spark, d):
    ids = lambda n: spark.range(1, n + 1).select(F.col("id").alias("name"))
    return s.resolution_counters(table(spark, d, "orders").select(F.col("o_custkey").alias("name")), ids(1000), ids(500))


@register("state_changes", """WITH e AS (SELECT user_id, ts, max(CAST(event_type = 'error' AS INTEGER)) AS flag FROM events GROUP BY 1, 2), p AS (SELECT *, lag(ts) OVER w AS previous_at, lag(flag) OVER w AS was FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, previous_at, ts AS current_at FROM p WHERE was = 0 AND flag = 1""")
def state_changes(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", (F.col("event_type") == "error").cast("int").alias("flag"))
    return st.state_changes(e, "user_id", "ts", "flag")


@register("weekly_windows", "SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n FROM events GROUP BY 1, 2")
def weekly_windows(spark, d):
    return st.weekly_windows(table(spark, d, "events"), "ts", ["event_type"], F.count("*").alias("n")).select("event_type", F.to_date("week.start").alias("week"), "n")


@register("session_windows", """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 8 DAY THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, d):
    return st.session_windows(table(spark, d, "events"), "ts", ["user_id"], F.count("*").alias("n")).select("user_id", F.col("session.start").alias("started"), "n")


@register("empirical_quantiles", "SELECT event_type, count(value) AS n, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90, CASE WHEN count(value) < 30 THEN 'low' WHEN count(value) < 100 THEN 'medium' ELSE 'high' END AS confidence FROM events GROUP BY 1")
def empirical_quantiles(spark, d):
    return st.quantiles(table(spark, d, "events"), ["event_type"], "value")


@register("simulated_sums")
def simulated_sums(spark, d):
    """Seeded simulation; no SQL twin."""
    return st.simulated_sums(table(spark, d, "events").select("event_type", "value"), "event_type", "value", 200, 7)
