"""Queries of calendars, intervals, weekly series and repositories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeseries as t
from .fixtures import DAILY, daily, table
from .registry import register

DATE = "CAST(ts AS DATE)"


@register("snapshot_calendar", "SELECT d AS snapshot_timestamp, row_number() OVER (ORDER BY d) - 1 AS slot, lag(d) OVER (ORDER BY d) AS previous_at, date_diff('day', lag(d) OVER (ORDER BY d), d) AS interval_days FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)")
def snapshot_calendar(spark, d):
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("snapshot_timestamp"))
    return t.calendar(days).select("snapshot_timestamp", F.col("slot").cast("long").alias("slot"), "previous_at", F.col("interval_days").cast("long").alias("interval_days"))


RANGE = """, ends AS (SELECT min(day) AS lo, CAST(min(day) + INTERVAL 60 DAY AS DATE) AS hi FROM daily)"""
INTERVAL = f"""WITH {DAILY}{RANGE},
targets AS (SELECT DISTINCT event_type AS name, CASE WHEN event_type = 'error' THEN 'NOT_FOUND' END AS failed FROM events UNION ALL SELECT 'nothing', NULL),
facts AS (SELECT name, sum(downloads) AS total, count(DISTINCT day) AS observed, count_if(downloads = 0) AS imputed FROM daily, ends WHERE day >= lo AND day < hi GROUP BY 1),
r AS (SELECT t.name, failed, total, coalesce(observed, 0) AS observed_days, coalesce(imputed, 0) AS imputed_days, date_diff('day', lo, hi) AS expected_days FROM targets t LEFT JOIN facts USING (name), ends),
s AS (SELECT *, CASE WHEN failed IS NOT NULL OR observed_days = 0 THEN 'UNAVAILABLE' WHEN observed_days < expected_days OR imputed_days > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM r)"""


def _ends(spark, d):
    lo = daily(spark, d).agg(F.min("day")).first()[0]
    return F.lit(lo), F.date_add(F.lit(lo), 60)


@register("interval_sums", INTERVAL + """ SELECT name, status, observed_days, imputed_days, CASE WHEN status <> 'UNAVAILABLE' THEN CAST(total AS BIGINT) END AS total,
 array_to_string(list_filter([failed, CASE WHEN observed_days = 0 THEN 'NO_OBSERVATION' END, CASE WHEN observed_days > 0 AND observed_days < expected_days THEN 'MISSING_DAYS' END, CASE WHEN imputed_days > 0 THEN 'IMPUTED_DAYS' END], lambda x: x IS NOT NULL), '|') AS reasons FROM s""")
def interval_sums(spark, d):
    lo, hi = _ends(spark, d)
    names = table(spark, d, "events").select(F.col("event_type").alias("name")).distinct().withColumn("failed", F.when(F.col("name") == "error", "NOT_FOUND"))
    targets = names.unionByName(spark.createDataFrame([("nothing", None)], "name string, failed string"))
    rows = t.interval_sums(targets, daily(spark, d).withColumn("gap", F.col("downloads") == 0), lo, hi, gap="gap", failed="failed")
    return rows.select("name", "status", "observed_days", "imputed_days", F.col("total").cast("long").alias("total"), F.array_join("reasons", "|").alias("reasons"))


@register("day_grid", INTERVAL + " SELECT t.name, CAST(g.day AS DATE) AS day, downloads, CASE WHEN downloads IS NULL THEN 'MISSING' ELSE 'OBSERVED' END AS quality FROM targets t CROSS JOIN (SELECT unnest(generate_series(lo, hi - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day FROM ends) g LEFT JOIN daily d ON d.name = t.name AND d.day = CAST(g.day AS DATE)")
def day_grid(spark, d):
    lo, hi = _ends(spark, d)
    names = table(spark, d, "events").select(F.col("event_type").alias("name")).distinct().unionByName(spark.createDataFrame([("nothing",)], "name string"))
    return t.day_grid(names, daily(spark, d), lo, hi)


@register("unmatched_targets", "SELECT c_custkey AS name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def unmatched_targets(spark, d):
    return t.unmatched(table(spark, d, "customer").select(F.col("c_custkey").alias("name")), table(spark, d, "events").select(F.col("user_id").alias("name")))


@register("outages", f"""WITH {DAILY}, m AS (SELECT *, quantile_cont(downloads, 0.5) OVER (PARTITION BY name ORDER BY day ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS med FROM daily)
SELECT name, day, CASE WHEN downloads = 0 AND med >= 1000 THEN NULL ELSE downloads END AS downloads, downloads = 0 AND med >= 1000 AS imputed_gap FROM m""")
def outages(spark, d):
    return t.outages(daily(spark, d)).select("name", "day", "downloads", "imputed_gap")


WEEKS = """WITH o AS (SELECT o_custkey AS name, CAST(o_orderdate AS DATE) AS snapshot_at, o_orderkey FROM orders),
p AS (SELECT name, lag(snapshot_at) OVER (PARTITION BY name ORDER BY snapshot_at, o_orderkey) AS previous_at, snapshot_at, o_orderkey % 1000 AS value FROM o),
i AS (SELECT * FROM p WHERE previous_at < snapshot_at),
w AS (SELECT *, CAST(unnest(generate_series(previous_at + CAST(8 - isodow(previous_at) AS INTEGER), snapshot_at + CAST((8 - isodow(snapshot_at)) % 7 AS INTEGER), INTERVAL 7 DAY)) AS DATE) AS monday FROM i),
x AS (SELECT *, date_diff('day', greatest(previous_at, monday - 7), least(snapshot_at, monday)) AS overlap FROM w),
s AS (SELECT name, monday, sum(overlap) AS covered, sum(round(CAST(value * overlap AS DECIMAL(26,9)) / date_diff('day', previous_at, snapshot_at), 6)) AS total FROM x WHERE overlap > 0 GROUP BY 1, 2)"""


def _weeks(spark, d):
    from pyspark.sql import Window as W

    o = table(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.to_date("o_orderdate").alias("snapshot_at"), "o_orderkey")
    w = W.partitionBy("name").orderBy("snapshot_at", "o_orderkey")
    return o.withColumn("previous_at", F.lag("snapshot_at").over(w)).withColumn("value", F.col("o_orderkey") % 1000).where("previous_at < snapshot_at")


@register("weekly_rebucket", WEEKS + " SELECT name, monday, CAST(round(CAST(total AS DECIMAL(38,6)), 0) AS BIGINT) AS value FROM s WHERE covered = 7 AND monday BETWEEN DATE '1993-01-01' AND DATE '1997-12-31'")
def weekly_rebucket(spark, d):
    return t.weekly(_weeks(spark, d), F.lit("1993-01-01").cast("date"), F.lit("1997-12-31").cast("date"))


@register("monday_interpolation", """WITH o AS (SELECT o_custkey AS name, CAST(o_orderdate AS DATE) AS obs, max(o_orderkey % 1000) AS v FROM orders GROUP BY 1, 2),
n AS (SELECT *, lead(obs) OVER w AS to_, lead(v) OVER w AS v2 FROM o WINDOW w AS (PARTITION BY name ORDER BY obs)),
m AS (SELECT *, CAST(unnest(generate_series(obs + CAST((8 - isodow(obs)) % 7 AS INTEGER), coalesce(to_ - 1, obs), INTERVAL 7 DAY)) AS DATE) AS monday FROM n)
SELECT name, monday, CASE WHEN monday = obs THEN v ELSE CAST(round(CAST(v AS DECIMAL(26,6)) + CAST(round(CAST((v2 - v) * date_diff('day', obs, monday) AS DECIMAL(30,9)) / date_diff('day', obs, to_), 6) AS DECIMAL(26,6)), 0) AS BIGINT) END AS value
FROM m WHERE monday BETWEEN DATE '1992-01-01' AND DATE '1998-12-31'""")
def monday_interpolation(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("name"), F.to_date("o_orderdate").alias("snapshot_at")).agg(F.max(F.col("o_orderkey") % 1000).alias("value"))
    return t.interpolated(o, F.lit("1992-01-01").cast("date"), F.lit("1998-12-31").cast("date"), ["name"])


@register("without_leading_zeros", f"WITH {DAILY}, z AS (SELECT name, day, CASE WHEN day < (SELECT min(day) FROM daily) + 20 THEN 0 ELSE downloads END AS v FROM daily), f AS (SELECT name, min(day) FILTER (WHERE v > 0) AS since FROM z GROUP BY 1) SELECT name, day, v FROM z JOIN f USING (name) WHERE day >= since")
def without_leading_zeros(spark, d):
    rows = daily(spark, d)
    lo = rows.agg(F.min("day")).first()[0]
    return t.without_leading_zeros(rows.select("name", "day", F.when(F.col("day") < F.date_add(F.lit(lo), 20), 0).otherwise(F.col("downloads")).alias("v")), ["name"], "day", "v")


SPAN = """WITH s AS (SELECT o_custkey AS name, o_orderdate AS obs, o_orderkey, o_orderpriority AS url FROM orders),
c AS (SELECT *, lag(url) OVER (PARTITION BY name ORDER BY obs, o_orderkey) AS was, row_number() OVER (PARTITION BY name ORDER BY obs, o_orderkey) AS n FROM s),
sp AS (SELECT name, url, obs AS valid_from, lead(obs) OVER (PARTITION BY name ORDER BY obs, o_orderkey) AS valid_to FROM c WHERE n = 1 OR url <> was)"""


def _spans(spark, d):
    from ..operators.windows import spans

    s = table(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderdate").alias("at"), "o_orderkey", F.col("o_orderpriority").alias("url"))
    return spans(s, ["name"], ["at", "o_orderkey"], "at", "url").select("name", "url", "valid_from", "valid_to")


@register("repository_spans", SPAN + " SELECT * FROM sp")
def repository_spans(spark, d):
    return _spans(spark, d)


@register("month_grid", SPAN + " SELECT name, url, CAST(m.month AS DATE) AS month FROM sp JOIN (SELECT unnest(generate_series(DATE '1993-01-01', DATE '1996-12-01', INTERVAL 1 MONTH)) AS month) m ON m.month >= valid_from AND (valid_to IS NULL OR m.month < valid_to)")
def month_grid(spark, d):
    return t.month_grid(_spans(spark, d), F.lit("1993-01-01").cast("date"), F.lit("1996-12-01").cast("date"), ["name"]).select("name", "url", "month")


@register("alias_distance", f"WITH {DAILY} SELECT a.name AS a, b.name AS b, count(*) AS n, avg(abs(a.downloads - b.downloads)::DOUBLE / nullif(greatest(a.downloads, b.downloads), 0)) AS distance FROM daily a JOIN daily b ON a.day = b.day AND a.name < b.name GROUP BY 1, 2")
def alias_distance(spark, d):
    rows = daily(spark, d)
    names = rows.select("name").distinct()
    pairs = names.select(F.col("name").alias("a")).join(names.select(F.col("name").alias("b")), F.col("a") < F.col("b"))
    return t.alias_distance(rows, pairs, "name", "day", "downloads")


@register("best_repository", "SELECT o_custkey AS name, arg_max(o_orderpriority, o_orderkey) FILTER (WHERE o_orderpriority <> '5-LOW') AS url FROM orders GROUP BY 1 HAVING count_if(o_orderpriority <> '5-LOW') > 0")
def best_repository(spark, d):
    return t.best_repository(table(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("ordinal"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("url")))


@register("matched_metrics", """WITH m AS (SELECT DISTINCT user_id AS url, event_type AS stars FROM events WHERE CAST(ts AS DATE) = (SELECT min(CAST(ts AS DATE)) FROM events)),
g AS (SELECT url, count(*) AS n, max(stars) AS stars FROM m GROUP BY 1)
SELECT c_custkey AS url, CASE WHEN n IS NULL THEN 'UNMAPPED' WHEN n > 1 THEN 'CONFLICT' ELSE 'MATCHED' END AS metric_status, CASE WHEN n = 1 THEN stars END AS stars FROM customer LEFT JOIN g ON url = c_custkey""")
def matched_metrics(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("url"), F.to_date("ts").alias("snapshot_at"), F.col("event_type").alias("stars"))
    first = e.agg(F.min("snapshot_at")).first()[0]
    return t.matched_metrics(table(spark, d, "customer").select(F.col("c_custkey").alias("url")), e, F.lit(first), values=("stars",))


@register("repository_timeline", """WITH s AS (SELECT o_custkey AS name, CAST(o_orderdate AS DATE) AS obs, CAST(o_orderkey % 7 AS BIGINT) AS rank, o_orderpriority AS url FROM orders),
b AS (SELECT name, obs, min([CAST(rank AS VARCHAR), url]) AS best FROM s GROUP BY 1, 2),
r AS (SELECT name, obs, min(best) OVER (PARTITION BY name ORDER BY obs) AS best FROM b),
c AS (SELECT *, lag(best[2]) OVER (PARTITION BY name ORDER BY obs) AS was, row_number() OVER (PARTITION BY name ORDER BY obs) AS n FROM r)
SELECT name, best[2] AS url, obs AS valid_from, lead(obs) OVER (PARTITION BY name ORDER BY obs) AS valid_to FROM c WHERE n = 1 OR best[2] <> was""")
def repository_timeline(spark, d):
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.to_date("o_orderdate").alias("at"), (F.col("o_orderkey") % 7).alias("rank"), F.col("o_orderpriority").alias("url"))
    return t.repository_timeline(s, ["name"], "at", "rank", "url")


@register("inherited_metadata", """WITH o AS (SELECT o_custkey AS name, o_orderkey, o_orderpriority FROM orders)
SELECT n.name, n.o_orderkey, p.o_orderkey AS matched_o_orderkey, p.o_orderpriority AS inherited FROM (SELECT name, o_orderkey FROM o WHERE o_orderkey % 3 = 0) n ASOF LEFT JOIN (SELECT * FROM o WHERE o_orderkey % 3 <> 0) p ON p.name = n.name AND n.o_orderkey > p.o_orderkey""")
def inherited_metadata(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("name"), "o_orderkey", F.col("o_orderpriority").alias("inherited"))
    return t.inherited(o.where("o_orderkey % 3 = 0").select("name", "o_orderkey"), o.where("o_orderkey % 3 <> 0"), ["name"], "o_orderkey", ["inherited"])


@register("change_set", """WITH a AS (SELECT event_id, event_type, props FROM events WHERE event_id % 5 <> 0),
b AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'changed' ELSE event_type END AS event_type, CASE WHEN event_id % 11 = 0 THEN '{"k": -1}' ELSE replace(props, ': ', ':   ') END AS props FROM events WHERE event_id % 6 <> 0)
SELECT coalesce(a.event_id, b.event_id) AS event_id, CASE WHEN a.event_id IS NULL THEN 'INSERT' WHEN b.event_id IS NULL THEN 'MISSING' ELSE 'UPDATE' END AS action FROM a FULL JOIN b ON a.event_id = b.event_id
WHERE a.event_id IS NULL OR b.event_id IS NULL OR a.event_type IS DISTINCT FROM b.event_type OR json_extract_string(a.props, '$.k') IS DISTINCT FROM json_extract_string(b.props, '$.k')""")
def change_set(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "props")
    i = F.col("event_id")
    new = e.where(i % 6 != 0).select("event_id", F.when(i % 7 == 0, "changed").otherwise(F.col("event_type")).alias("event_type"), F.when(i % 11 == 0, '{"k": -1}').otherwise(F.replace("props", F.lit(": "), F.lit(":   "))).alias("props"))
    return t.change_set(e.where(i % 5 != 0), new, ["event_id"], ["event_type"], ["props"]).select("event_id", "action")


@register("session_segments", "WITH g AS (SELECT event_id, user_id, ts, coalesce(CAST(date_diff('day', CAST(lag(ts) OVER w AS DATE), CAST(ts AS DATE)) > 8 AS BIGINT), 0) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM g")
def session_segments(spark, d):
    return t.sessions(table(spark, d, "events"), ["user_id"], "ts").select("event_id", "segment")


@register("indexed_series", f"WITH {DAILY}, b AS (SELECT name, arg_min(downloads, day) AS base FROM daily WHERE downloads <> 0 GROUP BY 1) SELECT name, day, downloads * 100.0::DOUBLE / base AS indexed FROM daily LEFT JOIN b USING (name)")
def indexed_series(spark, d):
    return t.indexed_to_100(daily(spark, d), ["name"], "day", "downloads").select("name", "day", "indexed")
