"""Queries of scans, projections, joins, aggregates, windows, sorts and set operations (S, P, J, A, W, L, U, F)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import arrays
from ..operators import checks, relational as r, windows as w
from ..sources import scan
from .fixtures import table
from .registry import register


@register("scan_project_filter", """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1995-07-01' AND l_returnflag = 'R'""")
def scan_project_filter(spark, d):
    df = scan.require_columns(scan.parquet(spark, f"{d}/lineitem.parquet"), "l_orderkey")
    return df.where((F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp")) & (F.col("l_shipdate") < F.lit("1995-07-01").cast("timestamp")) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("quantity"))


@register("case_ladder", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' WHEN o_totalprice IS NULL THEN NULL ELSE 'low' END AS band, o_orderstatus IS DISTINCT FROM 'F' AS not_f FROM orders")
def case_ladder(spark, d):
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.when(p > 200000, "high").when(p > 100000, "mid").when(p.isNull(), None).otherwise("low").alias("band"), (~F.col("o_orderstatus").eqNullSafe("F")).alias("not_f"))


@register("pricing_summary", """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty, count(*) AS n, CAST(min(l_quantity) AS DOUBLE) AS low, count(DISTINCT l_suppkey) AS suppliers,
  count(*) FILTER (WHERE l_discount > 0.05) AS discounted, bool_or(l_tax > 0.07) AS any_taxed, bool_and(l_quantity > 0) AS all_positive FROM lineitem GROUP BY 1, 2""")
def pricing_summary(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("sum_qty"), F.count("*").alias("n"), F.min("l_quantity").alias("low"), F.countDistinct("l_suppkey").alias("suppliers"),
        F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.bool_or(F.col("l_tax") > 0.07).alias("any_taxed"), F.bool_and(F.col("l_quantity") > 0).alias("all_positive"),
    )


@register("joins_inner_left", """SELECT n_name, count(c_custkey) AS customers, count(o_orderkey) AS orders FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1""")
def joins_inner_left(spark, d):
    n, c, o = table(spark, d, "nation"), table(spark, d, "customer"), table(spark, d, "orders").where("o_orderstatus = 'F'")
    return n.join(c, n.n_nationkey == c.c_nationkey, "left").join(o, c.c_custkey == o.o_custkey, "left").groupBy("n_name").agg(F.count("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"))


@register("semi_anti", """SELECT (SELECT count(*) FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS with_orders, (SELECT count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')) AS without_urgent""")
def semi_anti(spark, d):
    c, o = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders")
    a = c.join(o.select(F.col("o_custkey").alias("k")), "k", "left_semi").agg(F.count("*").alias("with_orders"))
    b = c.join(o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")), "k", "left_anti").agg(F.count("*").alias("without_urgent"))
    return a.crossJoin(b)


@register("reconcile_sets", """SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS in_a, b.k IS NOT NULL AS in_b FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_nationkey < 5) b ON a.k = b.k""")
def reconcile_sets(spark, d):
    a = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))
    return r.reconcile(a, table(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("k")), ["k"])


@register("null_safe_join", """WITH x AS (SELECT event_id, nullif(event_type, 'view') AS t FROM events), y AS (SELECT DISTINCT nullif(event_type, 'view') AS t, event_type FROM events) SELECT event_id, event_type FROM x JOIN y ON x.t IS NOT DISTINCT FROM y.t""")
def null_safe_join(spark, d):
    e = table(spark, d, "events")
    t = F.nullif("event_type", F.lit("view")).alias("t")
    return r.null_safe_join(e.select("event_id", t), e.select(t, "event_type").distinct(), ["t"]).select("event_id", "event_type")


ASOF = """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), q AS (SELECT user_id, ts, max(event_id) AS last_id FROM events WHERE event_type = 'click' GROUP BY 1, 2) """


def _sides(spark, d):
    e = table(spark, d, "events")
    return e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'click'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("other_id"))


@register("asof_backward", ASOF + "SELECT l.event_id, q.last_id AS other_id, q.ts AS matched_at FROM l ASOF LEFT JOIN q ON l.user_id = q.user_id AND l.ts >= q.ts")
def asof_backward(spark, d):
    a, b = _sides(spark, d)
    return r.asof_join(a, b, "ts", "at", ["user_id"], ["other_id"]).select("event_id", "other_id", "matched_at")


@register("asof_strict", ASOF + "SELECT l.event_id, q.last_id AS other_id FROM l ASOF LEFT JOIN q ON l.user_id = q.user_id AND l.ts > q.ts")
def asof_strict(spark, d):
    a, b = _sides(spark, d)
    return r.asof_join(a, b, "ts", "at", ["user_id"], ["other_id"], strict=True).select("event_id", "other_id")


@register("asof_forward_within", """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), q AS (SELECT user_id, ts, min(event_id) AS first_id FROM events WHERE event_type = 'click' GROUP BY 1, 2),
j AS (SELECT l.event_id, l.ts, q.first_id, q.ts AS next_ts FROM l ASOF LEFT JOIN q ON l.user_id = q.user_id AND l.ts <= q.ts)
SELECT event_id, CASE WHEN next_ts - ts <= INTERVAL 3 DAY THEN first_id END AS other_id FROM j""")
def asof_forward_within(spark, d):
    a, b = _sides(spark, d)
    return r.asof_join(a, b, "ts", "at", ["user_id"], ["other_id"], direction="forward", tolerance=F.expr("INTERVAL 3 DAY")).select("event_id", "other_id")


SPANS = """WITH s AS (SELECT o_custkey AS k, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to, o_orderkey FROM orders) """


@register("point_in_interval", SPANS + "SELECT event_id, o_orderkey FROM events JOIN s ON s.k = user_id AND ts - INTERVAL 27 YEAR >= valid_from AND (valid_to IS NULL OR ts - INTERVAL 27 YEAR < valid_to)")
def point_in_interval(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate", "o_orderkey")
    s = w.spans(o, ["k"], ["o_orderdate", "o_orderkey"], "o_orderdate", "o_orderkey", only_changes=False)
    p = table(spark, d, "events").select("event_id", F.col("user_id").alias("k"), (F.col("ts") - F.expr("INTERVAL 27 YEAR")).alias("at"))
    return r.point_in_interval(p, s, ["k"], "at").select("event_id", "o_orderkey")


@register("binned_range_join", "SELECT p_partkey, b.lo FROM part JOIN (VALUES (900, 950), (940, 1200), (1500, 1501)) b(lo, hi) ON CAST(p_retailprice AS BIGINT) >= lo AND CAST(p_retailprice AS BIGINT) < hi")
def binned_range_join(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.round("p_retailprice").cast("long").alias("price"))
    return r.binned_interval_join(p, scan.values(spark, [(900, 950), (940, 1200), (1500, 1501)], "lo long, hi long"), "price", "lo", "hi", 64).select("p_partkey", "lo")


@register("self_pairs", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def self_pairs(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return s.select(F.col("s_suppkey").alias("a"), "s_nationkey").join(s.select(F.col("s_suppkey").alias("b"), "s_nationkey"), "s_nationkey").where("a < b").select("a", "b")


@register("first_of_group", "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 2")
def first_of_group(spark, d):
    return r.qualify_first(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 2).select("o_custkey", "o_orderkey", "o_orderdate")


@register("best_by_order", "SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS priority FROM orders GROUP BY 1")
def best_by_order(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(r.best("o_orderpriority", "o_orderdate", "o_orderkey").alias("priority"))


@register("sorted_lists", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS priorities, count(DISTINCT (o_orderstatus, o_orderpriority)) AS combos FROM orders GROUP BY 1")
def sorted_lists(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), "|").alias("priorities"), F.countDistinct(F.struct("o_orderstatus", "o_orderpriority")).alias("combos"))


@register("quantiles", "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.9) AS p90, quantile_cont(l_quantity, 0.99) AS p99, median(l_extendedprice) AS med FROM lineitem GROUP BY 1")
def quantiles(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(*[F.percentile("l_quantity", F.lit(q)).alias(n) for q, n in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))], F.median("l_extendedprice").alias("med"))


@register("group_share", "SELECT l_returnflag, l_linenumber, n, n::DOUBLE / sum(n) OVER (PARTITION BY l_returnflag) AS share FROM (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def group_share(spark, d):
    return r.share_of_group(table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n")), "n", ["l_returnflag"], "share")


@register("filled_grid", "WITH f AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1, 2) SELECT g.nation, s.segment, coalesce(n, 0) AS n FROM (SELECT n_nationkey AS nation FROM nation) g CROSS JOIN (SELECT DISTINCT c_mktsegment AS segment FROM customer) s LEFT JOIN f ON f.nation = g.nation AND f.segment = s.segment")
def filled_grid(spark, d):
    c = table(spark, d, "customer")
    facts = c.groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    return r.filled_grid(facts, table(spark, d, "nation").select(F.col("n_nationkey").alias("nation")), c.select(F.col("c_mktsegment").alias("segment")).distinct(), measures=["n"])


@register("histogram", "SELECT CASE WHEN l_quantity < 10 THEN 'a' WHEN l_quantity < 25 THEN 'b' ELSE 'c' END AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy(F.when(q < 10, "a").when(q < 25, "b").otherwise("c").alias("bucket")).agg(F.count("*").alias("n"))


@register("rollup_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def rollup_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@register("record_setters", "SELECT o_custkey, o_orderkey FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM orders) WHERE top IS NULL OR o_totalprice > top")
def record_setters(spark, d):
    return w.record_setters(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_custkey", "o_orderkey")


@register("best_so_far", "SELECT o_orderkey, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM orders")
def best_so_far(spark, d):
    return w.best_so_far(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", "best").select("o_orderkey", "best")


ISLANDS = """WITH i AS (SELECT l_suppkey AS k, CAST(l_orderkey % 500 AS BIGINT) AS s, CAST(l_orderkey % 500 + l_linenumber AS BIGINT) AS e FROM lineitem),
m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m),
isl AS (SELECT k, min(s) AS start_index, max(e) AS end_index FROM n GROUP BY k, g)"""


def _intervals(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") % 500).alias("start_index"), (F.col("l_orderkey") % 500 + F.col("l_linenumber")).alias("end_index"))


@register("islands", ISLANDS + " SELECT * FROM isl")
def islands(spark, d):
    return w.islands(_intervals(spark, d), ["k"])


@register("running_intervals", ISLANDS + """, ev AS (SELECT k % 10 AS g, i, sum(x) AS delta FROM (SELECT k, s AS i, 1 AS x FROM i UNION ALL SELECT k, e, -1 FROM i) GROUP BY 1, 2 HAVING sum(x) <> 0),
run AS (SELECT g, i AS start_index, lead(i, 1, 600) OVER (PARTITION BY g ORDER BY i) AS end_index, sum(delta) OVER (PARTITION BY g ORDER BY i) AS active FROM ev)
SELECT g, start_index, end_index, CAST(active AS BIGINT) AS active FROM run WHERE active <> 0 AND start_index < end_index""")
def running_intervals(spark, d):
    rows = _intervals(spark, d).withColumn("g", F.col("k") % 10)
    return w.running(w.deltas(rows, ["g"]), ["g"], 600)


@register("densified", ISLANDS + " SELECT k, unnest(range(start_index, end_index)) AS index FROM isl")
def densified(spark, d):
    return w.densify(w.islands(_intervals(spark, d), ["k"])).select("k", "index")


@register("interval_faults", ISLANDS + " SELECT k, min(start_index) AS low, max(end_index) AS high FROM isl GROUP BY 1 HAVING count(*) > 1 OR min(start_index) <> 0 OR max(end_index) <> 506")
def interval_faults(spark, d):
    return w.coverage_faults(w.islands(_intervals(spark, d), ["k"]), ["k"], 0, 506).select("k", "low", "high")


@register("previous_delta", "WITH x AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER v AS rn, lead(o_totalprice) OVER v AS was FROM orders WINDOW v AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)) SELECT o_custkey, o_orderkey, o_totalprice - was AS delta FROM x WHERE rn = 1")
def previous_delta(spark, d):
    return w.previous_delta(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], "o_totalprice").select("o_custkey", "o_orderkey", F.col("o_totalprice_delta").alias("delta"))


@register("top_ordered", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20")
def top_ordered(spark, d):
    return table(spark, d, "customer").orderBy(F.col("c_acctbal").desc_nulls_last(), "c_custkey").limit(20).select("c_custkey", "c_acctbal")


@register("hash_sample", "SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey) AS rn FROM customer) WHERE rn <= 3")
def hash_sample(spark, d):
    return r.qualify_first(table(spark, d, "customer"), ["c_mktsegment"], [F.md5(F.col("c_custkey").cast("string")), F.col("c_custkey")], 3).select("c_custkey", "c_mktsegment")


@register("set_operations", """SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT 'except_all', count(*) FROM (SELECT o_orderpriority FROM orders EXCEPT ALL SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'F')""")
def set_operations(spark, d):
    c, s, o = table(spark, d, "customer"), table(spark, d, "supplier"), table(spark, d, "orders")
    k = o.select("o_custkey")
    parts = {
        "union": c.select("c_nationkey").union(s.select("s_nationkey")).distinct(), "except": c.select("c_custkey").subtract(k), "intersect": c.select("c_custkey").intersect(o.where("o_orderstatus = 'P'").select("o_custkey")),
        "except_all": o.select("o_orderpriority").exceptAll(o.where("o_orderstatus = 'F'").select("o_orderpriority")),
    }
    return scan.shards([df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n") for op, df in parts.items()])


@register("dense_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) + 100 AS id FROM orders")
def dense_ids(spark, d):
    return r.dense_ids(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"], start=100).select("o_orderkey", "id")


@register("stable_ids", "SELECT c_name, c_custkey AS id FROM customer WHERE c_custkey <= 50 UNION ALL SELECT c_name, 50 + row_number() OVER (ORDER BY c_name) FROM customer WHERE c_custkey > 50")
def stable_ids(spark, d):
    c = table(spark, d, "customer")
    return r.stable_ids(c.select("c_name"), c.where("c_custkey <= 50").select("c_name", F.col("c_custkey").alias("id")), "c_name")


@register("string_functions", """SELECT c_custkey, lower(c_name) AS l, split_part(c_name, '#', 1) AS p, regexp_extract(c_name, '([0-9]+)$', 1) AS digits, regexp_replace(c_mktsegment, '[AEIOU]', '', 'g') AS bare, contains(c_name, '00') AS has, length(c_name) AS n,
  sha256(c_name) AS h, concat_ws(chr(31), c_name, c_mktsegment) AS joined, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer""")
def string_functions(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", F.lower("c_name").alias("l"), F.split_part("c_name", F.lit("#"), F.lit(1)).alias("p"), F.regexp_extract("c_name", "([0-9]+)$", 1).alias("digits"), F.regexp_replace("c_mktsegment", "[AEIOU]", "").alias("bare"),
        F.contains("c_name", F.lit("00")).alias("has"), F.char_length("c_name").cast("long").alias("n"), F.sha2("c_name", 256).alias("h"), F.concat_ws("\x1f", "c_name", "c_mktsegment").alias("joined"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"),
    )


@register("date_functions", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym, CAST(year(o_orderdate) AS INTEGER) AS y, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') AS days, epoch_us(o_orderdate) AS us, CAST(CAST(o_orderdate AS DATE) + CAST((8 - isodow(CAST(o_orderdate AS DATE))) % 7 AS INTEGER) AS DATE) AS monday FROM orders")
def date_functions(spark, d):
    from ..operators.timeseries import monday_on_or_after

    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("ym"), F.year("o_orderdate").alias("y"), F.datediff(F.lit("1998-12-31").cast("date"), day).cast("long").alias("days"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', o_orderdate)").alias("us"), monday_on_or_after(day).alias("monday"))


@register("char_jaccard", "SELECT n_name, jaccard(n_name, 'UNITED STATES') AS j FROM nation")
def char_jaccard(spark, d):
    return table(spark, d, "nation").select("n_name", arrays.char_jaccard(F.col("n_name"), F.lit("UNITED STATES")).alias("j"))


@register("json_functions", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_valid(props) AS BOOLEAN) AS valid FROM events")
def json_functions(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@register("hash_bucket", "SELECT c_custkey, CAST(CAST('0x' || substr(sha256(c_name), 1, 15) AS BIGINT) % 16 AS BIGINT) AS bucket FROM customer")
def hash_bucket(spark, d):
    return table(spark, d, "customer").select("c_custkey", (F.conv(F.substring(F.sha2("c_name", 256), 1, 15), 16, 10).cast("decimal(20,0)") % 16).cast("long").alias("bucket"))


@register("named_checks", """SELECT 'duplicate_orders' AS "check", count(*) AS faults FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'orphan_items', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'customers_without_orders', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def named_checks(spark, d):
    o, i, c = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "customer")
    return checks.named({
        "duplicate_orders": checks.duplicates(o, ["o_orderkey"]), "orphan_items": checks.orphans(i.withColumnRenamed("l_orderkey", "k"), ["k"], o.select(F.col("o_orderkey").alias("k"))),
        "customers_without_orders": checks.orphans(c.select(F.col("c_custkey").alias("k")), ["k"], o.select(F.col("o_custkey").alias("k"))),
    })


@register("row_checks", "SELECT count_if(c_name IS NULL OR trim(c_name) = '' OR length(c_name) > 20) AS bad_name, count_if(c_acctbal < 0) AS negative, count_if(c_nationkey NOT BETWEEN 0 AND 24) AS out_of_range FROM customer")
def row_checks(spark, d):
    return checks.row_checks(table(spark, d, "customer"), bad_name=checks.text_fault("c_name", 20), negative=F.col("c_acctbal") < 0, out_of_range=~F.col("c_nationkey").between(0, 24))


@register("moving_window_counts", "SELECT event_id, count(*) OVER (PARTITION BY user_id) AS per_user, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 8 DAY AS gap FROM events")
def moving_window_counts(spark, d):
    v = W.partitionBy("user_id")
    return table(spark, d, "events").select("event_id", F.count("*").over(v).alias("per_user"), (F.col("ts") - F.lag("ts").over(v.orderBy("ts", "event_id")) > F.expr("INTERVAL 8 DAY")).alias("gap"))
