"""Queries of operators that stand between the families: gates, texts, snapshots, serving and load steps, functions (beside SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as val
from ..operators import checks, migration, relational as rel, serving as s, text as x, timeseries as ts, vectors as vec
from .fixtures import table
from .registry import register


@register("overlap_join", """WITH b AS (SELECT o_custkey AS k, min(o_orderkey % 100) AS birth FROM orders GROUP BY 1), s AS (SELECT o_custkey AS k, o_orderkey % 90 AS a, o_orderkey % 90 + o_orderkey % 30 AS z FROM orders)
SELECT k, birth, greatest(birth, a) AS start_index, z AS end_index FROM b JOIN s USING (k) WHERE greatest(birth, a) < z""")
def overlap_join(spark, d):
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    births = o.groupBy(F.col("o_custkey").alias("k")).agg(F.min(key % 100).alias("birth"))
    return rel.overlap_join(births, o.select(F.col("o_custkey").alias("k"), (key % 90).alias("start_index"), (key % 90 + key % 30).alias("end_index")), ["k"], "birth")


HALF = "CAST(sum(CAST(CAST('0x' || substr(m, {}, 16) AS UBIGINT) AS DECIMAL(38,0))) AS VARCHAR) AS {}"


@register("table_checksum", f"SELECT {HALF.format(1, 'high')}, {HALF.format(17, 'low')} FROM (SELECT md5('{{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}}') AS m FROM nation)")
def table_checksum(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return n.agg(checks.table_checksum(n).alias("c")).select(F.col("c.high").cast("string").alias("high"), F.col("c.low").cast("string").alias("low"))


@register("top_targets", "WITH t AS (SELECT l_suppkey AS target, min(l_extendedprice) AS least FROM lineitem GROUP BY 1 ORDER BY 2, 1 LIMIT 5) SELECT l_suppkey AS target, l_orderkey, l_linenumber, l_extendedprice AS price FROM lineitem JOIN t ON t.target = l_suppkey")
def top_targets(spark, d):
    i = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("target"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))
    return rel.top_targets(i, "target", ["price"], 5)


@register("balanced_sample", "SELECT true AS finished, CAST(20 AS BIGINT) AS n, CAST(20 AS BIGINT) AS n_distinct UNION ALL SELECT false, 20, 20")
def balanced_sample(spark, d):
    o = table(spark, d, "orders")
    finished = F.col("o_orderstatus") == "F"
    return rel.balanced_sample(o, finished, 20, 7, "o_orderkey").groupBy(finished.alias("finished")).agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("n_distinct"))


@register("sample_closure", "SELECT CAST(0 AS BIGINT) AS lacking, CAST(0 AS BIGINT) AS unneeded")
def sample_closure(spark, d):
    """Every customer that the sampled orders refer to is there, and no other."""
    picked, closed = rel.sample_with_closure(table(spark, d, "orders"), 0.1, 11, {"o_custkey": (table(spark, d, "customer"), "c_custkey")})
    sides = rel.reconcile(picked.select(F.col("o_custkey").alias("k")), closed["o_custkey"].select(F.col("c_custkey").alias("k")), ["k"])
    return sides.agg(F.count_if(F.col("in_a") & ~F.col("in_b")).alias("lacking"), F.count_if(~F.col("in_a") & F.col("in_b")).alias("unneeded"))


@register("projection", "SELECT * EXCLUDE (p_brand, p_type) REPLACE (upper(p_name) AS p_name, p_size * 2 AS p_size) FROM part")
def projection(spark, d):
    return rel.projected(table(spark, d, "part"), ("p_brand", "p_type"), {"p_name": F.upper("p_name"), "p_size": F.col("p_size") * 2})


@register("guarded_sums", "SELECT l_returnflag, CAST(sum(CAST(l_orderkey AS HUGEINT) * 1000000) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def guarded_sums(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(rel.guarded_sum(F.col("l_orderkey").cast("decimal(38,0)") * 1_000_000).alias("total"))


@register("merged_partials", "SELECT l_returnflag, count(*) AS n, count(nullif(l_suppkey, 7)) AS n_values, CAST(sum(nullif(l_suppkey, 7)) AS BIGINT) AS total, min(nullif(l_suppkey, 7)) AS least, max(nullif(l_suppkey, 7)) AS greatest FROM lineitem GROUP BY 1")
def merged_partials(spark, d):
    """Aggregates of seven parts, merged; the sketch is compared with the exact count in a test."""
    i = table(spark, d, "lineitem").withColumn("v", F.nullif("l_suppkey", F.lit(7)))
    return rel.merged_partials(rel.partials(i, ["l_returnflag"], "v", F.col("l_orderkey") % 7), ["l_returnflag"]).drop("about_distinct").withColumn("total", F.col("total").cast("long"))


@register("publisher_keys", """WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '@' || lower(p_type) || '/' || p_partkey ELSE p_name END AS name,
  CASE p_partkey % 4 WHEN 0 THEN 'git+https://GitHub.com/o/r' || p_size || '.git' WHEN 1 THEN 'https://github.com/o/r' || p_size WHEN 2 THEN '' END AS repo FROM part)
SELECT p_partkey, CASE WHEN starts_with(name, '@') THEN split_part(name, '/', 1) WHEN p_partkey % 4 = 0 THEN 'https://github.com/o/r' || p_size WHEN p_partkey % 4 = 1 THEN 'github.com/o/r' || p_size ELSE name END AS publisher FROM n JOIN part USING (p_partkey)""")
def publisher_keys(spark, d):
    """Only one prefix is taken off an address."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("@"), F.lower("p_type"), F.lit("/"), k.cast("string"))).otherwise(F.col("p_name"))
    size = F.col("p_size").cast("string")
    repo = F.when(k % 4 == 0, F.concat(F.lit("git+https://GitHub.com/o/r"), size, F.lit(".git"))).when(k % 4 == 1, F.concat(F.lit("https://github.com/o/r"), size)).when(k % 4 == 2, "")
    return p.select("p_partkey", migration.publisher(name, repo).alias("publisher"))


@register("gates_by_state", "SELECT count(*) FILTER (p_size % 3 = 0) AS archived, count(*) FILTER (p_size % 3 <> 0 AND p_size % 5 = 0) AS small, count(*) FILTER (p_size % 3 <> 0 AND p_size % 5 <> 0) AS kept FROM part")
def gates_by_state(spark, d):
    """V7 with unknown states: null is not archived."""
    size = F.col("p_size")
    pairs = table(spark, d, "part").withColumn("archived", F.when(size % 3 == 0, True).when(size % 3 == 1, False)).withColumn("small", F.when(size % 5 == 0, True))
    kept, drops = vec.gated(pairs, [("archived", vec.is_archived(F.col("archived"))), ("small", F.col("small"))])
    return drops.crossJoin(kept.agg(F.count("*").alias("kept")))


@register("corpus_coverage", "SELECT count(*) AS n, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS covered, (count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)))::DOUBLE / count(*) AS coverage FROM customer")
def corpus_coverage(spark, d):
    return vec.coverage(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey")


@register("symmetric_gold", "WITH p AS (SELECT DISTINCT l_suppkey % 30 AS a, l_partkey % 30 AS b FROM lineitem WHERE l_linenumber = 1) SELECT a, b FROM p WHERE a <> b UNION SELECT b, a FROM p WHERE a <> b")
def symmetric_gold(spark, d):
    return vec.symmetric(table(spark, d, "lineitem").where("l_linenumber = 1").select((F.col("l_suppkey") % 30).alias("a"), (F.col("l_partkey") % 30).alias("b")))


@register("unknown_popularity", """WITH p AS (SELECT l_suppkey AS base, l_orderkey AS other, l_linenumber AS line, CASE WHEN l_partkey % 4 > 0 THEN l_partkey END AS pop FROM lineitem WHERE l_suppkey % 9 = 0 OR l_orderkey % 500 = 0),
n AS (SELECT base, count(*) FILTER (pop >= 1900) AS n FROM p GROUP BY 1)
SELECT base, other, line, pop, CASE WHEN n >= 30 THEN 1900.0::DOUBLE ELSE 0.0 END AS floor FROM p JOIN n USING (base) WHERE n < 30 OR pop >= 1900""")
def unknown_popularity(spark, d):
    """Unknown popularity stays where no floor holds."""
    i = table(spark, d, "lineitem").where("l_suppkey % 9 = 0 or l_orderkey % 500 = 0")
    p = i.select(F.col("l_suppkey").alias("base"), F.col("l_orderkey").alias("other"), F.col("l_linenumber").alias("line"), F.when(F.col("l_partkey") % 4 > 0, F.col("l_partkey")).alias("pop"))
    return vec.popularity_floor(p, "base", "pop", [1900, 0], 30)


PACKAGES = """packages AS (
  SELECT p_name || '-' || p_partkey % 700 AS name, p_partkey % 5 AS fetched_at, p_partkey AS rank, CASE p_partkey % 4 WHEN 0 THEN '  ' WHEN 1 THEN ' ' || p_type END AS description,
    CASE WHEN p_partkey % 6 = 0 THEN [p_brand] WHEN p_partkey % 6 < 4 THEN []::VARCHAR[] END AS keywords, p_partkey % 11 AS dependent_packages_count,
    TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey % 60 + CASE WHEN p_size % 8 = 2 THEN p_partkey % 900 ELSE 0 END AS INTEGER)) AS latest_release_published_at,
    CASE p_partkey % 13 WHEN 0 THEN 'removed' WHEN 1 THEN 'deprecated' END AS status, CASE WHEN p_partkey % 10 > 0 THEN 'o/r' || p_size % 8 END AS repo_full_name,
    CASE WHEN p_size % 2 = 0 THEN 'repo ' || p_size % 8 END AS repo_description, [' JavaScript', 'T' || p_size % 3, 't' || p_size % 3, ''] AS repo_topics, CASE WHEN p_size % 8 < 6 THEN p_size % 8 * 3 END AS repo_stars
  FROM part),
second AS (SELECT p_name || '-' || p_partkey % 700 AS name, p_partkey AS ordinal, CASE WHEN p_partkey % 5 > 1 THEN p_brand ELSE '' END AS description FROM part),
ranks AS (SELECT ' ' || p_name || '-' || p_partkey % 700 AS name, CAST(p_partkey AS INTEGER) AS rank FROM part WHERE p_partkey % 2 = 0)"""


@register("package_texts", f"""WITH {PACKAGES},
newest AS (SELECT unnest(arg_max(p, [fetched_at, -rank])) FROM packages p GROUP BY p.name),
measured AS (
  SELECT *, CASE WHEN repo_full_name IS NULL THEN 0 ELSE count(*) OVER repo END AS n, max(dependent_packages_count) OVER repo < 20 AS unused, coalesce(max(repo_stars) OVER repo, 0) < 10 AS unseen,
    max(latest_release_published_at) OVER repo - min(latest_release_published_at) OVER repo < INTERVAL 90 DAY AS sudden, avg(CAST(coalesce(len(keywords), 0) > 0 AS INTEGER)) OVER repo < 0.15 AS unlabelled
  FROM newest WHERE coalesce(status, '') <> 'removed' WINDOW repo AS (PARTITION BY repo_full_name)),
told AS (
  SELECT m.*, [trim(m.description), trim((SELECT arg_max(description, ordinal) FROM second WHERE second.name = m.name)), trim(repo_description)] AS texts,
    list_sort(list_distinct(CASE WHEN n > 20 THEN [] ELSE ['t' || substr(repo_topics[2], 2)] END)) AS topics_, coalesce(keywords, []) AS words, (SELECT min(ranks.rank) FROM ranks WHERE trim(ranks.name) = m.name) AS download_rank
  FROM measured m),
chosen AS (SELECT *, list_min(list_filter([1, 2, 3], lambda i: texts[i] <> '')) AS which FROM told)
SELECT name, rank, download_rank, texts[which] AS description, coalesce(['npm', 'depsdev', 'repo'][which], 'none') AS description_source, array_to_string(words, '|') AS keywords, array_to_string(topics_, '|') AS topics,
  CASE WHEN words <> [] THEN 'npm' WHEN topics_ <> [] THEN 'github_topics' ELSE 'none' END AS keywords_source, repo_full_name, n AS repo_pkg_count, n >= 100 AND unlabelled AND unused AND (unseen OR sudden) AS is_spam FROM chosen""")
def package_texts(spark, d):
    p, k, size = table(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    name = F.concat("p_name", F.lit("-"), (k % 700).cast("string"))
    eighth = (size % 8).cast("string")
    released = F.date_add(F.lit("2024-01-01").cast("date"), (k % 60 + F.when(size % 8 == 2, k % 900).otherwise(0)).cast("int")).cast("timestamp")
    packages = p.select(
        name.alias("name"), (k % 5).alias("fetched_at"), k.alias("rank"), F.when(k % 4 == 0, "  ").when(k % 4 == 1, F.concat(F.lit(" "), "p_type")).alias("description"),
        F.when(k % 6 == 0, F.array("p_brand")).when(k % 6 < 4, F.array().cast("array<string>")).alias("keywords"), (k % 11).alias("dependent_packages_count"), released.alias("latest_release_published_at"),
        F.when(k % 13 == 0, "removed").when(k % 13 == 1, "deprecated").alias("status"), F.when(k % 10 > 0, F.concat(F.lit("o/r"), eighth)).alias("repo_full_name"), F.when(size % 2 == 0, F.concat(F.lit("repo "), eighth)).alias("repo_description"),
        F.array(F.lit(" JavaScript"), F.concat(F.lit("T"), (size % 3).cast("string")), F.concat(F.lit("t"), (size % 3).cast("string")), F.lit("")).alias("repo_topics"), F.when(size % 8 < 6, size % 8 * 3).alias("repo_stars"),
    )
    second = p.select(name.alias("name"), k.alias("ordinal"), F.when(k % 5 > 1, F.col("p_brand")).otherwise("").alias("description"))
    ranks = p.where(k % 2 == 0).select(F.concat(F.lit(" "), name).alias("name"), k.cast("int").alias("rank"))
    out = x.package_text(packages, second, ranks)
    return out.withColumns({"keywords": F.array_join("keywords", "|"), "topics": F.array_join(F.array_sort("topics"), "|")})


@register("snapshot_reconstruction", """WITH c AS (SELECT c_custkey AS name, TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 40 AS INTEGER)) AS born FROM customer),
spans AS (SELECT c_custkey AS name, 'r' || c_custkey % 50 AS url FROM customer WHERE c_custkey % 7 > 0 AND c_custkey % 20 < 15),
daily AS (SELECT user_id AS name, CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS downloads FROM events GROUP BY 1, 2),
sums AS (SELECT name, CAST(sum(downloads) AS BIGINT) AS total, count(*) AS n FROM daily WHERE day >= DATE '2024-01-10' AND day < DATE '2024-01-17' GROUP BY 1),
metrics AS (SELECT 'r' || s_suppkey % 60 AS url, max(s_suppkey % 10) AS stars, count(DISTINCT s_suppkey % 10) AS pairs FROM supplier WHERE s_suppkey % 3 > 0 GROUP BY 1)
SELECT c.name, total, CAST(coalesce(n, 0) AS BIGINT) AS observed_days, CASE WHEN n IS NULL THEN 'UNAVAILABLE' WHEN n < 7 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status, url, CASE WHEN pairs = 1 THEN stars END AS stars,
  CASE WHEN url IS NULL THEN 'NO_VALID_REPOSITORY' WHEN pairs > 1 THEN 'PROJECT_METRIC_CONFLICT' WHEN pairs IS NULL THEN 'NO_EXACT_OBSERVATION' ELSE 'SELECTED' END AS repository_reason
FROM c LEFT JOIN spans USING (name) LEFT JOIN sums USING (name) LEFT JOIN metrics USING (url) WHERE born <= TIMESTAMP '2024-01-17'""")
def snapshot_reconstruction(spark, d):
    """D46, with the key sets of its parts checked by D47."""
    at = F.lit("2024-01-17 00:00:00").cast("timestamp")
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    packages = c.select(k.alias("name"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 40).cast("int")).cast("timestamp").alias("first_published_at"))
    timeline = c.where(k % 7 > 0).select(
        k.alias("name"), F.concat(F.lit("r"), (k % 50).cast("string")).alias("url"), F.lit("2023-01-01").cast("timestamp").alias("valid_from"), F.when(k % 20 >= 15, at).when(k % 20 > 5, at + F.expr("interval 1 day")).alias("valid_to")
    )
    daily = table(spark, d, "events").groupBy(F.col("user_id").alias("name"), F.to_date("ts").alias("day")).agg(F.count("*").alias("downloads"))
    sk = F.col("s_suppkey")
    metrics = table(spark, d, "supplier").select(F.concat(F.lit("r"), (sk % 60).cast("string")).alias("url"), F.when(sk % 3 > 0, at).otherwise(at + F.expr("interval 1 second")).alias("snapshot_at"), (sk % 10).alias("stars"), F.lit(1).alias("open_issues"))
    out = ts.snapshot_at(packages, timeline, daily, metrics, at, F.lit("2024-01-10").cast("timestamp"))
    whole = ts.integrated(packages.where(F.col("first_published_at") <= at).select("name"), "name", snapshot=out)
    return whole.select("name", F.col("total").cast("long").alias("total"), F.col("observed_days").cast("long").alias("observed_days"), "status", "url", "stars", "repository_reason")


@register("serve_similar", "WITH k AS (SELECT p_partkey AS id, p_name || '#' || p_partkey AS name FROM part) SELECT a.name, b.name AS similar, r AS rank FROM (SELECT DISTINCT l_suppkey AS x, l_partkey AS y, l_partkey % 17 AS r FROM lineitem WHERE l_suppkey <> l_partkey) JOIN k a ON a.id = x JOIN k b ON b.id = y WHERE x = 5 ORDER BY r, b.name LIMIT 30")
def serve_similar(spark, d):
    i = table(spark, d, "lineitem").where("l_suppkey <> l_partkey").select(F.col("l_suppkey").alias("a_id"), F.col("l_partkey").alias("b_id"), (F.col("l_partkey") % 17).alias("rank")).distinct()
    names = table(spark, d, "part").select(F.col("p_partkey").alias("package_id"), F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("name"))
    five = names.where("package_id = 5").first()["name"]
    return s.similar(i, names, five, 30)


@register("serve_transition_status", """WITH o AS (SELECT o_custkey AS name, count(*) FILTER (o_orderkey % 5 = 0) AS retained, count(*) FILTER (o_orderkey % 7 = 0) AS inflow FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1)
SELECT c_custkey AS name, CASE WHEN retained IS NULL THEN 'NO_DATA' WHEN retained + inflow = 0 THEN 'EMPTY' ELSE 'OK' END AS status FROM customer LEFT JOIN o ON name = c_custkey""")
def serve_transition_status(spark, d):
    key = F.col("o_orderkey")
    facts = table(spark, d, "orders").where(key % 2 == 0).groupBy(F.col("o_custkey").alias("name")).agg(F.count_if(key % 5 == 0).alias("retained"), F.count_if(key % 7 == 0).alias("inflow")).withColumns({"outflow": F.lit(0), "unobserved": F.lit(0)})
    return table(spark, d, "customer").select(F.col("c_custkey").alias("name")).join(facts, "name", "left").select("name", s.transition_status().alias("status"))


@register("serve_removal_reasons", """WITH r AS (SELECT o_custkey AS name, CAST(year(o_orderdate) AS VARCHAR) AS period, CAST(sum(o_orderkey % 4) AS BIGINT) AS removals, CAST(sum(o_orderkey % 2) AS BIGINT) AS removals_no_replacement FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1, 2)
SELECT c_custkey AS name, '1995' AS period, c_nationkey AS scope, removals, removals_no_replacement FROM customer LEFT JOIN r ON name = c_custkey""")
def serve_removal_reasons(spark, d):
    year = F.year("o_orderdate").cast("string")
    scopes = table(spark, d, "customer").select(F.col("c_custkey").alias("name"), F.explode(F.array(F.lit("1995"), F.lit("1996"))).alias("period"), F.col("c_nationkey").alias("scope"))
    reasons = table(spark, d, "orders").select(F.col("o_custkey").alias("name"), year.alias("period"), (F.col("o_orderkey") % 4).alias("removals"), (F.col("o_orderkey") % 2).alias("removals_no_replacement"))
    return s.removal_reasons(scopes, reasons, "1995")


@register("serve_brief", "SELECT o_custkey AS name, arg_max(CAST(o_orderkey AS VARCHAR), o_orderkey) AS version, arg_max(o_orderpriority, o_orderkey) AS description FROM orders WHERE o_custkey BETWEEN 1 AND 40 GROUP BY 1")
def serve_brief(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").cast("string").alias("version"), F.col("o_orderpriority").alias("description"), F.col("o_orderkey").alias("ordinal"))
    return s.brief(o, list(range(1, 41)))


@register("serve_migration_targets", """WITH p AS (SELECT l_suppkey % 10 AS f, l_partkey % 40 AS t, count(*) AS votes, count(DISTINCT l_shipdate) % 6 AS pm FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (ORDER BY votes DESC, CAST(t AS VARCHAR)) AS rn FROM p WHERE f = 3 AND votes >= 5 AND pm >= 3)
SELECT 3 AS from_pkg, CASE WHEN rn <= 5 THEN CAST(t AS VARCHAR) ELSE 'etc' END AS to_pkg, CAST(least(rn, 6) AS INTEGER) AS rank, CAST(sum(votes) AS BIGINT) AS votes FROM k GROUP BY 1, 2, 3""")
def serve_migration_targets(spark, d):
    i = table(spark, d, "lineitem")
    pairs = i.groupBy((F.col("l_suppkey") % 10).alias("from_pkg"), (F.col("l_partkey") % 40).cast("string").alias("to_pkg")).agg(F.count("*").alias("votes"), (F.countDistinct("l_shipdate") % 6).alias("publisher_months"))
    return s.migration_targets(pairs, 3).withColumn("from_pkg", F.col("from_pkg").cast("int"))


@register("serve_issues", """WITH i AS (SELECT o_orderkey AS issue_id, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS state, o_orderdate AS updated_at, o_custkey % 9 AS comments, o_custkey % 7 AS reactions FROM orders)
SELECT issue_id, comments, reactions FROM i WHERE state = 'open' OR updated_at >= TIMESTAMP '1998-01-01' ORDER BY comments DESC, reactions DESC, issue_id LIMIT 25""")
def serve_issues(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("issue_id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("state"), F.col("o_orderdate").alias("updated_at"), (F.col("o_custkey") % 9).alias("comments"), (F.col("o_custkey") % 7).alias("reactions"))
    return s.selected_issues(o, F.lit("1998-01-01").cast("timestamp"), 25).select("issue_id", "comments", "reactions")


@register("serve_comments", """WITH c AS (SELECT l_suppkey AS issue_id, l_orderkey AS comment_id, max(l_shipdate) AS created_at FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY created_at DESC, comment_id DESC) AS rn FROM c)
SELECT issue_id, comment_id, created_at FROM r WHERE rn <= 100""")
def serve_comments(spark, d):
    i = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("issue_id"), F.col("l_orderkey").alias("comment_id"), F.col("l_shipdate").alias("created_at"), F.col("l_linenumber").alias("body"))
    return s.latest_comments(i, 100).select("issue_id", "comment_id", "created_at")


@register("snapshots_to_clean", "SELECT o_orderkey AS snapshot_id, o_orderdate AS created_at FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3) ORDER BY o_orderdate, o_orderkey LIMIT 40")
def snapshots_to_clean(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("created_at"))
    return s.to_clean_up(o, table(spark, d, "lineitem").where("l_linenumber = 3").select(F.col("l_orderkey").alias("snapshot_id")), 40)


@register("load_scopes", "SELECT o_custkey AS name, CAST(year(o_orderdate) AS INTEGER) AS period, min(o_orderdate) AS t1, min(o_orderstatus) AS t2, count(DISTINCT o_orderdate) - 1 + count(DISTINCT o_orderstatus) - 1 AS conflicts FROM orders GROUP BY 1, 2")
def load_scopes(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.year("o_orderdate").alias("period"), F.col("o_orderdate").alias("t1"), F.col("o_orderstatus").alias("t2"))
    return s.collapsed_scopes(o, ["name", "period"], ["t1", "t2"])


@register("strict_timestamps", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_orderdate + INTERVAL 123 MILLISECOND WHEN 1 THEN o_orderdate - INTERVAL 330 MINUTE WHEN 2 THEN o_orderdate + INTERVAL 1380 MINUTE END AS at FROM orders""")
def strict_timestamps(spark, d):
    """Zones, digits and missing days: three of six forms are none."""
    k, day = F.col("o_orderkey") % 6, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    forms = F.when(k == 0, F.concat(day, F.lit(".123Z"))).when(k == 1, F.concat(day, F.lit("+05:30"))).when(k == 2, F.concat(day, F.lit("-23:00"))).when(k == 3, day).when(k == 4, F.concat(day, F.lit(".1234567Z"))).otherwise(F.lit("1995-02-30T00:00:00Z"))
    return table(spark, d, "orders").select("o_orderkey", val.strict_timestamp(forms).cast("timestamp_ntz").alias("at"))


@register("declaration_json", """WITH a AS (SELECT l_suppkey, list_sort(list(DISTINCT 'p' || l_partkey % 9)) AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey, CASE WHEN l_suppkey % 5 <> 0 THEN '{"dependencies":{' || array_to_string(list_transform(n, lambda x: '"' || x || '":"^1.0"'), ',') || '},"peerDependencies":{}}' END AS json, CASE WHEN l_suppkey % 5 <> 1 THEN len(n) END AS n FROM a""")
def declaration_json(spark, d):
    """A list with one name twice under two requirements is none; a null list has a null length."""
    i, k = table(spark, d, "lineitem"), F.col("l_suppkey")
    lists = i.groupBy(k).agg(F.collect_set(F.struct(F.concat(F.lit("p"), (F.col("l_partkey") % 9).cast("string")).alias("Name"), F.lit("^1.0").alias("Requirement"))).alias("a"))
    twice = F.array_append("a", F.struct(F.element_at("a", 1)["Name"].alias("Name"), F.lit("^2.0").alias("Requirement")))
    none = F.array().cast("array<struct<Name:string,Requirement:string>>")
    found = val.declaration_json(dependencies=F.when(k % 5 == 0, twice).otherwise(F.col("a")), peerDependencies=none)
    return lists.select(k, found.alias("json"), val.length(F.when(k % 5 != 1, F.col("a"))).cast("long").alias("n"))


@register("json_kinds", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'object' WHEN 1 THEN 'array' WHEN 2 THEN 'string' WHEN 3 THEN 'boolean' WHEN 4 THEN 'number' END AS kind, CASE WHEN event_id % 6 = 1 THEN event_type || '|' || event_id END AS elements, event_type = 'click' OR event_type = 'error' AS c FROM events""")
def json_kinds(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id") % 6
    number = F.col("event_id").cast("string")
    text = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit('["'), "event_type", F.lit('", '), number, F.lit("]"))).when(k == 2, '"x"').when(k == 3, " true").when(k == 4, number).otherwise("{no json")
    marked = F.concat(F.lit("a.b*("), "event_type")
    pattern = "^" + val.literal("a.b*(") + "(click|error)$"
    return e.select("event_id", val.json_kind(text).alias("kind"), F.array_join(val.json_elements(text), "|").alias("elements"), val.found(marked, pattern).alias("c"))
