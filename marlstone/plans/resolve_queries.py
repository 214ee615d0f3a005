"""Queries of version ranges and historical dependents (D51-D69, LD5)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import semver
from ..operators import resolve as v
from .fixtures import table
from .registry import register

VERSIONS = """ver AS (SELECT DISTINCT CAST(l_suppkey % 20 AS VARCHAR) AS name, (l_orderkey % 3)::BIGINT AS a, (l_partkey % 4)::BIGINT AS b, l_linenumber::BIGINT AS c FROM lineitem),
asked AS (SELECT DISTINCT CAST(l_suppkey % 25 AS VARCHAR) AS name, (l_partkey % 4)::BIGINT AS a, (l_orderkey % 4)::BIGINT AS b, l_linenumber::BIGINT AS c, CASE l_orderkey % 4 WHEN 0 THEN '^' WHEN 1 THEN '~' WHEN 2 THEN '>=' ELSE '' END AS op FROM lineitem)"""


def _versions(spark, d):
    i = table(spark, d, "lineitem")
    return i.select((F.col("l_suppkey") % 20).cast("string").alias("name"), F.concat_ws(".", F.col("l_orderkey") % 3, F.col("l_partkey") % 4, "l_linenumber").alias("version")).distinct()


def _asked(spark, d):
    i = table(spark, d, "lineitem")
    o = F.col("l_orderkey") % 4
    op = F.when(o == 0, "^").when(o == 1, "~").when(o == 2, ">=").otherwise("")
    return i.select((F.col("l_suppkey") % 25).cast("string").alias("declared_name"), F.concat(op, F.concat_ws(".", F.col("l_partkey") % 4, o, "l_linenumber")).alias("requirement")).distinct()


@register("semver_resolution", f"""WITH {VERSIONS},
j AS (
  SELECT q.name, q.op, q.a, q.b, q.c, arg_max(v.a || '.' || v.b || '.' || v.c, (v.a, v.b, v.c)) AS target FROM asked q JOIN ver v ON v.name = q.name AND CASE q.op
    WHEN '>=' THEN (v.a, v.b, v.c) >= (q.a, q.b, q.c) WHEN '~' THEN v.a = q.a AND v.b = q.b AND v.c >= q.c WHEN '' THEN v.a = q.a AND v.b = q.b AND v.c = q.c
    ELSE (v.a, v.b, v.c) >= (q.a, q.b, q.c) AND (v.a = q.a AND (q.a > 0 OR (v.b = q.b AND (q.b > 0 OR v.c = q.c)))) END GROUP BY 1, 2, 3, 4, 5)
SELECT q.name AS declared_name, q.op || q.a || '.' || q.b || '.' || q.c AS requirement, j.target AS target_version,
  CASE WHEN j.target IS NOT NULL THEN 'RESOLVED' WHEN q.name IN (SELECT name FROM ver) THEN 'NO_SATISFYING_VERSION' ELSE 'NO_ELIGIBLE_TARGET' END AS status
FROM asked q LEFT JOIN j ON j.name = q.name AND j.op = q.op AND j.a = q.a AND j.b = q.b AND j.c = q.c""")
def semver_resolution(spark, d):
    return v.resolve(v.lookups(_asked(spark, d)), _versions(spark, d)).select("declared_name", "requirement", "target_version", "status")


@register("release_lines", "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN CAST(p_size % 3 AS VARCHAR) ELSE '0.' || (p_partkey % 10) END AS line, 'ELIGIBLE' AS kind FROM part")
def release_lines(spark, d):
    version = F.concat_ws(".", F.col("p_size") % 3, F.col("p_partkey") % 10, F.lit(0))
    return table(spark, d, "part").select("p_partkey", semver.line(version).alias("line"), semver.classify(version).alias("kind"))


CLOSE = 120
LOOKUPS = f"""cand AS (SELECT l_suppkey AS lookup_id, l_orderkey % {CLOSE} AS birth_index, l_partkey AS rank, l_partkey % 17 AS target FROM lineitem),
each_ AS (SELECT lookup_id, birth_index, max(rank) AS rank FROM cand GROUP BY 1, 2),
top AS (SELECT lookup_id, birth_index, max(rank) OVER (PARTITION BY lookup_id ORDER BY birth_index) AS rank FROM each_),
chg AS (SELECT *, lag(rank) OVER (PARTITION BY lookup_id ORDER BY birth_index) AS was FROM top),
iv AS (SELECT lookup_id, birth_index AS start_index, lead(birth_index, 1, {CLOSE}) OVER (PARTITION BY lookup_id ORDER BY birth_index) AS end_index, rank % 17 AS target FROM chg WHERE was IS NULL OR rank <> was),
decl AS (SELECT o_custkey % 100 AS source, l_suppkey AS lookup_id, o_orderkey % {CLOSE} AS birth_index FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def _winners(spark, d):
    i = table(spark, d, "lineitem")
    cand = i.select(F.col("l_suppkey").alias("lookup_id"), (F.col("l_orderkey") % CLOSE).alias("birth_index"), F.col("l_partkey").alias("rank"), (F.col("l_partkey") % 17).alias("target"))
    return v.winners_over_time(cand, ["lookup_id"], CLOSE)


def _decl(spark, d):
    i, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return i.join(o, i.l_orderkey == o.o_orderkey).select((F.col("o_custkey") % 100).alias("source"), F.col("l_suppkey").alias("lookup_id"), (F.col("o_orderkey") % CLOSE).alias("birth_index"))


@register("winner_intervals", f"WITH {LOOKUPS} SELECT * FROM iv")
def winner_intervals(spark, d):
    return _winners(spark, d)


DENSE = """dense AS (SELECT DISTINCT source, target, unnest(range(greatest(birth_index, start_index), end_index)) AS index FROM decl JOIN iv USING (lookup_id) WHERE greatest(birth_index, start_index) < end_index)"""


@register("dependents_over_time", f"WITH {LOOKUPS}, {DENSE} SELECT target, index, count(*) AS active FROM dense GROUP BY 1, 2")
def dependents_over_time(spark, d):
    """Compared slot by slot with a brute-force expansion."""
    from ..operators.windows import densify

    return densify(v.dependents_over_time(_decl(spark, d), _winners(spark, d), CLOSE)).select("target", "index", "active")


@register("weighted_sweep", f"""WITH {LOOKUPS}, x AS (SELECT target, unnest(range(greatest(birth_index, start_index), end_index)) AS index FROM decl JOIN iv USING (lookup_id) WHERE greatest(birth_index, start_index) < end_index)
SELECT target, index, count(*) AS active FROM x GROUP BY 1, 2""")
def weighted_sweep(spark, d):
    from ..operators.windows import densify

    return densify(v.weighted_sweep(v.weighted_births(_decl(spark, d)), _winners(spark, d), CLOSE)).select("target", "index", "active")


@register("direct_dependents", "WITH e AS (SELECT DISTINCT l_suppkey AS target, o_custkey AS source FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT s_suppkey AS target, count(source) AS dependents_count FROM supplier LEFT JOIN e ON target = s_suppkey GROUP BY 1")
def direct_dependents(spark, d):
    i, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    e = i.join(o, i.l_orderkey == o.o_orderkey).select(F.col("l_suppkey").alias("target"), F.col("o_custkey").alias("source"))
    return v.dependents_count(e, table(spark, d, "supplier").select(F.col("s_suppkey").alias("target")), "source", ["target"])


SOURCES = f"""src AS (
  SELECT o_custkey AS source, min(o_orderkey % {CLOSE}) AS birth, o_custkey % 23 <> 0 AS has_requirements, o_custkey % 19 = 0 AS null_dependencies,
    CASE WHEN o_custkey % 17 = 0 THEN true WHEN o_custkey % 13 <> 0 THEN false END AS dependency_error
  FROM orders GROUP BY o_custkey),
decl AS (SELECT o_custkey AS source, l_suppkey AS lookup_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 11 <> 0),
firsts AS (SELECT l_suppkey AS lookup_id, min(l_orderkey % {CLOSE}) AS first FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY 1),
slots AS (SELECT *, unnest(range(birth, {CLOSE})) AS index FROM src)"""


def _sources(spark, d):
    key, o = F.col("o_custkey"), table(spark, d, "orders")
    error = F.when(key % 17 == 0, True).when(key % 13 != 0, False)
    return o.groupBy(key).agg(F.min(F.col("o_orderkey") % CLOSE).alias("birth_index")).select(key.alias("source"), "birth_index", (key % 23 != 0).alias("has_requirements"), (key % 19 == 0).alias("null_dependencies"), error.alias("dependency_error"))


def _declared_and_firsts(spark, d):
    i, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    declared = i.join(o, i.l_orderkey == o.o_orderkey).where("o_custkey % 11 <> 0").select(F.col("o_custkey").alias("source"), F.col("l_suppkey").alias("lookup_id"))
    firsts = i.where("l_suppkey % 5 <> 0").groupBy(F.col("l_suppkey").alias("lookup_id")).agg(F.min(F.col("l_orderkey") % CLOSE).alias("first_resolved"))
    return declared, firsts


STATUS = """CASE WHEN NOT has_requirements THEN 'MISSING_REQUIREMENTS' WHEN null_dependencies THEN 'NULL_DEPENDENCY_LIST' WHEN dependency_error THEN 'DEPENDENCY_EXTRACTION_ERROR'
  WHEN dependency_error IS NULL THEN 'DEPENDENCY_EXTRACTION_UNKNOWN' WHEN n = 0 THEN 'OBSERVED_NO_DEPENDENCIES' WHEN done = n THEN 'RESOLVED' WHEN done > 0 THEN 'PARTIAL' ELSE 'UNRESOLVED' END"""


@register("source_status_series", f"""WITH {SOURCES},
each_ AS (SELECT s.source, s.index, count(d.lookup_id) AS n, count(*) FILTER (f.first <= s.index) AS done FROM slots s LEFT JOIN decl d USING (source) LEFT JOIN firsts f USING (lookup_id) GROUP BY 1, 2)
SELECT {STATUS} AS status, index, count(*) AS active FROM each_ JOIN src USING (source) GROUP BY 1, 2""")
def source_status_series(spark, d):
    """Compared slot by slot with a brute-force count of resolved declarations."""
    from ..operators.windows import densify

    sources, (declared, firsts) = _sources(spark, d), _declared_and_firsts(spark, d)
    counted = v.first_resolutions(declared.join(sources.select("source", "birth_index"), "source"), firsts).drop("birth_index")
    every = sources.join(counted, "source", "left").fillna(0, ["declaration_count", "never_resolved_count"])
    return densify(v.status_series(v.source_status(every, CLOSE), CLOSE)).select("status", F.col("index").cast("long").alias("index"), "active")


@register("source_intervals_series", f"""WITH {SOURCES},
spans AS (SELECT source, lookup_id, CASE WHEN first IS NOT NULL THEN greatest(birth, first) END AS a, CASE WHEN first IS NOT NULL THEN least({CLOSE}, greatest(birth, first) + 10 + lookup_id % 40) END AS z FROM decl JOIN src USING (source) LEFT JOIN firsts USING (lookup_id)),
each_ AS (SELECT s.source, s.index, count(d.lookup_id) AS n, count(*) FILTER (d.a <= s.index AND s.index < d.z) AS done FROM slots s LEFT JOIN spans d USING (source) GROUP BY 1, 2)
SELECT {STATUS} AS status, index, count(*) AS active, CAST(sum(done) AS BIGINT) AS resolved, CAST(sum(n - done) AS BIGINT) AS unresolved FROM each_ JOIN src USING (source) GROUP BY 1, 2""")
def source_intervals_series(spark, d):
    """Resolutions that end again, compared slot by slot."""
    from ..operators.windows import densify

    sources, (declared, firsts) = _sources(spark, d), _declared_and_firsts(spark, d)
    met = declared.join(sources.select("source", "birth_index"), "source").join(firsts, "lookup_id")
    start = F.greatest("birth_index", "first_resolved")
    spans = met.select("source", start.alias("start_index"), F.least(F.lit(CLOSE), start + 10 + F.col("lookup_id") % 40).alias("end_index"))
    n = declared.groupBy("source").agg(F.count("*").alias("declaration_count"))
    each = densify(v.source_intervals(sources.join(n, "source", "left").fillna(0, ["declaration_count"]), spans, CLOSE))
    return each.groupBy("status", "index").agg(F.count("*").alias("active"), F.sum("resolved_count").alias("resolved"), F.sum("unresolved_count").alias("unresolved"))


@register("source_edges", "SELECT o_custkey AS name, l_suppkey % 40 AS target_name, list_sort(list(DISTINCT l_returnflag)) AS kinds FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2")
def source_edges(spark, d):
    """Declarations taken out of arrays, looked up once each, and collapsed into edges with their kinds."""
    i, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    rows = i.join(o, i.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("name"), "l_returnflag", F.concat(F.lit("p"), F.col("l_suppkey") % 40).alias("t"))
    arrays = rows.groupBy("name").agg(*[F.collect_list(F.when(F.col("l_returnflag") == k, F.struct(F.col("t").alias("Name"), F.lit("^1.0.0").alias("Requirement")))).alias(k) for k in "ANR"])
    declared = v.declarations(arrays, ["name"], [(k, k) for k in "ANR"])
    versions = declared.select(F.col("declared_name").alias("name"), F.lit("1.2.0").alias("version")).distinct()
    edges = v.edges(declared, v.resolve(v.lookups(declared), versions), ["name"])
    return edges.select("name", F.substring("target_name", 2, 9).cast("long").alias("target_name"), "kinds")


@register("population_over_time", f"SELECT birth_index, born, CAST(sum(born) OVER (ORDER BY birth_index) AS BIGINT) AS population FROM (SELECT o_orderkey % {CLOSE} AS birth_index, count(*) AS born FROM orders GROUP BY 1)")
def population_over_time(spark, d):
    return v.population_over_time(table(spark, d, "orders").select((F.col("o_orderkey") % CLOSE).alias("birth_index")), CLOSE)


@register("calendar_birth", "WITH c AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS slot FROM (SELECT unnest(generate_series(TIMESTAMP '1992-01-01', TIMESTAMP '2030-01-01', INTERVAL 3 MONTH)) AS d)) SELECT o_orderkey, min(slot) AS birth_index FROM orders JOIN c ON d >= o_orderdate GROUP BY 1")
def calendar_birth(spark, d):
    days = spark.range(1).select(F.explode(F.expr("sequence(TIMESTAMP_NTZ'1992-01-01', TIMESTAMP_NTZ'2030-01-01', interval 3 month)")).alias("snapshot_timestamp"))
    cal = days.withColumn("slot", F.row_number().over(W.orderBy("snapshot_timestamp")) - 1)
    return v.birth_index(table(spark, d, "orders"), cal, "o_orderdate", 153).select("o_orderkey", F.col("birth_index").cast("long").alias("birth_index"))


@register("workload_buckets", """WITH l AS (SELECT CAST(l_suppkey AS VARCHAR) AS n, count(DISTINCT l_partkey) AS q FROM lineitem GROUP BY 1), c AS (SELECT CAST(s_suppkey AS VARCHAR) AS n, s_suppkey % 7 AS k FROM supplier),
w AS (SELECT l.n, q * coalesce(k, 0) AS work FROM l LEFT JOIN c USING (n)) SELECT CASE WHEN work = 0 THEN '0' WHEN work < 100 THEN '1-99' WHEN work < 10000 THEN '100-9999' ELSE '10000+' END AS bucket, count(*) AS names, CAST(sum(work) AS BIGINT) AS work FROM w GROUP BY 1""")
def workload_buckets(spark, d):
    decl = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("declared_name"), F.col("l_partkey").alias("requirement"))
    s = table(spark, d, "supplier")
    eligible = s.where("s_suppkey % 7 > 0").select(F.col("s_suppkey").cast("string").alias("name"), F.explode(F.sequence(F.lit(1), (F.col("s_suppkey") % 7).cast("int"))))
    return v.workload(decl, eligible)[0].withColumn("work", F.col("work").cast("long"))


@register("interval_load", """WITH b AS (SELECT l_returnflag AS day, l_orderkey % 50 AS s, l_orderkey % 50 + l_linenumber AS e, count(*) AS n FROM lineitem GROUP BY 1, 2, 3), x AS (SELECT day, i, sum(n) AS active FROM (SELECT day, unnest(range(s, e)) AS i, n FROM b) GROUP BY 1, 2)
SELECT day, CAST((SELECT sum(n) FROM b WHERE b.day = x.day) AS BIGINT) AS total, (SELECT count(*) FROM b WHERE b.day = x.day) AS positive, CAST(max(active) AS BIGINT) AS most FROM x GROUP BY 1""")
def interval_load(spark, d):
    s = F.col("l_orderkey") % 50
    bins = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("day"), s.alias("start"), (s + F.col("l_linenumber")).alias("end")).agg(F.count("*").alias("n"))
    return v.interval_load(bins)
