"""What SQL can't show: errors, files, sketches, encoders."""

import oracle
import pytest
from pyspark.sql import functions as F

from marlstone.functions import values
from marlstone.operators import relational, serving, text, timeseries, vectors, windows
from marlstone.plans import registry
from marlstone.sources import sinks


def test_sums_out_of_range_are_errors(spark):
    df = spark.createDataFrame([(2**62,), (2**62,)], "v long")
    assert df.limit(1).agg(relational.guarded_sum(F.col("v")).alias("s")).first().s == 2**62
    assert df.where("v < 0").agg(relational.guarded_sum(F.col("v")).alias("s")).first().s is None
    with pytest.raises(Exception, match="sum out of range: 9223372036854775808"):
        df.agg(relational.guarded_sum(F.col("v"))).collect()


def test_a_sum_is_out_of_range_where_its_sql_is(spark, duck, tmp_path):
    """The registered query and its SQL, on keys whose sum is 2^63 or more."""
    rows = [("A", 9_000_000_000_000), ("A", 9_000_000_000_000), ("N", 5)]
    spark.createDataFrame(rows, "l_returnflag string, l_orderkey long").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    sql, con = registry.oracle_sql()["guarded_sums"].replace("lineitem", f"read_parquet('{tmp_path}/lineitem.parquet/*.parquet')"), duck.cursor()
    with pytest.raises(Exception, match="18000000000000000000"):
        con.execute(sql).fetchall()
    with pytest.raises(Exception, match="sum out of range: 18000000000000000000"):
        registry.queries()["guarded_sums"](spark, str(tmp_path)).collect()


def test_products_beyond_64_bits_are_summed(spark, duck, tmp_path):
    """Only the sum must fit, as in the SQL: its products are wide."""
    rows = [("A", 10_000_000_000_000), ("A", -9_999_999_999_999), ("N", 5), ("R", None)]
    spark.createDataFrame(rows, "l_returnflag string, l_orderkey long").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    sql = registry.oracle_sql()["guarded_sums"].replace("lineitem", f"read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert sorted(duck.cursor().execute(sql).fetchall()) == [("A", 1_000_000), ("N", 5_000_000), ("R", None)]
    assert oracle.compare(registry.queries()["guarded_sums"](spark, str(tmp_path)), duck.cursor(), sql) == ""


def test_islands_of_tied_intervals(spark):
    """Equal intervals may stand in any order: both windows use one sort, and the result is the union, in islands and in indexes."""
    rows = [(i % 20, s := i * i % 211 // 7 * 9, s + 1 + i % 11) for i in range(3000)] * 2
    cells = {(k, x) for k, s, e in rows for x in range(s, e)}
    found = windows.islands(spark.createDataFrame(rows, "k int, start_index long, end_index long").repartition(3), ["k"])
    assert found._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    got = found.collect()
    starts, ends = {c for c in cells if (c[0], c[1] - 1) not in cells}, {(k, x + 1) for k, x in cells if (k, x + 1) not in cells}
    assert len(got) == len(starts) > 20 and {(r.k, r.start_index) for r in got} == starts and {(r.k, r.end_index) for r in got} == ends
    dense = [(r.k, r["index"]) for r in windows.densify(found).collect()]
    assert len(dense) == len(cells) and set(dense) == cells


def test_islands_of_null_bounds(spark, duck, tmp_path):
    """Rows without a bound come last, as in the SQL, and open an island only where there is nothing to join."""
    rows = [(1, 3, 2), (1, None, 2), (1, None, 4), (1, 9, None), (1, 9, 3), (2, None, 1), (2, None, None), (3, 7, None), (3, 7, 7), (None, 5, 1), (None, None, 1), (4, 1, 1)]
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    for name, n in (("islands", 7), ("densified", 14)):
        sql = registry.oracle_sql()[name].replace("lineitem", f"read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
        found = registry.queries()[name](spark, str(tmp_path))
        assert found.count() == n and oracle.compare(found, duck.cursor(), sql) == ""


def test_merged_sketches_are_near(spark):
    df = spark.range(50_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 7919).alias("v"))
    parts = relational.partials(df, ["g"], "v", F.col("v") % 5)
    for r in relational.merged_partials(parts.where("part < 3").unionByName(parts.where("part >= 3")), ["g"]).collect():
        assert r.n == r.n_values == 25_000 and abs(r.about_distinct - 7919) < 400


def test_projection_of_absent_columns(spark):
    with pytest.raises(ValueError):
        relational.projected(spark.range(1), exclude=("x",))


def test_key_sets_must_be_equal(spark):
    people = spark.range(3).withColumnRenamed("id", "k")
    good = people.withColumn("v", F.lit(1))
    assert timeseries.integrated(people, "k", v=good).count() == 3
    for bad in (good.where("k > 0"), good.unionByName(spark.createDataFrame([(9, 1)], "k long, v int")), good.union(good)):
        with pytest.raises(ValueError):
            timeseries.integrated(people, "k", v=bad)


def test_gate_outcomes():
    assert vectors.gate_outcome({"recall": 0.5}, {"recall": 0.4}) == "PASSED" and vectors.gate_outcome({}, {"recall": 0.4}, allow_skip=True) == "SKIPPED"
    for metrics, skip in (({}, False), ({"recall": 0.3}, True)):
        with pytest.raises(ValueError):
            vectors.gate_outcome(metrics, {"recall": 0.4}, skip)


def test_a_load_without_matches_is_an_error(spark):
    assert serving.load_quality(spark.createDataFrame([(1, 2)], "unresolved int, matched int")) == {"unresolved": 1, "matched": 2}
    with pytest.raises(ValueError):
        serving.load_quality(spark.createDataFrame([(1, 0)], "unresolved int, matched int"))


def test_one_file_in_a_total_order(spark, tmp_path):
    sinks.ordered_file(spark.range(100).repartition(4), str(tmp_path / "o"), [F.desc("id")])
    parts = list((tmp_path / "o").glob("part-*"))
    assert len(parts) == 1 and [r.id for r in spark.read.parquet(str(parts[0])).collect()] == list(range(99, -1, -1))


def test_embedding_in_batches(spark):
    def load():
        return lambda texts: [[float(len(t)), float(len(texts))] for t in texts]

    df = spark.createDataFrame([(i, None if i == 3 else " " if i == 4 else "x" * i) for i in range(1, 11)], "id int, t string").coalesce(1)
    got = {r.id: r.embedding for r in vectors.embedded(df, "t", load, batch=3).collect()}
    assert got[3] is None and got[4] is None and got[1] == [1.0, 3.0] and got[10] == [10.0, 2.0] and callable(vectors.onnx_encoder("m.onnx", "t.json"))


def test_neighbours_with_ties(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(30)]
    got = vectors.exact_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 4, block=7).collect()
    near = {}
    for r in sorted(got, key=lambda r: (r.vec_id, r["rank"])):
        near.setdefault(r.vec_id, []).append(r.neighbour)
    assert all(v == [j for j in range(30) if j % 3 == i % 3 and j != i][:4] for i, v in near.items()) and len(near) == 30


def test_contained_pairs_by_blocks(spark):
    rows = [(None if i == 7 else i % 97, None if i % 50 == 3 else (i * i * 7 + i // 5) % (5 if i % 3 else 400)) for i in range(4000)]
    edges, sets = spark.createDataFrame(rows, "m long, x long"), {}
    for m, x in rows:
        sets.setdefault(m, set()).add(x)
    del sets[None]
    want = {(a, b): None if min(len(p), len(q)) < 20 else len((p & q) - {None}) / min(len(p), len(q)) for a, p in sets.items() for b, q in sets.items() if a < b and (p & q) - {None}}
    for block in (10, 1000):
        got = vectors.contained_pairs(edges, "m", "x", block=block).collect()
        assert len(got) == len(want) and {(r.a, r.b): r.containment for r in got} == want
    assert None in want.values() and {(r.a, r.b) for r in got if r.contained} == {k for k, v in want.items() if v is not None and v > 0.3}
    pairs = spark.createDataFrame(list(want), "a long, b long")
    assert {(r.a, r.b): r.containment for r in vectors.contained_by_edges(pairs, edges, "m", "x").collect()} == want
    names = edges.select(F.concat(F.lit("p"), F.col("m")).alias("m"), F.col("x").cast("string").alias("x"))
    text = {tuple(sorted((f"p{a}", f"p{b}"))): v for (a, b), v in want.items()}
    assert {(r.a, r.b): r.containment for r in vectors.contained_pairs(names, "m", "x", block=30).collect()} == text


def test_shared_elements_never_become_rows(spark, sf, tmp_path):
    """No join on elements, in the query either. 3,000 members of 200 elements each: 900 million shared elements, 4,498,500 pairs."""
    path = str(tmp_path / "e")
    spark.range(600_000).select((F.col("id") % 3000).alias("m"), F.floor(F.col("id") / 3000).alias("x")).write.parquet(path)
    found = vectors.contained_pairs(spark.read.parquet(path), "m", "x", block=512)
    for df in (found, registry.queries()["containment_gate"](spark, sf)):
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert tuple(found.agg(F.count("*"), F.min("containment"), F.max("containment")).first()) == (4_498_500, 1.0, 1.0)


@pytest.mark.parametrize("stamp, want", [
    ("2024-02-29T12:00:00Z", "2024-02-29 12:00:00"), ("2024-02-29 12:00:00.5 UTC", "2024-02-29 12:00:00.500000"), ("2024-01-01T00:00:00.000001-23:59", "2024-01-01 23:59:00.000001"), ("2023-02-29T12:00:00Z", None), ("2024-01-01T24:00:00Z", None),
    ("2024-01-01T00:00:00", None), ("2024-01-01T00:00:00.1234567Z", None), ("2024-01-01T00:00:00+24:00", None), ("2024-01-01", None), ("", None), (None, None),
])
def test_strict_timestamps(spark, stamp, want):
    got = spark.createDataFrame([(stamp,)], "t string").select(values.strict_timestamp(F.col("t")).cast("string").alias("t")).first().t
    assert got == (want and want.rstrip("0").rstrip(".") if want and "." in want else want)


def test_page_paths_of_repositories(spark):
    cases = {"https://github.com/o/r/tree/main": "https://github.com/o/r", "https://github.com/o/r/wiki": None, "github:o/r": "https://github.com/o/r"}
    got = {r.v: r.u for r in spark.createDataFrame([(k,) for k in cases], "v string").select("v", text.repository_url(F.col("v")).alias("u")).collect()}
    assert got == cases


def test_literal_patterns(spark):
    wild = "a.b*c\\Q[é]_$ 1"
    assert spark.createDataFrame([(wild,), ("axb",)], "t string").where(values.found(F.col("t"), "^" + values.literal(wild) + "$")).count() == 1
