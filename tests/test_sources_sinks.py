import gzip
import json

import pytest
from pyspark.sql import functions as F

from marlstone.operators import checks, relational
from marlstone.sources import scan, sinks


def test_schema_is_asserted(spark, sf):
    df = scan.parquet(spark, f"{sf}/nation.parquet")
    scan.assert_schema(df, df.schema)
    with pytest.raises(scan.SchemaMismatch):
        scan.assert_schema(df, "n_nationkey string")
    with pytest.raises(scan.SchemaMismatch):
        scan.require_columns(df, "absent")


def test_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "v int, date string")
    sinks.partitioned(df, str(tmp_path / "t"), "date")
    sinks.partitioned(spark.createDataFrame([(3, "2024-01-02")], "v int, date string"), str(tmp_path / "t"), "date")
    assert sorted(r.v for r in scan.partitioned(spark, str(tmp_path / "t")).collect()) == [1, 3]
    one = scan.partitioned(spark, str(tmp_path / "t"), date="2024-01-02")
    assert [r.v for r in one.collect()] == [3] and "PartitionFilters: [" in one._jdf.queryExecution().toString()
    assert scan.path_value_conflicts(spark.read.parquet(str(tmp_path / "t" / "date=2024-01-01")).withColumn("p", F.lit("2024-01-01")), "date", "p").count() == 0


def test_json_csv_and_shards(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"name": "x", "days": [{"day": "2024-01-01", "downloads": 5}]}\n')
    (tmp_path / "b.json").write_text('{"name": "y", "repo": {"full_name": "o/y"}}\n')
    fixed = scan.json_lines(spark, str(tmp_path / "a.json"), schema="name string, days array<struct<downloads:bigint,day:date>>")
    assert fixed.select(F.explode("days")).select("col.downloads").first()[0] == 5
    assert scan.json_lines(spark, str(tmp_path / "*.json")).select("repo.full_name").where("full_name is not null").first()[0] == "o/y"
    (tmp_path / "c.csv").write_text("name,n\na,01\n")
    assert scan.csv(spark, str(tmp_path / "c.csv"), all_text=True).first().n == "01" and scan.csv(spark, str(tmp_path / "c.csv")).first().n == 1
    both = scan.shards([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, 3)], "a int, b int")])
    assert sorted(map(tuple, both.collect())) == [(1, None), (2, 3)]
    assert scan.json_table(spark, '[{"a": 1}, {"a": 2}]', "a int").count() == 2
    links = spark.createDataFrame([([("HOMEPAGE", "h"), ("SOURCE_REPO", "s")],), ([],)], "Links array<struct<Label:string,URL:string>>")
    assert [r[0] for r in links.select(scan.linked_url()).collect()] == ["s", None]


def test_footers_and_parts(spark, sf, tmp_path):
    assert scan.footer_range(spark, [f"{sf}/nation.parquet"], "n_nationkey") == (25, 0, 24)
    for n, data in (("p1.gz", gzip.compress(b"ok")), ("p2.gz", gzip.compress(b"cut" * 99)[:-9]), ("p3.gz", gzip.compress(b"new" * 99)[:-9])):
        (tmp_path / n).write_bytes(data)
    complete, broken = scan.complete_parts(spark, [str(tmp_path / n) for n in ("p1.gz", "p2.gz", "p3.gz")])
    assert [p[-5:] for p in complete] == ["p1.gz"] and [p[-5:] for p in broken] == ["p2.gz"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, ["a", "b"]), (1, [])], "k int, v array<string>")
    assert sinks.parquet(df, str(tmp_path / "p")).count() == 2
    with pytest.raises(Exception, match="already exists"):
        sinks.parquet(df, str(tmp_path / "p"))
    path = sinks.csv_with_mark(df, str(tmp_path / "c"), ["k"])
    assert open(path, "rb").read() == b'\xef\xbb\xbfk,v\n1,""\n2,a|b\n'
    sinks.json_lines(spark.sql("select 1 as a, cast(null as int) as b, timestamp'2024-01-01 00:00:00' as t"), str(tmp_path / "j"))
    assert json.loads(next((tmp_path / "j").glob("*.json")).read_text()) == {"a": 1, "b": None, "t": "2024-01-01T00:00:00.000000Z"}
    manifest = sinks.publish(df, str(tmp_path / "pub"), {"label": "x"})
    assert manifest["rows"] == 2 and sinks.verify_published(spark, str(tmp_path / "pub"))
    with pytest.raises(FileExistsError):
        sinks.publish(df, str(tmp_path / "pub"))
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, sinks.merge(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, sinks.merge(old, new, ["k"], update=False).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, sinks.staged_swap(new, old, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, v string")
    with pytest.raises(checks.CheckFailed):
        checks.require_clean(checks.named({"dup": checks.duplicates(df, ["k"])}))
    with pytest.raises(checks.CheckFailed):
        checks.require_clean(checks.row_checks(df, missing=F.col("v").isNull()))
    checks.require_clean(checks.row_checks(df, negative=F.col("k") < 0))
    with pytest.raises(checks.CheckFailed):
        checks.expect_count(df, 5)
    assert checks.same_rows(df, df.orderBy(F.desc("k"))) and not checks.same_rows(df, df.limit(2))
    assert relational.multiset_differences(df, df.where("k = 1")).collect()[0].side == "a"


def test_row_counts_and_repeated_changes(spark, tmp_path):
    df = spark.range(10).selectExpr("id k", "id % 3 v")
    assert sinks.parquet(df, str(tmp_path / "n"), max_records=4).count() == 10
    with pytest.raises(Exception, match="already exists"):
        sinks.parquet(df, str(tmp_path / "n"))
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    twice = spark.createDataFrame([(2, "c"), (2, "d"), (3, None), (3, "e"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, sinks.merge(old, twice, ["k"]).collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(map(tuple, sinks.merge(old, twice, ["k"], order=["v"]).collect())) == [(1, "a"), (2, "c"), (3, None)]


def test_swap_into_a_stored_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.partitioned(spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (4, "d", "z")], "k int, v string, p string"), path, "p")
    n = sinks.swap_into(spark.createDataFrame([(3, "C", "x"), (5, "e", "w")], "k int, v string, p string"), path, ["k"], "p")
    assert n == 4 and sorted(map(tuple, spark.read.parquet(path).select("k", "v", "p").collect())) == [(1, "a", "x"), (2, "b", "x"), (3, "C", "x"), (4, "d", "z"), (5, "e", "w")]
    assert [x.name for x in tmp_path.iterdir()] == ["t"]


def test_bucketed_tables_join_without_a_shuffle(spark):
    a = sinks.bucketed_table(spark.range(1000).selectExpr("id k", "id * 2 a"), "bucketed_a", "k", 4)
    b = sinks.bucketed_table(spark.range(1000).selectExpr("id % 100 k", "id b"), "bucketed_b", "k", 4)
    joined = a.hint("merge").join(b, "k")
    assert joined.count() == 1000 and "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    spark.sql("drop table bucketed_a")
    spark.sql("drop table bucketed_b")


def test_published_digests(spark, tmp_path):
    path = str(tmp_path / "pub")
    sinks.publish(spark.range(100).repartition(3), path)
    assert sinks.verify_published(spark, path) and not sinks.verify_published(spark, str(tmp_path))
    part = next((tmp_path / "pub" / "data").glob("*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    assert not sinks.verify_published(spark, path)


def test_json_without_a_schema(spark):
    text = '[{"name": "a", "deps": [{"to": "b", "at": {"day": 1}}, {"to": "c", "at": {"day": 2}}]}, {"name": "d", "deps": []}]'
    got = scan.json_table(spark, text)
    assert sorted((r.name, r.to, r.day) for r in got.collect() if r.to) == [("a", "b", 1), ("a", "c", 2)] and got.count() == 3
    assert scan.footer_range(spark, [], "x") == (0, None, None) and scan.complete_parts(spark, []) == ([], [])
