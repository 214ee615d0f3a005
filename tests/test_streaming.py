from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marlstone.streaming import streams


@pytest.fixture
def events(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("a", t, 0), ("a", t + timedelta(minutes=5), 1), ("a", t + timedelta(minutes=5), 1), ("a", t + timedelta(minutes=9), 0), ("b", t, 1), ("b", t + timedelta(days=20), 0), ("b", t + timedelta(days=20, minutes=1), 1)]
    spark.createDataFrame(rows, "k string, at timestamp, flag int").coalesce(1).write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_state_changes_equal_batch(spark, events, tmp_path):
    batch = spark.read.parquet(events)
    out = streams.state_changes_stream(streams.files(spark, events, batch.schema), "k", "at", "flag", "30 days")
    streams.run_once(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, streams.state_changes(batch, "k", "at", "flag").collect()))


def test_run_once_takes_up_where_it_ended(spark, events, tmp_path):
    source = streams.files(spark, events, spark.read.parquet(events).schema)
    for _ in range(2):
        streams.run_once(streams.first_arrivals_stream(source, ["k", "at"], "at"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_windows_on_a_stream(spark, events, tmp_path):
    source = streams.files(spark, events, spark.read.parquet(events).schema).withWatermark("at", "1 day")
    streams.run_once(streams.weekly_windows(source, "at", ["k"], F.count("*").alias("n")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {(r.k, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()} >= {("a", 4), ("b", 1)}


def test_forward_match(spark, events, tmp_path):
    df = streams.files(spark, events, spark.read.parquet(events).schema)
    p, a = df.where("flag = 0").select("k", "at"), df.where("flag = 1").select("k", F.col("at").alias("actual"))
    out = streams.forward_matches_stream(p, a, "k", "at", "actual").select(F.col("p.k").alias("k"), "at", "actual")
    streams.run_once(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted((r.k, (r.actual - r["at"]).seconds) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 300), ("a", 300), ("b", 60)]


def test_newest_fetch_wins(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("a", t, 1, "old"), ("a", t, 3, "new"), ("a", t, 2, "middle"), ("b", t, 1, "only"), ("a", t + timedelta(days=1), 1, "next"), ("z", t + timedelta(days=40), 1, "late")]
    spark.createDataFrame(rows, "name string, day timestamp, fetched int, v string").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = streams.files(spark, str(tmp_path / "in"), "name string, day timestamp, fetched int, v string")
    streams.run_once(streams.newest_stream(source, ["name"], "day", ["fetched"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.name, r.day, r.v) for r in got.collect()) == [("a", t, "new"), ("a", t + timedelta(days=1), "next"), ("b", t, "only")]
