"""Structured Streaming forms (ST1-ST9): state changes, forward matches, deduplication, weekly and session windows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def files(spark: SparkSession, folder: str, schema, form: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(form)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(folder)


def state_changes(events: DataFrame, key: str, at: str, flag: str) -> DataFrame:
    """ST1 in batch: (previous, current] of each change of a 0/1 flag to 1, duplicates of (key, at) collapsed to the greatest flag."""
    once = events.groupBy(key, at).agg(F.max(flag).alias(flag))
    w = W.partitionBy(key).orderBy(at)
    return once.withColumn("previous_at", F.lag(at).over(w)).withColumn("__was", F.lag(flag).over(w)).where((F.col("__was") == 0) & (F.col(flag) == 1)).select(key, "previous_at", F.col(at).alias("current_at"))


def state_changes_stream(events: DataFrame, key: str, at: str, flag: str, delay: str) -> DataFrame:
    """ST1 on a stream: one small state a key (last instant and flag); an event at or before the last instant is a duplicate or late.

    The state of a key that stays silent for longer than an hour of event time is dropped.
    """
    kind = dict(events.dtypes)[key]

    def step(k: tuple, frames: Iterator, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        last, was = state.get if state.exists else (None, None)
        out = []
        for rows in frames:
            for t, f in rows.groupby(at)[flag].max().items():
                micros = int(pd.Timestamp(t).value // 1000)
                if last is not None and micros <= last:
                    continue
                if was == 0 and f == 1:
                    out.append((k[0], pd.Timestamp(last * 1000), pd.Timestamp(t)))
                last, was = micros, int(f)
        state.update((last, was))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + 3_600_000)
        yield pd.DataFrame(out, columns=[key, "previous_at", "current_at"])

    return events.withWatermark(at, delay).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, previous_at timestamp, current_at timestamp", "last long, was int", "append", GroupStateTimeout.EventTimeTimeout)


def forward_matches_stream(predictions: DataFrame, actuals: DataFrame, key: str, at: str, actual_at: str, within: str = "20 minutes", delay: str = "10 minutes") -> DataFrame:
    """ST2: predictions with the actual events at or after them within a limit: an interval join of two streams, state bounded by watermarks."""
    p = predictions.withWatermark(at, delay).alias("p")
    a = actuals.withWatermark(actual_at, delay).alias("a")
    on = (F.col(f"p.{key}") == F.col(f"a.{key}")) & (F.col(f"a.{actual_at}") >= F.col(f"p.{at}")) & (F.col(f"a.{actual_at}") <= F.col(f"p.{at}") + F.expr(f"INTERVAL {within}"))
    return p.join(a, on)


def quantiles(df: DataFrame, by: list[str], value: str, few: int = 30, some: int = 100) -> DataFrame:
    """ST3: p10, p50, p90 with a label of confidence by sample size."""
    n = F.count(value)
    label = F.when(n < few, "low").when(n < some, "medium").otherwise("high")
    return df.groupBy(*by).agg(n.alias("n"), *[F.percentile(value, F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.1, 0.5, 0.9)], label.alias("confidence"))


def simulated_sums(samples: DataFrame, leg: str, value: str, runs: int, seed: int) -> DataFrame:
    """ST4: sums over legs of one random sample each, ``runs`` times: runs are a range, a draw picks a numbered sample by equi join."""
    numbered = samples.withColumn("pick", F.row_number().over(W.partitionBy(leg).orderBy(value)) - 1)
    sizes = samples.groupBy(leg).agg(F.count("*").alias("n"))
    draws = samples.sparkSession.range(runs).withColumnRenamed("id", "run").crossJoin(F.broadcast(sizes)).withColumn("pick", F.pmod(F.xxhash64(F.lit(seed), "run", leg), "n").cast("int"))
    return draws.join(numbered, [leg, "pick"]).groupBy("run").agg(F.sum(value).alias("total"))


def first_arrivals_stream(events: DataFrame, keys: list[str], at: str, delay: str = "1 day") -> DataFrame:
    """The first arrival of each key within the watermark, at once."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def newest_stream(events: DataFrame, keys: list[str], day: str, order: list[str], delay: str = "1 day") -> DataFrame:
    """ST5: of each (keys, ``day``) the row that comes last by ``order`` (such as the time of its fetch), once the watermark has passed the day.

    A running maximum a key is all the state there is; later fetches replace earlier ones, whichever arrives first.
    """
    rest = [c for c in events.columns if c not in (*keys, day)]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return events.withWatermark(day, delay).groupBy(*keys, day).agg(best.alias("__v")).select(*keys, day, "__v.*")


def run_once(df: DataFrame, path: str, checkpoint: str, form: str = "parquet", mode: str = "append", by: list[str] | None = None):
    """ST6: everything that has arrived, once; the checkpoint makes a repeated run take up where the last ended."""
    writer = df.writeStream.format(form).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if by:
        writer = writer.partitionBy(*by)
    query = writer.start(path)
    query.awaitTermination()
    return query


def weekly_windows(df: DataFrame, at: str, by: list[str], *aggregates: Column) -> DataFrame:
    """ST7: tumbling weeks that begin on Mondays; batch or stream."""
    return df.groupBy(F.window(at, "7 days", "7 days", "4 days").alias("week"), *by).agg(*aggregates)


def session_windows(df: DataFrame, at: str, by: list[str], *aggregates: Column, gap: str = "8 days") -> DataFrame:
    """ST9."""
    return df.groupBy(F.session_window(at, gap).alias("session"), *by).agg(*aggregates)


def sliding_windows(df: DataFrame, at: str, width: str, step: str, by: list[str], *aggregates: Column) -> DataFrame:
    return df.groupBy(F.window(at, width, step).alias("window"), *by).agg(*aggregates)
