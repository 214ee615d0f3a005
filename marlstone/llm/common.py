"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one block of documents holds at most (a single longer document is a block of its own).
BLOCK_CHARS = 8_000_000
#: Bounds of one Arrow batch between the JVM and a Python worker.
ARROW_ROWS, ARROW_BYTES = 500, 16 << 20


def bound_arrow(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a worker's memory doesn't grow with text length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``. Only a session on one machine (tests) gets a default where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/marlstone-{uuid.uuid4().hex}"


def cut(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free() -> None:
    """Give memory that this worker no longer uses back to the machine: workers are kept for later tasks, which may need little."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # a function of the GNU C library
        trim(0)


def freeing_groups(run):
    """A function of a key and two tables that frees memory after each group."""

    def wrapped(key, left, right):
        out = run(key, left, right)
        free()
        return out

    return wrapped


def freeing(run):
    """A function of Arrow batches that frees memory when it ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            free()

    return wrapped


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, whatever Catalyst makes of it elsewhere."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocks(batches: Iterator, text: str, limit: int = BLOCK_CHARS) -> Iterator:
    """Arrow batches joined into tables of about ``limit`` bytes of column ``text``."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        n = batch.column(batch.schema.get_field_index(text)).nbytes
        if held and size + n > limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield pa.Table.from_batches(held)
