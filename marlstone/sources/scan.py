"""Sources (S1-S14): Parquet, partitioned Parquet, JSON lines, CSV, JDBC shards, value lists, footers, and their schema checks."""

from __future__ import annotations

import gzip
import re
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from pyspark.sql import types as T


class SchemaMismatch(ValueError):
    """A table's columns or types are not those that were agreed."""


def assert_schema(df: DataFrame, expected: T.StructType | str, nullable: bool = False) -> DataFrame:
    """``df`` if its (name, type) list equals ``expected``, in order."""
    if isinstance(expected, str):
        expected = T._parse_datatype_string(expected)
    of = lambda s: [(f.name, f.dataType.simpleString(), *([f.nullable] if nullable else [])) for f in s]
    if of(df.schema) != of(expected):
        raise SchemaMismatch(f"expected {of(expected)}, found {of(df.schema)}")
    return df


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise SchemaMismatch(f"missing columns: {missing}")
    return df


def parquet(spark: SparkSession, *paths: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet by glob or explicit list."""
    df = spark.read.parquet(*paths)
    return assert_schema(df, schema) if schema is not None else df


def partitioned(spark: SparkSession, root: str, **partition) -> DataFrame:
    """Hive-partitioned Parquet, pruned to the given partition values before any file is read."""
    df = spark.read.option("basePath", root).parquet(root)
    for name, value in partition.items():
        df = df.where(F.col(name).isin(list(value)) if isinstance(value, list | tuple) else F.col(name) == F.lit(value))
    return df


def with_path_value(df: DataFrame, key: str, column: str | None = None) -> DataFrame:
    """S3: the value of ``key=...`` in each row's file path as a column."""
    return df.withColumn(column or key, F.regexp_extract(F.col("_metadata.file_path"), rf"/{re.escape(key)}=([^/]+)/", 1))


def path_value_conflicts(df: DataFrame, key: str, physical: str) -> DataFrame:
    """S3: rows whose physical column differs from the value in the path; must be empty."""
    return with_path_value(df, key, "__path_value").where(~F.col("__path_value").eqNullSafe(F.col(physical).cast("string")))


def json_lines(spark: SparkSession, *paths: str, schema: str | T.StructType | None = None) -> DataFrame:
    """JSON lines with an explicit nested schema, or with the union of the schemas found."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(list(paths))


def csv(spark: SparkSession, *paths: str, schema: str | None = None, all_text: bool = False) -> DataFrame:
    """CSV with header: given schema, all text, or inferred types."""
    reader = spark.read.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    elif not all_text:
        reader = reader.option("inferSchema", True)
    return reader.csv(list(paths))


def shards(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL of shards by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def jdbc_shards(spark: SparkSession, urls: list[str], table: str, properties: dict[str, str] | None = None) -> DataFrame:
    """One table of several databases; a second database for a comparison is a list of one."""
    return shards([spark.read.jdbc(url, table, properties=properties or {}) for url in urls])


def linked_url(links: str = "Links", label: str = "SOURCE_REPO"):
    """The URL of the first link with a label, from an array of (Label, URL)."""
    return F.get(F.filter(F.col(links), lambda x: x["Label"] == label), F.lit(0))["URL"]


def s3a(spark: SparkSession, endpoint: str, access_key: str, secret_key: str, path_style: bool = True) -> SparkSession:
    """Object store settings for s3a:// paths."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for k, v in {"endpoint": endpoint, "access.key": access_key, "secret.key": secret_key, "path.style.access": str(path_style).lower()}.items():
        conf.set(f"fs.s3a.{k}", v)
    return spark


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A list of parameters as a table."""
    return spark.createDataFrame(rows, schema)


def unnested(df: DataFrame) -> DataFrame:
    """Arrays of structs as rows and structs as columns, level by level, until neither is left; an empty array leaves nulls."""
    from pyspark.sql import types as T

    while True:
        for f in df.schema:
            rest = [F.col(f"`{c}`") for c in df.columns if c != f.name]
            if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                df = df.select(*rest, F.explode_outer(f"`{f.name}`").alias(f.name))
                break
            if isinstance(f.dataType, T.StructType):
                df = df.select(*rest, *[F.col(f"`{f.name}`.`{n}`").alias(n) for n in f.dataType.names])
                break
        else:
            return df


def json_table(spark: SparkSession, text: str, schema: str | None = None) -> DataFrame:
    """A JSON array of objects as a table, parsed by the engine; without a schema that of the text, taken apart by :func:`unnested`."""
    if schema is None:
        one = spark.range(1).select(F.from_json(F.lit(text), F.schema_of_json(F.lit(text))).alias("rows"))
        return unnested(one)
    one = spark.createDataFrame([(text,)], "j string")
    return one.select(F.inline(F.from_json("j", f"array<struct<{schema}>>")))


def footer_range(spark: SparkSession, paths: list[str], column: str) -> tuple:
    """(rows, min, max) of a column from Parquet footers alone, read on the executors; min and max are None if a row group lacks statistics."""
    if not paths:
        return 0, None, None
    kind = spark.read.parquet(paths[0]).schema[column].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                meta = pq.ParquetFile(place, filesystem=store).metadata
                at = meta.schema.to_arrow_schema().names.index(column)
                groups = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
                known = all(x is not None and x.has_min_max for x in groups)
                ends = [x for s in groups for x in (s.min, s.max)] if known else []
                of = meta.schema.to_arrow_schema().field(at).type
                yield pa.RecordBatch.from_arrays([pa.array([meta.num_rows], pa.int64()), pa.array([min(ends, default=None)], of), pa.array([max(ends, default=None)], of), pa.array([known])], ["n", "low", "high", "known"])

    rows = files.each_path(spark, paths).mapInArrow(run, f"n long, low {kind}, high {kind}, known boolean")
    r = rows.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_and("known").alias("known")).first()
    return r["n"], r["low"] if r["known"] else None, r["high"] if r["known"] else None


def complete_parts(spark: SparkSession, paths: list[str], in_progress: bool = True) -> tuple[list[str], list[str]]:
    """(complete, broken) gzip parts, inflated on the executors. The newest part may still be written: if broken it is left out without being reported."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                try:
                    with store.open_input_stream(place, compression=None) as raw, gzip.open(raw) as part:
                        while part.read(1 << 20):
                            pass
                    ok = True
                except (EOFError, OSError):
                    ok = False
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([ok])], ["path", "ok"])

    whole = {r["path"]: r["ok"] for r in files.each_path(spark, paths).mapInArrow(run, "path string, ok boolean").collect()} if paths else {}
    complete = [p for p in sorted(paths) if whole[files.uri(spark, p)]]
    broken = [p for p in sorted(paths) if not whole[files.uri(spark, p)]]
    if in_progress and broken and broken[-1] == max(paths):
        broken.pop()
    return complete, broken


class Catalog:
    """Named temporary views over Parquet globs."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}

    def register(self, name: str, *paths: str) -> DataFrame:
        df = self.spark.read.parquet(*paths)
        df.createOrReplaceTempView(name)
        self.tables[name] = list(paths)
        return df

    def register_folder(self, folder: str, pattern: str = "*.parquet") -> list[str]:
        for path in sorted(Path(folder).glob(pattern)):
            self.register(path.name.removesuffix(".parquet"), str(path))
        return sorted(self.tables)
