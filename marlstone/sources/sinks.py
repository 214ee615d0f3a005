"""Sinks (K1-K11). Manifests and markers go through the file system of the path, digests are made on the executors."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from . import files


def parquet(df: DataFrame, path: str, codec: str = "zstd", max_records: int | None = None, block_bytes: int | None = None, mode: str = "error") -> DataFrame:
    """K1, K2: Parquet, an error if it exists unless ``mode`` says otherwise; read again, and an error if it has other rows than were written."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).option("compression", codec)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    if block_bytes:
        writer = writer.option("parquet.block.size", block_bytes)
    writer.parquet(path)
    again = df.sparkSession.read.parquet(path)
    if mode != "append" and (n := again.count()) != seen.get["n"]:
        raise ValueError(f"{seen.get['n']} rows written, {n} read again")
    return again


def partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Partitions by value; a run replaces only the partitions that it has rows for."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def ordered_file(df: DataFrame, path: str, order: list[Column | str], form: str = "parquet", **options) -> None:
    """K4: one file in a total order. Meant for results that one task can hold; ``order`` must leave no ties."""
    writer = df.orderBy(*order).coalesce(1).write.mode("overwrite")
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.format(form).save(path)


def csv_with_mark(df: DataFrame, path: str, order: list[Column | str], bar: str = "|") -> str:
    """K5: a CSV file that begins with a UTF-8 byte-order mark (it stands before the first column's name); arrays are joined by ``bar``. The path of the file."""
    names = [n if i else f"\ufeff{n}" for i, n in enumerate(df.columns)]
    flat = df.orderBy(*order).select(*[(F.array_join(F.col(n), bar) if t.startswith("array") else F.col(n)).alias(name) for (n, t), name in zip(df.dtypes, names, strict=True)])
    flat.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
    return f"{path}/{files.listed(df.sparkSession, path, '.csv')[0]}"


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K6: JSON lines with nulls kept and ISO timestamps."""
    df.write.mode(mode).option("ignoreNullFields", "false").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def bucketed(df: DataFrame, path: str, key: str, buckets: int = 16) -> None:
    """K7: one file for each hash bucket of ``key``."""
    df.repartition(buckets, key).write.mode("overwrite").parquet(path)


def bucketed_table(df: DataFrame, name: str, key: str, buckets: int = 16, path: str | None = None) -> DataFrame:
    """A table in hash buckets of ``key``, sorted within: two such tables of equal buckets join by it without a shuffle."""
    writer = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def consolidated(df: DataFrame, path: str, parts: int) -> DataFrame:
    """K7: few large files of many small ones, without a shuffle; checked like :func:`parquet`."""
    return parquet(df.coalesce(parts), path)


def staged_swap(stage: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """K8: ``target`` with the rows of every key in ``stage`` replaced by those of ``stage``."""
    return target.join(stage.select(*keys).distinct(), keys, "left_anti").unionByName(stage)


def swap_into(stage: DataFrame, path: str, keys: list[str], by: str) -> int:
    """K8: :func:`staged_swap` on a stored table partitioned by ``by``: what takes the place of the touched partitions is written beside
    the table and counted first, then these partitions alone are overwritten. The number of rows they hold now.

    A key that moves between partitions leaves its old one, too: partitions that hold a staged key count as touched.
    """
    spark = stage.sparkSession
    target = spark.read.parquet(path)
    held = target.join(stage.select(*keys).distinct(), keys, "left_semi").select(by).unionByName(stage.select(by)).distinct()
    touched = [r[0] for r in held.collect()]
    some = target.where(F.col(by).isin(touched)) if touched else target.limit(0)
    beside = f"{path.rstrip('/')}.stage-{uuid.uuid4().hex}"
    new = parquet(staged_swap(stage.select(*target.columns), some, keys), beside)
    partitioned(new, path, by)
    emptied = set(touched) - {r[0] for r in new.select(by).distinct().collect()}
    store, place = files._at(spark, path)
    for value in emptied:
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(place, f"{by}={value}"), True)
    n = new.count()
    store.delete(files._at(spark, beside)[1], True)
    return n


def merge(target: DataFrame, changes: DataFrame, keys: list[str], update: bool = True, order: list[Column | str] | None = None) -> DataFrame:
    """K9: insert-or-update (or insert-or-ignore) by ``keys``. Of changes with equal keys the first by ``order`` counts, by default
    the greatest by all other columns."""
    from ..operators.relational import qualify_first

    once = qualify_first(changes, keys, order or [F.desc_nulls_last(c) for c in changes.columns if c not in keys] or keys)
    if update:
        return target.join(once.select(*keys), keys, "left_anti").unionByName(once)
    return target.unionByName(once.join(target.select(*keys), keys, "left_anti"))


def publish(df: DataFrame, path: str, facts: dict | None = None) -> dict:
    """Data, then a manifest of sizes and SHA-256 digests, then the marker, in that order. Refuses an existing marker."""
    spark = df.sparkSession
    if files.exists(spark, f"{path}/_SUCCESS"):
        raise FileExistsError(path)
    df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").option("compression", "zstd").parquet(f"{path}/data")
    names = [f"data/{x}" for x in files.listed(spark, f"{path}/data", ".parquet")]
    found = files.digests(spark, [f"{path}/{x}" for x in names])
    parts = [{"name": x, "bytes": found[f"{path}/{x}"][0], "sha256": found[f"{path}/{x}"][1]} for x in names]
    manifest = {"rows": spark.read.parquet(f"{path}/data").count(), "files": parts} | (facts or {})
    files.write_text(spark, f"{path}/manifest.json", json.dumps(manifest, indent=1, sort_keys=True))
    files.write_text(spark, f"{path}/_SUCCESS", "")
    return manifest


def verify_published(spark, path: str) -> bool:
    """Whether a published folder has its marker and every file its digest."""
    if not files.exists(spark, f"{path}/_SUCCESS"):
        return False
    manifest = json.loads(files.read_text(spark, f"{path}/manifest.json"))
    if not all(files.exists(spark, f"{path}/{f['name']}") for f in manifest["files"]):
        return False
    found = files.digests(spark, [f"{path}/{f['name']}" for f in manifest["files"]])
    return all(found[f"{path}/{f['name']}"] == (f["bytes"], f["sha256"]) for f in manifest["files"])
