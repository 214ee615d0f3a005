"""Small files and digests on any file system that Hadoop and Arrow know."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def uri(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, as Arrow reads it."""
    store, place = _at(spark, path)
    whole = store.makeQualified(place).toString()
    return "file://" + whole.removeprefix("file:") if whole.startswith("file:/") and not whole.startswith("file://") else whole


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _at(spark, path)
    return bool(store.exists(place))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    store, place = _at(spark, path)
    out = store.create(place, True)
    out.write(bytearray(text.encode()))
    out.hsync() if hasattr(out, "hsync") else None
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    store, place = _at(spark, path)
    source = store.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def listed(spark: SparkSession, folder: str, ending: str = "") -> list[str]:
    """Files directly in a folder, in order of name."""
    store, place = _at(spark, folder)
    found = [x.getPath().getName() for x in store.listStatus(place) if x.isFile()]
    return sorted(x for x in found if x.endswith(ending) and not x.startswith((".", "_")))


def each_path(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path): one task for some paths, so that what is done for each is done on the executors."""
    rows = spark.createDataFrame([(uri(spark, p),) for p in paths], "path string")
    return rows.repartition(max(1, min(len(paths), 1000)))


def digests(spark: SparkSession, paths: list[str]) -> dict[str, tuple[int, str]]:
    """{path: (bytes, SHA-256)}, read in pieces on the executors."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                size, digest = 0, hashlib.sha256()
                with store.open_input_stream(place, compression=None) as source:
                    while piece := source.read(1 << 20):
                        size += len(piece)
                        digest.update(piece)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([digest.hexdigest()])], ["path", "size", "digest"])

    found = {r["path"]: (r["size"], r["digest"]) for r in each_path(spark, paths).mapInArrow(run, "path string, size long, digest string").collect()} if paths else {}
    return {p: found[uri(spark, p)] for p in paths}
