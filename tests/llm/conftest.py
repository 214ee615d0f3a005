from pathlib import Path

import pytest


@pytest.fixture(scope="session")
def docs(spark, sf):
    """The documents of the smallest table, with nulls, empty, repeated and awkward rows, and columns of clashing names."""
    from pyspark.sql import functions as F

    more = [
        (10**6, None, None, None), (10**6 + 1, "", "en", "src0"), (10**6 + 2, "é😀 it's 12½²Ⅷ  \n\n x\x1c y z 一二三 日本 ñ× don't!! <|endoftext|> \x00\x7f", None, None), (10**6 + 3, "a" * 30_000, "en", "src0"),
        (10**6 + 3, "a" * 30_000, "en", "src0"), (None, "cc by cc by cc by", None, "src1"), (10**6 + 4, "MIT license secret = token: abcdefghijklmnop PassWord=\"abc=/.-+_123456\" api_key:0123456789abcdef0 AKIA AKIAX AKIAABCDEFGHIJKLMN", "en", None),
    ]
    base = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 3 = 0 or doc_id < 120").select("doc_id", "text", "lang", "source")
    rows = base.union(spark.createDataFrame(more, base.schema)).withColumn("n_chars", F.char_length("text").cast("long"))
    return rows.withColumns({"quality": F.lit("q"), "row": F.lit(1), "mix": F.lit(2), "score": F.lit(0.5), "found": F.lit(3), "lang_pred": F.lit("?"), "content": F.lit(4)}).coalesce(4).cache()


@pytest.fixture(scope="session")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
