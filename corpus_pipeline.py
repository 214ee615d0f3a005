"""The corpus pipeline: language ID, near-duplicates, secrets, source mixing, byte-level BPE.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept; all but the last return the
columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.llm import bpe, langid, mixing, neardup, secrets
from marlstone.llm.common import cut


def identify_language(spark, docs, sf_dir):
    """Documents whose language isn't known well enough go (no letters, or no language much likelier than the others)."""
    return langid.keep(docs, langid.fit(docs))


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each class stays: that with the least doc_id."""
    return neardup.deduplicated(docs)


def redact_secrets(spark, docs, sf_dir):
    """Secrets are replaced in the text and n_chars is counted anew; every document stays."""
    return secrets.redact(docs)


def mix_sources(spark, docs, sf_dir):
    """Documents in the order of the Pfair schedule of their sources, which is the order of the written files; every document stays."""
    return mixing.mixed_order(docs)


def digest(data):
    return F.sha2(data.cast("binary"), 256)


def encode_bytes(spark, docs, sf_dir):
    """Token ids of every document, in the order in which ``docs`` were written. Ids are decoded, and it is an error if that isn't the text.

    ``docs`` are read from files: the number in a file's name and the row's place in the file are carried through the encoding, and the
    result is dealt and sorted by them. Ids are decoded after that, so that no task needs more than one Python worker at a time.
    """
    at = F.struct("doc_id", F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int").alias("part"), F.col("_metadata.row_index").alias("place"), digest(F.coalesce("text", F.lit(""))).alias("digest"))
    coded = bpe.encode(docs.select(at.alias("doc_id"), "text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = coded.repartitionById(n, F.least("doc_id.part", F.lit(n - 1))).sortWithinPartitions("doc_id.part", "doc_id.place")
    same = digest(F.col("decoded")) == F.col("doc_id.digest")
    return bpe.decode(ordered).select("doc_id.doc_id", F.when(same, F.col("ids")).otherwise(F.raise_error(F.lit("decoded ids differ from the text"))).alias("ids"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode_bytes),
]

#: Models, signatures, BPE and the schedule aren't SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """STAGES one after another over ``documents``; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
