"""The ten queries opN_<name>, each over its whole table, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from .common import read_table
from . import ann, bpe, langid, licenses, mixing, neardup, oracles, quality, secrets, urls, warc


def op1_ann(spark, sf_dir):
    return ann.op1(read_table(spark, sf_dir, "embeddings"))


def op2_mix_sources(spark, sf_dir):
    return mixing.op2(read_table(spark, sf_dir, "documents"))


def op3_license_scan(spark, sf_dir):
    return licenses.op3(read_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark, sf_dir):
    return quality.op4(read_table(spark, sf_dir, "documents"))


def op5_url_filter(spark, sf_dir):
    return urls.op5(read_table(spark, sf_dir, "pages"))


def op6_secret_scan(spark, sf_dir):
    return secrets.op6(read_table(spark, sf_dir, "documents"))


def op7_language_id(spark, sf_dir):
    return langid.op7(read_table(spark, sf_dir, "documents"))


def op8_near_dedup(spark, sf_dir):
    return neardup.op8(read_table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark, sf_dir):
    return bpe.op9(read_table(spark, sf_dir, "documents"))


def op10_warc(spark, sf_dir):
    return warc.op10(read_table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_ann, op2_mix_sources, op3_license_scan, op4_quality_rules, op5_url_filter, op6_secret_scan, op7_language_id, op8_near_dedup, op9_byte_bpe, op10_warc)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
