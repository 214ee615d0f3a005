"""Validation (Q1-Q12): named conditions that must count 0, evaluated in one aggregate for each frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """A check counted something; nothing may be published."""


def row_checks(df: DataFrame, **bad: Column) -> DataFrame:
    """Q1, Q4, Q11: one row with the count of rows for which each condition holds."""
    return df.agg(*[F.count_if(c).alias(k) for k, c in bad.items()])


def text_fault(column: str, most: int, required: bool = True) -> Column:
    """Q1: null (if required), blank, too long, or with a NUL."""
    c = F.col(column)
    fault = (F.trim(c) == "") | (F.char_length(c) > most) | (F.instr(c, "\0") > 0)
    return (c.isNull() | fault) if required else F.coalesce(fault, F.lit(False))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Q2, A15."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, keys: list[str], parents: DataFrame) -> DataFrame:
    """Q3."""
    return df.join(parents.select(*keys), keys, "left_anti")


def table_checksum(df: DataFrame) -> Column:
    """Halves of each row's MD5 summed as decimals, so that order doesn't matter."""
    digest = F.md5(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    half = lambda i: F.sum(F.conv(F.substring(digest, i, 16), 16, 10).cast("decimal(38,0)"))
    return F.struct(half(1).alias("high"), half(17).alias("low"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Q9 by checksum and count: two aggregates, no sort."""
    x = a.agg(F.count("*"), table_checksum(a)).first()
    y = b.select(*a.columns).agg(F.count("*"), table_checksum(a)).first()
    return tuple(x) == tuple(y)


def named(checks: dict[str, DataFrame]) -> DataFrame:
    """Q10: one row a check with its number of faults; one job for all."""
    out = None
    for name, faults in checks.items():
        row = faults.agg(F.count("*").alias("faults")).select(F.lit(name).alias("check"), "faults")
        out = row if out is None else out.unionByName(row)
    return out


def require_clean(counts: DataFrame) -> None:
    """Q12: raises if any count of a one-row (or check, faults) frame isn't 0."""
    rows = counts.collect()
    bad = {r["check"]: r["faults"] for r in rows if r["faults"]} if "check" in counts.columns else {k: v for k, v in rows[0].asDict().items() if v}
    if bad:
        raise CheckFailed(str(bad))


def expect_count(df: DataFrame, expected: int) -> DataFrame:
    """Q5: ``df`` if its count is the manifest's."""
    if (n := df.count()) != expected:
        raise CheckFailed(f"{n} rows, expected {expected}")
    return df
