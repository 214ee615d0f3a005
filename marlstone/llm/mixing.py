"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source's rows are dealt into blocks. With weight w (an exact fraction of the sum of the target weights), block j (from 1) is released
at slot floor((j - 1) / w) and due by slot ceil(j / w); earliest deadline first among released blocks (ties: successor bit, then source
name) gives each slot one block, and a source's blocks differ from its weight times the slots by less than one at every slot.

The driver works the schedule out from one number a source, block by block, in whole numbers. A block is BLOCK_ROWS rows, or as many
more as keep all of them to about SLOTS, so the schedule is a table of at most SLOTS rows and one for each source, whatever the
number of rows, which find their slot by a join with it.

A row's place within its source is its rank by bucket (a hash) and id. Every bucket has about BUCKET_ROWS rows, so a source that
holds a third of all rows is ranked by many tasks; offsets come from the counts of buckets. What is ranked are numbers of equal rows,
summed on the map side and dealt by SALTS, so a row that is repeated in a third of the table is many tasks' work, too.

Defined results: a null source is a source of its own. Repeated rows get places of their own. Sources without a target weight, or an
empty table, follow :func:`target_weights`; those of weight 0 (or below LEAST of the sum) come after all others, in order of name. Every
row is kept: where a source has run out, its later slots stay empty; ``within`` says whether a row stands before the first such slot.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import columns_of

BLOCK_ROWS, SLOTS, BUCKET_ROWS, SALTS = 16, 200_000, 1000, 1024
#: Exponent of the default target: weight in proportion to rows ** TEMPERATURE.
TEMPERATURE = 0.7
#: Shares below this count as 0, so that slots are 64-bit numbers.
LEAST = Fraction(1, 10**12)


def by_name(source: str | None) -> tuple[bool, str]:
    return source is not None, source or ""


def shares(weights: dict[str | None, float]) -> dict[str | None, Fraction]:
    """Exact shares of the sum; a float is taken as the decimal that it is written as."""
    exact = {k: Fraction(str(v)) for k, v in weights.items()}
    if any(v < 0 for v in exact.values()):
        raise ValueError("a weight is negative")
    total = sum(exact.values()) or 1
    return {k: v / total if v >= LEAST * total else Fraction(0) for k, v in exact.items()}


def release(j: int, share: Fraction) -> int:
    return (j - 1) * share.denominator // share.numerator


def deadline(j: int, share: Fraction) -> int:
    return -(-j * share.denominator // share.numerator)


def schedule(share: dict[str | None, Fraction], blocks: dict[str | None, int]) -> Iterator[tuple[str | None, int, int]]:
    """(source, block, slot) of all ``blocks`` (a number for each source), slot by slot. Slots that no block is released for stay empty."""
    waiting = sorted((0, by_name(k), k, 1) for k, s in share.items() if s and blocks[k])
    ready: list = []
    slot = -1
    while waiting or ready:
        slot = slot + 1 if ready else max(slot + 1, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, name, k, j = heapq.heappop(waiting)
            due = deadline(j, share[k])
            overlaps = due > release(j + 1, share[k])  # a successor that overlaps it goes first among equals
            heapq.heappush(ready, (due, not overlaps, name, k, j))
        _, _, name, k, j = heapq.heappop(ready)
        yield k, j, slot
        if j < blocks[k]:
            heapq.heappush(waiting, (max(slot + 1, release(j + 1, share[k])), name, k, j + 1))
    for k in sorted((k for k, s in share.items() if not s), key=by_name):
        for j in range(1, blocks[k] + 1):
            slot += 1
            yield k, j, slot


def target_weights(counts: dict[str | None, int], targets: dict[str, float] | None = None, temperature: float = TEMPERATURE) -> dict[str | None, float]:
    """``targets`` for the sources that occur (others share what is left of 1, by their rows); without targets rows ** temperature."""
    if targets is None:
        return {k: float(n) ** temperature for k, n in counts.items()}
    left = max(Fraction(0), 1 - sum(Fraction(str(targets[k])) for k in counts if k in targets))
    others = sum(n for k, n in counts.items() if k not in targets)
    return {k: targets[k] if k in targets else left * n / others for k, n in counts.items()}


def timetable(counts: dict[str | None, int], targets: dict[str, float] | None, block_rows: int) -> tuple[list[tuple], int]:
    """((source, (block, release, deadline, slot, turn) of each block) of each source, the first slot that a source with no rows left
    should have had). A block's turn is its number in the order of slots."""
    share = shares(target_weights(counts, targets))
    blocks = {k: -(-n // block_rows) for k, n in counts.items()}
    rows: dict[str | None, list] = {k: [] for k in counts}
    for turn, (k, j, slot) in enumerate(schedule(share, blocks)):
        s = share[k]
        rows[k].append((j, *((release(j, s), deadline(j, s)) if s else (slot, slot + 1)), slot, turn))
    return list(rows.items()), min((release(blocks[k] + 1, s) for k, s in share.items() if s), default=0)


def scheduled(docs: DataFrame, source: str, key: str, text: str, targets: dict[str, float] | None, block_rows: int | None, bucket_rows: int) -> tuple[DataFrame, int, int]:
    """(doc, i, at, within) of each row: its columns, its place in its source, its block's line of the timetable; the rows of a block and the number of blocks."""
    spark = docs.sparkSession
    counts = {r[0]: r["count"] for r in docs.groupBy(source).count().collect()}
    block_rows = block_rows or max(BLOCK_ROWS, -(-sum(counts.values()) // SLOTS))
    held, horizon = timetable(counts, targets, block_rows)
    name = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    sources = spark.createDataFrame([(k, -(-counts[k] // bucket_rows), rows) for k, rows in held], "source string, buckets int, rows array<struct<block:long,release:long,deadline:long,slot:long,turn:long>>").withColumn("source", name(F.col("source")))
    table = sources.select("source", F.explode("rows").alias("at")).withColumn("block", F.col("at.block"))
    hashed = lambda word: F.xxhash64(F.lit(word), F.col(key), F.col(text))
    named = docs.select(
        F.struct(*columns_of(docs)).alias("doc"), name(F.col(source)).alias("source"), hashed("bucket").alias("h"), F.col(key).alias("k"), name(F.col(key)).alias("named"), hashed("mix").alias("tie"),
        F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"),
    )
    rows = named.join(F.broadcast(sources.select("source", "buckets")), "source").withColumn("bucket", F.pmod("h", "buckets").cast("int")).drop("buckets", "h")
    same = ["source", "bucket", "named", "tie", "salt"]
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    equal = rows.groupBy(*same).agg(F.count("*").alias("n"), F.min("k").alias("k"))
    offsets = equal.groupBy("source", "bucket").agg(F.sum("n").alias("n")).withColumn("offset", before(W.partitionBy("source").orderBy("bucket"))).drop("n")
    starts = equal.withColumn("before", before(W.partitionBy("source", "bucket").orderBy("k", "tie", "salt"))).join(offsets, ["source", "bucket"])
    starts = starts.select(*same, (F.col("offset") + F.col("before")).alias("start"))
    # numbers of equal rows and their starts have the same keys, so documents are shuffled once
    numbered = rows.withColumn("nth", F.row_number().over(W.partitionBy(*same).orderBy(F.lit(0))) - 1).join(starts, same)
    placed = numbered.select("doc", "source", (F.col("start") + F.col("nth")).alias("i")).withColumn("block", F.floor(F.col("i") / block_rows) + 1)
    return placed.join(F.broadcast(table), ["source", "block"]).select("doc", "i", "at", (F.col("at.slot") < horizon).alias("within")), block_rows, sum(len(x) for _, x in held)


def mix(
    docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", targets: dict[str, float] | None = None,
    block_rows: int | None = None, bucket_rows: int = BUCKET_ROWS, out: str = "mix",
) -> DataFrame:
    """``docs`` with struct column ``out``: block, release, deadline, slot, place (of the row in its slot), within.

    ``docs`` are computed twice, and equal rows must be in the same partitions both times, as they are in scans of files.
    """
    rows, size, _ = scheduled(docs, source, key, text, targets, block_rows, bucket_rows)
    return rows.select("doc.*", F.struct("at.block", "at.release", "at.deadline", "at.slot", (F.col("i") % size).alias("place"), "within").alias(out))


def mixed_order(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", targets: dict[str, float] | None = None, block_rows: int | None = None) -> DataFrame:
    """``docs`` in the order of the schedule: dealt by turns of blocks, as many to each partition, and sorted by turn and place. Every row stays."""
    rows, _, turns = scheduled(docs, source, key, text, targets, block_rows, BUCKET_ROWS)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = F.least(F.lit(n - 1), F.floor(F.col("at.turn") * n / max(1, turns))).cast("int")
    return rows.repartitionById(n, by).sortWithinPartitions("at.turn", "i").select("doc.*")


def op2(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "source", F.xxhash64("text").alias("text"))).select("doc_id", "source", "mix.*")
