"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join, in DataFrame functions only.

A listed entry is a canonical host and a path prefix. A URL is expanded into the entries that could list it: for each shape in the
list (a number of labels and a length of path, counted together) its host's last labels and its path's first characters, so a host of
very many labels costs no more than another. These candidates are probed in the filter (one 256-bit block each, eight bits within it);
what passes goes to the exact join by host and path, which drops false positives.

The filter has a block for ENTRIES entries of the list, which are counted, and MOST_BLOCKS at most (rows of eight integers), so it may
be broadcast; a still longer list only makes more false positives. The exact join broadcasts the list up to BROADCAST_ROWS rows, which it
counts, and is otherwise salted, so that an entry that lists a third of all rows is dealt over many tasks.

Defined results: a null URL, or one without ``://``, has empty host and path and no rule. Rows are judged each for itself.
Listed entries with null host or path are ignored; repeated ones count once, block before allow. An empty list allows all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules (host, path, verdict), in the contract's order (fixed values).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Hosts that the method lists beside the rules.
LISTED = (
    ("spam-farm.example.org", "", "block"),
    ("spam-farm.example.net", "", "block"),
    ("cheap-pills.example.org", "", "block"),
    ("cheap-pills.example.net", "", "block"),
)
#: Entries for each block of the filter (16 bits each), and the bounds of its size.
ENTRIES, LEAST_BLOCKS, MOST_BLOCKS = 16, 64, 1 << 18
BROADCAST_ROWS, SALTS = 100_000, 32
#: Odd multipliers, one for each 32-bit word of a filter block.
MULTIPLIERS = [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: the host up to /, ?, # or the end, A-Z lower-cased; then the path up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def bits(key: Column) -> tuple[Column, list[Column]]:
    """Block number (before the modulus) and the bit of each of the block's eight words."""
    low = F.pmod(key, F.lit(1 << 31))
    return F.shiftrightunsigned(key, 32), [F.pmod(F.shiftright(low * F.lit(m), 27), F.lit(32)).cast("int") for m in MULTIPLIERS]


def bloom(listed: DataFrame, filter_blocks: int) -> DataFrame:
    """(block, w0 ... w7) for the blocks of the filter that hold an entry."""
    top, at = bits(F.xxhash64("host", "path"))
    words = [F.call_function("shiftleft", F.lit(1).cast("long"), b).alias(f"w{i}") for i, b in enumerate(at)]
    return listed.select(F.pmod(top, F.lit(filter_blocks)).alias("block"), *words).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])


def probe(candidates: DataFrame, filter_: DataFrame, filter_blocks: int) -> DataFrame:
    """Header rows, and the candidates whose eight bits are set. The filter has at most ``filter_blocks`` rows and is broadcast."""
    top, at = bits(F.xxhash64("host", "path"))
    both = candidates.withColumn("block", F.pmod(top, F.lit(filter_blocks))).join(F.broadcast(filter_), "block", "left")
    hit = F.lit(True)
    for i, b in enumerate(at):
        hit = hit & (F.call_function("getbit", F.coalesce(F.col(f"w{i}"), F.lit(0).cast("long")), b) == 1)
    return both.where(F.col("head") | hit).select(*candidates.columns)


def canonical(listed: DataFrame) -> DataFrame:
    """Distinct (host, path) of the list with verdict and priority: hosts lower-cased, the highest priority wins, then block; no nulls."""
    rows = listed.where(F.col("host").isNotNull() & F.col("path").isNotNull())
    best = rows.groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path").agg(F.max(F.struct("priority", "verdict")).alias("best"))
    return best.select("host", "path", "best.*")


def url_filter(pages: DataFrame, listed: DataFrame, url: str = "url", key: str = "page_id", filter_blocks: int | None = None) -> DataFrame:
    """One row for each page: ``key``, host, path, and rule, listed verdict and priority of the entry that fits best (else null).

    ``listed`` has host, path, verdict and priority. The best entry is the one of highest priority, then with most characters of
    host and path, then of host. A page travels as one header row and its candidates; what is shuffled are headers and exact hits.
    """
    listed = canonical(listed)
    n_labels = lambda host: F.char_length(host) - F.char_length(F.replace(host, F.lit("."), F.lit(""))) + 1
    shape = listed.agg(F.count("*").alias("n"), F.collect_set(F.struct(n_labels(F.col("host")).alias("labels"), F.char_length("path").alias("length"))).alias("shapes")).first()
    filter_blocks = filter_blocks or min(MOST_BLOCKS, max(LEAST_BLOCKS, -(-shape["n"] // ENTRIES)))
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("k"), F.monotonically_increasing_id().alias("row"), host.alias("u_host"), path.alias("u_path"))
    shapes = F.array(*[F.struct(F.lit(x["labels"]).alias("labels"), F.lit(x["length"]).alias("length")) for x in sorted(shape["shapes"])]).cast("array<struct<labels:int,length:int>>")
    entry = lambda h, p, head: F.struct(h.alias("host"), p.alias("path"), F.lit(head).alias("head"))
    possible = F.filter(shapes, lambda x: (x["labels"] <= n_labels(F.col("u_host"))) & (x["length"] <= F.char_length("u_path")))
    last_labels = lambda n: F.call_function("substring_index", F.col("u_host"), F.lit("."), -n)
    tried = F.transform(possible, lambda x: entry(last_labels(x["labels"]), F.substring(F.col("u_path"), F.lit(1), x["length"]), False))
    head = F.array(entry(F.concat(F.lit("?"), F.col("row").cast("string")), F.lit(""), True))
    candidates = rows.select("k", "row", "u_host", "u_path", F.explode(F.when(F.col("u_host") == "", head).otherwise(F.concat(head, tried))).alias("c")).select("k", "row", "u_host", "u_path", "c.*")
    passed = probe(candidates, bloom(listed, filter_blocks), filter_blocks)
    if shape["n"] <= BROADCAST_ROWS:
        exact = passed.join(F.broadcast(listed), ["host", "path"], "left")
    else:
        salted = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        exact = passed.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["host", "path", "salt"], "left")
    fit = F.struct("priority", (F.char_length("host") + F.char_length("path")).alias("size"), F.char_length("host").alias("h"), F.concat("host", "path").alias("rule"), "verdict")
    best = exact.where(F.col("head") | F.col("verdict").isNotNull()).groupBy("row").agg(
        F.max(F.when(F.col("head"), F.struct("k", "u_host", "u_path"))).alias("u"), F.max(F.when(F.col("verdict").isNotNull(), fit)).alias("hit")
    )
    return best.select(F.col("u.k").alias(key), F.col("u.u_host").alias("host"), F.col("u.u_path").alias("path"), F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("listed_verdict"), F.col("hit.priority").alias("priority"))


def default_list(spark: SparkSession, rules=RULES, listed=LISTED) -> DataFrame:
    """Rules come before whatever else is listed."""
    return spark.createDataFrame([(*r, 1) for r in rules] + [(*r, 0) for r in listed], "host string, path string, verdict string, priority int")


def op5(pages: DataFrame) -> DataFrame:
    """A rule's verdict, else that of the method's own list, else allow; ``rule`` is null unless a rule fits."""
    judged = url_filter(pages.select("page_id", "url"), default_list(pages.sparkSession))
    return judged.select("page_id", "host", "path", F.when(F.col("priority") == 1, F.col("rule")).alias("rule"), F.coalesce("listed_verdict", F.lit("allow")).alias("verdict"))
