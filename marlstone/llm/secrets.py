"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans come from three patterns. Weak candidates (bare 32-64 character keys, service endpoints) mean little alone: they are
reported only where a complementary part stands within SCOPE characters: for a key an access identifier or an endpoint (but not one
whose own address the key is part of), for an endpoint an access identifier, a key or an assigned secret. Both sides are put into bins of
SCOPE characters and joined on (document, kind, bin); a bin holds only its extreme places, so a part meets at most three rows of a kind.

Places in a text are running sums of the lengths of matches and of what lies between. Sums run in parts of the square root of their
number, since an array can only grow by copying it; the work for n matches is n to the power 1.5.

Defined results: a null text is an empty one (no spans). Rows are scanned each for itself, repeated ones too; ties in start are
ordered by kind. Texts are scanned whole. Other columns of the input don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, cut, let

VALUE = "[A-Za-z0-9+/_.=-]+"
#: Kind and pattern, in order of kind (fixed values); only letters A-Z ignore case in the first.
ASSIGN = rf"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?({VALUE})"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "key", "endpoint")
#: Weak kinds. A bare key has upper and lower case letters and digits, and may end in padding.
KEY = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/]*[0-9])(?=[0-9a-z+/]*[A-Z])(?=[0-9A-Z+/]*[a-z])[A-Za-z0-9+/]{32,64}={0,2}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"https?://[A-Za-z0-9.-]+\.(?:amazonaws\.com|cloudfront\.net|core\.windows\.net|googleapis\.com)[A-Za-z0-9/._-]*"
#: Characters within which complementary parts belong together.
SCOPE = 512
#: Documents with linked spans are broadcast up to this many, which are counted.
BROADCAST_ROWS = 100_000
#: Characters of a piece of text that is being redacted.
PIECE = 1024

SPAN = "struct<start:int,kind:int,stop:int>"


def running(values: Column, step) -> Column:
    """What ``step`` makes of the ``values`` (integers, not null) up to each one."""

    def within(part: Column, first: Column) -> Column:
        """Running results of ``part``, which goes on from ``first`` (null: nothing before)."""
        start = F.struct(first.alias("last"), F.array().cast("array<int>").alias("all"))
        add = lambda acc, x: let(F.when(acc["last"].isNull(), x).otherwise(step(acc["last"], x)), lambda y: F.struct(y.alias("last"), F.concat(acc["all"], F.array(y)).alias("all")))
        return F.aggregate(part, start, add, lambda acc: acc["all"])

    none = F.lit(None).cast("int")

    def of(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda i: F.slice(v, i * size + 1, size))
        totals = lambda p: F.transform(p, lambda x: F.aggregate(F.slice(x, 2, F.greatest(F.lit(1), F.size(x))), F.element_at(x, 1), step))
        return let(parts, lambda p: let(within(totals(p), none), lambda t: F.flatten(F.transform(p, lambda x, i: within(x, F.get(t, i - 1))))))

    return let(values, lambda v: F.when(F.size(v) == 0, v).otherwise(of(v)))


def spans_of(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points: places follow from the lengths of matches and of what lies between."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def placed(parts: Column) -> Column:
        gap = F.slice(parts["gaps"], F.lit(1), F.size(parts["found"]))
        stops = running(F.zip_with(gap, parts["found"], lambda g, m: F.char_length(g) + F.char_length(m)), lambda a, b: a + b)
        spans = F.zip_with(parts["found"], stops, lambda m, stop: F.struct((stop - F.char_length(m)).alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), m.alias("m")))
        if keep is not None:
            spans = F.filter(spans, lambda s: keep(s["m"]))
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")).cast(SPAN))

    none = F.array().cast(f"array<{SPAN}>")
    return let(found, lambda f: F.when(F.size(f) == 0, none).otherwise(let(F.struct(gaps.alias("gaps"), f.alias("found")), placed)))


def digest_text(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with struct column ``found``: assign, access, hex, key, free (keys outside endpoints), endpoint (arrays of spans)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    long_enough = lambda m: F.char_length(F.regexp_extract(m, f"^{ASSIGN}$", 2)) >= 12
    parted = whole.contains("AKIA") | whole.rlike(ENDPOINT)  # else there is nothing that a key could belong to
    weak = lambda spans: F.when(parted, spans).otherwise(F.array().cast(f"array<{SPAN}>"))
    return docs.withColumn(
        "found",
        F.struct(
            spans_of(whole, ASSIGN, 0, long_enough).alias("assign"),
            spans_of(whole, ACCESS, 1).alias("access"),
            spans_of(whole, HEX, 2).alias("hex"),
            weak(spans_of(whole, KEY, 3)).alias("key"),
            weak(spans_of(whole, f"{ENDPOINT}|{KEY}", 3, lambda m: ~m.contains(":"))).alias("free"),
            weak(spans_of(whole, ENDPOINT, 4)).alias("endpoint"),
        ),
    )


def linked(parts: DataFrame) -> DataFrame:
    """(row, linked): the weak spans of each row of ``parts`` (row, found) that have a complementary part within SCOPE characters.

    Interval join by bins: a part enters the bins of its ends, and each bin keeps its least start and greatest end. Whatever
    shares a bin is near enough; in the bins beside it the extreme places decide.
    """
    with_partners = lambda spans, *kinds: F.transform(spans, lambda w: F.struct(w.alias("w"), F.array(*map(F.lit, kinds)).alias("partners")))
    weak = parts.select("row", F.explode(F.concat(with_partners("found.key", 1), with_partners("found.free", 4), with_partners("found.endpoint", 0, 1, 3))).alias("x"))
    weak = weak.select("row", "x.w", F.explode("x.partners").alias("partner"))
    bins = lambda s, e: F.sequence(F.floor(s / SCOPE).cast("int"), F.floor((e - 1) / SCOPE).cast("int"))
    ids = (
        parts.select("row", F.explode(F.concat("found.assign", "found.access", "found.free", "found.endpoint")).alias("a"))
        .select("row", F.col("a.kind").alias("partner"), F.col("a.start").alias("s"), F.col("a.stop").alias("e"), F.explode(bins(F.col("a.start"), F.col("a.stop"))).alias("bin"))
        .groupBy("row", "partner", "bin")
        .agg(F.min("s").alias("first"), F.max("e").alias("last"))
    )
    reach = weak.select("row", "w", "partner", F.explode(F.sequence(F.floor((F.col("w.start") - SCOPE) / SCOPE).cast("int"), F.floor((F.col("w.stop") + SCOPE) / SCOPE).cast("int"))).alias("bin"))
    near = reach.join(ids, ["row", "partner", "bin"]).where((F.col("first") <= F.col("w.stop") + SCOPE) & (F.col("last") >= F.col("w.start") - SCOPE))
    return near.groupBy("row").agg(F.array_sort(F.collect_set("w")).alias("linked"))


def secret_scan(docs: DataFrame, text: str = "text", key: str = "doc_id", out: str = "secrets") -> DataFrame:
    """``docs`` with struct column ``out``: n_assign, n_access, n_hex, base (sorted spans), spans (sorted, linked weak ones too).

    Only documents with weak candidates and another part send spans through the interval join, once for all rows of equal ``key`` and
    text, by a digest of these. Linked spans are a table of their own, which comes back as a broadcast up to BROADCAST_ROWS documents
    and by a join of the documents beyond.
    """
    row = F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("null")), F.coalesce(F.col(text), F.lit(""))))
    found = find(docs.select(F.struct(*columns_of(docs)).alias("doc"), F.col(text).alias("text"), row.alias("row")), "text")
    base = F.array_sort(F.concat("found.assign", "found.access", "found.hex"))
    sizes = {f"n_{k}": F.size(f"found.{k}").cast("long") for k in KINDS[:3]}
    n = {k: (F.size(f"found.{k}") > 0).cast("int") for k in ("assign", "access", "key", "endpoint")}
    some = found.where((n["key"] + n["endpoint"] > 0) & (sum(n.values()) > 1)).groupBy("row").agg(F.any_value("found").alias("found"))
    links = cut(linked(cut(some)))
    links = F.broadcast(links) if links.count() <= BROADCAST_ROWS else links
    none = F.array().cast(f"array<{SPAN}>")
    secrets = F.struct(*[v.alias(k) for k, v in sizes.items()], base.alias("base"), F.array_sort(F.concat(base, F.coalesce("linked", none))).alias("spans"))
    return found.join(links, "row", "left").select("doc.*", secrets.alias(out))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with ``mark`` in place of each span (sorted by start); overlapping spans become one.

    What stays is put together from pieces of PIECE characters, since a place in a text is only found by counting from its start.
    """

    def between(pieces: Column, start: Column, stop: Column) -> Column:
        some = F.transform(F.sequence(F.floor(start / PIECE).cast("int"), F.floor((stop - 1) / PIECE).cast("int")), lambda i: F.substring(F.get(pieces, i), F.greatest(start - i * PIECE, F.lit(0)) + 1, stop - F.greatest(start, i * PIECE)))
        return F.when(start < stop, F.array_join(some, "")).otherwise(F.lit(""))

    def whole(pieces: Column, stops: Column) -> Column:
        before = lambda i: F.coalesce(F.get(stops, i - 1), F.lit(0))
        parts = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(between(pieces, before(i), s["start"]), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(parts, ""), between(pieces, F.element_at(stops, -1), F.char_length(text)))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    stops = running(F.transform(spans, lambda s: s["stop"]), lambda a, b: F.greatest(a, b))
    return F.when(F.size(spans) > 0, let(F.struct(pieces.alias("p"), stops.alias("s")), lambda x: whole(x["p"], x["s"]))).otherwise(text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the secrets of ``text`` replaced and n_chars, if there, counted anew. Every row stays."""
    out = secret_scan(docs, text, out="__secrets").withColumn(text, redacted(F.col(text), F.col("__secrets.spans"))).drop("__secrets")
    return out.withColumn("n_chars", F.char_length(text).cast("long")) if "n_chars" in docs.columns else out


def op6(docs: DataFrame) -> DataFrame:
    """The digest of the contract: counts, the SHA-256 of the base spans, and all spans."""
    s = F.col("secrets")
    return secret_scan(docs.select("doc_id", "text")).select(
        "doc_id", s["n_assign"].alias("n_assign"), s["n_access"].alias("n_access"), s["n_hex"].alias("n_hex"),
        F.sha2(digest_text(s["base"]), 256).alias("base_sha256"), digest_text(s["spans"]).alias("spans"),
    )
