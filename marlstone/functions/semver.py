"""Version and range expressions as Columns (D51-D54), by npm's published strict grammar.

A range is an array of structs {lo, lo_open, hi, hi_open, pre}: bounds are version keys (arrays of integers), null for none. Any
interval of the array may hold a version; ``||`` makes several, and hyphen, caret, tilde, wildcard and comparator forms one each.
A version has at most MOST_CHARS characters and no part above LARGEST; a range with a greater part is none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST, MOST_CHARS = 2**53 - 1, 256
PART = "(0|[1-9][0-9]*)"
#: Identifiers of prereleases (numeric ones without leading zeros) and of builds.
PRE_ID, BUILD_ID = "(?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)", "[0-9A-Za-z-]+"
PRE, BUILD = rf"({PRE_ID}(?:\.{PRE_ID})*)", rf"{BUILD_ID}(?:\.{BUILD_ID})*"
FULL = rf"^\s*v?{PART}\.{PART}\.{PART}(?:-{PRE})?(?:\+({BUILD}))?\s*$"
NUM = "bigint"
KEY = "array<bigint>"
XR = r"(0|[1-9][0-9]*|[xX*])"
PARTIAL = rf"[v=]*{XR}(?:\.{XR}(?:\.{XR}(?:-{PRE})?(?:\+{BUILD})?)?)?"
#: Requirement statuses (fixed values).
STATUSES = (
    "RESOLVED", "NO_SATISFYING_VERSION", "NO_ELIGIBLE_TARGET", "INVALID_SPEC", "INVALID_PACKAGE_NAME",
    "UNSUPPORTED_ALIAS", "UNSUPPORTED_TAG", "UNSUPPORTED_GIT", "UNSUPPORTED_FILE", "UNSUPPORTED_URL",
)


def too_large(text: Column) -> Column:
    """Whether a number above LARGEST stands before any prerelease or build. Only numbers of as many digits are looked at."""
    digits = len(str(LARGEST))
    long = F.regexp_extract_all(F.regexp_extract(text, "^[^+-]*", 0), F.lit(rf"[0-9]{{{digits},}}"), F.lit(0))
    return F.exists(long, lambda x: (F.char_length(x) > digits) | (x > F.lit(str(LARGEST))))


def valid(version: Column) -> Column:
    return F.coalesce(version.rlike(FULL) & (F.char_length(F.trim(version)) <= MOST_CHARS) & ~too_large(version), F.lit(False))


def key(version: Column) -> Column:
    """[major, minor, patch] of a full version, else null; arrays compare element by element."""
    parts = [F.regexp_extract(version, FULL, i).try_cast(NUM) for i in (1, 2, 3)]
    return F.when(valid(version), F.array(*parts))


def prerelease(version: Column) -> Column:
    """The prerelease tag, null without one."""
    return F.when(valid(version), F.nullif(F.regexp_extract(version, FULL, 4), F.lit("")))


def classify(version: Column) -> Column:
    """ELIGIBLE, PRERELEASE_TARGET or INVALID_TARGET_SEMVER."""
    return F.when(~valid(version), "INVALID_TARGET_SEMVER").when(prerelease(version).isNotNull(), "PRERELEASE_TARGET").otherwise("ELIGIBLE")


def line(version: Column) -> Column:
    """Release line: the major, or 0.minor below 1."""
    head = r"^(\d+)\.(\d+)"
    major, minor = F.regexp_extract(version, head, 1), F.regexp_extract(version, head, 2)
    return F.when(major.try_cast("int") > 0, major).otherwise(F.concat(F.lit("0."), minor))


def order_parts(version: Column) -> list[Column]:
    """Leading numbers, one pattern each, so that 1.3 sorts after 1.2.3; then the text."""
    number = lambda p: F.coalesce(F.regexp_extract(version, p, 1).try_cast("int"), F.lit(0))
    return [number(r"^(\d+)"), number(r"^\d+\.(\d+)"), number(r"^\d+\.\d+\.(\d+)"), version]


def _interval(lo, lo_open, hi, hi_open, pre=None) -> Column:
    none = F.lit(None).cast(KEY)
    return F.struct(
        (none if lo is None else lo.cast(KEY)).alias("lo"), F.lit(lo_open).alias("lo_open"), (none if hi is None else hi.cast(KEY)).alias("hi"), F.lit(hi_open).alias("hi_open"),
        (F.lit(None).cast("string") if pre is None else pre).alias("pre"),
    )


INTERVAL = "struct<lo:array<bigint>,lo_open:boolean,hi:array<bigint>,hi_open:boolean,pre:string>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value bound to a variable, so that the expression stays small."""
    return F.element_at(F.transform(F.array(value), body), 1)


OP = r"^\s*(\^|~>?|>=|<=|>|<|=)?"


def comparator(text: Column) -> Column:
    """The interval of one comparator (^1.2, ~1, >=1.2.3, 1.x, ...); null if it is none."""
    pattern = rf"{OP}\s*{PARTIAL}\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    parsed = F.struct(part(1).alias("op"), *[part(i).try_cast(NUM).alias(n) for i, n in ((2, "a"), (3, "b"), (4, "c"))], F.nullif(part(5), F.lit("")).alias("pre"))
    return F.when(text.rlike(pattern) & ~too_large(text), _let(parsed, _interval_of))


def _interval_of(p: Column) -> Column:
    op, a, pre = p["op"], p["a"], p["pre"]
    zero, one = F.lit(0).cast(NUM), F.lit(1).cast(NUM)
    # a part is wild if it, or one before it, is missing or x
    w1, w2 = a.isNull(), a.isNull() | p["b"].isNull()
    w3 = w2 | p["c"].isNull()
    bounds = F.struct(
        F.array(a, F.when(w2, zero).otherwise(p["b"]), F.when(w3, zero).otherwise(p["c"])).alias("low"),
        F.array(a + one, zero, zero).alias("major"), F.array(a, p["b"] + one, zero).alias("minor"), F.array(a, p["b"], p["c"] + one).alias("patch"),
    )

    def chosen(v: Column) -> Column:
        low = v["low"]
        after = F.when(w2, v["major"]).when(w3, v["minor"]).otherwise(v["patch"])
        caret = F.when(w2 | (a > 0), v["major"]).when(w3 | (p["b"] > 0), v["minor"]).otherwise(v["patch"])
        tilde = F.when(w2, v["major"]).otherwise(v["minor"])
        none = F.array(zero, zero, zero)
        return (
            F.when(w1 & op.isin("<", ">"), _interval(none, False, none, True)).when(w1, _interval(None, False, None, True))
            .when(op == "^", _interval(low, False, caret, True, pre))
            .when(op.startswith("~"), _interval(low, False, tilde, True, pre))
            .when(op == ">=", _interval(low, False, None, True, pre))
            .when(op == "<", _interval(None, False, low, True, pre))
            .when((op == ">") & ~w3, _interval(low, True, None, True, pre))
            .when(op == ">", _interval(after, False, None, True))
            .when((op == "<=") & ~w3, _interval(None, False, low, False, pre))
            .when(op == "<=", _interval(None, False, after, True))
            .when(w3, _interval(low, False, after, True))
            .otherwise(_interval(low, False, low, False, pre))
        )

    return _let(bounds, chosen)


def _meet(x: Column, y: Column) -> Column:
    """The intersection of two intervals."""
    higher = y["lo"].isNotNull() & (x["lo"].isNull() | (y["lo"] > x["lo"]) | ((y["lo"] == x["lo"]) & y["lo_open"]))
    lower = y["hi"].isNotNull() & (x["hi"].isNull() | (y["hi"] < x["hi"]) | ((y["hi"] == x["hi"]) & y["hi_open"]))
    pick = lambda cond, f: F.when(cond, y[f]).otherwise(x[f])
    return F.struct(pick(higher, "lo").alias("lo"), pick(higher, "lo_open").alias("lo_open"), pick(lower, "hi").alias("hi"), pick(lower, "hi_open").alias("hi_open"), F.coalesce(y["pre"], x["pre"]).alias("pre"))


def parse_range(requirement: Column) -> Column:
    """Array of intervals of an npm range; null if it is not a range. '' and * are anything."""
    text = F.regexp_replace(F.trim(requirement), r"([<>=^~])\s+", "$1")
    hyphen = rf"^\s*({PARTIAL})\s+-\s+({PARTIAL})\s*$"
    anything = _interval(None, False, None, True).cast(INTERVAL)

    def one(alternative: Column) -> Column:
        ends = r"^\s*(\S+)\s+-\s+(\S+)\s*$"
        spanned = F.array(F.concat(F.lit(">="), F.regexp_extract(alternative, ends, 1)), F.concat(F.lit("<="), F.regexp_extract(alternative, ends, 2)))
        texts = F.when(alternative.rlike(hyphen), spanned).otherwise(F.split(F.trim(alternative), r"\s+"))
        parts = F.transform(texts, lambda c: comparator(c).cast(INTERVAL))
        met = lambda ps: F.when(F.forall(ps, lambda c: c.isNotNull()), F.aggregate(ps, anything, lambda acc, c: _meet(acc, c).cast(INTERVAL)))
        return F.when(F.trim(alternative) == "", anything).otherwise(_let(parts, met))

    found = F.transform(F.split(text, r"\|\|", -1), one)
    return F.when(requirement.isNotNull(), _let(found, lambda f: F.when(F.forall(f, lambda x: x.isNotNull()), f)))


def satisfies(version_key: Column, ranges: Column) -> Column:
    """Whether a release (no prerelease) with this key lies in any interval."""

    def inside(r: Column) -> Column:
        above = r["lo"].isNull() | (version_key > r["lo"]) | ((version_key == r["lo"]) & ~r["lo_open"] & r["pre"].isNull()) | ((version_key == r["lo"]) & r["pre"].isNotNull() & (r["hi"].isNull() | (r["hi"] > r["lo"])))
        below = r["hi"].isNull() | (version_key < r["hi"]) | ((version_key == r["hi"]) & ~r["hi_open"] & (r["pre"].isNull()))
        return above & below

    return F.exists(ranges, inside)


def spec_status(name: Column, requirement: Column) -> Column:
    """D53 before resolution: null if the requirement is a range, else its status."""
    r = F.trim(requirement)
    scoped = r"^(?:@[a-z0-9~_][a-z0-9._~-]*/)?[a-z0-9~_-][a-z0-9._~-]*$"
    return (
        F.when(name.isNull() | ~F.lower(name).rlike(scoped), "INVALID_PACKAGE_NAME")
        .when(requirement.isNull() | (F.instr(requirement, "\0") > 0), "INVALID_SPEC")
        .when(r.rlike(r"^npm:"), "UNSUPPORTED_ALIAS")
        .when(r.rlike(r"^(?:git(?:\+[a-z]+)?:|git@|(?:github|gitlab|bitbucket|gist):|[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+(?:#.*)?$)|^(?:git\+)?(?:https?|ssh)://[^ ]*\.git(?:#.*)?$"), "UNSUPPORTED_GIT")
        .when(r.rlike(r"^(?:file:|\.{1,2}/|/|~/|[A-Za-z]:[\\/])|\.(?:tgz|tar|tar\.gz)$") & ~r.rlike("^https?://"), "UNSUPPORTED_FILE")
        .when(r.rlike(r"^https?://"), "UNSUPPORTED_URL")
        .when(parse_range(requirement).isNotNull(), F.lit(None).cast("string"))
        .when(r.rlike(r"^[A-Za-z][A-Za-z0-9._-]*$"), "UNSUPPORTED_TAG")
        .otherwise("INVALID_SPEC")
    )
