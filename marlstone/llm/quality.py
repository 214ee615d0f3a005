"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Words are maximal runs of characters other than ASCII white space. Every measure is a Column over the
whole text; :func:`verdict` turns a table of (measure, kind, low, high) rows into one boolean Column.

Defined results: a null text has no words and every measure is 0, so the base rule (fewer than ten words)
rejects it; an empty text likewise. Repeated rows are judged each for itself; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5

#: Frequent function words of nine languages (fixed values).
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was with "
    "au aux ce dans de des du elle en est et la le les par pas pour que qui sur un une "
    "als auf auch das dem den der des die ein eine für ist im in mit nicht sich sie und von zu "
    "al como con del el en es la las los más no para por que se su un una y "
    "che di e gli i il non per si sono "
    "com da do dos em na não o os um uma "
    "dat een het niet op te van voor zijn "
    "i jest na nie się w z że "
    "в и на не он она они по с то что это я как к у из за от"
).split()
#: Letters of their scripts, and the least share of stop words that a text in these scripts has. A text of mostly other letters needs none.
SCRIPTS = "[A-Za-zÀ-ÖØ-öø-ɏЀ-ӿ]"
LEAST_STOP = 0.02
#: Beginnings of list items and ends of broken-off lines.
BULLET, ELLIPSIS = r"^[\x20\x09-\x0D]*[-*•‣◦·]", r"(\.\.\.|…)[\x20\x09-\x0D]*$"

#: (measure, lowest, highest) that a kept text has; measures are ratios unless they begin with n_ (counts of :func:`measures`) or mean_.
THRESHOLDS = (
    ("mean_word_chars", 2.0, 14.0),
    ("symbol_ratio", None, 0.10),
    ("stop_ratio", LEAST_STOP, None),
    ("dup_line_ratio", None, 0.50),
    ("bullet_line_ratio", None, 0.90),
    ("ellipsis_line_ratio", None, 0.30),
    ("repeat_word_ratio", None, 0.20),
    ("upper_ratio", None, 0.60),
    ("distinct_word_ratio", 0.10, None),
)


def words_of(text: Column) -> Column:
    """Array of the words; empty for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def repeated_words(words: Column, k: int = WINDOW) -> Column:
    """Words covered by the k-word windows that occur twice or more (first occurrence included).

    Windows are compared by a 64-bit hash. A text without equal windows, the usual case, costs one hash set; else windows are
    sorted by (hash, place), so equal ones are neighbours, and the covered words are counted in order of place. n log n.
    """
    n = F.size(words)

    def covered(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s: F.filter(
            F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"])),
            lambda i: i.isNotNull(),
        )
        count = lambda d: F.aggregate(
            F.zip_with(d, F.slice(d, 2, F.greatest(F.size(d), F.lit(1))), lambda a, b: F.least(F.lit(k), F.coalesce(b - a, F.lit(k)))), F.lit(0), lambda s, x: s + x
        )
        return let(pairs, lambda s: let(F.array_sort(same(s)), count))

    hashes = F.when(n < k, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k))))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the raw counts n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_bullet_lines, n_ellipsis_lines,
    n_repeat_words, n_stop, n_upper, n_distinct, n_letters (letters of SCRIPTS, counted only where stop words are too few, else null).

    They come in one struct column ``quality``, so that no column of ``docs`` is overwritten.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    cut_out = lambda pattern: F.char_length(whole) - F.char_length(F.regexp_replace(whole, pattern, ""))
    n_of = lambda items, test: F.size(F.filter(items, test)).cast("long")

    def of(words: Column) -> Column:
        lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        of_lines = lambda x: F.struct(
            F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), n_of(x, lambda y: y.rlike(BULLET)).alias("bullet"), n_of(x, lambda y: y.rlike(ELLIPSIS)).alias("ellipsis")
        )
        stop = n_of(words, lambda w: F.lower(w).isin(STOP_WORDS))
        stops = lambda n: F.struct(n.alias("n"), F.when(n < LEAST_STOP * F.size(words), cut_out(SCRIPTS).cast("long")).alias("letters"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            cut_out(SYMBOLS).cast("long").alias("n_symbols"),
            let(lines, of_lines).alias("lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            let(stop, stops).alias("stops"),
            n_of(words, lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.char_length(w) > 1)).alias("n_upper"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
        )

    out = docs.withColumn("quality", let(words_of(F.col(text)), of))
    q = F.col("quality")
    flat = [q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_upper", "n_distinct")]
    flat += [q["lines"]["n"].alias("n_lines")] + [q["lines"][c].alias(f"n_{c}_lines") for c in ("dup", "bullet", "ellipsis")]
    return out.withColumn("quality", F.struct(*flat, q["stops"]["n"].alias("n_stop"), q["stops"]["letters"].alias("n_letters")))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def verdict(q: Column, thresholds=THRESHOLDS) -> Column:
    """One conjunction from the threshold table; a measure that isn't there is an error."""
    n = q["n_words"]
    values = {
        "mean_word_chars": ratio(q["word_chars"], n),
        "symbol_ratio": ratio(q["n_symbols"], q["word_chars"]),
        "stop_ratio": F.when(2 * q["n_letters"] < q["word_chars"], F.lit(1.0)).otherwise(ratio(q["n_stop"], n)),
        "dup_line_ratio": ratio(q["n_dup_lines"], q["n_lines"]),
        "bullet_line_ratio": ratio(q["n_bullet_lines"], q["n_lines"]),
        "ellipsis_line_ratio": ratio(q["n_ellipsis_lines"], q["n_lines"]),
        "repeat_word_ratio": ratio(q["n_repeat_words"], n),
        "upper_ratio": ratio(q["n_upper"], n),
        "distinct_word_ratio": F.when(n >= 100, ratio(q["n_distinct"], n)).otherwise(F.lit(1.0)),
    }
    kept = F.lit(True)
    for name, low, high in thresholds:
        value = q[name] if name.startswith("n_") else values[name]
        if low is not None:
            kept = kept & (value >= low)
        if high is not None:
            kept = kept & (value <= high)
    return kept


def quality_rules(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """``docs`` with ``quality`` (counts), ``base_failed`` and ``kept``. One projection: no shuffle, no Python."""
    q = F.col("quality")
    failed = (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])
    return measures(docs, text).withColumns({"base_failed": failed, "kept": ~failed & verdict(q, thresholds)})


def op4(docs: DataFrame) -> DataFrame:
    q = F.col("quality")
    return quality_rules(docs.select("doc_id", "text")).select(
        "doc_id", q["n_words"].alias("n_words"), q["word_chars"].alias("word_chars"), q["n_symbols"].alias("n_symbols"),
        q["n_dup_lines"].alias("n_dup_lines"), q["n_repeat_words"].alias("n_repeat_words"), "base_failed", "kept",
    )
