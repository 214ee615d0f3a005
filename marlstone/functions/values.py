"""Strict timestamps, sizes, maps, JSON and literal patterns (F5, F6, F17, F23, F26-F28), as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A full date and time with a zone and at most six digits of a second (fixed format).
STAMP = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(\.\d{1,6})?(Z| UTC|[+-](?:[01]\d|2[0-3]):[0-5]\d)$"


def strict_timestamp(text: Column) -> Column:
    """the instant of a full ISO timestamp; null for anything else: no zone, seven digits of a second, a day or an hour that isn't there."""
    part = lambda i: F.regexp_extract(text, STAMP, i)
    micros = F.rpad(F.concat(F.when(part(3) == "", ".").otherwise(part(3))), 7, "0")
    zone = F.when(part(4).isin("Z", " UTC"), "+00:00").otherwise(part(4))
    whole = F.concat(part(1), F.lit("T"), part(2), micros, zone)
    # offsets beyond 18 hours are no time zones to the engine: they are taken off by hand
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    minutes = sign * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int"))
    utc = F.try_to_timestamp(F.concat(F.substring(whole, 1, 26), F.lit("+00:00")), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    return F.when(text.rlike(STAMP), utc - F.make_dt_interval(F.lit(0), F.lit(0), minutes))


def length(array: Column) -> Column:
    """elements of an array; null, not 0 or -1, for a null array, whatever the session's settings."""
    return F.when(array.isNotNull(), F.size(array))


def pairs_map(pairs: Column, key: str, value: str) -> Column:
    """an array of structs as a map, in order of key and value; equal pairs count once. A key with two values is an error of the engine."""
    once = F.array_sort(F.array_distinct(F.transform(pairs, lambda x: F.struct(x[key].alias("key"), x[value].alias("value")))))
    return F.map_from_entries(once)


def faulty_pairs(pairs: Column, key: str, value: str) -> Column:
    """Whether a list of declarations can't be a map: null, an element, name or value missing, a blank name or one with a NUL, or a name with two values."""
    bad = lambda x: x.isNull() | x[key].isNull() | x[value].isNull() | (F.trim(x[key]) == "") | (F.instr(x[key], "\0") > 0)
    names = F.array_distinct(F.transform(pairs, lambda x: x[key]))
    return pairs.isNull() | F.exists(pairs, lambda x: F.coalesce(bad(x), F.lit(True))) | (F.size(names) != F.size(F.array_distinct(pairs)))


def declaration_json(**lists: Column) -> Column:
    """compact JSON of several lists of (Name, Requirement), each sorted by name; null if one of them is faulty."""
    wrong = None
    for c in lists.values():
        fault = faulty_pairs(c, "Name", "Requirement")
        wrong = fault if wrong is None else wrong | fault
    return F.when(~wrong, F.to_json(F.struct(*[pairs_map(c, "Name", "Requirement").alias(k) for k, c in lists.items()])))


def json_elements(text: Column) -> Column:
    """the elements of a JSON array as texts, strings without their quotes; null if it isn't an array."""
    return F.when(json_kind(text) == "array", F.transform(F.from_json(text, "array<string>"), lambda x: x))


def json_kind(text: Column) -> Column:
    """object, array, string, number, boolean or null by a valid text's first character; null if the text is no JSON."""
    first = F.substring(F.ltrim(text), 1, 1)
    valid = F.try_parse_json(text).isNotNull()
    kind = F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").otherwise("number")
    return F.when(valid, kind)


def literal(text: str) -> str:
    """a pattern that matches ``text`` itself."""
    return "".join(c if c.isalnum() or c == "_" or ord(c) > 127 else f"\\x{ord(c):02x}" for c in text)


def found(text: Column, pattern: str) -> Column:
    """whether a pattern occurs anywhere; null for null."""
    return text.rlike(pattern)
