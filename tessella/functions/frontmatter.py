"""Frontmatter as a map, and back.

Maps keep the last value of a repeated key by taking the last entry of each key before the map is made, whatever the
session's policy for repeated keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import strip

BLOCK = r"(?s)\A---(?U:\s)*\n(.*?)\n---(?U:\s)*\n"


def has_block(text: Column) -> Column:
    return F.coalesce(text.rlike(BLOCK), F.lit(False))


def _entries(text: Column) -> Column:
    """Array of structs k, v in order of lines."""
    lines = F.filter(F.split(F.regexp_extract(text, BLOCK, 1), "\n"), lambda x: F.contains(x, F.lit(":")))

    def entry(line: Column) -> Column:
        at = F.instr(line, ":")
        value = strip(F.substr(line, at + 1))
        quoted = (F.length(value) >= 2) & value.startswith('"') & value.endswith('"')
        return F.struct(strip(F.substr(line, F.lit(1), at - 1)).alias("k"), F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value).alias("v"))

    return F.transform(lines, entry)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once, however often it is used and in whichever lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def last_map(entries: Column) -> Column:
    """A map of each key's last value; entries must be bound by let()."""
    return F.map_from_entries(F.filter(entries, lambda e, k: ~F.exists(F.slice(entries, k + F.lit(2), F.size(entries)), lambda later: later["k"] == e["k"])))


def parsed(text: Column) -> Column:
    """Map of keys to values as written; empty without a block."""
    return F.when(has_block(text), let(_entries(text), last_map)).otherwise(F.create_map().cast("map<string,string>"))


def body(text: Column) -> Column:
    """What follows the block; the whole text without one."""
    return F.regexp_replace(text, BLOCK, "")


def value(fm: Column, key: str, default: str = "") -> Column:
    """A key's value, or the default if the key is missing."""
    return F.coalesce(F.element_at(fm, F.lit(key)), F.lit(default))


def integer(fm: Column, key: str) -> Column:
    """A key's value as int; 0 if it is missing or not one."""
    return F.coalesce(strip(F.element_at(fm, F.lit(key))).try_cast("int"), F.lit(0))


def has(fm: Column, key: str) -> Column:
    return F.map_contains_key(fm, F.lit(key))


def quoted(val: Column) -> Column:
    """A value as written: in quotes if it has any of : " ' # or a line end."""
    text = F.coalesce(val.cast("string"), F.lit(""))
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(text.rlike("[:\"'#\n]"), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(text)


def field(key: str, val: Column) -> Column:
    """One line of a block."""
    return F.concat(F.lit(f"{key}: "), quoted(val))


def serialized(lines: Column, rest: Column) -> Column:
    """A block of lines (array of field() texts) and the body without leading line ends."""
    return F.concat(F.array_join(F.concat(F.array(F.lit("---")), lines, F.array(F.lit("---"), F.lit(""))), "\n"), F.regexp_replace(rest, r"\A\n+", ""))


def serialized_pairs(pairs: Column, rest: Column) -> Column:
    """As serialized(), from an array of structs k, v, whose order is kept."""
    return serialized(F.transform(pairs, lambda e: F.concat(e["k"], F.lit(": "), quoted(e["v"]))), rest)


def pairs(text: Column) -> Column:
    """Ordered array of structs k, v; a repeated key keeps its first place and its last value."""

    def ordered(entries: Column) -> Column:
        first = F.filter(entries, lambda e, k: ~F.exists(F.slice(entries, F.lit(1), k), lambda before: before["k"] == e["k"]))
        return let(last_map(entries), lambda last: F.transform(first, lambda e: F.struct(e["k"].alias("k"), F.element_at(last, e["k"]).alias("v"))))

    return F.when(has_block(text), let(_entries(text), ordered)).otherwise(F.array().cast("array<struct<k:string,v:string>>"))


def updated(old: Column, **new: Column) -> Column:
    """Ordered pairs with keys set: a known key keeps its place, a new one goes to the end."""
    names = list(new)

    def merged(both: Column) -> Column:
        kept = F.transform(both["old"], lambda e: F.struct(e["k"].alias("k"), F.when(e["k"].isin(names), F.element_at(both["new"], e["k"])).otherwise(e["v"]).alias("v")))
        added = F.filter(F.transform(F.array(*map(F.lit, names)), lambda k: F.struct(k.alias("k"), F.element_at(both["new"], k).alias("v"))), lambda x: ~F.exists(both["old"], lambda e: e["k"] == x["k"]))
        return F.concat(kept, added)

    values = F.create_map(*[x for k in names for x in (F.lit(k), new[k].cast("string"))])
    return let(F.struct(old.alias("old"), values.alias("new")), merged)


def list_value(col: Column) -> Column:
    """`[a, b]` as an array; a bare value as an array of one; nothing as an empty array."""
    inner = F.regexp_replace(strip(F.coalesce(col, F.lit(""))), r"\A\[|\]\z", "")
    parts = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(strip(x), r"\A[\"']|[\"']\z", ""))
    return F.filter(parts, lambda x: x != "")
