"""Which items a stage works on: predicates on rows, whose status holds the state.

A predicate is pushed below the projection that parses a note, so each binds the parsed map once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import frontmatter as fmt
from tessella.functions.text import basename


def is_item(path: Column, *, playbook: bool = True, meta: bool = True) -> Column:
    """Not a readme, an index or an import log; nor, where asked, a playbook or in a meta folder."""
    name = F.lower(basename(path))
    kept = ~name.isin("readme.md", "index.md") & ~F.contains(name, F.lit("import log"))
    if not playbook:
        kept &= ~F.contains(name, F.lit("playbook"))
    if not meta:
        kept &= ~F.arrays_overlap(F.split(path, "/"), F.array(F.lit("_meta"), F.lit("_attachments")))
    return kept


def needs_classification(fm: Column, include_unfronted: bool) -> Column:
    """By presence of keys: no frontmatter, done, marked, or without a value."""

    def rule(m: Column) -> Column:
        status = fmt.value(m, "status")
        return (
            F.when(F.size(m) == 0, F.lit(include_unfronted))
            .when(status.isin("classified", "skip", "keep"), F.lit(False))
            .when(status == "unclassified", F.lit(True))
            .otherwise(F.lit(include_unfronted) & ~fmt.has(m, "value"))
        )

    return fmt.let(fm, rule)


def routable(fm: Column, reroute: bool = False) -> Column:

    def rule(m: Column) -> Column:
        placed = F.lit(False) if reroute else fmt.value(m, "destination") != ""
        return (F.size(m) > 0) & (fmt.value(m, "status") == "classified") & ~placed & (fmt.integer(m, "value") >= 1)

    return fmt.let(fm, rule)


def executable(fm: Column, destination: str | None = None) -> Column:

    def rule(m: Column) -> Column:
        place = fmt.value(m, "destination")
        return (F.size(m) > 0) & (fmt.value(m, "status") == "classified") & (place != "" if destination is None else place == destination)

    return fmt.let(fm, rule)


def in_reading_list(folders: Column) -> Column:
    return F.exists(folders, lambda p: F.coalesce(F.contains(p, F.lit("com.apple.ReadingList")) | (p == "Reading List"), F.lit(False)))


def open_tab(url: Column, deleted: Column, closed: Column) -> Column:
    """Any case of http, as SQLite's LIKE has it."""
    return url.ilike("http%") & (deleted == 0) & closed.isNull()


def web_address(url: Column) -> Column:
    return F.coalesce(url.startswith("http"), F.lit(False))


def is_extracted(text: Column) -> Column:
    """Any line that starts with the status."""
    return text.rlike(r"(?m)^status: extracted")


def dated_folder(folder: Column) -> Column:
    return folder.startswith("20")


def long_media(seconds: Column, most: int = 3600) -> Column:
    return seconds > most


def first(df: DataFrame, most: int, order: Column) -> DataFrame:
    """The first rows in an order; 0: all. Each task keeps its own first rows."""
    return df.orderBy(order).limit(most) if most else df


def wanted_kinds(kind: Column, only: list[str] | None = None, skip: list[str] | None = None) -> Column:
    """Per-source selection."""
    kept = kind.isin(only) if only else F.lit(True)
    return kept & ~kind.isin(skip) if skip else kept
