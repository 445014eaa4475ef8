"""Writers. Notes are rows of a table; a folder tree is an export of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_new(df: DataFrame, existing: DataFrame, path: str, keys: list[str]) -> None:
    """Adds rows whose key isn't there: repeating a run adds nothing."""
    df.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti").write.mode("append").parquet(path)


def upserted(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The current table with changed rows in place of those of the same key."""
    return current.join(changes.select(*keys), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def export_notes(df: DataFrame, path: str, folder: str = "destination", name: str = "name", content: str = "content") -> None:
    """One folder `destination=.../name=...` with a text file for each row."""
    df.select(F.col(folder), F.col(name), F.col(content)).write.mode("overwrite").partitionBy(folder, name).option("lineSep", "\n").text(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """A folder of JSON objects, one a line, null fields left out; tasks write their own parts. sources.notes.read_manifest_parts() reads it."""
    df.write.mode("overwrite").json(path)


def archive_texts(df: DataFrame, path: str | None, name: str = "archive", content: str = "content") -> None:
    """Texts by archive name, one folder each; what is there under a name is replaced, and other names stay. Without a path nothing is done."""
    if path:
        df.select(name, content).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).option("lineSep", "\n").text(path)


def append_letters(df: DataFrame, path: str, letter: str = "letter") -> None:
    df.select(F.col(letter).alias("value")).write.mode("append").text(path)
