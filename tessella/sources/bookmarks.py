"""Bookmark trees and tab databases."""

from __future__ import annotations

import os
import plistlib
import shutil
import sqlite3
import tempfile
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from tessella.session import cut

LEAVES = "path string, position long, url string, uri_title string, uuid string, preview string, reading_added timestamp, added timestamp, folders array<string>"


def _leaves(root: dict) -> Iterator[tuple]:
    """Depth first, without recursion, so that depth is bounded by memory only; folders without a title add no part."""
    stack: list[tuple[object, tuple[str, ...]]] = [(root, ())]
    while stack:
        node, folders = stack.pop()
        if not isinstance(node, dict):
            continue
        if node.get("WebBookmarkType") == "WebBookmarkTypeLeaf":
            reading = node.get("ReadingList") or {}
            dates = [d if isinstance(d, datetime) else None for d in (reading.get("DateAdded"), node.get("DateAdded"))]
            yield node.get("URLString", ""), (node.get("URIDictionary") or {}).get("title"), node.get("WebBookmarkUUID", ""), reading.get("PreviewText", ""), *dates, list(folders)
            continue
        below = (*folders, node["Title"]) if node.get("Title") else folders
        stack += [(child, below) for child in reversed(node.get("Children", []))]


def read_plist(spark: SparkSession, path: str) -> DataFrame:
    """Bookmarks of property lists, a row each, with the folders that hold them. A file is read by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"]):
                rows = [(where, k, *leaf) for k, leaf in enumerate(_leaves(plistlib.loads(content)))]
                yield pd.DataFrame(rows, columns=["path", "position", "url", "uri_title", "uuid", "preview", "reading_added", "added", "folders"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, LEAVES)


def flatten(nodes: DataFrame) -> DataFrame:
    """The same from a parent-child table (id, parent_id, type, title, ...): leaves with the titles above them. Folders whose parents
    lead to no root, or to themselves, are left out with all that they hold.

    Each round joins every open folder with what is known of its uppermost known parent, so the reach doubles: rounds grow with the logarithm of
    the depth. Only the number of open folders comes to the driver; it falls until what is left leads nowhere.
    """
    own = F.when(F.coalesce(F.col("title"), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array("title"))
    leaf = F.coalesce(F.col("type") == "WebBookmarkTypeLeaf", F.lit(False))
    now = cut(nodes.filter(~leaf).select("id", F.col("parent_id").alias("above"), own.alias("folders")))
    left = None
    while (still := now.filter("above is not null").count()) and still != left:
        left = still
        known = now.select(F.col("id").alias("_id"), F.col("above").alias("_above"), F.col("folders").alias("_folders"))
        joined = now.filter("above is not null").join(known, F.col("above") == F.col("_id"))
        now = cut(now.filter("above is null").unionByName(joined.select("id", F.col("_above").alias("above"), F.concat("_folders", "folders").alias("folders"))))
    paths = now.filter("above is null").select(F.col("id").alias("_id"), "folders")
    held = nodes.filter(leaf & F.col("parent_id").isNotNull()).join(paths, F.col("parent_id") == F.col("_id")).drop("_id")
    return held.unionByName(nodes.filter(leaf & F.col("parent_id").isNull()).withColumn("folders", F.array().cast("array<string>")))


class SqliteSource(DataSource):
    """`spark.read.format("sqlite_snapshot").option("path", ...).option("query", ...).schema(...)`: rows of one query on a
    copy of a live database, its log included, opened read-only."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_snapshot"

    def schema(self) -> str:
        raise ValueError("a schema must be given")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(self.options["path"], self.options["query"], len(schema.fields))


class _SqliteReader(DataSourceReader):
    def __init__(self, path: str, query: str, width: int):
        self.path, self.query, self.width = path, query, width

    def read(self, partition) -> Iterator[tuple]:
        with tempfile.TemporaryDirectory() as folder:
            for suffix in ("", "-wal", "-shm"):
                if os.path.exists(self.path + suffix):
                    shutil.copy2(self.path + suffix, f"{folder}/db{suffix}")
            connection = sqlite3.connect(f"file:{folder}/db?mode=ro", uri=True)
            try:
                for row in connection.execute(self.query):
                    yield tuple(row[: self.width])
            finally:
                connection.close()


def read_tabs(spark: SparkSession, path: str) -> DataFrame:
    """Open tabs; the filter and the order stay with the caller's plan."""
    spark.dataSource.register(SqliteSource)
    query = "SELECT title, url, last_modified, deleted, date_closed, order_index FROM bookmarks"
    schema = "title string, url string, last_modified double, deleted int, date_closed double, order_index int"
    return spark.read.format("sqlite_snapshot").option("path", path).option("query", query).schema(schema).load()


def read_cloud_tabs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tabs, devices)."""
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite_snapshot").option("path", path)
    tabs = reader.option("query", "SELECT title, url, last_viewed_time, device_uuid FROM cloud_tabs").schema("title string, url string, last_viewed_time double, device_uuid string").load()
    reader = spark.read.format("sqlite_snapshot").option("path", path)
    devices = reader.option("query", "SELECT device_uuid, device_name FROM cloud_tab_devices").schema("device_uuid string, device_name string").load()
    return tabs, devices
