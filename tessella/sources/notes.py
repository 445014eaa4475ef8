"""Readers of notes, configuration, manifests and originals."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import origins, text
from tessella.operators.gateway import MANIFEST_FIELDS

#: Names may be given by a variable of the environment.
CONFIG_VARIABLE, CONFIG_NAME = "TESSELLA_CONFIG", "tessella.yaml"
# Defaults of the configuration; the library's path has none.
DEFAULTS = {
    "search_provider": "grep", "search_collection": "library", "default_model": "sonnet", "default_language": "en",
    "whisper_model": "large-v3", "auto_detect_origin": "true", "archive_dir": "",
}


_TARGET = re.compile(
    r"""(?P<name>[^\s#][^:#]*):(?=\s|$)\s*(?:"(?P<double>(?:[^"\\]|\\.)*)"|'(?P<single>(?:[^']|'')*)'|(?P<plain>(?:[^\s#"']|(?<!\s)#|(?<!^)["']|[^\S\n](?!#))*))\s*(?:(?<=\s)\#.*)?$"""
)


def read_notes(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, content: a row for each Markdown file; paths are as Spark has them, with scheme."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=recursive)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_library(spark: SparkSession, folder: str) -> DataFrame:
    """folder, source, extract of every folder of a library that holds notes."""
    notes = read_notes(spark, folder).withColumn("parts", F.split("path", "/"))
    named = notes.select(F.get("parts", F.size("parts") - 2).alias("folder"), F.get("parts", F.size("parts") - 1).alias("name"), "content")
    return named.groupBy("folder").agg(F.max(F.when(F.col("name") == "source.md", F.col("content"))).alias("source"), F.max(F.when(F.col("name") == "extract.md", F.col("content"))).alias("extract"))


def read_one(spark: SparkSession, path: str) -> DataFrame:
    """path, content of one note; a missing file raises."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def from_text(spark: SparkSession, content: str, title: str | None = None, origin: str = "text") -> DataFrame:
    """A capture given as text or idea."""
    return spark.createDataFrame([(origin, title, content)], "origin string, title string, content string")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """position (from 0) and the manifest's fields as text; null and false are empty. Text that isn't a JSON array raises."""
    return manifest_items(spark.read.text(path, wholetext=True))


def manifest_items(df: DataFrame, column: str = "value") -> DataFrame:
    """The same from a column of manifest texts; the other columns stay in front."""
    element = T.StructType([T.StructField(c, T.StringType()) for c in MANIFEST_FIELDS])
    others = [c for c in df.columns if c != column]
    parsed = df.select(*others, F.from_json(column, T.ArrayType(element), {"mode": "FAILFAST"}).alias("items"))
    rows = parsed.select(*others, F.posexplode("items").alias("position", "i")).select(*others, "position", "i.*")
    return rows.select(*others, "position", *[F.when(F.col(c) == "false", "").otherwise(F.coalesce(c, F.lit(""))).alias(c) for c in MANIFEST_FIELDS])


def read_manifest_parts(spark: SparkSession, path: str) -> DataFrame:
    """What sinks.write_manifest() wrote, with the same rules for fields; position as written."""
    rows = spark.read.schema(", ".join(["position long", *(f"{c} string" for c in MANIFEST_FIELDS)])).option("mode", "FAILFAST").json(path)
    return rows.select("position", *[F.when(F.col(c) == "false", "").otherwise(F.coalesce(c, F.lit(""))).alias(c) for c in MANIFEST_FIELDS])


def yaml_value(lines: DataFrame, key: str, home: str = "") -> str:
    """The first value of a key in a file of flat `key: value` lines (column value, in file order)."""
    found = lines.filter(F.col("value").startswith(f"{key}: ")).select(text.config_value(F.col("value"), key).alias("v")).head()
    value = found["v"] if found else ""
    return home + value[1:] if home and value.startswith("~") else value


def config_table(files: DataFrame, home: str = "", column: str = "value") -> DataFrame:
    """key and value of every known key, for each text of flat `key: value` lines: that of the first line of the key, or else the
    default. The other columns stay in front."""
    lines = F.split(column, "\n")

    def value(key: str, default: str) -> Column:
        first = text.config_value(F.get(F.filter(lines, lambda line: F.startswith(line, F.lit(f"{key}: "))), F.lit(0)), key)
        placed = F.when(first.startswith("~"), F.concat(F.lit(home), F.substring(first, 2, 1 << 30))).otherwise(first) if home else first
        return F.struct(F.lit(key).alias("key"), F.coalesce(text.present(placed), F.lit(default)).alias("value"))

    found = F.array(*[value(k, v) for k, v in {"vault_path": "", "reader_context_path": "", **DEFAULTS}.items()])
    return files.select(*[c for c in files.columns if c != column], F.explode(found).alias("c")).select(*[c for c in files.columns if c != column], "c.*")


def find_config(given: str | None = None, environment: Mapping[str, str] = os.environ, here: str = ".", root: str = ".") -> str:
    """What was given, else the environment's, else the current folder's, else the root's."""
    candidates = [given or environment.get(CONFIG_VARIABLE) or ""]
    if not candidates[0]:
        candidates = [f"{here}/{CONFIG_NAME}", f"{root}/{CONFIG_NAME}"]
    for path in candidates:
        if os.path.isfile(path):
            return path
    raise FileNotFoundError(f"no configuration at {' or '.join(candidates)}")


def load_config(spark: SparkSession, path: str, home: str = "") -> dict[str, str]:
    """The configuration with defaults. Without vault_path it is an error."""
    lines = spark.read.text(path).coalesce(1).cache()
    try:
        found = {k: yaml_value(lines, k, home) for k in ("vault_path", "reader_context_path", *DEFAULTS)}
    finally:
        lines.unpersist()
    if not found["vault_path"]:
        raise ValueError("vault_path is not set")
    found["reader_context_path"] = found["reader_context_path"] or f"{found['vault_path']}/reader-context.md"
    return found | {k: found[k] or v for k, v in DEFAULTS.items()}


def load_targets(path: str, home: str = "") -> dict[str, str | None]:
    """Destinations and their folders, in file order, from flat YAML; an empty target is None. A comment starts a line or follows white
    space, outside quotes. A quoted value ends with its quote; in double quotes a backslash escapes."""
    out: dict[str, str | None] = {}
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            m = _TARGET.match(line)
            if m:
                double, single, plain = m["double"], m["single"], m["plain"]
                value = re.sub(r"\\(.)", r"\1", double) if double is not None else single.replace("''", "'") if single is not None else plain.strip()
                if plain is not None and value in ("~", "null", "Null", "NULL", "false", "False", "FALSE"):
                    value = ""
                out[m["name"].strip().strip("\"'")] = (home + value[1:] if home and re.match(r"~(/|$)", value) else value) or None
    return out


def read_originals(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Archived originals: path, bytes, size, extension, sha256 and, by name, origin."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select(
        "path", "content", "length", text.extension(text.basename(F.col("path"))).alias("ext"), F.sha2("content", 256).alias("sha256"),
        origins.file_origin(F.col("path"), text.extension(F.col("path"))).alias("origin"),
    )
