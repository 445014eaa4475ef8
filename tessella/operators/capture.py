"""From pages, bookmarks and tabs to capture rows and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import frontmatter as fmt
from tessella.functions import origins, text
from tessella.operators.numbering import collision_names
from tessella.operators.selection import in_reading_list, open_tab, web_address


def pages(df: DataFrame, day: Column, url: str = "url", html: str = "html", order: str = "page_id") -> DataFrame:
    """Capture row of each page: folder, origin, type, readable text; rows of one folder name get suffixes."""
    rows = df.select(
        F.col(order),
        F.col(url).alias("url"),
        text.hash8(F.col(url)).alias("hash8"),
        text.folder_name(day, F.col(url)).alias("base"),
        origins.url_origin(F.col(url)).alias("origin"),
        text.archive_name(day, F.col(url), F.lit("html")).alias("archive"),
        text.html_text(F.col(html)).alias("content"),
        text.rendered_enough(F.col(html)).alias("rendered"),
    ).withColumn("source_type", origins.source_type(F.col("origin")))
    return collision_names(rows, "base", F.col(order), "folder").drop("base")


def bookmarks(leaves: DataFrame) -> DataFrame:
    """leaves: url, uri_title, uuid, preview, reading_added, added, folders (array). Adds the kind."""
    return leaves.select(
        F.when(in_reading_list(F.col("folders")), "reading-list").otherwise("bookmarks").alias("kind"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce(text.present(F.col("uri_title")), F.col("url"), F.lit("")).alias("title"),
        F.coalesce("uuid", F.lit("")).alias("uuid"),
        F.coalesce("preview", F.lit("")).alias("preview"),
        F.coalesce(F.date_format(F.coalesce("reading_added", "added"), "yyyy-MM-dd"), F.lit("")).alias("date_added"),
        F.array_join(F.filter("folders", lambda p: F.coalesce(p != "", F.lit(False))), " / ").alias("folder"),
    ).filter("url <> ''")


def _tab(kind: str, url: Column, title: Column, seconds: Column, folder: Column) -> list[Column]:
    return [
        F.lit(kind).alias("kind"), url.alias("url"), F.coalesce(text.present(title), url).alias("title"), F.lit("").alias("uuid"),
        F.lit("").alias("preview"), text.mac_date(seconds).alias("date_added"), folder.alias("folder"),
    ]


def open_tabs(tabs: DataFrame) -> DataFrame:
    """tabs: title, url, last_modified, deleted, date_closed, order_index."""
    kept = tabs.filter(open_tab(F.col("url"), F.col("deleted"), F.col("date_closed")))
    return kept.select(*_tab("open-tabs", F.col("url"), F.col("title"), F.col("last_modified"), F.lit("open-tabs")), F.col("order_index").cast("long").alias("seq"))


def cloud_tabs(tabs: DataFrame, devices: DataFrame) -> DataFrame:
    """tabs: title, url, last_viewed_time, device_uuid; devices: device_uuid, device_name. A tab of an unknown device stays."""
    joined = tabs.filter(web_address(F.col("url"))).join(devices, "device_uuid", "left")
    folder = F.concat(F.lit("cloud-tabs / "), F.coalesce(text.present(F.col("device_name")), F.lit("unknown-device")))
    return joined.select(*_tab("cloud-tabs", F.col("url"), F.col("title"), F.col("last_viewed_time"), folder))


def union(*parts: DataFrame) -> DataFrame:
    """One shape for all captures; nothing is dropped."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def limited(df: DataFrame, most: int, kind: str = "kind", order: str = "seq") -> DataFrame:
    """The first rows of each kind; 0: all. Each task keeps its own first rows before the shuffle."""
    if not most:
        return df
    return df.withColumn("_n", F.row_number().over(W.partitionBy(kind).orderBy(order))).filter(F.col("_n") <= most).drop("_n")


def note_name(url: Column, title: Column) -> Column:
    return F.concat(text.hash8(url), F.lit("-"), text.slug(title), F.lit(".md"))


def first_notes(items: DataFrame, order: Column, existing: DataFrame | None = None) -> DataFrame:
    """The first item of each (kind, note name); names that exist already are left alone. Adds name."""
    named = items.withColumn("name", note_name(F.col("url"), F.col("title")))
    if existing is not None:
        named = named.join(existing.select("kind", "name"), ["kind", "name"], "left_anti")
    return named.withColumn("_n", F.row_number().over(W.partitionBy("kind", "name").orderBy(order))).filter("_n = 1").drop("_n")


def note(prefix: str = "safari") -> Column:
    """Markdown of a captured item (url, title, uuid, date_added, folder, preview, kind)."""
    def plain(key: str, value: Column) -> Column:
        return F.concat(F.lit(f'{key}: "'), value, F.lit('"'))

    lines = F.array(
        F.lit("type: dump-item"), F.concat(F.lit(f"source: {prefix}-"), F.col("kind")), plain("url", text.frontmatter_escaped(F.col("url"))),
        plain("title", text.frontmatter_escaped(F.col("title"))), plain("uuid", F.col("uuid")), plain("date_added", F.col("date_added")),
        plain("folder", text.frontmatter_escaped(F.col("folder"))), F.lit("status: unclassified"), F.lit("category: "), F.lit("domain: "), F.lit("value: "), F.lit("reason: "),
    )
    preview = F.when(F.col("preview") != "", F.concat(F.lit("## Preview\n\n"), F.col("preview"), F.lit("\n")))
    folder = F.when(F.col("folder") != "", F.concat(F.lit("**Folder:** "), F.col("folder"), F.lit("\n")))
    body = F.concat_ws("\n", F.concat(F.lit("\n# "), F.col("title"), F.lit("\n")), F.concat(F.lit("**URL:** "), F.col("url"), F.lit("\n")), preview, folder)
    return F.concat(F.array_join(F.concat(F.array(F.lit("---")), lines, F.array(F.lit("---"))), "\n"), F.lit("\n"), body)


def counts(items: DataFrame, kinds: list[str]) -> DataFrame:
    """Items of each kind, kinds without any included."""
    known = items.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    found = items.groupBy("kind").agg(F.count("*").alias("n"))
    return known.join(found, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def archived(items: DataFrame, order: Column) -> DataFrame:
    """One row of each archive name: the last written wins."""
    return items.withColumn("_n", F.row_number().over(W.partitionBy("archive").orderBy(order.desc()))).filter("_n = 1").drop("_n")


def archived_files(items: DataFrame, originals: DataFrame, day: Column, folder: str) -> DataFrame:
    """items: file, canonical; originals: path, length. Adds length, where the copy goes, with the file's extension, and an error
    where there is no such file."""
    joined = items.join(originals.select(F.col("path").alias("_path"), "length"), F.col("file") == F.col("_path"), "left")
    there = F.col("_path").isNotNull()
    name = text.archive_name(day, F.col("canonical"), text.extension(F.col("file")))
    return joined.withColumns({"archive": F.when(there, F.concat(F.lit(f"{folder}/"), name)), "error": F.when(~there, F.concat(F.lit("file not found: "), "file"))}).drop("_path")


# Content format of an origin; others are text.
FORMATS = {"youtube": "transcript", "audio": "transcript", "pdf": "pdf", "ref:vault": "reference", "ref:mcp": "reference"}


def source_note(df: DataFrame, day: Column, by: str = "agent") -> Column:
    """The unchanging note of a captured source (origin, source_type, content; url, author, archive, origin_path if there are such columns)."""
    formats = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])

    def optional(name: str) -> Column:
        value = text.present(F.col(name).cast("string")) if name in df.columns else F.lit(None).cast("string")
        return F.when(value.isNotNull(), fmt.field(name, value))

    lines = [
        F.lit("type: source"), fmt.field("source_type", F.col("source_type")), fmt.field("content_format", F.coalesce(F.element_at(formats, F.col("origin")), F.lit("text"))), fmt.field("origin", F.col("origin")),
        optional("url"), optional("author"), fmt.field("captured", F.date_format(day, "yyyy-MM-dd")), F.lit(f"captured_by: {by}"), optional("archive"), optional("origin_path"),
    ]
    return fmt.serialized(F.array_compact(F.array(*lines)), F.col("content"))


def notes(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Raw notes to rows: path, fm (map), pairs (ordered), body."""
    c = F.col(content)
    return df.select(F.col(path).alias("path"), fmt.parsed(c).alias("fm"), fmt.pairs(c).alias("pairs"), fmt.body(c).alias("body"))
