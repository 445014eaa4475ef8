"""Requests for extraction, batches of them, their results and their failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import origins, text

MANIFEST_FIELDS = ["origin", "url", "title", "content", "source_type", "ref_path", "ref_source", "ref_id", "file"]

# What a request says of an origin.
NOTES = {
    "youtube": "Content format: transcript\nNote: the transcript comes with the request.",
    "audio": "Content format: transcript\nNote: the transcript comes with the request.",
    "ref:vault": "Note: the note's text comes with the request; the source refers to it by path.",
    "ref:mcp": "Note: fetch the item by its source and id.",
    "pdf": "Content format: pdf\nNote: read the file, and record its number of pages.",
}
#: Characters of a text that a dry run shows.
PREVIEW_CHARS = 300
RENDERED = "Note: the page was rendered beforehand; its text comes with the request."


def template(df: DataFrame, templates: DataFrame) -> DataFrame:
    """Adds the template of a row's source_type (templates: source_type, template), or a sentence in its place."""
    return df.join(templates, "source_type", "left").withColumn(
        "template", F.coalesce("template", F.concat(F.lit("No template for source type: "), "source_type", F.lit(". Extract key ideas and summary.")))
    )


def request(
    row: DataFrame, *, origin: str = "origin", source_type: str = "source_type", reader: Column | None = None, template: Column | None = None, instructions: str = ""
) -> Column:
    """One request for a row that may have the columns url, file, title, author, ref_path, ref_source, ref_id, origin_path,
    archive, render, context, session, intent, import_source and import_batch; lines without a value are left out."""

    def value(name: str, clean: bool = True) -> Column:
        if name not in row.columns:
            return F.lit(None).cast("string")
        return text.present(text.sanitized(F.col(name)) if clean else F.col(name))

    def line(label: str, name: str) -> Column:
        return F.concat(F.lit(f"{label}: "), value(name))

    of = F.col(origin)
    notes = F.element_at(F.create_map(*[F.lit(x) for pair in NOTES.items() for x in pair]), of)
    if "render" in row.columns:
        notes = F.when((of == "url") & F.col("render"), F.lit(RENDERED)).otherwise(notes)
    parts = [
        F.lit("=== ACTION ===\nsource-add"), F.concat(F.lit("Origin: "), of), F.concat(F.lit("Source type: "), F.col(source_type)),
        line("URL", "url"), line("File", "file"), line("Title", "title"), line("Author", "author"), line("Ref path", "ref_path"),
        line("Ref source", "ref_source"), line("Ref ID", "ref_id"), notes, line("Origin path", "origin_path"), line("Archive", "archive"),
        F.concat(F.lit("\n=== CAPTURE CONTEXT ===\nContext: "), F.coalesce(value("context"), F.lit("personal"))),
        F.concat(F.lit("Session: "), F.coalesce(value("session"), F.lit("unknown"))),
        F.concat(F.lit("Intent: "), F.coalesce(value("intent"), F.lit("none specified"))),
        line("Import source", "import_source"), line("Import batch", "import_batch"),
        F.concat(F.lit("\n=== READER CONTEXT ===\n"), F.coalesce(reader, F.lit("No reader context configured."))) if reader is not None else None,
        F.concat(F.lit("\n=== EXTRACTION TEMPLATE ===\n"), template) if template is not None else None,
        F.lit(f"\n=== INSTRUCTIONS ===\n{instructions}") if instructions else None,
    ]
    return F.concat_ws("\n", *[p for p in parts if p is not None])


def dry_run(rows: DataFrame, content: str = "content", **how) -> DataFrame:
    """What would be asked, without asking: adds the request, the start of the text that would go with it (null: none), and its length."""
    said = text.present(F.col(content))
    return rows.withColumns({"request": request(rows, **how), "preview": F.substring(said, 1, PREVIEW_CHARS), "n_chars": F.coalesce(F.length(said), F.lit(0)).cast("long")})


def referenced(items: DataFrame, notes: DataFrame) -> DataFrame:
    """items: ref_path; notes: path, content, one row a path. Adds content, and an error where there is no such note."""
    joined = items.join(notes.select(F.col("path").alias("_path"), "content"), F.col("ref_path") == F.col("_path"), "left")
    return joined.withColumn("error", F.when(F.col("_path").isNull(), F.concat(F.lit("note not found: "), "ref_path"))).drop("_path")


def batch_items(manifest: DataFrame, inherited: dict[str, str] | None = None) -> DataFrame:
    """Manifest rows (with position, from 0) to gateway rows: empty fields null, origin and type found, label, and the
    batch's own parameters, which are literals."""
    fields = {c: text.present(F.col(c).cast("string")) if c in manifest.columns else F.lit(None).cast("string") for c in MANIFEST_FIELDS}
    rows = manifest.select("position", *[v.alias(k) for k, v in fields.items()])
    none = F.lit(None).cast("string")
    found = origins.origin(F.col("origin"), none, F.col("ref_path"), F.col("ref_source"), F.col("ref_id"), F.col("url"), F.col("file"), none)
    rows = rows.withColumn("origin", found).withColumn("source_type", origins.source_type(F.col("origin"), F.col("source_type")))
    label = F.coalesce("title", "url", F.concat(F.lit("item "), F.col("position") + 1))
    out = rows.withColumn("label", label)
    for name, value in (inherited or {}).items():
        out = out.withColumn(name, F.lit(value))
    return out


def batch_summary(results: DataFrame) -> DataFrame:
    """results: position, label, ok. One row of counts: total, passed, failed, all_ok."""
    return results.agg(F.count("*").alias("total"), F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), (F.count_if(~F.col("ok")) == 0).alias("all_ok"))


def batch_failures(results: DataFrame) -> DataFrame:
    """position, failure: a row for each item that failed."""
    return results.filter(~F.col("ok")).select("position", F.format_string("[%d] %s: gateway failed", F.col("position") + 1, "label").alias("failure"))


def results(output: DataFrame, column: str = "line") -> tuple[DataFrame, DataFrame]:
    """(key, value of RESULT: lines; all other lines)."""
    marked = F.col(column).startswith("RESULT:")
    pairs = output.filter(marked).select(
        *[c for c in output.columns if c != column], F.regexp_extract(column, r"(?s)\ARESULT:([^=]*)=(.*)\z", 1).alias("key"), F.regexp_extract(column, r"(?s)\ARESULT:([^=]*)=(.*)\z", 2).alias("value")
    )
    return pairs, output.filter(~marked)


def dead_letters(failed: DataFrame, when: Column) -> DataFrame:
    """Rows with action, origin, url, file, context, session and error, escaped, and the time in UTC, as one JSON text each."""
    names = ["action", "origin", "url", "file", "context", "session", "error"]
    stamp = F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fields = [F.concat(F.lit('"timestamp": "'), stamp, F.lit('"'))]
    for n in names:
        value = F.col(n) if n in failed.columns else F.lit("")
        fields.append(F.concat(F.lit(f'"{n}": "'), text.json_escaped(value.cast("string")), F.lit('"')))
    return failed.withColumn("letter", F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")))
