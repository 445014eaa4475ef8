"""Metadata, captions and transcripts of recordings. Fetching and speech recognition are outside; their results are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import basename, duration, present, stem

METADATA = "title string, channel string, uploader string, duration double, upload_date string, webpage_url string, description string, language string"
DESCRIPTION_CHARS = 500


def metadata(df: DataFrame, column: str = "json") -> DataFrame:
    """Six fields of a downloader's JSON."""
    parsed = df.withColumn("m", F.from_json(column, METADATA))
    return parsed.select(
        *[c for c in df.columns if c != column], F.coalesce("m.title", F.lit("")).alias("title"), F.coalesce("m.channel", "m.uploader", F.lit("")).alias("channel"),
        F.coalesce("m.duration", F.lit(0.0)).alias("seconds"), F.coalesce("m.upload_date", F.lit("")).alias("published"),
        F.coalesce("m.webpage_url", F.lit("")).alias("url"), F.substring(F.coalesce("m.description", F.lit("")), 1, DESCRIPTION_CHARS).alias("description"),
    )


def preference(lang: Column, manual: Column, position: Column, languages: tuple[str, ...] = ("en", "ru")) -> Column:
    """Manual captions by language, then generated ones by language, then the first that is listed; smaller is better."""
    n = len(languages)
    rank = None
    for k, name in enumerate(languages):
        rank = F.when(manual & (lang == name), k) if rank is None else rank.when(manual & (lang == name), k)
    for k, name in enumerate(languages):
        rank = rank.when(~manual & (lang == name), n + k)
    return F.struct(rank.otherwise(2 * n).alias("rank"), position.alias("position"))


def transcripts(captions: DataFrame, key: str = "video_id") -> DataFrame:
    """captions: key, lang, is_manual, list_pos, pos, text. key, lang, transcript of the preferred track.

    Lines are gathered for each track, then tracks are compared; a transcript is one cell anyway.
    """
    tracks = captions.groupBy(key, "lang", "is_manual", "list_pos").agg(joined(F.col("pos"), F.col("text")).alias("transcript"))
    rank = preference(F.col("lang"), F.col("is_manual"), F.col("list_pos"))
    return tracks.groupBy(key).agg(F.min_by(F.struct("lang", "transcript"), rank).alias("t")).select(key, "t.lang", "t.transcript")


def joined(position: Column, text: Column) -> Column:
    """Texts of a group in order of position, a line each."""
    ordered = F.array_sort(F.collect_list(F.struct(position.alias("p"), text.alias("t"))))
    return F.array_join(F.transform(ordered, lambda x: x["t"]), "\n")


def with_fallback(captions: Column, recognised: Column, no_recognition: bool = False) -> tuple[Column, Column]:
    """(transcript, method); null if neither has text."""
    spoken = F.lit(None).cast("string") if no_recognition else present(recognised)
    return F.coalesce(present(captions), spoken), F.when(present(captions).isNotNull(), "captions").when(spoken.isNotNull(), "recognised")


def audio_title(title: Column, path: Column) -> Column:
    return F.coalesce(present(title), stem(path))


def transcribed(df: DataFrame, no_recognition: bool = False) -> DataFrame:
    """df: captions, recognised, title, file and others of document(). Adds transcript, method, document, and an error where there is no text; the
    title is the file's stem where there is none."""
    said, method = with_fallback(F.col("captions"), F.col("recognised"), no_recognition)
    rows = df.withColumns({"transcript": said, "method": method, "title": audio_title(F.col("title"), F.col("file"))})
    silent = F.col("transcript").isNull()
    return rows.withColumns({"document": F.when(~silent, document(rows)), "error": F.when(silent, F.lit("empty transcript"))})


def document(df: DataFrame) -> Column:
    """Header lines and text of a transcript row (title, channel or file, seconds, published, url, language, method, description, transcript)."""
    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), present(value))

    lines = []
    for label, name in (("Title", "title"), ("Channel", "channel"), ("File", "file"), ("Duration", "seconds"), ("Published", "published"), ("URL", "url"), ("Language", "language"), ("Transcript method", "method")):
        if name in df.columns:
            value = duration(F.col(name)) if name == "seconds" else basename(F.col(name)) if name == "file" else F.col(name).cast("string")
            lines.append(line(label, value))
    described = F.concat(F.lit("\nDescription:\n"), present(F.col("description"))) if "description" in df.columns else None
    return F.concat_ws("\n", *lines, *([described] if described is not None else []), F.lit("\n--- TRANSCRIPT ---\n"), F.col("transcript"))
