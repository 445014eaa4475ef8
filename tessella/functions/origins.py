"""Where a capture comes from, and what kind of source that makes it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import present

# What tells an origin by address or media format.
VIDEO_URL = r"youtube\.com/watch|youtu\.be/|youtube\.com/shorts/"
PDF_URL = r"\.pdf(\?|#|\z)"
AUDIO_FORMATS = r"mp3|wav|flac|ogg|aac|m4a|opus"

# Source type of an origin; others are articles, a batch has none.
SOURCE_TYPES = {
    "youtube": "video", "audio": "podcast", "pdf": "paper", "book": "book", "idea": "idea", "ref:vault": "document", "ref:mcp": "document", "batch": "",
}


def url_origin(url: Column) -> Column:
    """Case counts, and the patterns may match anywhere in the address."""
    return F.when(url.rlike(VIDEO_URL), "youtube").when(url.rlike(PDF_URL), "pdf").otherwise("url")


def file_origin(path: Column, media_format: Column) -> Column:
    """media_format: what a media probe says of the file, in any case; null if nothing."""
    return F.when(path.rlike(r"\.pdf\z"), "pdf").when(F.coalesce(media_format, F.lit("")).rlike(f"(?i){AUDIO_FORMATS}"), "audio").otherwise("file")


def origin(given: Column, manifest: Column, ref_path: Column, ref_source: Column, ref_id: Column, url: Column, path: Column, media_format: Column, detect: bool = True) -> Column:
    """What was given; else by what is set, first match: manifest, reference, remote reference, address, file. Null if nothing is."""
    if not detect:
        return present(given)
    found = (
        F.when(present(manifest).isNotNull(), "batch")
        .when(present(ref_path).isNotNull(), "ref:vault")
        .when(present(ref_source).isNotNull() & present(ref_id).isNotNull(), "ref:mcp")
        .when(present(url).isNotNull(), url_origin(url))
        .when(present(path).isNotNull(), file_origin(path, media_format))
    )
    return F.coalesce(present(given), found)


def source_type(of: Column, given: Column | None = None) -> Column:
    chain = None
    for name, kind in SOURCE_TYPES.items():
        chain = F.when(of == name, kind) if chain is None else chain.when(of == name, kind)
    found = chain.otherwise("article")
    return found if given is None else F.coalesce(present(given), found)


def video_id(url: Column) -> Column:
    """Eleven characters; null if the address has none."""
    return present(F.regexp_extract(url, r"(?:v=|youtu\.be/|shorts/)([a-zA-Z0-9_-]{11})", 1))
