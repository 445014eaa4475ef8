"""Scalar text functions, all built-in Spark expressions.

Patterns that mean Python's word class use [\\p{L}\\p{N}_]; Java's \\w is ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s"
#: Seconds from 1970-01-01 to 2001-01-01, where browser databases start counting.
MAC_EPOCH = 978307200


def strip(col: Column) -> Column:
    """Without white space, of any script, at both ends."""
    return F.regexp_replace(col, r"(?U)\A\s+|\s+\z", "")


def present(col: Column) -> Column:
    """Null for the empty string too."""
    return F.nullif(col, F.lit(""))


def hash8(col: Column) -> Column:
    """First eight hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(col, 256), 1, 8)


def slug(col: Column, longest: int = 80) -> Column:
    """File-safe form of a title; `untitled` if nothing is left."""
    kept = strip(F.regexp_replace(col, r"(?U)[^\p{L}\p{N}_\s-]", ""))
    joined = F.substring(F.regexp_replace(kept, r"(?U)[-\s]+", "-"), 1, longest)
    return F.coalesce(present(joined), F.lit("untitled"))


def sanitized(col: Column) -> Column:
    """One line, without delimiter runs, so that a value can't open a section of a request."""
    return F.replace(F.translate(col, "\n", " "), F.lit("==="), F.lit(""))


def frontmatter_escaped(col: Column) -> Column:
    """Backslash and double quote escaped; null is empty."""
    doubled = F.replace(F.coalesce(col, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit('"'), F.lit('\\"'))


def json_escaped(col: Column) -> Column:
    """As frontmatter_escaped, with line ends as spaces."""
    return F.translate(frontmatter_escaped(col), "\n", " ")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """What follows the last dot; the whole path if there is none."""
    return F.substring_index(path, ".", -1)


def stem(path: Column) -> Column:
    """File name without its last extension; a leading dot opens no extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*\z", "")


def title_from_filename(path: Column) -> Column:
    """The stem without a date in front."""
    name = stem(path)
    return F.coalesce(present(F.regexp_extract(name, r"(?s)^[0-9]{4}[_-][0-9]{2}[_-][0-9]{2}\s+(.+)$", 1)), name)


def folder_hint(path: Column) -> Column:
    """The two folders that hold a file."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 2), F.lit(2)), "/")).otherwise(F.get(parts, F.size(parts) - 2))


def path_key(path: Column) -> Column:
    """Sorts paths folder by folder, not byte by byte."""
    return F.translate(path, "/", "\u0001")


def one_line(col: Column) -> Column:
    return F.translate(col, "\n", " ")


def body_preview(body: Column, cut: int = 200) -> Column:
    """Start of a body on one line."""
    return strip(one_line(F.substring(strip(body), 1, cut)))


def note_preview(body: Column, has_frontmatter: Column, raw_cut: int = 400, cut: int = 300) -> Column:
    """The paragraph under a Preview heading; or, for raw notes only, the start of the body."""
    headed = F.regexp_extract(body, r"(?s)## Preview\s*\n\n(.+?)(?:\n\n|\z)", 1)
    found = F.when(headed != "", strip(headed)).when(~has_frontmatter, strip(one_line(F.substring(strip(body), 1, raw_cut)))).otherwise("")
    return F.substring(found, 1, cut)


def duration(seconds: Column) -> Column:
    """H:MM:SS, hours unpadded, fractions dropped."""
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60)


def mac_date(seconds: Column) -> Column:
    """ISO date of seconds since 2001; empty for null and zero."""
    day = F.date_format(F.timestamp_seconds(seconds + F.lit(MAC_EPOCH)), "yyyy-MM-dd")
    return F.when(seconds.isNull() | (seconds == 0), "").otherwise(day)


def date_text(col: Column) -> Column:
    """ISO date of a date or time as text; what isn't one keeps its first ten characters."""
    return F.coalesce(F.date_format(F.try_to_timestamp(col), "yyyy-MM-dd"), F.substring(col, 1, 10), F.lit(""))


def archive_name(day: Column, canonical: Column, ext: Column) -> Column:
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("_"), hash8(canonical), F.lit("."), ext)


def folder_name(day: Column, canonical: Column) -> Column:
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("_"), hash8(canonical))


# Elements that end a line, by prefix, and entities with what they stand for, in the order of decoding.
LINE_TAGS = "h[1-6]|p|li|div|section|article|br|hr|tr|table|ul|ol|nav|header|footer|main|aside"
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')]
SCRIPTS = ("script", "style", "noscript")


def html_text(html: Column, least: int = 2) -> Column:
    """Readable lines of a page, a blank line between two; lines of `least` characters or fewer are dropped."""
    page = html
    for tag in SCRIPTS:
        page = F.regexp_replace(page, rf"(?s)<{tag}[^>]*>.*?</{tag}>", "")
    body = F.regexp_extract(page, r"(?s)<body[^>]*>(.*)</body>", 1)
    page = F.when(page.rlike(r"(?s)<body[^>]*>.*</body>"), body).otherwise(page)
    page = F.regexp_replace(page, rf"(?i)</?({LINE_TAGS})[^>]*>", "\n")
    page = F.regexp_replace(page, r"<[^>]+>", " ")
    for entity, plain in ENTITIES:
        page = F.replace(page, F.lit(entity), F.lit(plain))
    lines = F.transform(F.split(F.regexp_replace(page, r"[ \t]+", " "), "\n"), strip)
    return F.array_join(F.filter(lines, lambda x: F.length(x) > least), "\n\n")


def rendered_enough(html: Column, least: int = 1000) -> Column:
    """A rendered page below this many bytes counts as not rendered."""
    return F.octet_length(html) >= least


def config_value(line: Column, key: str) -> Column:
    """The value on a `key: value` line: no comment, no trailing space, one pair of each quote taken off, each end alone."""
    value = F.substring(line, len(key) + 3, 1 << 30)
    value = F.regexp_replace(value, r"\s*#.*$", "")
    value = F.regexp_replace(value, r"\s+$", "")
    for quote in ('"', "'"):
        value = F.regexp_replace(value, rf"\A{quote}|{quote}\z", "")
    return value
