"""Library tables derived from the test tables, by expressions that Spark and DuckDB read alike.

The derivations are fixtures; what is computed on them is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "DATE '2026-01-15'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_select(select: str) -> list[str]:
    """Select items of one text of SQL, cut at commas outside brackets."""
    out, depth, now = [], 0, ""
    for c in select:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def day() -> Column:
    return F.expr(DAY)


PATH = """source || '/' || lang || '/' || CASE WHEN doc_id % 97 = 0 THEN 'README-' || cast(doc_id AS string) || '/README.md'
  ELSE CASE WHEN doc_id % 11 = 0 THEN '2024-01-02 ' ELSE '' END || 'note-' || cast(doc_id AS string) || '.md' END"""

DESTINATION = "CASE cast(doc_id % 6 AS int) WHEN 0 THEN 'work' WHEN 1 THEN 'knowledge' WHEN 2 THEN 'skip' WHEN 3 THEN 'attic' WHEN 4 THEN 'home' ELSE '' END"

NOTE = f"""CASE WHEN doc_id % 5 = 0 THEN text ELSE
  '---' || chr(10) || 'type: dump-item' || chr(10)
  || 'source: ' || source || '/' || lang || chr(10)
  || CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'title: "' || lang || ': note ' || cast(doc_id AS string) || '"' || chr(10) END
  || 'url: ' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'https://example.org/' || source || '/' || cast(doc_id AS string) END || chr(10)
  || 'no colon on this line' || chr(10)
  || 'status: ' || CASE cast(doc_id % 8 AS int) WHEN 0 THEN 'unclassified' WHEN 1 THEN 'keep' WHEN 2 THEN 'maybe' WHEN 3 THEN 'skip' ELSE 'classified' END || chr(10)
  || CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'value: ' || CASE WHEN doc_id % 13 = 0 THEN 'high' ELSE cast(doc_id % 6 AS string) END || chr(10) END
  || 'category: ' || CASE cast(doc_id % 3 AS int) WHEN 0 THEN 'tech' WHEN 1 THEN 'reference' ELSE 'other' END || chr(10)
  || CASE WHEN doc_id % 2 = 0 THEN 'domain: tools' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 10 < 6 THEN 'destination: ' || {DESTINATION} || chr(10) ELSE '' END
  || CASE WHEN doc_id % 17 = 0 THEN 'status: classified' || chr(10) ELSE '' END
  || '---' || chr(10) || CASE WHEN doc_id % 12 = 1 THEN '# Head' || chr(10) || '## Preview' || chr(10) || chr(10) || replace(text, chr(10) || chr(10), chr(10)) || chr(10) || chr(10) || 'more' ELSE text END
END"""

#: Columns doc_id, path, content of dump notes.
NOTES_SQL = f"SELECT doc_id, {PATH} AS path, {NOTE} AS content FROM documents"


def dump_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{PATH} AS path", f"{NOTE} AS content")


_LINE = "[l FOR l IN string_split(blk, chr(10)) IF contains(l, ':') AND trim(split_part(l, ':', 1)) = '{key}']"


def duck_value(key: str) -> str:
    """DuckDB: a key's value, null if it is missing, from a column blk with the block's lines."""
    line = f"({_LINE.format(key=key)})[-1]"
    return f"regexp_replace(trim(substr({line}, instr({line}, ':') + 1)), '^\"(.*)\"$', '\\1')"


#: DuckDB: dump notes with blk, body and the keys that queries use; a CTE named n.
PARSED_SQL = f"""WITH raw AS ({NOTES_SQL}),
cut AS (
  SELECT doc_id, path, content, regexp_matches(content, '(?s)\\A---\\s*\\n(.*?)\\n---\\s*\\n') AS fronted,
    regexp_extract(content, '(?s)\\A---\\s*\\n(.*?)\\n---\\s*\\n', 1) AS blk,
    regexp_replace(content, '(?s)\\A---\\s*\\n(.*?)\\n---\\s*\\n', '') AS body
  FROM raw
),
n AS (
  SELECT doc_id, path, content, fronted, body, {", ".join(f"{duck_value(k)} AS {k}" for k in ("type", "source", "title", "url", "status", "value", "category", "domain", "destination"))}
  FROM cut
)"""

#: DuckDB: a value as int, 0 if it isn't one.
DUCK_INT = "CASE WHEN regexp_matches(value, '^[+-]?[0-9]+$') THEN value::INT ELSE 0 END"
#: DuckDB: not a readme, an index or an import log.
DUCK_ITEM = "NOT (lower(split_part(path, '/', -1)) IN ('readme.md', 'index.md') OR contains(lower(split_part(path, '/', -1)), 'import log'))"
DUCK_STEM = "regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '')"
DUCK_FILE_TITLE = f"coalesce(nullif(regexp_extract({DUCK_STEM}, '^[0-9]{{4}}[_-][0-9]{{2}}[_-][0-9]{{2}}\\s+(.+)$', 1), ''), {DUCK_STEM})"


def duck_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr(
        "CASE WHEN page_id % 6 = 0 THEN '' WHEN page_id % 6 = 1 THEN null ELSE 'Tab ' || cast(page_id AS string) END AS title",
        "CASE WHEN page_id % 10 = 0 THEN 'HTTP://UP.example/' || cast(page_id AS string) WHEN page_id % 10 = 1 THEN 'about:blank' ELSE url END AS url",
        "CASE WHEN page_id % 8 = 0 THEN null ELSE cast(page_id * 86400 AS double) END AS last_modified", "cast(page_id % 5 = 0 AS int) AS deleted",
        "CASE WHEN page_id % 7 = 0 THEN cast(1 AS double) END AS date_closed", "cast(page_id AS int) AS order_index",
        "'dev-' || cast(page_id % 4 AS string) AS device_uuid",
    )


TABS_SQL = """SELECT CASE WHEN page_id % 6 = 0 THEN '' WHEN page_id % 6 = 1 THEN null ELSE 'Tab ' || page_id::VARCHAR END AS title,
  CASE WHEN page_id % 10 = 0 THEN 'HTTP://UP.example/' || page_id::VARCHAR WHEN page_id % 10 = 1 THEN 'about:blank' ELSE url END AS url,
  CASE WHEN page_id % 8 = 0 THEN null ELSE page_id * 86400 END AS seconds, page_id % 5 = 0 AS deleted, page_id % 7 = 0 AS closed, page_id, 'dev-' || (page_id % 4)::VARCHAR AS device_uuid FROM pages"""


def devices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("dev-0", "laptop"), ("dev-1", None), ("dev-2", "")], "device_uuid string, device_name string")


DEVICES_SQL = "(VALUES ('dev-0', 'laptop'), ('dev-1', NULL), ('dev-2', '')) AS d(device_uuid, device_name)"

PROFILES = "# Places\n\n## work\nMeetings.\n\n## knowledge\nBooks.\n## skip  \nNoise.\n## empty-one\n### not this\n##tight\n"
TARGETS = {"work": "/in/work", "home": "/in/home", "later": None, "knowledge_manifest": "/out/manifest.json"}
