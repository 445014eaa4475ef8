"""Queries on imports: configuration, manifests, origins, references, archives, recordings, and whole rounds through a scorer."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import frontmatter as fmt
from tessella.functions import origins, text
from tessella.operators import capture, gateway, routing, scoring, search, selection, sinks
from tessella.plans import library, triage
from tessella.plans.fixtures import DAY, DUCK_INT, DUCK_ITEM, PARSED_SQL, PATH, PROFILES, day, duck_strip, dump_notes, split_select, table
from tessella.sources import media, notes

MANIFEST = """'[{"url": "' || url || '", "title": ' || CASE WHEN page_id % 3 = 0 THEN 'null' WHEN page_id % 3 = 1 THEN 'false' ELSE '"T' || cast(page_id AS string) || '"' END
  || ', "origin": "url"}, {"ref_path": "a/b.md", "extra": 5}]'"""


def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.manifest_items(table(spark, sf_dir, "pages").selectExpr("page_id", f"{MANIFEST} AS value"))


MANIFEST_ROWS_SQL = """SELECT page_id, 0 AS position, 'url' AS origin, url, CASE WHEN page_id % 3 = 2 THEN 'T' || page_id ELSE '' END AS title, '' AS content, '' AS source_type, '' AS ref_path, '' AS ref_source, '' AS ref_id, '' AS file FROM pages
UNION ALL SELECT page_id, 1, '', '', '', '', '', 'a/b.md', '', '', '' FROM pages"""

KIND = "CASE cast(page_id % 5 AS int) WHEN 0 THEN 'article' WHEN 1 THEN 'video' WHEN 2 THEN 'paper' WHEN 3 THEN 'podcast' END"


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("article", "Summarise."), ("video", "List the parts.")], "source_type string, template string")
    return gateway.template(table(spark, sf_dir, "pages").selectExpr("page_id", f"{KIND} AS source_type"), known)


TEMPLATE_SQL = f"""WITH k AS (SELECT page_id, {KIND} AS source_type FROM pages)
SELECT page_id, source_type, CASE source_type WHEN 'article' THEN 'Summarise.' WHEN 'video' THEN 'List the parts.' ELSE 'No template for source type: ' || source_type || '. Extract key ideas and summary.' END AS template FROM k"""

CONFIG = """'# settings' || chr(10) || 'vault_path: "~/v' || cast(page_id AS string) || '"   # home' || chr(10) || 'search_provider:' || chr(10)
  || CASE WHEN page_id % 2 = 0 THEN 'default_model: ''big' || chr(10) || 'default_model: second' || chr(10) ELSE '' END || ' whisper_model: indented' || chr(10) || 'archive_dir:   "a b"  '"""


def config_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.config_table(table(spark, sf_dir, "pages").selectExpr("page_id", f"{CONFIG} AS value"), home="/home/me")


def _duck_config(key: str, default: str) -> str:
    line = f"[l FOR l IN string_split(t, chr(10)) IF starts_with(l, '{key}: ')][1]"
    value = f"regexp_replace(regexp_replace(substr({line}, {len(key) + 3}), '\\s*#.*$', ''), '\\s+$', '')"
    value = f"regexp_replace(regexp_replace({value}, '\\A\"|\"\\z', '', 'g'), '\\A''|''\\z', '', 'g')"
    value = f"CASE WHEN starts_with({value}, '~') THEN '/home/me' || substr({value}, 2) ELSE {value} END"
    return f"SELECT page_id, '{key}' AS key, coalesce(nullif({value}, ''), '{default}') AS value FROM c"


CONFIG_SQL = f"WITH c AS (SELECT page_id, {CONFIG} AS t FROM pages) " + " UNION ALL ".join(_duck_config(k, v) for k, v in {"vault_path": "", "reader_context_path": "", **notes.DEFAULTS}.items())


def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", f"{WHEN} AS said")
    return rows.withColumn("day", text.date_text(F.col("said")))


WHEN = """CASE cast(page_id % 6 AS int) WHEN 0 THEN '2026-01-02 03:04:05' WHEN 1 THEN '2026-11-30' WHEN 2 THEN 'some day in May' WHEN 3 THEN '' WHEN 4 THEN 'n/a' END"""
WHEN_SQL = f"WITH w AS (SELECT page_id, {WHEN} AS said FROM pages) SELECT page_id, said, coalesce(strftime(try_cast(said AS TIMESTAMP), '%Y-%m-%d'), substr(said, 1, 10), '') AS day FROM w"

ORIGINS = """CASE WHEN page_id % 10 = 0 THEN 'idea' ELSE '' END AS given, CASE WHEN page_id % 10 = 1 THEN 'm.json' ELSE '' END AS manifest, CASE WHEN page_id % 10 IN (1, 2) THEN 'a/b.md' ELSE '' END AS ref_path,
  CASE WHEN page_id % 10 IN (3, 4) THEN 'mail' ELSE '' END AS ref_source, CASE WHEN page_id % 10 = 3 THEN 'id7' ELSE '' END AS ref_id, CASE WHEN page_id % 10 = 5 THEN url WHEN page_id % 10 = 0 THEN url ELSE '' END AS url,
  CASE cast(page_id % 10 AS int) WHEN 4 THEN 'b.PDF' WHEN 6 THEN 'c.pdf' WHEN 7 THEN 'd.MP3' WHEN 8 THEN 'e.bin' ELSE '' END AS file, CASE cast(page_id % 10 AS int) WHEN 7 THEN 'MP3' WHEN 8 THEN 'data' END AS format"""


def origin_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", *split_select(ORIGINS))
    found = origins.origin(*[F.col(c) for c in ("given", "manifest", "ref_path", "ref_source", "ref_id", "url", "file", "format")])
    return rows.select("page_id", found.alias("origin")).withColumn("source_type", origins.source_type(F.col("origin")))


ORIGIN_SQL = f"""WITH o AS (SELECT page_id, CASE page_id % 10 WHEN 0 THEN 'idea' WHEN 1 THEN 'batch' WHEN 2 THEN 'ref:vault' WHEN 3 THEN 'ref:mcp' WHEN 4 THEN 'file' WHEN 5 THEN {library.DUCK_ORIGIN} WHEN 6 THEN 'pdf' WHEN 7 THEN 'audio' WHEN 8 THEN 'file' END AS origin FROM pages)
SELECT page_id, origin, CASE origin WHEN 'idea' THEN 'idea' WHEN 'batch' THEN '' WHEN 'ref:vault' THEN 'document' WHEN 'ref:mcp' THEN 'document' WHEN 'pdf' THEN 'paper' WHEN 'audio' THEN 'podcast' WHEN 'youtube' THEN 'video' ELSE 'article' END AS source_type FROM o"""


def referenced_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").selectExpr("doc_id", f"CASE WHEN doc_id % 4 = 0 THEN 'missing/' || cast(doc_id AS string) ELSE {PATH} END AS ref_path")
    found = gateway.referenced(items, dump_notes(spark, sf_dir).select("path", "content"))
    return found.select("doc_id", "ref_path", F.sha2("content", 256).alias("content_hash"), "error")


REFERENCE_SQL = f"""{PARSED_SQL} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'missing/' || doc_id ELSE path END AS ref_path, CASE WHEN doc_id % 4 > 0 THEN sha256(content) END AS content_hash,
  CASE WHEN doc_id % 4 = 0 THEN 'note not found: missing/' || doc_id END AS error FROM n"""

FILE = "'/in/p' || cast(page_id AS string) || CASE WHEN page_id % 2 = 0 THEN '.pdf' ELSE '.tar.MP3' END"


def archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    there = pages.filter("page_id % 4 > 0").selectExpr(f"{FILE} AS path", "cast(octet_length(html) AS bigint) AS length")
    return capture.archived_files(pages.selectExpr("page_id", f"{FILE} AS file", "url AS canonical"), there, day(), "/archive")


ARCHIVE_FILES_SQL = f"""WITH f AS (SELECT page_id, {FILE} AS file, url AS canonical, CASE WHEN page_id % 4 > 0 THEN octet_length(encode(html)) END AS length FROM pages)
SELECT page_id, canonical, file, length, CASE WHEN length IS NOT NULL THEN '/archive/' || strftime({DAY}, '%Y-%m-%d') || '_' || substr(sha256(canonical), 1, 8) || CASE WHEN page_id % 2 = 0 THEN '.pdf' ELSE '.MP3' END END AS archive,
  CASE WHEN length IS NULL THEN 'file not found: ' || file END AS error FROM f"""

CAPTIONS = "CASE cast(conv_id % 4 AS int) WHEN 0 THEN '' WHEN 1 THEN 'captions ' || cast(conv_id AS string) WHEN 2 THEN 'c2' END"
SPOKEN = "CASE cast(conv_id % 3 AS int) WHEN 0 THEN 'heard ' || cast(conv_id AS string) WHEN 1 THEN '' END"


def transcript_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns")).selectExpr(
        "conv_id", f"{CAPTIONS} AS captions", f"{SPOKEN} AS recognised", "CASE WHEN conv_id % 5 = 0 THEN '' ELSE 'T' || cast(conv_id AS string) END AS title", "'/in/talk ' || cast(conv_id AS string) || '.v1.mp3' AS file",
        "cast(turns * 61 AS double) AS seconds", "CASE WHEN conv_id % 2 = 0 THEN 'About it' ELSE '' END AS description",
    )
    return media.transcribed(rows).select("conv_id", "method", "error", "document")


TRANSCRIPTS_SQL = f"""WITH r AS (SELECT conv_id, nullif({CAPTIONS}, '') AS cap, nullif({SPOKEN}, '') AS heard, CASE WHEN conv_id % 5 = 0 THEN 'talk ' || conv_id || '.v1' ELSE 'T' || conv_id END AS title, count(*) * 61 AS s FROM conversations GROUP BY conv_id),
t AS (SELECT *, coalesce(cap, heard) AS said FROM r)
SELECT conv_id, CASE WHEN cap IS NOT NULL THEN 'captions' WHEN heard IS NOT NULL THEN 'recognised' END AS method, CASE WHEN said IS NULL THEN 'empty transcript' END AS error,
  CASE WHEN said IS NOT NULL THEN concat_ws(chr(10), 'Title: ' || title, 'File: talk ' || conv_id || '.v1.mp3', 'Duration: ' || printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60),
    'Transcript method: ' || CASE WHEN cap IS NOT NULL THEN 'captions' ELSE 'recognised' END, CASE WHEN conv_id % 2 = 0 THEN chr(10) || 'Description:' || chr(10) || 'About it' END, chr(10) || '--- TRANSCRIPT ---' || chr(10), said) END AS document FROM t"""


class TitleScorer:
    """Stands in for the extracting model: answers with the title that a request names; fails where there is none."""

    def __call__(self, request: str) -> str:
        title = re.search(r"(?m)^Title: (.*)$", request)
        if not title:
            raise ValueError("no title")
        return f"Reading.\nRESULT:status=extracted\nRESULT:title={title[1]}"


def extraction_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request a row, through a scorer, and its results; a request that fails is a row with its error."""
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", "'url' AS origin", "'article' AS source_type", "url", "CASE WHEN page_id % 6 = 0 THEN '' ELSE 'Page ' || cast(page_id AS string) END AS title")
    asked = rows.select(F.col("page_id").alias("batch"), F.lit(1).cast("long").alias("size"), gateway.request(rows).alias("request"))
    said = scoring.answered(asked, TitleScorer)
    lines = said.select("batch", "error", F.explode(F.split(F.coalesce("answer", F.lit("RESULT:status=failed")), "\n")).alias("line"))
    return gateway.results(lines)[0].withColumnRenamed("batch", "page_id")


EXTRACTION_SQL = """SELECT page_id, NULL AS error, 'status' AS key, 'extracted' AS value FROM pages WHERE page_id % 6 > 0 UNION ALL SELECT page_id, NULL, 'title', 'Page ' || page_id FROM pages WHERE page_id % 6 > 0
UNION ALL SELECT page_id, 'no title', 'status', 'failed' FROM pages WHERE page_id % 6 = 0"""


class RouteScorer:
    """Stands in for the routing model: every third item gets no destination."""

    def __call__(self, request: str) -> str:
        found = re.findall(r"(?m)^ID: (item-(\d+))", request)
        return "\n".join(f'{{"id": "{name}", "reason": "r{number}"}}' if int(number) % 3 == 0 else f'{{"id": "{name}", "destination": "work"}}' for name, number in found)


def routing_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole round: requests, answers, join, frontmatter, and the original's mark after its copy."""
    rows = triage._notes(spark, sf_dir).filter(selection.is_item(F.col("path"), playbook=False) & selection.routable(F.col("fm")))
    items = scoring.in_batches(rows, "path", scoring.ROUTE_BATCH)
    lines = items.select("batch", "item_id", scoring.route_line(F.col("item_id"), F.col("path"), F.col("fm"), F.col("body")).alias("line"))
    said = scoring.answered(scoring.requests(lines, "Items:\n"), RouteScorer)
    joined = scoring.joined_back(items, scoring.answers(said, scoring.ANSWERS["route"]))
    done = joined.withColumn("fm", F.map_from_entries(scoring.routed(F.col("pairs"), F.col("destination"), F.col("reason"))))
    went = F.when(F.element_at("fm", F.lit("destination")) == "work", F.concat(F.lit("/in/work/"), text.basename(F.col("path"))))
    marked = F.map_from_entries(routing.original(F.map_entries("fm").cast("array<struct<k:string,v:string>>"), went))
    return done.select("path", *[F.element_at(marked, F.lit(k)).alias(k) for k in ("destination", "destination_reason", "status", "routed_to")])


ROUND_SQL = f"""{PARSED_SQL}, w AS (SELECT *, ({triage._NUMBER} - 1) % 40 + 1 AS k FROM n WHERE {DUCK_ITEM} AND status = 'classified' AND coalesce(destination, '') = '' AND {DUCK_INT} >= 1)
SELECT path, CASE WHEN k % 3 = 0 THEN 'skip' ELSE 'work' END AS destination, CASE WHEN k % 3 = 0 THEN 'r' || printf('%04d', k) ELSE '' END AS destination_reason, 'routed' AS status,
  CASE WHEN k % 3 > 0 THEN '/in/work/' || split_part(path, '/', -1) END AS routed_to FROM w"""


def limited_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trial import: the first 120 notes that need classification, in batches."""
    rows = triage._notes(spark, sf_dir).filter(selection.is_item(F.col("path")) & selection.needs_classification(F.col("fm"), True))
    return scoring.in_batches(selection.first(rows, 120, text.path_key(F.col("path"))), "path", scoring.CLASSIFY_BATCH).select("path", "batch", "item_id")


LIMITED_SQL = f"{triage.TO_CLASSIFY_SQL} SELECT path, batch, item_id FROM b WHERE k <= 120"


def limited_after_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What auto-skip leaves, the first 100 of it; without a declared `skip` nothing is skipped."""
    rows = triage._notes(spark, sf_dir).filter(selection.routable(F.col("fm"), True))
    known = routing.destinations(spark.createDataFrame([(PROFILES,)], "value string"))
    parts = []
    for name, declared in (("declared", known), ("undeclared", known.filter("destination <> 'skip'"))):
        left = routing.skip_gate(rows, declared, 4).filter("not skipped")
        parts.append(selection.first(left, 100, text.path_key(F.col("path"))).select("path", F.lit(name).alias("profile")))
    return parts[0].unionByName(parts[1])


AFTER_SQL = f"""{PARSED_SQL}, v AS (SELECT path, {DUCK_INT} AS v FROM n WHERE status = 'classified')
SELECT path, 'declared' AS profile FROM (SELECT path FROM v WHERE v >= 4 ORDER BY replace(path, '/', chr(1)) LIMIT 100) UNION ALL SELECT path, 'undeclared' FROM (SELECT path FROM v WHERE v >= 1 ORDER BY replace(path, '/', chr(1)) LIMIT 100)"""


def tab_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first open tabs by their place."""
    return selection.first(library.open_tabs(spark, sf_dir), 15, F.col("seq")).select("url", "seq")


TAB_ORDER_SQL = f"SELECT url, seq FROM ({library.OPEN_SQL}) ORDER BY seq LIMIT 15"


def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "CASE WHEN doc_id % 2 = 0 THEN 'text' ELSE 'idea' END AS origin", "'article' AS source_type", "'T' || cast(doc_id AS string) AS title", "CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END AS content"
    )
    return gateway.dry_run(rows, "content").drop("content", "origin", "source_type", "title")


DRY_SQL = """WITH d AS (SELECT doc_id, nullif(CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END, '') AS content FROM documents)
SELECT doc_id, concat_ws(chr(10), '=== ACTION ===' || chr(10) || 'source-add', 'Origin: ' || CASE WHEN doc_id % 2 = 0 THEN 'text' ELSE 'idea' END, 'Source type: article', 'Title: T' || doc_id,
  chr(10) || '=== CAPTURE CONTEXT ===' || chr(10) || 'Context: personal', 'Session: unknown', 'Intent: none specified') AS request, substr(content, 1, 300) AS preview, coalesce(length(content), 0) AS n_chars FROM d"""


def source_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").selectExpr(
        "page_id", "CASE WHEN page_id % 3 = 0 THEN 'youtube' WHEN page_id % 3 = 1 THEN 'url' ELSE 'ref:vault' END AS origin", "CASE WHEN page_id % 3 = 2 THEN '' ELSE url END AS url",
        "CASE WHEN page_id % 2 = 0 THEN 'Ann: B' ELSE '' END AS author", "'a' || cast(page_id AS string) AS archive", "'Body ' || cast(page_id AS string) AS content",
    ).withColumn("source_type", origins.source_type(F.col("origin")))
    return rows.select("page_id", capture.source_note(rows, day()).alias("note"))


SOURCE_SQL = f"""SELECT page_id, '---' || chr(10) || 'type: source' || chr(10) || 'source_type: ' || CASE page_id % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'article' ELSE 'document' END || chr(10)
  || 'content_format: ' || CASE page_id % 3 WHEN 0 THEN 'transcript' WHEN 1 THEN 'text' ELSE 'reference' END || chr(10) || 'origin: ' || CASE page_id % 3 WHEN 0 THEN 'youtube' WHEN 1 THEN 'url' ELSE '"ref:vault"' END || chr(10)
  || CASE WHEN page_id % 3 = 2 THEN '' ELSE 'url: "' || url || '"' || chr(10) END || CASE WHEN page_id % 2 = 0 THEN 'author: "Ann: B"' || chr(10) ELSE '' END || 'captured: ' || strftime({DAY}, '%Y-%m-%d') || chr(10) || 'captured_by: agent' || chr(10)
  || 'archive: a' || page_id || chr(10) || '---' || chr(10) || 'Body ' || page_id AS note FROM pages"""


def reextracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second extraction replaces the first; folders that are new are added."""
    now = table(spark, sf_dir, "pages").filter("page_id % 3 < 2").selectExpr("page_id AS folder", "'old' AS extract")
    new = table(spark, sf_dir, "pages").filter("page_id % 3 > 0").selectExpr("page_id AS folder", "'new' AS extract")
    return sinks.upserted(now, new, ["folder"])


REEXTRACTED_SQL = "SELECT page_id AS folder, CASE WHEN page_id % 3 > 0 THEN 'new' ELSE 'old' END AS extract FROM pages"


def routing_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by destination and outcome, with writes that failed."""
    return routing.statistics(triage._planned(spark, sf_dir).withColumn("failed", F.col("path").rlike(r"[37]\.md$")))


OUTCOMES_SQL = f"""{triage.PLANNED_SQL} SELECT CASE kind WHEN 'skip' THEN 'skip_marked' WHEN 'knowledge' THEN 'knowledge_queued' ELSE destination || CASE WHEN regexp_matches(path, '[37]\\.md$') THEN '_failed' ELSE '_copied' END END AS key, count(*) AS n
FROM p WHERE kind <> 'unconfigured' GROUP BY 1"""


def batch_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gateway.batch_failures(triage._results(spark, sf_dir))


FAILURES_SQL = "SELECT page_id::INT AS position, '[' || (page_id + 1) || '] P' || page_id || ': gateway failed' AS failure FROM pages WHERE page_id % 41 = 7"


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and vectors, fused; documents and vectors share their numbers here."""
    words = search.bm25(table(spark, sf_dir, "documents"), ["license", "under", "token"], most=20)
    near = search.vector(table(spark, sf_dir, "embeddings"), [1.0 if k % 3 else -0.5 for k in range(64)], most=20).withColumnRenamed("vec_id", "doc_id")
    return search.hybrid(words, near, "doc_id", most=40).select("doc_id", F.round("score", 9).alias("score"))


HYBRID_SQL = f"""WITH words AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({triage.BM25_SQL.replace("SELECT doc_id, round(score, 6) AS score FROM r", "SELECT doc_id, score FROM r")})),
near AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM ({triage.VECTOR_SQL.replace("round(", "(").replace(", 9) AS score", ") AS score").replace("LIMIT 10", "LIMIT 20")}))
SELECT coalesce(w.doc_id, v.doc_id) AS doc_id, round(coalesce(1.0::DOUBLE / (60 + w.r), 0) + coalesce(1.0::DOUBLE / (60 + v.r), 0), 9) AS score FROM words w FULL JOIN near v ON w.doc_id = v.doc_id"""


def reader_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reader's context as a classifier gets it: its first 8,000 characters, which is the feature."""
    rows = table(spark, sf_dir, "documents").select("doc_id", scoring.reader_context(F.concat(F.lit(" \n"), "text")).alias("context"))
    return rows.select("doc_id", F.length("context").cast("long").alias("n"), F.sha2("context", 256).alias("hash"))


READER_SQL = f"""WITH c AS (SELECT doc_id, {duck_strip("substr(' ' || chr(10) || text, 1, 8000)")} AS context FROM documents) SELECT doc_id, length(context) AS n, sha256(context) AS hash FROM c"""

PLANS = {
    "manifest_rows": (manifest_rows, MANIFEST_ROWS_SQL), "templates": (templates, TEMPLATE_SQL), "config_values": (config_values, CONFIG_SQL), "date_texts": (date_texts, WHEN_SQL),
    "origin_rows": (origin_rows, ORIGIN_SQL), "referenced_notes": (referenced_notes, REFERENCE_SQL), "archive_files": (archive_files, ARCHIVE_FILES_SQL), "transcript_documents": (transcript_documents, TRANSCRIPTS_SQL),
    "extraction_round": (extraction_round, EXTRACTION_SQL), "routing_round": (routing_round, ROUND_SQL), "limited_scan": (limited_scan, LIMITED_SQL), "limited_after_skip": (limited_after_skip, AFTER_SQL),
    "tab_order": (tab_order, TAB_ORDER_SQL), "dry_run": (dry_run, DRY_SQL), "source_notes": (source_notes, SOURCE_SQL), "reextracted": (reextracted, REEXTRACTED_SQL), "routing_outcomes": (routing_outcomes, OUTCOMES_SQL),
    "batch_failures": (batch_failures, FAILURES_SQL), "hybrid_search": (hybrid_search, HYBRID_SQL), "reader_contexts": (reader_contexts, READER_SQL),
}
