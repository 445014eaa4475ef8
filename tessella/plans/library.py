"""Queries on captures, notes and status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import extracts, origins, text
from tessella.functions import frontmatter as fmt
from tessella.operators import capture, selection, status
from tessella.operators.numbering import collision_names
from tessella.plans.fixtures import DAY, DEVICES_SQL, PARSED_SQL, TABS_SQL, day, devices, duck_strip, dump_notes, split_select, table, tabs
from tessella.sources.bookmarks import flatten


def capture_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.pages(table(spark, sf_dir, "pages"), day()).drop("content")


DUCK_ORIGIN = "CASE WHEN regexp_matches(url, 'youtube\\.com/watch|youtu\\.be/|youtube\\.com/shorts/') THEN 'youtube' WHEN regexp_matches(url, '\\.pdf(\\?|#|\\z)') THEN 'pdf' ELSE 'url' END"
DUCK_TYPE = "CASE origin WHEN 'youtube' THEN 'video' WHEN 'pdf' THEN 'paper' ELSE 'article' END"

CAPTURE_SQL = f"""WITH c AS (
  SELECT page_id, url, substr(sha256(url), 1, 8) AS hash8, strftime({DAY}, '%Y-%m-%d') || '_' || substr(sha256(url), 1, 8) AS base, {DUCK_ORIGIN} AS origin, octet_length(encode(html)) >= 1000 AS rendered FROM pages
), k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY page_id) AS n FROM c)
SELECT page_id, url, hash8, origin, base || '.html' AS archive, rendered, {DUCK_TYPE} AS source_type,
  CASE WHEN n > 1 THEN base || '-' || n ELSE base END AS folder FROM k"""


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("content"))


def _duck_html() -> str:
    page = "html"
    for tag in text.SCRIPTS:
        page = f"regexp_replace({page}, '<{tag}[^>]*>.*?</{tag}>', '', 'gs')"
    steps = [f"SELECT page_id, {page} AS h FROM pages", "SELECT page_id, CASE WHEN regexp_matches(h, '<body[^>]*>.*</body>', 's') THEN regexp_extract(h, '<body[^>]*>(.*)</body>', 1, 's') ELSE h END AS h FROM a"]
    body = f"regexp_replace(regexp_replace(h, '</?({text.LINE_TAGS})[^>]*>', chr(10), 'gi'), '<[^>]+>', ' ', 'g')"
    for entity, plain in text.ENTITIES:
        body = f"replace({body}, '{entity}', '{plain}')"
    steps.append(f"SELECT page_id, string_split(regexp_replace({body}, '[ \\t]+', ' ', 'g'), chr(10)) AS lines FROM b")
    last = f"array_to_string([{duck_strip('l')} FOR l IN lines IF length({duck_strip('l')}) > 2], chr(10) || chr(10))"
    return f"WITH a AS ({steps[0]}), b AS ({steps[1]}), c AS ({steps[2]}) SELECT page_id, {last} AS content FROM c"


VARIANT = """CASE cast(page_id % 9 AS int) WHEN 0 THEN url || '.pdf' WHEN 1 THEN url || '.pdf?v=2' WHEN 2 THEN url || '.PDF' WHEN 3 THEN 'https://youtu.be/' || cast(page_id AS string)
  WHEN 4 THEN 'https://www.youtube.com/shorts/x' WHEN 5 THEN url || '.pdf#a' WHEN 6 THEN 'https://z.example/?u=youtu.be/' WHEN 7 THEN 'https://youtube.com/embed/x' ELSE url || '.pdfx' END"""


def detect_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", f"{VARIANT} AS url").withColumn("origin", origins.url_origin(F.col("url")))
    return rows.withColumn("source_type", origins.source_type(F.col("origin")))


DETECT_SQL = f"WITH v AS (SELECT page_id, {VARIANT} AS url FROM pages), o AS (SELECT *, {DUCK_ORIGIN} AS origin FROM v) SELECT *, {DUCK_TYPE} AS source_type FROM o"

VIDEO = """CASE cast(page_id % 4 AS int) WHEN 0 THEN 'https://youtube.com/watch?v=' || substr({h}, 1, 11) WHEN 1 THEN 'https://youtu.be/' || substr({h}, 1, 11)
  WHEN 2 THEN 'https://youtube.com/shorts/' || substr({h}, 1, 11) ELSE 'https://youtu.be/abc' END"""


def video_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", f"{VIDEO.format(h='sha2(url, 256)')} AS video")
    return rows.withColumn("video_id", origins.video_id(F.col("video")))


VIDEO_SQL = f"WITH v AS (SELECT page_id, {VIDEO.format(h='sha256(url)')} AS video FROM pages) SELECT *, nullif(regexp_extract(video, '(?:v=|youtu\\.be/|shorts/)([a-zA-Z0-9_-]{{11}})', 1), '') AS video_id FROM v"


def archive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", text.archive_name(day(), F.concat(F.lit("t"), F.col("page_id") % 40), F.lit("txt")).alias("archive"))
    return capture.archived(rows, F.col("page_id"))


ARCHIVE_SQL = f"""SELECT max(page_id) AS page_id, strftime({DAY}, '%Y-%m-%d') || '_' || substr(sha256('t' || (page_id % 40)::VARCHAR), 1, 8) || '.txt' AS archive FROM pages GROUP BY 2"""


def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("n"), F.col("page_id") % 17).alias("name"))
    return collision_names(rows, "name", F.col("page_id"), "unique_name", ext=".md")


COLLISION_SQL = """WITH r AS (SELECT page_id, 'n' || (page_id % 17)::VARCHAR AS name FROM pages), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY page_id) AS n FROM r)
SELECT page_id, name, CASE WHEN n > 1 THEN name || '-' || n ELSE name END || '.md' AS unique_name FROM k"""

EXTRACT = """CASE WHEN page_id % 5 = 0 THEN null ELSE '---' || chr(10) || 'status: ' || CASE WHEN page_id % 3 = 0 THEN 'captured' ELSE 'extracted' END || chr(10)
  || CASE WHEN page_id % 7 = 0 THEN '' ELSE 'title: "Page "' || cast(page_id AS string) || chr(10) END || '---' || chr(10) || 'Body' END"""
FOLDER = "CASE WHEN page_id % 10 = 9 THEN 'misc-' ELSE '2026-01-' END || right('00' || cast(page_id % 28 + 1 AS string), 2) || '_' || cast(page_id AS string)"


def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr(f"{FOLDER} AS folder", f"{EXTRACT} AS extract")


def status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.totals(_library(spark, sf_dir))


TOTALS_SQL = f"SELECT count(DISTINCT {FOLDER}) AS total, count(CASE WHEN regexp_matches({EXTRACT}, '(?m)^status: extracted') THEN 1 END) AS extracted FROM pages"


def status_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.recent(_library(spark, sf_dir))


RECENT_SQL = f"""WITH l AS (SELECT {FOLDER} AS folder, {EXTRACT} AS extract FROM pages)
SELECT folder, CASE WHEN coalesce(regexp_matches(extract, '(?m)^title:'), false) THEN replace(regexp_extract(extract, '(?m)^title:[ \\t]*(.*)$', 1), '"', '') ELSE 'untitled' END AS title
FROM l WHERE folder LIKE '20%' ORDER BY folder DESC LIMIT 5"""


def dump_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    rows = dump_notes(spark, sf_dir).select("doc_id", fmt.has_block(c).alias("fronted"), fmt.parsed(c).alias("fm"), fmt.body(c).alias("body"))
    keys = ["type", "source", "title", "url", "status", "value", "category", "domain", "destination"]
    return rows.select("doc_id", "fronted", F.sha2("body", 256).alias("body_hash"), *[F.element_at("fm", F.lit(k)).alias(k) for k in keys])


FRONTMATTER_SQL = f"{PARSED_SQL} SELECT doc_id, fronted, sha256(body) AS body_hash, type, source, title, url, status, value, category, domain, destination FROM n"


def dump_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    rows = dump_notes(spark, sf_dir).filter(fmt.has_block(c)).select("doc_id", fmt.updated(fmt.pairs(c), status=F.lit("routed"), routed_to=F.lit("a: b")).alias("pairs"), fmt.body(c).alias("body"))
    return rows.select("doc_id", fmt.serialized_pairs(F.col("pairs"), F.col("body")).alias("content"))


def _duck_line(key: str, value: str) -> str:
    escaped = f"replace(replace({value}, '\\', '\\\\'), '\"', '\\\"')"
    return f"CASE WHEN {value} IS NULL THEN '' ELSE '{key}: ' || CASE WHEN regexp_matches({value}, '[:\"''#\\n]') THEN '\"' || {escaped} || '\"' ELSE {value} END || chr(10) END"


REWRITTEN_SQL = f"""{PARSED_SQL} SELECT doc_id, '---' || chr(10) || {" || ".join(_duck_line(k, k) for k in ("type", "source", "title", "url"))} || 'status: routed' || chr(10)
  || {" || ".join(_duck_line(k, k) for k in ("value", "category", "domain", "destination"))} || 'routed_to: "a: b"' || chr(10) || '---' || chr(10) || regexp_replace(body, '^\\n+', '') AS content FROM n WHERE fronted"""


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


SLUG_SQL = f"""SELECT doc_id, coalesce(nullif(substr(regexp_replace({duck_strip("regexp_replace(text, '[^\\p{L}\\p{N}_\\s-]', '', 'g')")}, '[-\\s]+', '-', 'g'), 1, 80), ''), 'untitled') AS slug FROM documents"""


def open_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.open_tabs(tabs(spark, sf_dir))


_DATE = "CASE WHEN seconds IS NULL OR seconds = 0 THEN '' ELSE strftime(TIMESTAMP '2001-01-01' + to_seconds(seconds), '%Y-%m-%d') END AS date_added"
OPEN_SQL = f"""SELECT 'open-tabs' AS kind, url, coalesce(nullif(title, ''), url) AS title, '' AS uuid, '' AS preview, {_DATE}, 'open-tabs' AS folder, page_id AS seq
FROM ({TABS_SQL}) WHERE url ILIKE 'http%' AND NOT deleted AND NOT closed"""


def cloud_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.cloud_tabs(tabs(spark, sf_dir).withColumnRenamed("last_modified", "last_viewed_time"), devices(spark))


CLOUD_SQL = f"""SELECT 'cloud-tabs' AS kind, url, coalesce(nullif(title, ''), url) AS title, '' AS uuid, '' AS preview, {_DATE},
  'cloud-tabs / ' || coalesce(nullif(device_name, ''), 'unknown-device') AS folder
FROM ({TABS_SQL}) t LEFT JOIN {DEVICES_SQL} ON t.device_uuid = d.device_uuid WHERE starts_with(url, 'http')"""


def per_kind_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", "'k' || cast(page_id % 3 AS string) AS kind")
    return capture.limited(rows, 7, order="page_id")


LIMIT_SQL = "SELECT page_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY page_id) AS n FROM (SELECT page_id, 'k' || (page_id % 3)::VARCHAR AS kind FROM pages)) WHERE n <= 7"


def bookmark_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", "'bookmarks' AS kind", "'https://b.example/' || cast(page_id % 50 AS string) AS url", "'Title ' || cast(page_id % 100 AS string) AS title")
    existing = spark.range(10).select(F.lit("bookmarks").alias("kind"), capture.note_name(F.concat(F.lit("https://b.example/"), "id"), F.concat(F.lit("Title "), "id")).alias("name"))
    return capture.first_notes(rows, F.col("page_id"), existing)


DEDUPE_SQL = """WITH r AS (SELECT page_id, 'bookmarks' AS kind, 'https://b.example/' || (page_id % 50)::VARCHAR AS url, 'Title ' || (page_id % 100)::VARCHAR AS title FROM pages),
m AS (SELECT *, substr(sha256(url), 1, 8) || '-' || replace(title, ' ', '-') || '.md' AS name FROM r),
e AS (SELECT substr(sha256('https://b.example/' || i::VARCHAR), 1, 8) || '-Title-' || i::VARCHAR || '.md' AS name FROM range(10) AS x(i))
SELECT page_id, kind, url, title, name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY page_id) AS n FROM m WHERE name NOT IN (SELECT name FROM e)) WHERE n = 1"""


def dump_note_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = open_tabs(spark, sf_dir).withColumn("preview", F.when(F.col("seq") % 3 == 0, "Some preview").otherwise(""))
    return rows.select("seq", capture.note().alias("note"))


NOTE_SQL = f"""SELECT seq, '---' || chr(10) || 'type: dump-item' || chr(10) || 'source: safari-open-tabs' || chr(10) || 'url: "' || url || '"' || chr(10) || 'title: "' || title || '"' || chr(10)
  || 'uuid: ""' || chr(10) || 'date_added: "' || date_added || '"' || chr(10) || 'folder: "open-tabs"' || chr(10) || 'status: unclassified' || chr(10) || 'category: ' || chr(10) || 'domain: ' || chr(10) || 'value: ' || chr(10) || 'reason: ' || chr(10) || '---' || chr(10)
  || chr(10) || '# ' || title || chr(10) || chr(10) || '**URL:** ' || url || chr(10) || CASE WHEN seq % 3 = 0 THEN chr(10) || '## Preview' || chr(10) || chr(10) || 'Some preview' || chr(10) ELSE '' END
  || chr(10) || '**Folder:** open-tabs' || chr(10) AS note FROM ({OPEN_SQL})"""


NODE = """page_id AS id, CASE WHEN page_id > 0 THEN cast(floor(page_id / 5) AS bigint) END AS parent_id, CASE WHEN page_id >= 60 THEN 'WebBookmarkTypeLeaf' ELSE 'WebBookmarkTypeList' END AS type,
  CASE WHEN page_id % 4 = 3 THEN '' WHEN page_id = 8 THEN 'com.apple.ReadingList' ELSE 'F' || cast(page_id AS string) END AS title, CASE WHEN page_id % 50 = 9 THEN '' ELSE url END AS url,
  CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 5 = 1 THEN null ELSE 'B' || cast(page_id AS string) END AS uri_title, 'u' || cast(page_id AS string) AS uuid, CASE WHEN page_id % 6 = 0 THEN 'p' END AS preview,
  CASE WHEN page_id % 4 = 0 THEN TIMESTAMP '2026-01-02 10:00:00' END AS reading_added, CASE WHEN page_id % 4 = 1 THEN TIMESTAMP '2025-05-06 00:00:00' END AS added"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of a tree of all pages: from 60 on a page is a leaf, and a page's children have five times its number and up to four more."""
    return flatten(table(spark, sf_dir, "pages").selectExpr(*split_select(NODE)))


def bookmark_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).select("id", "url", F.array_join("folders", " / ").alias("folder"), selection.in_reading_list(F.col("folders")).alias("reading_list"))


WALK_SQL = f"""WITH RECURSIVE nodes AS (SELECT {NODE} FROM pages), walk AS (
  SELECT id, title AS folder FROM nodes WHERE parent_id IS NULL AND type = 'WebBookmarkTypeList'
  UNION ALL
  SELECT n.id, CASE WHEN n.title = '' THEN w.folder WHEN w.folder = '' THEN n.title ELSE w.folder || ' / ' || n.title END FROM nodes n JOIN walk w ON n.parent_id = w.id WHERE n.type = 'WebBookmarkTypeList'
), leaves AS (SELECT n.*, w.folder FROM nodes n JOIN walk w ON n.parent_id = w.id WHERE n.type = 'WebBookmarkTypeLeaf')"""
TREE_SQL = f"{WALK_SQL} SELECT id, url, folder, contains(folder, 'com.apple.ReadingList') AS reading_list FROM leaves"


def bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.bookmarks(_tree(spark, sf_dir))


BOOKMARKS_SQL = f"""{WALK_SQL} SELECT CASE WHEN contains(folder, 'com.apple.ReadingList') THEN 'reading-list' ELSE 'bookmarks' END AS kind, url, coalesce(nullif(uri_title, ''), url) AS title, uuid, coalesce(preview, '') AS preview,
  coalesce(strftime(coalesce(reading_added, added), '%Y-%m-%d'), '') AS date_added, folder FROM leaves WHERE url <> ''"""


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = cloud_tabs(spark, sf_dir).withColumn("seq", F.xxhash64("url"))
    return capture.union(open_tabs(spark, sf_dir), cloud, bookmarks(spark, sf_dir))


def capture_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.counts(_captures(spark, sf_dir), ["reading-list", "bookmarks", "open-tabs", "cloud-tabs"])


COUNTS_SQL = f"""SELECT k AS kind, count(c.kind)::BIGINT AS n FROM (VALUES ('reading-list'), ('bookmarks'), ('open-tabs'), ('cloud-tabs')) AS v(k)
LEFT JOIN (SELECT kind FROM ({OPEN_SQL}) UNION ALL SELECT kind FROM ({CLOUD_SQL}) UNION ALL SELECT kind FROM ({BOOKMARKS_SQL})) c ON v.k = c.kind GROUP BY k"""

IDEA_BODY = """'### Key Ideas' || chr(10) || '- **Idea ' || cast(doc_id AS string) || '** #' || CASE WHEN doc_id % 3 = 0 THEN 'Tools' ELSE 'tools/' || lang END || ' — ' || replace(text, chr(10), ' ') || chr(10)
  || CASE WHEN doc_id % 2 = 0 THEN '- **Second** #career — short claim' || chr(10) ELSE '' END || '### Connections' || chr(10) || '- [[topic ' || cast(doc_id % 7 AS string) || ']] — because' || chr(10) || '- [[' || lang || ']]' || chr(10)
  || '### Raw Quotes' || chr(10) || '> "Said ' || cast(doc_id AS string) || '" — Someone' || chr(10)"""


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{IDEA_BODY} AS body", "CASE cast(doc_id % 4 AS int) WHEN 0 THEN 'idea' WHEN 1 THEN 'article' WHEN 2 THEN 'conversation' ELSE 'unknown' END AS kind")


def key_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracts.key_ideas(_bodies(spark, sf_dir), "body", "doc_id")


_IDEA = "(?m)^- \\*\\*(.+?)\\*\\* #(\\S+) — (.+)$"
IDEAS_SQL = f"""WITH b AS (SELECT doc_id, {IDEA_BODY} AS body FROM documents),
x AS (SELECT doc_id, unnest(range(len(t))) AS i, t, d, c FROM (SELECT doc_id, regexp_extract_all(body, '{_IDEA}', 1) AS t, regexp_extract_all(body, '{_IDEA}', 2) AS d, regexp_extract_all(body, '{_IDEA}', 3) AS c FROM b)),
y AS (SELECT doc_id, i::INT AS position, t[i + 1] AS title, d[i + 1] AS domain, c[i + 1] AS claim FROM x)
SELECT *, len(regexp_split_to_array({duck_strip("claim")}, '\\s+'))::INT AS words, regexp_matches(domain, '^[a-z0-9-]+(/[a-z0-9-]+)*$') AS domain_ok, len(regexp_split_to_array({duck_strip("claim")}, '\\s+')) <= 16 AS claim_ok FROM y"""


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = extracts.connections(_bodies(spark, sf_dir), "body", "doc_id")
    return edges.groupBy("topic").agg(F.count("*").alias("n"), F.count_if(F.col("why") != "").alias("explained"))


CONNECTIONS_SQL = """WITH t AS (SELECT 'topic ' || (doc_id % 7)::VARCHAR AS topic, 1 AS e FROM documents UNION ALL SELECT lang, 0 FROM documents) SELECT topic, count(*) AS n, sum(e)::BIGINT AS explained FROM t GROUP BY topic"""


def idea_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bodies(spark, sf_dir).select("doc_id", "kind", *extracts.conformance(F.col("body"), F.col("kind")))


CONFORMANCE_SQL = f"""WITH b AS (SELECT doc_id, {IDEA_BODY} AS body, CASE doc_id % 4 WHEN 0 THEN 'idea' WHEN 1 THEN 'article' WHEN 2 THEN 'conversation' ELSE 'unknown' END AS kind FROM documents),
c AS (SELECT doc_id, kind, len(regexp_extract_all(body, '{_IDEA}', 1))::INT AS i, len(regexp_extract_all(body, '\\[\\[([^\\]]+)\\]\\]', 1))::INT AS l, len(regexp_extract_all(body, '(?m)^> "(.+?)"', 1))::INT AS q FROM b)
SELECT doc_id, kind, i AS n_ideas, CASE kind WHEN 'idea' THEN i BETWEEN 1 AND 3 WHEN 'article' THEN i BETWEEN 3 AND 15 WHEN 'conversation' THEN i BETWEEN 2 AND 10 END AS ideas_ok,
  l AS n_connections, CASE kind WHEN 'idea' THEN l BETWEEN 1 AND 3 WHEN 'article' THEN l BETWEEN 2 AND 5 WHEN 'conversation' THEN l BETWEEN 1 AND 3 END AS connections_ok,
  q AS n_quotes, CASE kind WHEN 'idea' THEN q = 0 WHEN 'article' THEN q BETWEEN 3 AND 5 WHEN 'conversation' THEN q = 0 END AS quotes_ok FROM c"""


def section_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _bodies(spark, sf_dir).select("doc_id", extracts.sections(F.col("body")).alias("s"))
    return found.select("doc_id", F.element_at("s", F.lit("Connections")).alias("connections"), F.element_at("s", F.lit("Missing")).alias("missing"), F.size("s").alias("n"))


SECTION_SQL = "SELECT doc_id, '- [[topic ' || (doc_id % 7)::VARCHAR || ']] — because' || chr(10) || '- [[' || lang || ']]' AS connections, NULL::VARCHAR AS missing, 3 AS n FROM documents"


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dump_notes(spark, sf_dir).select("doc_id", fmt.parsed(F.col("content")).alias("fm"))
    has = fmt.has(F.col("fm"), "value")
    return rows.select(
        "doc_id", status.dump_status(fmt.value(F.col("fm"), "status"), has, F.col("doc_id") % 20 == 0).alias("dump_state"),
        status.vault_status(F.col("doc_id") % 3 > 0, F.col("doc_id") % 10 == 0).alias("vault_state"),
    )


LIFECYCLE_SQL = f"""{PARSED_SQL} SELECT doc_id, CASE WHEN status IN ('keep', 'skip', 'maybe') THEN status WHEN doc_id % 20 = 0 THEN 'routed' WHEN value IS NOT NULL THEN 'classified' ELSE coalesce(nullif(status, ''), 'unclassified') END AS dump_state,
  CASE WHEN doc_id % 10 = 0 THEN 'integrated' WHEN doc_id % 3 > 0 THEN 'extracted' ELSE 'captured' END AS vault_state FROM n"""


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dump_notes(spark, sf_dir).select(fmt.parsed(F.col("content")).alias("fm"))
    return status.dashboard(rows.select(fmt.value(F.col("fm"), "status", "none").alias("status"), fmt.value(F.col("fm"), "destination", "none").alias("destination")))


DASHBOARD_SQL = f"{PARSED_SQL} SELECT status, destination, count(*) AS n FROM (SELECT coalesce(status, 'none') AS status, coalesce(destination, 'none') AS destination FROM n) GROUP BY CUBE (status, destination)"

def dashboard_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    fm = F.col("fm")
    rows = dump_notes(spark, sf_dir).select("doc_id", fmt.parsed(F.col("content")).alias("fm"))
    fields = [F.element_at(fm, F.lit(k)).alias(k) for k in ("status", "type", "domain", "title", "source", "reason")]
    return status.by_domain(rows.select(*fields, fmt.integer(fm, "value").alias("value")))


VIEW_SQL = f"""{PARSED_SQL} SELECT domain, title, source, NULL::VARCHAR AS reason FROM n WHERE status = 'classified' AND type = 'dump-item' AND value = '5'"""


def kind_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = selection.wanted_kinds(F.col("kind"), only=["open-tabs", "cloud-tabs"], skip=["cloud-tabs"])
    return _captures(spark, sf_dir).filter(kept).select("kind", "url")


KIND_SQL = f"SELECT kind, url FROM ({OPEN_SQL})"

PLANS = {
    "capture_pages": (capture_pages, CAPTURE_SQL), "page_text": (page_text, _duck_html()), "detect_origin": (detect_origin, DETECT_SQL), "video_ids": (video_ids, VIDEO_SQL),
    "archive_names": (archive_names, ARCHIVE_SQL), "collision_names": (collisions, COLLISION_SQL), "status_totals": (status_totals, TOTALS_SQL), "status_recent": (status_recent, RECENT_SQL),
    "dump_frontmatter": (dump_frontmatter, FRONTMATTER_SQL), "dump_rewritten": (dump_rewritten, REWRITTEN_SQL), "slugs": (slugs, SLUG_SQL), "open_tabs": (open_tabs, OPEN_SQL),
    "cloud_tabs": (cloud_tabs, CLOUD_SQL), "capture_counts": (capture_counts, COUNTS_SQL), "per_kind_limit": (per_kind_limit, LIMIT_SQL), "bookmark_dedupe": (bookmark_dedupe, DEDUPE_SQL),
    "dump_note_texts": (dump_note_texts, NOTE_SQL), "bookmark_tree": (bookmark_tree, TREE_SQL), "bookmarks": (bookmarks, BOOKMARKS_SQL), "key_ideas": (key_ideas, IDEAS_SQL), "connections": (connections, CONNECTIONS_SQL),
    "idea_conformance": (idea_conformance, CONFORMANCE_SQL), "section_map": (section_map, SECTION_SQL), "lifecycle": (lifecycle, LIFECYCLE_SQL), "dashboard": (dashboard, DASHBOARD_SQL),
    "dashboard_view": (dashboard_view, VIEW_SQL), "kind_selection": (kind_selection, KIND_SQL),
}
