"""Queries on classification, routing, batches, media and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import frontmatter as fmt
from tessella.functions import text
from tessella.operators import capture, gateway, routing, scoring, search, selection
from tessella.plans.fixtures import (
    DAY,
    DUCK_FILE_TITLE,
    DUCK_INT,
    DUCK_ITEM,
    DUCK_STEM,
    PARSED_SQL,
    PROFILES,
    TARGETS,
    day,
    duck_strip,
    dump_notes,
    split_select,
    table,
)
from tessella.sources import media


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.notes(dump_notes(spark, sf_dir))


def needs_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    fm = F.col("fm")
    return _notes(spark, sf_dir).select(
        "path", selection.is_item(F.col("path")).alias("item"), selection.needs_classification(fm, True).alias("wide"), selection.needs_classification(fm, False).alias("narrow")
    )


def _needs(wide: str) -> str:
    return f"CASE WHEN NOT fronted THEN {wide} WHEN coalesce(status, '') IN ('classified', 'skip', 'keep') THEN false WHEN status = 'unclassified' THEN true ELSE {wide} AND value IS NULL END"


NEEDS_SQL = f"{PARSED_SQL} SELECT path, {DUCK_ITEM} AS item, {_needs('true')} AS wide, {_needs('false')} AS narrow FROM n"


def routable_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    fm = F.col("fm")
    return _notes(spark, sf_dir).select(
        "path", selection.is_item(F.col("path"), playbook=False, meta=False).alias("item"), selection.routable(fm).alias("routable"), selection.routable(fm, True).alias("rerouted"),
        selection.executable(fm).alias("executable"), selection.executable(fm, "work").alias("to_work"), fmt.integer(fm, "value").alias("value"),
    )


ROUTABLE_SQL = f"""{PARSED_SQL}, c AS (SELECT *, coalesce(status = 'classified', false) AS done, {DUCK_INT} AS v, coalesce(destination, '') AS d FROM n)
SELECT path, {DUCK_ITEM} AND NOT contains(lower(split_part(path, '/', -1)), 'playbook') AS item, done AND d = '' AND v >= 1 AS routable, done AND v >= 1 AS rerouted,
  done AND d <> '' AS executable, done AND d = 'work' AS to_work, v AS value FROM c"""


def _to_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _notes(spark, sf_dir).filter(selection.is_item(F.col("path")) & selection.needs_classification(F.col("fm"), True))
    return scoring.in_batches(rows, "path", scoring.CLASSIFY_BATCH)


def classify_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _to_classify(spark, sf_dir).select("path", "batch", "item_id", scoring.classify_line(F.col("item_id"), F.col("path"), F.col("fm"), F.col("body")).alias("line"))


_NUMBER = "row_number() OVER (ORDER BY replace(path, '/', chr(1)))"
_PREVIEW = f"""substr(CASE WHEN regexp_extract(body, '(?s)## Preview\\s*\\n\\n(.+?)(?:\\n\\n|\\z)', 1) <> '' THEN {duck_strip("regexp_extract(body, '(?s)## Preview\\s*\\n\\n(.+?)(?:\\n\\n|\\z)', 1)")}
  WHEN NOT fronted THEN {duck_strip(f"replace(substr({duck_strip('body')}, 1, 400), chr(10), ' ')")} ELSE '' END, 1, 300)"""
TO_CLASSIFY_SQL = f"""{PARSED_SQL}, w AS (SELECT *, {_NUMBER} AS k FROM n WHERE {DUCK_ITEM} AND {_needs('true')}),
b AS (SELECT *, (k - 1) // 50 + 1 AS batch, printf('item-%04d', (k - 1) % 50 + 1) AS item_id, {_PREVIEW} AS preview FROM w),
l AS (SELECT path, batch, item_id, concat_ws(' | ', 'ID: ' || item_id, 'TITLE: ' || substr(coalesce(nullif(title, ''), {DUCK_FILE_TITLE}), 1, 150), 'URL: ' || nullif(url, ''), 'PREVIEW: ' || nullif(preview, '')) AS line FROM b)"""
CLASSIFY_SQL = f"{TO_CLASSIFY_SQL} SELECT path, batch, item_id, line FROM l"


def classify_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = scoring.requests(classify_requests(spark, sf_dir), "Items:\n")
    return asked.select("batch", "size", F.sha2("request", 256).alias("request_hash"))


BATCHES_SQL = f"{TO_CLASSIFY_SQL} SELECT batch, count(*) AS size, sha256('Items:' || chr(10) || string_agg(line, chr(10) ORDER BY item_id)) AS request_hash FROM l GROUP BY batch"


def route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _notes(spark, sf_dir).filter(selection.is_item(F.col("path"), playbook=False) & selection.routable(F.col("fm")))
    rows = scoring.in_batches(rows, "path", scoring.ROUTE_BATCH)
    return rows.select("path", "batch", "item_id", scoring.route_line(F.col("item_id"), F.col("path"), F.col("fm"), F.col("body")).alias("line"))


_BODY_PREVIEW = duck_strip(f"replace(substr({duck_strip('body')}, 1, 200), chr(10), ' ')")
ROUTE_SQL = f"""{PARSED_SQL}, w AS (SELECT *, {_NUMBER} AS k FROM n WHERE {DUCK_ITEM} AND status = 'classified' AND coalesce(destination, '') = '' AND {DUCK_INT} >= 1),
b AS (SELECT *, (k - 1) // 40 + 1 AS batch, printf('item-%04d', (k - 1) % 40 + 1) AS item_id FROM w)
SELECT path, batch, item_id, concat_ws(' | ', 'ID: ' || item_id, 'FOLDER: ' || array_to_string(string_split(path, '/')[-3:-2], '/'), 'TITLE: ' || substr(coalesce(nullif(title, ''), {DUCK_STEM}), 1, 120),
  'URL: ' || nullif(url, ''), 'CAT: ' || nullif(category, ''), 'DOMAIN: ' || nullif(domain, ''), 'PREVIEW: ' || nullif({_BODY_PREVIEW}, '')) AS line FROM b"""

#: Model output for a batch of ten items, as it may come: talk, a fence, broken lines, unknown and repeated ids.
ANSWER = """'Here you are:' || chr(10) || '```' || chr(10)
  || CASE WHEN doc_id % 4 = 3 THEN '{"id": "item-broken", "category":' ELSE '  {"id": "item-' || right('0000' || cast(doc_id % 10 + 1 AS string), 4) || '", "category": "tech", "value": ' || cast(doc_id % 6 AS string) || ', "reason": "r' || cast(doc_id AS string) || '"}' END || chr(10)
  || CASE WHEN doc_id % 5 = 0 THEN '{"id": "item-9999", "category": "other"}' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 6 = 0 THEN '{"id": "item-' || right('0000' || cast(doc_id % 10 + 1 AS string), 4) || '", "category": "late", "value": "5"}' || chr(10) ELSE '' END || '```'"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "documents").selectExpr("doc_id AS batch", f"{ANSWER} AS answer")
    return scoring.answers(said, scoring.ANSWERS["classify"])


def response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("batch", "line_no", "id", "category", "value", "reason")


ANSWERS_SQL = f"""WITH s AS (SELECT doc_id AS batch, string_split({ANSWER}, chr(10)) AS lines FROM documents),
x AS (SELECT batch, unnest(range(len(lines))) AS i, lines FROM s), y AS (SELECT batch, i::INT AS line_no, trim(lines[i + 1]) AS line FROM x),
a AS (SELECT batch, line_no, json_extract_string(line, '$.id') AS id, json_extract_string(line, '$.category') AS category, json_extract_string(line, '$.value') AS value, json_extract_string(line, '$.reason') AS reason
  FROM (SELECT *, CASE WHEN json_valid(line) THEN line END AS ok FROM y) WHERE ok IS NOT NULL AND starts_with(line, '{{'))"""
RESPONSE_SQL = f"{ANSWERS_SQL} SELECT batch, line_no, id, category, value, reason FROM a"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS batch", "explode(sequence(1, 10)) AS i").select("batch", F.format_string("item-%04d", "i").alias("item_id"))


def join_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = scoring.joined_back(_items(spark, sf_dir), _answers(spark, sf_dir))
    return joined.select("batch", "item_id", "category", F.coalesce("value", F.lit("1")).alias("value"), F.coalesce("reason", F.lit("")).alias("reason"))


JOIN_SQL = f"""{ANSWERS_SQL}, z AS (SELECT *, row_number() OVER (PARTITION BY batch, id ORDER BY line_no DESC) AS k FROM a)
SELECT batch, id AS item_id, category, coalesce(value, '1') AS value, coalesce(reason, '') AS reason FROM z WHERE k = 1 AND id BETWEEN 'item-0001' AND 'item-0010'"""


def missing_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.accounts(_items(spark, sf_dir), _answers(spark, sf_dir))


MISSING_SQL = f"""{ANSWERS_SQL} SELECT doc_id AS batch, 10::BIGINT AS size, coalesce(n, 0) AS applied, 10 - coalesce(n, 0) AS missing
FROM documents LEFT JOIN (SELECT batch, count(DISTINCT id) AS n FROM a WHERE id BETWEEN 'item-0001' AND 'item-0010' GROUP BY batch) t ON doc_id = t.batch"""


def classified_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole round with the stub: requests, answers, join, frontmatter."""
    items = _to_classify(spark, sf_dir)
    lines = items.select("batch", "item_id", scoring.classify_line(F.col("item_id"), F.col("path"), F.col("fm"), F.col("body")).alias("line"))
    said = scoring.answered(scoring.requests(lines, "Items:\n"), lambda: scoring.StubScorer(category="tech", value="3"))
    joined = scoring.joined_back(items, scoring.answers(said, scoring.ANSWERS["classify"]))
    pairs = scoring.classified(F.col("pairs"), F.col("path"), F.col("category"), F.col("domain"), F.col("value"), F.col("reason"))
    fm = F.map_from_entries("new")
    done = joined.withColumn("new", pairs)
    return done.select("path", *[F.element_at(fm, F.lit(k)).alias(k) for k in ("type", "source", "title", "category", "domain", "value", "reason", "status")])


CLASSIFIED_SQL = f"""{PARSED_SQL} SELECT path, CASE WHEN fronted THEN type ELSE 'dump-item' END AS type, CASE WHEN fronted THEN source ELSE 'apple-notes' END AS source,
  CASE WHEN fronted THEN title ELSE {DUCK_FILE_TITLE} END AS title, 'tech' AS category, '' AS domain, '3' AS value, '' AS reason, 'classified' AS status FROM n WHERE {DUCK_ITEM} AND {_needs('true')}"""


def auto_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _notes(spark, sf_dir).filter(selection.routable(F.col("fm"), True))
    low = routing.low_value(F.col("fm"), 4)
    new = F.when(low, routing.auto_skipped(F.col("pairs"), F.col("fm"), 4)).otherwise(F.col("pairs"))
    fm = F.map_from_entries(new)
    return rows.select("path", low.alias("skipped"), *[F.element_at(fm, F.lit(k)).alias(k) for k in ("destination", "reason", "destination_reason")])


AUTO_SQL = f"""{PARSED_SQL}, v AS (SELECT *, {DUCK_INT} AS v FROM n WHERE status = 'classified')
SELECT path, v < 4 AS skipped, CASE WHEN v < 4 THEN 'skip' ELSE destination END AS destination, CASE WHEN v < 4 THEN 'below min_value threshold' END AS reason,
  CASE WHEN v < 4 THEN 'auto-skip: value ' || v || ' < 4' END AS destination_reason FROM v WHERE v >= 1"""


def _targets(spark: SparkSession) -> DataFrame:
    return routing.targets_table(spark, TARGETS)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir).withColumn("destination", fmt.value(F.col("fm"), "destination"))


def route_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = routing.destinations(spark.createDataFrame([(PROFILES,)], "value string"))
    return routing.distribution(_placed(spark, sf_dir), known).select("destination", "n", "known")


DISTRIBUTION_SQL = f"""{PARSED_SQL}, k AS (SELECT * FROM (VALUES ('work'), ('knowledge'), ('skip'), ('empty-one')) AS t(destination)),
c AS (SELECT destination, count(*) AS n FROM n WHERE destination <> '' GROUP BY destination)
SELECT coalesce(k.destination, c.destination) AS destination, coalesce(n, 0) AS n, k.destination IS NOT NULL AS known FROM k FULL JOIN c ON k.destination = c.destination
UNION ALL SELECT 'TOTAL', count(*), true FROM n WHERE destination <> ''"""


def routing_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.breakdown(_placed(spark, sf_dir).filter(selection.executable(F.col("fm"))), _targets(spark)).select("destination", "n", "known")


BREAKDOWN_SQL = f"""{PARSED_SQL}, k AS (SELECT * FROM (VALUES ('knowledge'), ('skip'), ('work'), ('home'), ('later')) AS t(destination)),
c AS (SELECT destination, count(*) AS n FROM n WHERE destination <> '' AND status = 'classified' GROUP BY destination)
SELECT coalesce(k.destination, c.destination) AS destination, coalesce(n, 0) AS n, k.destination IS NOT NULL AS known FROM k FULL JOIN c ON k.destination = c.destination"""


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _placed(spark, sf_dir).filter(selection.is_item(F.col("path"), meta=False) & selection.executable(F.col("fm")))
    return routing.plan(rows, _targets(spark))


def routing_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir).select("path", "destination", "kind", "target")


PLANNED_SQL = f"""{PARSED_SQL}, p AS (SELECT n.*, CASE n.destination WHEN 'work' THEN '/in/work' WHEN 'home' THEN '/in/home' END AS target,
  CASE n.destination WHEN 'skip' THEN 'skip' WHEN 'knowledge' THEN 'knowledge' WHEN 'work' THEN 'copy' WHEN 'home' THEN 'copy' ELSE 'unconfigured' END AS kind
  FROM n WHERE status = 'classified' AND destination <> '' AND {DUCK_ITEM})"""
PLAN_SQL = f"{PLANNED_SQL} SELECT path, destination, kind, target FROM p"


def inbox_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names collide on purpose: the note's number is dropped."""
    rows = _planned(spark, sf_dir).withColumn("origin_path", F.col("path")).withColumn("path", F.regexp_replace("path", r"[0-9]+\.md$", "x.md"))
    rows = rows.withColumn("path", F.concat("path", F.lit("")))
    named = routing.collision_names(
        rows.filter("kind = 'copy'").withColumn("stem", routing.inbox_stem(F.col("path"), F.col("fm"))), "stem", text.path_key(F.col("origin_path")), "name", ["target"], None, ".md"
    )
    return named.select(F.col("origin_path").alias("path"), "target", "name")


INBOX_SQL = f"""{PLANNED_SQL}, s AS (SELECT path, target, replace(source, '/', '-') || '-' || regexp_replace({DUCK_STEM}, '[0-9]+$', 'x') AS stem FROM p WHERE kind = 'copy'),
k AS (SELECT *, row_number() OVER (PARTITION BY target, stem ORDER BY replace(path, '/', chr(1))) AS n FROM s)
SELECT path, target, CASE WHEN n > 1 THEN stem || '-' || n ELSE stem END || '.md' AS name FROM k"""


def routed_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = routing.copies(_planned(spark, sf_dir), day())
    fm = F.map_from_entries("copy_pairs")
    return made.select("path", "routed_to", *[F.element_at(fm, F.lit(k)).alias(k) for k in ("title", "status", "routed_from_dump", "routed_on")])


COPIES_SQL = f"""{PLANNED_SQL} SELECT path, target || '/' || replace(source, '/', '-') || '-' || {DUCK_STEM} || '.md' AS routed_to, title, 'routed' AS status, path AS routed_from_dump, strftime({DAY}, '%Y-%m-%d') AS routed_on
FROM p WHERE kind = 'copy'"""


def routing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.statistics(_planned(spark, sf_dir))


STATS_SQL = f"{PLANNED_SQL} SELECT CASE kind WHEN 'skip' THEN 'skip_marked' WHEN 'knowledge' THEN 'knowledge_queued' ELSE destination || '_copied' END AS key, count(*) AS n FROM p WHERE kind <> 'unconfigured' GROUP BY 1"


def knowledge_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.manifest(_planned(spark, sf_dir).filter("kind = 'knowledge'"))


MANIFEST_SQL = f"""{PLANNED_SQL}, w AS (SELECT *, coalesce(starts_with(url, 'http'), false) AS web FROM p WHERE kind = 'knowledge')
SELECT CASE WHEN web THEN 'url' ELSE 'ref:vault' END AS origin, CASE WHEN web THEN url END AS url, CASE WHEN NOT web THEN path END AS ref_path,
  CASE WHEN web THEN coalesce(title, '') ELSE coalesce(title, {DUCK_STEM}) END AS title, CASE category WHEN 'reference' THEN 'document' ELSE 'article' END AS source_type FROM w"""

ITEM = """cast(page_id AS int) AS position, CASE WHEN page_id % 5 = 0 THEN 'text' ELSE '' END AS origin, CASE WHEN page_id % 5 IN (1, 2) THEN url ELSE '' END AS url,
  CASE WHEN page_id % 3 = 0 THEN 'T' || cast(page_id AS string) ELSE '' END AS title, CASE WHEN page_id % 5 = 3 THEN 'a/b.md' ELSE '' END AS ref_path, CASE WHEN page_id % 5 = 4 THEN 'x.pdf' ELSE '' END AS file"""


def batch_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gateway.batch_items(table(spark, sf_dir, "pages").selectExpr(*split_select(ITEM)), {"context": "personal", "import_batch": "b1"})
    return rows.select("position", "origin", "source_type", "url", "title", "ref_path", "file", "label", "context", "import_batch")


BATCH_SQL = f"""WITH i AS (SELECT {ITEM} FROM pages),
o AS (SELECT position, CASE WHEN origin <> '' THEN origin WHEN ref_path <> '' THEN 'ref:vault' WHEN url <> '' THEN 'url' ELSE 'pdf' END AS origin, nullif(url, '') AS url, nullif(title, '') AS title, nullif(ref_path, '') AS ref_path, nullif(file, '') AS file FROM i)
SELECT position, origin, CASE origin WHEN 'ref:vault' THEN 'document' WHEN 'pdf' THEN 'paper' ELSE 'article' END AS source_type, url, title, ref_path, file,
  coalesce(title, url, 'item ' || (position + 1)) AS label, 'personal' AS context, 'b1' AS import_batch FROM o"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("cast(page_id AS int) AS position", "'P' || cast(page_id AS string) AS label", "page_id % 41 <> 7 AS ok")


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gateway.batch_summary(_results(spark, sf_dir))


SUMMARY_SQL = """SELECT count(*) AS total, count(CASE WHEN page_id % 41 <> 7 THEN 1 END) AS passed, count(CASE WHEN page_id % 41 = 7 THEN 1 END) AS failed, count(CASE WHEN page_id % 41 = 7 THEN 1 END) = 0 AS all_ok FROM pages"""


def gateway_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").selectExpr(
        "page_id", "CASE WHEN page_id % 3 = 0 THEN 'pdf' WHEN page_id % 3 = 1 THEN 'url' ELSE 'youtube' END AS origin", "CASE WHEN page_id % 3 = 0 THEN 'paper' ELSE 'article' END AS source_type", "url",
        "'A' || chr(10) || '===B' || cast(page_id AS string) AS title", "CASE WHEN page_id % 2 = 0 THEN 'me' ELSE '' END AS author", "page_id % 4 = 1 AS render",
    )
    return rows.select("page_id", gateway.request(rows).alias("request"))


GATEWAY_SQL = f"""WITH r AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN 'pdf' WHEN page_id % 3 = 1 THEN 'url' ELSE 'youtube' END AS origin FROM pages)
SELECT page_id, concat_ws(chr(10), '=== ACTION ===' || chr(10) || 'source-add', 'Origin: ' || origin, 'Source type: ' || CASE origin WHEN 'pdf' THEN 'paper' ELSE 'article' END, 'URL: ' || url, 'Title: A B' || page_id,
  CASE WHEN page_id % 2 = 0 THEN 'Author: me' END,
  CASE WHEN origin = 'url' AND page_id % 4 = 1 THEN '{gateway.RENDERED}' WHEN origin = 'pdf' THEN '{gateway.NOTES["pdf"]}' WHEN origin = 'youtube' THEN '{gateway.NOTES["youtube"]}' END,
  chr(10) || '=== CAPTURE CONTEXT ===' || chr(10) || 'Context: personal', 'Session: unknown', 'Intent: none specified') AS request FROM r"""


def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "pages").selectExpr("page_id", "explode(array('Done.', 'RESULT:path=Sources/' || cast(page_id AS string) || '/', 'RESULT:title=a=b', ' RESULT:no=1')) AS line")
    return gateway.results(said)[0]


RESULT_SQL = "SELECT page_id, 'path' AS key, 'Sources/' || page_id || '/' AS value FROM pages UNION ALL SELECT page_id, 'title', 'a=b' FROM pages"


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = table(spark, sf_dir, "events").filter("event_type = 'error'").selectExpr(
        "event_id", "ts", "'source-add' AS action", "'url' AS origin", "'C:\\\\dir\\\\' || cast(user_id AS string) AS file", "props || chr(10) || 'x' AS error"
    )
    return gateway.dead_letters(failed, F.col("ts")).select("event_id", "letter")


_ESCAPED = "replace(replace(replace({x}, '\\', '\\\\'), '\"', '\\\"'), chr(10), ' ')"
LETTER_SQL = f"""SELECT event_id, '{{"timestamp": "' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '", "action": "source-add", "origin": "url", "url": "", "file": "' || {_ESCAPED.format(x="('C:\\dir\\' || user_id)")}
  || '", "context": "", "session": "", "error": "' || {_ESCAPED.format(x="(props || chr(10) || 'x')")} || '"}}' AS letter FROM events WHERE event_type = 'error'"""


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "event_id * 37 % 90000 AS seconds")
    return rows.select("event_id", text.duration(F.col("seconds")).alias("duration"), selection.long_media(F.col("seconds")).alias("long"))


DURATION_SQL = "SELECT event_id, printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS duration, s > 3600 AS long FROM (SELECT event_id, event_id * 37 % 90000 AS s FROM events)"


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(media.joined(F.struct("turn", "role"), F.col("text")).alias("transcript"))


TRANSCRIPT_SQL = "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, role, text) AS transcript FROM conversations GROUP BY conv_id"


def caption_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = table(spark, sf_dir, "conversations").withColumn("l", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).filter("conv_id % 7 > l - 1")
    lines = tracks.selectExpr(
        "conv_id AS video_id", "CASE cast((conv_id + l) % 4 AS int) WHEN 0 THEN 'de' WHEN 1 THEN 'ru' WHEN 2 THEN 'en' ELSE 'fr' END AS lang",
        "(conv_id + l * 2) % 5 < 2 AS is_manual", "l AS list_pos", "turn AS pos", "cast(l AS string) || text AS text",
    )
    return media.transcripts(lines)


CAPTION_SQL = """WITH c AS (SELECT conv_id AS video_id, CASE (conv_id + l) % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'ru' WHEN 2 THEN 'en' ELSE 'fr' END AS lang, (conv_id + l * 2) % 5 < 2 AS man, l, turn, l || text AS text
  FROM conversations, (VALUES (0), (1), (2)) AS v(l) WHERE conv_id % 7 > l - 1),
t AS (SELECT video_id, lang, l, string_agg(text, chr(10) ORDER BY turn, text) AS transcript, CASE WHEN any_value(man) AND lang = 'en' THEN 0 WHEN any_value(man) AND lang = 'ru' THEN 1 WHEN NOT any_value(man) AND lang = 'en' THEN 2 WHEN NOT any_value(man) AND lang = 'ru' THEN 3 ELSE 4 END AS r
  FROM c GROUP BY video_id, lang, l)
SELECT video_id, lang, transcript FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY r, l) AS k FROM t) WHERE k = 1"""


def media_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.to_json(F.struct(
        F.concat(F.lit("T "), "page_id").alias("title"), F.when(F.col("page_id") % 2 == 0, F.lit("Chan")).alias("channel"), (F.col("page_id") * 10).cast("double").alias("duration"),
        F.lit("20260101").alias("upload_date"), F.col("url").alias("webpage_url"), F.col("html").alias("description"),
    )).alias("json"))
    return media.metadata(rows)


METADATA_SQL = """SELECT page_id, 'T ' || page_id AS title, CASE WHEN page_id % 2 = 0 THEN 'Chan' ELSE '' END AS channel, (page_id * 10)::DOUBLE AS seconds, '20260101' AS published, url, substr(html, 1, 500) AS description FROM pages"""


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.keyword(table(spark, sf_dir, "documents"), "License").select("doc_id")


KEYWORD_SQL = "SELECT doc_id FROM documents WHERE contains(lower(text), 'license')"


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.bm25(table(spark, sf_dir, "documents"), ["license", "under", "token"], most=20)
    return found.select("doc_id", F.round("score", 6).alias("score"))


BM25_SQL = """WITH t AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+') IF x <> ''] AS w FROM documents),
c AS (SELECT doc_id, len(w) AS l, len([x FOR x IN w IF x = 'license']) AS a, len([x FOR x IN w IF x = 'under']) AS b, len([x FOR x IN w IF x = 'token']) AS c FROM t),
s AS (SELECT count(*) AS n, avg(l) AS m, count(CASE WHEN a > 0 THEN 1 END) AS da, count(CASE WHEN b > 0 THEN 1 END) AS db, count(CASE WHEN c > 0 THEN 1 END) AS dc FROM c),
r AS (SELECT doc_id, ln(1 + (n - da + 0.5::DOUBLE) / (da + 0.5::DOUBLE)) * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / m))
  + ln(1 + (n - db + 0.5::DOUBLE) / (db + 0.5::DOUBLE)) * b * 2.2::DOUBLE / (b + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / m))
  + ln(1 + (n - dc + 0.5::DOUBLE) / (dc + 0.5::DOUBLE)) * c * 2.2::DOUBLE / (c + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / m)) AS score FROM c, s)
SELECT doc_id, round(score, 6) AS score FROM r WHERE score > 0 ORDER BY r.score DESC, doc_id LIMIT 20"""


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.vector(table(spark, sf_dir, "embeddings"), [1.0 if k % 3 else -0.5 for k in range(64)])
    return found.select("vec_id", F.round("score", 9).alias("score"))


VECTOR_SQL = "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], [CASE WHEN k % 3 = 0 THEN -0.5 ELSE 1.0 END FOR k IN range(64)]::DOUBLE[]), 9) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], [CASE WHEN k % 3 = 0 THEN -0.5 ELSE 1.0 END FOR k IN range(64)]::DOUBLE[]) DESC, vec_id LIMIT 10"


def new_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "documents").filter("doc_id % 3 = 0").select(F.sha2("text", 256).alias("hash"))
    return search.new_contents(table(spark, sf_dir, "documents"), known).select("doc_id", "hash")


NEW_SQL = "SELECT doc_id, sha256(text) AS hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)"

PLANS = {
    "needs_classification": (needs_classification, NEEDS_SQL), "routable_items": (routable_items, ROUTABLE_SQL), "classify_requests": (classify_requests, CLASSIFY_SQL),
    "classify_batches": (classify_batches, BATCHES_SQL), "route_requests": (route_requests, ROUTE_SQL), "response_parse": (response_parse, RESPONSE_SQL), "join_back": (join_back, JOIN_SQL),
    "missing_count": (missing_count, MISSING_SQL), "classified_notes": (classified_notes, CLASSIFIED_SQL), "auto_skip": (auto_skip, AUTO_SQL), "route_distribution": (route_distribution, DISTRIBUTION_SQL),
    "routing_breakdown": (routing_breakdown, BREAKDOWN_SQL), "routing_plan": (routing_plan, PLAN_SQL), "inbox_names": (inbox_names, INBOX_SQL), "routed_copies": (routed_copies, COPIES_SQL),
    "routing_stats": (routing_stats, STATS_SQL), "knowledge_manifest": (knowledge_manifest, MANIFEST_SQL), "batch_items": (batch_items, BATCH_SQL), "batch_summary": (batch_summary, SUMMARY_SQL),
    "gateway_requests": (gateway_requests, GATEWAY_SQL), "result_lines": (result_lines, RESULT_SQL), "dead_letters": (dead_letters, LETTER_SQL), "durations": (durations, DURATION_SQL),
    "transcripts": (transcripts, TRANSCRIPT_SQL), "caption_choice": (caption_choice, CAPTION_SQL), "media_metadata": (media_metadata, METADATA_SQL), "keyword_search": (keyword_search, KEYWORD_SQL),
    "bm25_search": (bm25_search, BM25_SQL), "vector_topk": (vector_topk, VECTOR_SQL), "new_contents": (new_contents, NEW_SQL),
}
