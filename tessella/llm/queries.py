"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import ann, bpe, dedup, html_blocks, langid, media, mixing, pii, quality, simhash
from tessella.llm.common import checkpointed, held_out, table, utf8

#: The rank file that the tokenizing query and the pipeline use.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.deduplicated(table(spark, sf_dir, "documents"), kept=False)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out("doc_id").alias("held_out"), quality.stated(utf8("text")).alias("x"))
    docs = checkpointed(docs)
    labels = quality.one_label(table(spark, sf_dir, "labels"))
    learnt = docs.filter("not held_out").join(labels, docs.doc_id == labels.key).select("x", "y")
    scores = docs.withColumn("score", quality.scored(quality.fit(learnt), F.col("x")))
    return scores.select("doc_id", "held_out", "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.self_search(table(spark, sf_dir, "embeddings"), every=50, k=5)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND list_sum([abs(x) FOR x IN embedding]) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.selection(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken")


OP5_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight, 2 * source_size AS cap FROM src
), ranked AS (
  SELECT *, cap::DOUBLE / weight AS ratio,
    (1.5::DOUBLE * sum(source_size) OVER () - (sum(cap) OVER upto - cap)::DOUBLE) / (sum(weight) OVER rest)::DOUBLE AS level
  FROM weighed
  WINDOW upto AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING),
         rest AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), aimed AS (
  SELECT source, source_size, n_docs,
    CASE WHEN level >= ratio THEN cap::DOUBLE ELSE max(CASE WHEN level < ratio THEN level END) OVER () * weight END AS target
  FROM ranked
), seated AS (
  SELECT *, round(sum(target) OVER () / 16)::BIGINT AS seats FROM aimed
), quotient AS (
  SELECT source, target / (2 * k + 1) AS q, k, seats
  FROM (SELECT *, unnest(range(greatest(0, floor(target / 16 - 64))::BIGINT, ceil(target / 16 + 64)::BIGINT)) AS k FROM seated)
), based AS (
  SELECT source, greatest(0, floor(target / 16 - 64))::BIGINT AS base FROM seated
), won AS (
  SELECT source, q, row_number() OVER (ORDER BY q DESC, source NULLS LAST, k) AS place,
         (SELECT any_value(seats) FROM seated) - (SELECT sum(base) FROM based) AS open
  FROM quotient WHERE q > 0
), blocks AS (
  SELECT b.source, b.base + count(w.place) AS blocks
  FROM based b LEFT JOIN won w ON b.source IS NOT DISTINCT FROM w.source AND w.place <= w.open
  GROUP BY b.source, b.base
), dealt AS (
  SELECT s.*, a.source_size, a.target, b.blocks, ceil((a.source_size + a.n_docs) / 250000.0)::BIGINT AS n_shards,
         ('0x' || substr(s.h, 1, 8))::BIGINT % ceil((a.source_size + a.n_docs) / 250000.0)::BIGINT AS shard
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source JOIN blocks b ON s.source IS NOT DISTINCT FROM b.source
), shards AS (
  SELECT source, shard, sum(size)::BIGINT AS shard_size, any_value(blocks) AS blocks, any_value(shard % ceil(n_shards / 4096.0)::BIGINT) AS grp FROM dealt GROUP BY source, shard
), groups AS (
  SELECT source, grp, sum(shard_size)::BIGINT AS group_size, any_value(blocks) AS blocks FROM shards GROUP BY source, grp
), group_exact AS (
  SELECT *, CASE WHEN sum(group_size) OVER (PARTITION BY source) > 0
                 THEN blocks * group_size::DOUBLE / sum(group_size) OVER (PARTITION BY source) ELSE 0 END AS share FROM groups
), group_base AS (
  SELECT *, greatest(0, floor(share - 2100))::BIGINT AS base FROM group_exact
), group_q AS (
  SELECT source, grp, group_size::DOUBLE / (2 * k + 1) AS q, k
  FROM (SELECT *, unnest(range(base, ceil(share + 2100)::BIGINT)) AS k FROM group_base)
), group_won AS (
  SELECT source, grp, row_number() OVER (PARTITION BY source ORDER BY q DESC, grp, k) AS place FROM group_q WHERE q > 0
), group_open AS (
  SELECT source, any_value(blocks) - sum(base) AS open FROM group_base GROUP BY source
), group_blocks AS (
  SELECT b.source, b.grp, b.base + count(w.place) AS group_blocks
  FROM group_base b JOIN group_open o ON b.source IS NOT DISTINCT FROM o.source
  LEFT JOIN group_won w ON b.source IS NOT DISTINCT FROM w.source AND b.grp = w.grp AND w.place <= o.open
  GROUP BY b.source, b.grp, b.base
), exact AS (
  SELECT s.*, g.group_blocks, CASE WHEN sum(shard_size) OVER (PARTITION BY s.source, s.grp) > 0
                 THEN group_blocks * shard_size::DOUBLE / sum(shard_size) OVER (PARTITION BY s.source, s.grp) ELSE 0 END AS share
  FROM shards s JOIN group_blocks g ON s.source IS NOT DISTINCT FROM g.source AND s.grp = g.grp
), shard_base AS (
  SELECT *, greatest(0, floor(share - 2100))::BIGINT AS base FROM exact
), shard_q AS (
  SELECT source, grp, shard, shard_size::DOUBLE / (2 * k + 1) AS q, k
  FROM (SELECT *, unnest(range(base, ceil(share + 2100)::BIGINT)) AS k FROM shard_base)
), shard_won AS (
  SELECT source, shard, row_number() OVER (PARTITION BY source, grp ORDER BY q DESC, shard, k) AS place FROM shard_q WHERE q > 0
), shard_open AS (
  SELECT source, grp, any_value(group_blocks) - sum(base) AS open FROM shard_base GROUP BY source, grp
), shard_quota AS (
  SELECT b.source, b.shard, b.shard_size, least((b.base + count(w.place)) * 16, 2 * b.shard_size) AS quota
  FROM shard_base b JOIN shard_open o ON b.source IS NOT DISTINCT FROM o.source AND b.grp = o.grp
  LEFT JOIN shard_won w ON b.source IS NOT DISTINCT FROM w.source AND b.shard = w.shard AND w.place <= o.open
  GROUP BY b.source, b.shard, b.shard_size, b.base
), placed AS (
  SELECT d.*, q.quota, q.shard_size,
    CASE WHEN q.shard_size > 0 THEN q.quota // q.shard_size ELSE 0 END AS whole,
    sum(d.size) OVER (PARTITION BY d.source, d.shard ORDER BY d.h RANGE UNBOUNDED PRECEDING)
      - sum(d.size) OVER (PARTITION BY d.source, d.shard, d.h) AS before,
    sum(d.size) OVER (PARTITION BY d.source, d.shard, d.h) AS tie,
    count(*) OVER (PARTITION BY d.source, d.shard, d.h) AS ties
  FROM dealt d JOIN shard_quota q ON d.source IS NOT DISTINCT FROM q.source AND d.shard = q.shard
), rest AS (
  SELECT *, greatest(0, quota - whole * shard_size - before) AS remaining FROM placed
)
SELECT doc_id, size, source_size, target,
  (whole * size + CASE WHEN remaining > 0 AND remaining < tie THEN least(remaining // ties, size) WHEN remaining > 0 THEN size ELSE 0 END)::BIGINT AS taken
FROM rest
"""


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "pages").select("page_id", "url", html_blocks.extracted(utf8("html")).alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~held_out("doc_id")))
    labelled = docs.select("doc_id", held_out("doc_id").alias("held_out"), langid.predicted(spark, model, utf8("text")).alias("p"))
    return labelled.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", media.described(utf8("text")).alias("m")).select("doc_id", "m.*")


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", pii.spans(utf8("text")).alias("p")).select("doc_id", "p.*")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_byte_bpe, op3_quality, op4_nearest, op5_source_mixing, op6_main_text, op7_language_id, op8_media, op9_pii_spans, op10_simhash_near_dedup)}
ORACLE: dict[str, str] = {"op4_nearest": OP4_SQL, "op5_source_mixing": OP5_SQL}
