"""From raw documents to token ids, in five stages; each works on all that the one before kept.

Null texts are rejected by the first stage. Documents of one id that repeat are handled as each operator documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, langid, mixing, pii, queries, simhash
from tessella.llm.common import bound_batches, discarded, held_out, utf8, written

#: Documents of which a lower share of letters is in words of learned languages, all of them together, go.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or mostly in scripts that no learned language uses, go; lang is the predicted one."""
    bound_batches(spark)
    model = langid.fit(docs.filter(~held_out("doc_id")))
    found = docs.withColumn("_p", langid.predicted(spark, model, utf8("text")))
    kept = found.filter((F.col("_p.lang_pred") != langid.UNKNOWN) & (F.col("_p.known") >= LEAST_SCORE))
    return kept.select(*[F.col("_p.lang_pred").alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts alike by 0.8 or more (sets of five-word shingles, found by wide SimHash fingerprints and compared themselves),
    the document of least id stays. Rows without an id stay only where nothing of their group has one."""
    bound_batches(spark)
    return simhash.keep_one_similar(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    bound_batches(spark)
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the words that the mix takes of them: none, once, twice or in part."""
    return mixing.mix(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens."""
    bound_batches(spark)
    found = bpe.with_tokens(docs.select("doc_id", "lang", "source", "text"), queries.RANKS, public_tokenizers.PATTERN)
    return found.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("PII", personal_data),
    ("mixing", source_mix),
    ("byte-level BPE", tokens),
]

#: Hashes, a fitted model and merges by rank are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; each result is written to the shared folder and read again, and deleted once the next
    one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
            discarded(before)
    return docs
