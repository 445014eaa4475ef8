import hashlib

import duckdb
import numpy as np
import pyarrow as pa

import __spark_entry__ as entry
import corpus_pipeline
from tessella.llm import langid

from .test_corpus_operators import brute_roots, shingle_set

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, SF).cache()
        rows = out.collect()
        if k < 4:
            assert out.columns == docs.columns, name
        if k == 0:
            assert {r["doc_id"] for r in rows} == {d for d, r in before.items() if any(c.isalpha() for c in r["text"] or "")}
        if k == 1:
            sets = {d: shingle_set(r["text"]) for d, r in before.items()}
            ids = sorted(sets)
            alike = [(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), i, j) for j, b in enumerate(ids) for i, a in enumerate(ids[:j])]
            wanted = brute_roots(len(ids), [(i, j) for s, i, j in alike if s >= 0.8])
            assert {r["doc_id"] for r in rows} == {d for k, d in enumerate(ids) if wanted[k] == k}
        if k == 2:
            assert len(rows) == len(before) and all("@" not in r["text"] for r in rows) and all(r["n_chars"] == len(r["text"]) for r in rows)
        if k == 3:
            words = sum(len(r["text"].split()) for r in rows)
            assert abs(words - 1.5 * sum(len(r["text"].split()) for r in before.values())) < 400
        if k == 4:
            assert len(rows) == docs.count() and all(len(r["ids"]) == r["n_tokens"] > 0 for r in rows)
        docs = out


def test_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "a", 0), (10**6 + 1, "123 !!", "en", "a", 0), (10**6 + 2, "καλημέρα κόσμε", "en", "a", 0), (10**6 + 3, docs.first()["text"], None, None, None)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(odd), SF).collect()}
    assert kept & {10**6 + k for k in range(4)} == {10**6 + 3}
    assert langid.UNKNOWN not in kept


def test_mixed_languages_stay(spark):
    """Parts of three or four languages, none with 40 % of the letters."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    parts = {r["lang"]: r["text"] for r in docs.filter("length(text) > 400").orderBy("doc_id").collect()}
    mixed = " ".join(parts[k][:400] for k in sorted(parts))
    odd = spark.createDataFrame([(10**6, mixed, "en", "a", len(mixed)), (10**6 + 1, mixed[:100] + " καλημέρα κόσμε" * 20, "en", "a", 0)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(odd), SF).collect()}
    assert len(parts) >= 3 and kept & {10**6, 10**6 + 1} == {10**6}


def test_run_is_repeatable(spark):
    digest = lambda: hashlib.sha256(str(sorted((r["doc_id"], r["n_tokens"], sum(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect())).encode()).hexdigest()
    assert digest() == digest()


def test_queries_against_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    for name in ("op4_nearest", "op5_source_mixing"):
        mine, theirs = entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
        keys = [c for c in mine.columns if mine[c].dtype != float]
        mine, theirs = (x[sorted(x.columns)].sort_values(keys).reset_index(drop=True) for x in (mine, theirs))
        assert len(mine) and all(np.allclose(mine[c], theirs[c]) for c in mine.columns)


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_batches_are_lowered_and_never_raised(spark):
    from tessella.llm.common import TEXT_BYTES, bound_batches

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for size, want in ((str(1 << 30), TEXT_BYTES), ("64m", TEXT_BYTES), ("1000", 1000)):
        spark.conf.set(name, size)
        bound_batches(spark)
        assert int(spark.conf.get(name)) == want
    spark.conf.unset(name)
    bound_batches(spark)
    assert int(spark.conf.get(name)) == TEXT_BYTES

    def counted(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    rows = spark.range(0, 200, 1, 1).selectExpr("id", "repeat('x', 50000) AS t").mapInArrow(counted, "n long").collect()
    # a batch ends with the row that passes the bound
    assert sum(r["n"] for r in rows) == 200 and (max(r["n"] for r in rows) - 1) * 50_000 <= TEXT_BYTES
