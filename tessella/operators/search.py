"""Search over notes. The formulas here are this library's own choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.session import cut

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda x: x != "")


def keyword(df: DataFrame, word: str, text: str = "text") -> DataFrame:
    """Rows that hold a word, any case, as a substring."""
    return df.filter(F.contains(F.lower(F.col(text)), F.lit(word.lower())))


def bm25(df: DataFrame, query: list[str], key: str = "doc_id", text: str = "text", most: int = 10) -> DataFrame:
    """key, score: best first, ties to the smaller key. One pass counts the query's words in each text; only counts are kept."""
    words = F.col("_t")
    counts = df.select(F.col(key).alias(key), tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t")).select(
        key, F.size(words).alias("len"), *[(F.size(words) - F.size(F.array_remove(words, w.lower()))).alias(f"tf{i}") for i, w in enumerate(query)]
    )
    counts = cut(counts)
    whole = counts.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(query))])
    joined = counts.crossJoin(F.broadcast(whole))  # one row
    score = F.lit(0.0)
    for i in range(len(query)):
        tf, frequency = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - frequency + 0.5) / (frequency + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return joined.select(key, score.alias("score")).filter("score > 0").orderBy(F.col("score").desc(), key).limit(most)


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector(df: DataFrame, query: list[float], key: str = "vec_id", column: str = "embedding", most: int = 10) -> DataFrame:
    """key, score by cosine with one query vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.filter(F.size(column) == len(query)).select(key, cosine(F.col(column), q).alias("score")).orderBy(F.col("score").desc(), key).limit(most)


def hybrid(left: DataFrame, right: DataFrame, key: str, most: int = 10, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two short ranked lists (key, score)."""
    def ranked(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, (1.0 / (constant + F.row_number().over(W.orderBy(F.col("score").desc(), key)))).alias(name))

    joined = ranked(left, "a").join(ranked(right, "b"), key, "full")
    return joined.select(key, (F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias("score")).orderBy(F.col("score").desc(), key).limit(most)


def new_contents(df: DataFrame, indexed: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose content hash isn't indexed yet (indexed: hash)."""
    return df.withColumn("hash", F.sha2(F.col(text), 256)).join(indexed.select("hash").distinct(), "hash", "left_anti")
