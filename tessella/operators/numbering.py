"""Consecutive numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.session import cut

#: Keys that are looked at to choose where ranges end.
SAMPLE = 1024


def _range(keys: DataFrame, ranges: int) -> Column:
    """The number of the range that the column _key is in, from 0; -1 for a null key."""
    seen = sorted(r[0] for r in keys.filter("_key is not null").orderBy(F.xxhash64("_key"), "_key").limit(SAMPLE).collect())
    ends = sorted({seen[len(seen) * k // ranges] for k in range(1, ranges)}) if seen else []
    bucket = F.size(F.filter(F.array(*[F.lit(x) for x in ends]), lambda end: end <= F.col("_key"))) if ends else F.lit(0)
    return F.when(F.col("_key").isNull(), -1).otherwise(bucket)


def numbered(df: DataFrame, key: Column, name: str = "n", ranges: int | None = None) -> DataFrame:
    """Adds 1, 2, 3... in order of a string key; ties are in any order, so the key should be unique.

    Range ends come from the SAMPLE keys of least hash, so they are the same whenever the plan runs. Rows are ranked within
    their range, and each range starts after the sum of those before: one row a range crosses to one task. Only keys are read
    beforehand, once where a session names a folder to keep them in.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_key", key)
    keys = cut(keyed.select("_key"))
    bucket = _range(keys, ranges)
    placed = keyed.withColumn("_bucket", bucket)
    sizes = keys.withColumn("_bucket", bucket).groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = sizes.select("_bucket", (F.sum("_size").over(W.orderBy("_bucket")) - F.col("_size")).alias("_before"))
    ranked = placed.withColumn("_rank", F.row_number().over(W.partitionBy("_bucket").orderBy("_key")))
    # at most `ranges` rows
    joined = ranked.join(F.broadcast(before), "_bucket")
    return joined.withColumn(name, F.col("_before") + F.col("_rank")).drop("_key", "_bucket", "_rank", "_before")


def batched(df: DataFrame, number: str, size: int, prefix: str = "item") -> DataFrame:
    """Adds batch (from 1) and item_id (`item-0001`, from 1 in each batch) from consecutive numbers."""
    zero = F.col(number) - 1
    return df.withColumn("batch", (F.floor(zero / size) + 1).cast("long")).withColumn("item_id", F.format_string(f"{prefix}-%04d", zero % size + 1))


def collision_names(df: DataFrame, name: str, order: Column, out: str, scope: list[str] | None = None, taken: DataFrame | None = None, ext: str = "", ranges: int | None = None) -> DataFrame:
    """Adds a name that no other row of the scope has: the first row of a name keeps it, the k-th gets -k.

    taken: names (column `name`, and the scope's columns) that exist already; numbering goes on after those of one stem.
    A row whose own name looks like another's numbered one is not moved.

    As in numbered(), the rows of a name are ranked within ranges of the order, so that those of a frequent name are in many tasks;
    a row for each name and range starts after those before.
    """
    scope = scope or []
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same = [*scope, name]
    keys = cut(df.select(*same, order.alias("_key")))
    bucket = _range(keys.select("_key"), ranges)
    placed = df.withColumn("_key", order).withColumn("_bucket", bucket)
    ranked = placed.withColumn("_rank", F.row_number().over(W.partitionBy(*same, "_bucket").orderBy("_key")))
    sizes = keys.withColumn("_bucket", bucket).groupBy(*same, "_bucket").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(W.partitionBy(*same).orderBy("_bucket")) - F.col("_size")).filter("_before > 0")
    before = before.select(*[F.col(c).alias(f"_of{k}") for k, c in enumerate(same)], F.col("_bucket").alias("_in"), "_before")
    met = [ranked["_bucket"] == before["_in"], *[ranked[c].eqNullSafe(before[f"_of{k}"]) for k, c in enumerate(same)]]
    ranked = ranked.join(before, met, "left").select(*[ranked[c] for c in df.columns], (F.col("_rank") + F.coalesce(before["_before"], F.lit(0))).alias("_k"))
    if taken is not None:
        bare = F.regexp_replace(F.col("name"), r"\.[^.]*\z", "") if ext else F.col("name")
        stems = taken.select(*scope, F.regexp_replace(bare, r"-[0-9]+\z", "").alias("_stem"), bare.alias("_bare"))
        counts = stems.unionByName(stems.withColumn("_stem", F.col("_bare"))).distinct().groupBy(*scope, "_stem").agg(
            F.max(F.coalesce(F.regexp_extract(F.expr("substr(_bare, length(_stem) + 1)"), r"^-([0-9]+)\z", 1).try_cast("int"), F.when(F.col("_bare") == F.col("_stem"), 1))).alias("_have")
        )
        ranked = ranked.join(counts, [*[ranked[c] == counts[c] for c in scope], ranked[name] == counts["_stem"]], "left").select(ranked["*"], F.coalesce("_have", F.lit(0)).alias("_have"))
        ranked = ranked.withColumn("_k", F.col("_k") + F.col("_have")).drop("_have")
    numbered_name = F.when(F.col("_k") > 1, F.concat(F.col(name), F.lit("-"), F.col("_k"))).otherwise(F.col(name))
    return ranked.withColumn(out, F.concat(numbered_name, F.lit(ext))).drop("_k")
