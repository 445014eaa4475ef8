"""Mixing sources to target weights, in DataFrame functions alone.

1. A document's size is its number of words. Sources, by code point and null last, have cyclic weights; they share
   `share` times all sizes by weight, no target is above `most` times its source's size, and what is above goes to the
   others by weight until none is above.
2. Targets become integer quotas of equal blocks by Sainte-Lague: the highest quotients target / (2k + 1) win a block
   each. A source's count lies within its exact share plus or minus (sources * share / 2 + 1.5), so only quotients in that
   band are ranked: about four rows a source, however many blocks there are.
3. A source is cut into shards by a seeded hash of key and text, one for about SHARD_WORDS words, and shards into groups of about
   GROUP; its quota goes to its groups, and a group's to its shards, in the same way. So hot sources are in many tasks, and no ranking below
   sources has more than some GROUP rows.
4. A shard takes its quota in seeded order of its documents: whole passes first, then documents up to a border, where one is
   taken in part. So a shard's selection is a border hash and a number of words. Tables of sources and of borders up to BROADCAST
   rows are broadcast, and texts are not shuffled; where borders are more, texts are shuffled once, by source and shard.

Sources are ranked in one task, a row each. Null texts have size 0 and take nothing. A null source is a source. Rows that repeat key and text have one place in the order and share
what is taken at the border. Empty tables give empty results. Other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import checkpointed, small

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Words in a block.
BLOCK = 16
#: Words and documents of a shard, and shards of a group.
SHARD_WORDS = 250_000
GROUP = 4096
#: Rows of a broadcast table, of some 100 bytes each.
BROADCAST = 200_000
SEED = "mix-1"


def order_hash(key: str, text: str, seed: str = SEED) -> Column:
    """Hexadecimal; by it documents are dealt to shards (first 8 digits) and ordered within."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")))))


def sizes(df: DataFrame, key: str, text: str, source: str, seed: str) -> DataFrame:
    return df.select(
        F.col(key).alias("doc"),
        F.col(source).alias("src"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        order_hash(key, text, seed).alias("h"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """src, source_size, n_docs, target: a row for each source."""
    cycle = F.array(*[F.lit(w) for w in weights])
    by_name = W.orderBy(F.col("src").asc_nulls_last())
    by_ratio = W.orderBy("ratio", F.col("src").asc_nulls_last())
    everything = W.partitionBy(F.lit(0))
    sources = sized.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranked = (
        sources.withColumn("weight", F.get(cycle, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")).cast("long"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * share)
        .withColumn("caps", F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("caps")) / F.col("rest"))
        .withColumn("capped", F.col("level") >= F.col("ratio"))
    )
    # capped sources come first by ratio, and beyond them the level only falls: the highest is the one that holds
    first = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    return ranked.withColumn("first", first).select(
        "src", "source_size", "n_docs", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("first") * F.col("weight")).alias("target")
    )


def apportion(df: DataFrame, group: list[str], weight: str, seats: str, order: list[Column], out: str) -> DataFrame:
    """Adds `out`: of the group's seats, those that go to the row by the highest quotients weight / (2k + 1); ties go to
    the row that is first in `order`."""
    whole = W.partitionBy(*(group or [F.lit(0)]))
    share = F.when(F.col("_sum") > 0, F.col(weight).cast("double") / F.col("_sum")).otherwise(0.0)
    exact = F.col("_share") * F.col(seats)
    slack = F.col("_n") * F.col("_share") / 2 + 1.5
    banded = (
        df.withColumn("_sum", F.sum(F.col(weight).cast("double")).over(whole))
        .withColumn("_n", F.count("*").over(whole))
        .withColumn("_share", share)
        .withColumn("_low", F.greatest(F.lit(0).cast("long"), F.floor(exact - slack).cast("long")))
        .withColumn("_high", F.ceil(exact + slack).cast("long"))
        .withColumn("_open", F.col(seats) - F.sum("_low").over(whole))
    )
    offered = banded.withColumn("_k", F.explode(F.sequence(F.col("_low"), F.col("_high")))).withColumn("_q", F.col(weight).cast("double") / (2 * F.col("_k") + 1))
    by_quotient = (W.partitionBy(*group) if group else W.partitionBy(F.lit(0))).orderBy(F.col("_q").desc(), *order, F.col("_k").asc())
    won = offered.withColumn("_won", (F.row_number().over(by_quotient) <= F.col("_open")) & (F.col(weight) > 0))
    names = [c for c in df.columns]
    return won.groupBy(*names).agg((F.first("_low") + F.count_if("_won")).alias(out))


def quotas(sized: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, block=BLOCK) -> DataFrame:
    """src, source_size, target, blocks, n_shards, n_groups: a row for each source."""
    seats = F.round(F.sum("target").over(W.partitionBy(F.lit(0))) / block).cast("long")
    shards = F.ceil((F.col("source_size") + F.col("n_docs")) / SHARD_WORDS).cast("long")
    groups = F.ceil(F.col("n_shards") / GROUP).cast("long")
    by_source = targets(sized, weights, share, most).withColumn("seats", seats)
    return apportion(by_source, [], "target", "seats", [F.col("src").asc_nulls_last()], "blocks").select("src", "source_size", "target", "blocks", shards.alias("n_shards")).withColumn("n_groups", groups)


def shard_of() -> Column:
    return F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % F.col("n_shards")


def selection(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, block: int = BLOCK, most: int = MOST, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """doc, src, size, source_size, target, taken, shard, h, whole (passes), border (words of a document at the border; null elsewhere)."""
    sized = checkpointed(sizes(df, key, text, source, seed))
    by_source = small(checkpointed(quotas(sized, weights, share, most, block)), BROADCAST)
    dealt = sized.join(by_source, sized.src.eqNullSafe(by_source.src)).select(sized["*"], "source_size", "target", "blocks", "n_shards", "n_groups").withColumn("shard", shard_of())
    shards = dealt.groupBy("src", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"), F.first(F.col("shard") % F.col("n_groups")).alias("grp"))
    shards = checkpointed(shards)
    groups = shards.groupBy("src", "grp").agg(F.sum("shard_size").alias("group_size"), F.first("blocks").alias("blocks"))
    groups = checkpointed(apportion(groups, ["src"], "group_size", "blocks", [F.col("grp").asc()], "group_blocks"))
    within = small(groups.select(F.col("src").alias("_src"), F.col("grp").alias("_grp"), "group_blocks"), BROADCAST)
    shards = shards.join(within, shards.src.eqNullSafe(within._src) & (shards.grp == within._grp)).select("src", "grp", "shard", "shard_size", "group_blocks")
    shards = apportion(shards, ["src", "grp"], "shard_size", "group_blocks", [F.col("shard").asc()], "won").select(
        F.col("src").alias("_src"), F.col("shard").alias("_shard"), "shard_size", F.least(F.col("won") * block, F.col("shard_size") * most).alias("quota")
    )
    shards = small(checkpointed(shards), BROADCAST)
    in_order = W.partitionBy("src", "shard").orderBy("h")
    same = W.partitionBy("src", "shard", "h")
    left = F.col("quota") - F.col("whole") * F.col("shard_size") - F.col("before")
    return (
        dealt.join(shards, dealt.src.eqNullSafe(shards._src) & (dealt.shard == shards._shard))
        .withColumn("whole", F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(0).cast("long"))
        .withColumn("_tie", F.sum("size").over(same))
        .withColumn("_ties", F.count("*").over(same))
        .withColumn("before", F.sum("size").over(in_order.rangeBetween(W.unboundedPreceding, 0)) - F.col("_tie"))
        .withColumn("_left", F.greatest(F.lit(0).cast("long"), left))
        .withColumn("border", F.when((F.col("_left") > 0) & (F.col("_left") < F.col("_tie")), F.floor(F.col("_left") / F.col("_ties")).cast("long")))
        .withColumn("taken", F.col("whole") * F.col("size") + F.when(F.col("border").isNotNull(), F.least("border", "size")).when(F.col("_left") > 0, F.col("size")).otherwise(0))
        .select("doc", "src", "size", "source_size", "target", "taken", "shard", "h", "n_shards", "whole", "border", "_left")
    )


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **how) -> DataFrame:
    """The rows of the mix, with the columns of df: a document that is taken twice comes twice, one that is taken in part
    comes with its first words. Selection travels as a row for each shard."""
    chosen = selection(df, key, text, source, seed, **how)
    shards = checkpointed(
        chosen.groupBy("src", "shard", "n_shards").agg(
            F.max("whole").alias("whole"),
            F.max(F.when(F.col("_left") > 0, F.col("h"))).alias("last"),  # the last document of which any is taken in the last pass
            F.max("border").alias("border"),
        )
    )
    counts = small(checkpointed(shards.groupBy(F.col("src").alias("_s")).agg(F.first("n_shards").alias("n_shards"))), BROADCAST)
    borders = small(shards.select(F.col("src").alias("_src"), F.col("shard").alias("_shard"), "whole", "last", "border"), BROADCAST)
    rows = df.select(F.struct("*").alias("row"), F.col(text).alias("body"), F.col(source).alias("src"), order_hash(key, text, seed).alias("h"))
    dealt = rows.join(counts, F.col("src").eqNullSafe(F.col("_s"))).withColumn("shard", shard_of())
    joined = dealt.join(borders, F.col("src").eqNullSafe(F.col("_src")) & (F.col("shard") == F.col("_shard")))
    part = (F.col("h") == F.col("last")) & F.col("border").isNotNull()
    again = F.when(F.col("h") < F.col("last"), 1).when((F.col("h") == F.col("last")) & F.col("border").isNull(), 1).otherwise(0)
    words = F.regexp_extract_all(F.col("body"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(words, F.lit(1), F.col("border").cast("int")), "")
    copies = F.array_repeat(F.col("body"), (F.col("whole") + again).cast("int"))
    pieces = F.when(part & (F.col("border") > 0), F.concat(copies, F.array(head))).otherwise(copies)
    taken = joined.select("row", F.explode(pieces).alias("piece")).filter(F.col("piece").rlike(WORD))
    return taken.select(*[F.col("piece").alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns])
