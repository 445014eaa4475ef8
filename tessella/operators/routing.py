"""From classified items to destinations: auto-skip, plan, copies, originals, manifest and reports.

Dimensions (destinations, targets) are small tables that a person writes; joins with them are left to the optimizer, which
broadcasts a side whose size it has checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import frontmatter as fmt
from tessella.functions import text
from tessella.operators.numbering import collision_names
from tessella.operators.selection import web_address

HEADING = r"(?m)^##(?U:\s)+([a-zA-Z][\p{L}\p{N}_-]*)(?U:\s)*$"
RESERVED = ["knowledge", "skip"]
# Source type hint of a category; others are articles.
TYPE_HINTS = {"reference": "document"}


def destinations(profiles: DataFrame, column: str = "value") -> DataFrame:
    """ordinal, destination: `##` headings of a profile text, in order."""
    return profiles.select(F.posexplode(F.regexp_extract_all(F.col(column), F.lit(HEADING), F.lit(1))).alias("ordinal", "destination"))


def low_value(fm: Column, least: int) -> Column:
    return fmt.integer(fm, "value") < least


def skip_gate(items: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """items: fm. Adds skipped: below the threshold, if `skip` is among the known destinations."""
    declared = known.agg(F.coalesce(F.max(F.col("destination") == "skip"), F.lit(False)).alias("_declared"))
    return items.crossJoin(F.broadcast(declared)).withColumn("skipped", F.col("_declared") & low_value(F.col("fm"), least)).drop("_declared")  # one row


def auto_skipped(pairs: Column, fm: Column, least: int) -> Column:
    """Ordered frontmatter of an item below the threshold; reasons that are there stay."""
    said = F.format_string("auto-skip: value %d < %d", fmt.integer(fm, "value"), F.lit(least))
    with_reason = F.when(fmt.has(fm, "reason"), fmt.updated(pairs, destination=F.lit("skip"))).otherwise(
        fmt.updated(pairs, destination=F.lit("skip"), reason=F.lit("below min_value threshold"))
    )
    return F.when(fmt.has(fm, "destination_reason"), with_reason).otherwise(fmt.updated(with_reason, destination_reason=said))


def plan(items: DataFrame, targets: DataFrame) -> DataFrame:
    """items: path, fm, destination...; targets: destination, target. Adds kind: skip, knowledge, copy or unconfigured."""
    kind = (
        F.when(F.col("destination") == "skip", "skip")
        .when(F.col("destination") == "knowledge", "knowledge")
        .when(text.present(F.col("target")).isNotNull(), "copy")
        .otherwise("unconfigured")
    )
    return items.join(targets.filter("destination <> 'knowledge_manifest'"), "destination", "left").withColumn("kind", kind)


def inbox_stem(path: Column, fm: Column) -> Column:
    return F.concat(F.replace(fmt.value(fm, "source", "unknown"), F.lit("/"), F.lit("-")), F.lit("-"), text.stem(path))


def copies(planned: DataFrame, day: Column, taken: DataFrame | None = None) -> DataFrame:
    """Rows to copy, with a name that is free in their target, and the frontmatter of the copy."""
    rows = planned.filter("kind = 'copy'").withColumn("stem", inbox_stem(F.col("path"), F.col("fm")))
    named = collision_names(rows, "stem", text.path_key(F.col("path")), "name", ["target"], taken, ".md")
    copied = fmt.updated(F.col("pairs"), routed_from_dump=F.col("path"), routed_on=F.date_format(day, "yyyy-MM-dd"), status=F.lit("routed")) if "pairs" in planned.columns else None
    named = named.withColumn("routed_to", F.concat("target", F.lit("/"), "name"))
    return named if copied is None else named.withColumn("copy_pairs", copied)


def original(pairs: Column, routed_to: Column) -> Column:
    """Ordered frontmatter of an original after its copy; skipped items have no place they went to."""
    return F.when(routed_to.isNull(), fmt.updated(pairs, status=F.lit("routed"))).otherwise(fmt.updated(pairs, status=F.lit("routed"), routed_to=routed_to))


def manifest(items: DataFrame) -> DataFrame:
    """items: path, fm. A row for the batch gateway: by address if there is one, else by reference to the note."""
    url = text.strip(fmt.value(F.col("fm"), "url"))
    web = web_address(url)
    hints = F.create_map(*[F.lit(x) for pair in TYPE_HINTS.items() for x in pair])
    return items.select(
        F.when(web, "url").otherwise("ref:vault").alias("origin"),
        F.when(web, url).alias("url"),
        F.when(~web, F.col("path")).alias("ref_path"),
        text.strip(F.when(web, fmt.value(F.col("fm"), "title")).otherwise(F.coalesce(F.element_at("fm", F.lit("title")), text.stem(F.col("path"))))).alias("title"),
        F.coalesce(F.element_at(hints, fmt.value(F.col("fm"), "category")), F.lit("article")).alias("source_type"),
    )


def distribution(items: DataFrame, known: DataFrame, total: str = "TOTAL") -> DataFrame:
    """destination, n, known, rank: known destinations with zeros, then others by name, then the total of all."""
    counts = items.filter("destination <> ''").groupBy("destination").agg(F.count("*").alias("n"))
    joined = known.select("destination", "ordinal").join(counts, "destination", "full").select(
        "destination", F.coalesce("n", F.lit(0)).alias("n"), F.col("ordinal").isNotNull().alias("known"), F.coalesce("ordinal", F.lit(1 << 30)).alias("rank")
    )
    whole = joined.agg(F.lit(total).alias("destination"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.lit(True).alias("known"), F.lit((1 << 31) - 1).alias("rank"))
    return joined.unionByName(whole).orderBy("rank", "destination")


def breakdown(items: DataFrame, targets: DataFrame) -> DataFrame:
    """Reserved destinations first, then configured ones in their order, then others by name."""
    own = items.sparkSession.createDataFrame([(k, i - len(RESERVED)) for i, k in enumerate(RESERVED)], "destination string, ordinal int")
    configured = targets.filter(~F.col("destination").isin(*RESERVED, "knowledge_manifest")).select("destination", "ordinal")
    return distribution(items, own.unionByName(configured)).filter("destination <> 'TOTAL'")


def statistics(planned: DataFrame) -> DataFrame:
    """key, n by name: skip_marked, knowledge_queued, <destination>_copied; failed writes count as <destination>_failed."""
    failed = F.coalesce(F.col("failed"), F.lit(False)) if "failed" in planned.columns else F.lit(False)
    key = (
        F.when(F.col("kind") == "skip", "skip_marked")
        .when(F.col("kind") == "knowledge", "knowledge_queued")
        .when(F.col("kind") == "copy", F.concat("destination", F.when(failed, "_failed").otherwise("_copied")))
    )
    return planned.select(key.alias("key")).filter("key is not null").groupBy("key").agg(F.count("*").alias("n")).orderBy("key")


def targets_table(spark: SparkSession, targets: dict[str, str | None]) -> DataFrame:
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(targets.items())], "destination string, target string, ordinal int")
