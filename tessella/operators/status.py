"""Reports on a library of sources, and the lifecycle of its items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import present
from tessella.operators.selection import dated_folder, is_extracted


def title_line(text: Column) -> Column:
    """The first title line without quotes; `untitled` without one."""
    found = F.regexp_extract(text, r"(?m)^title:[ \t]*(.*)$", 1)
    return F.when(F.coalesce(text.rlike(r"(?m)^title:"), F.lit(False)), F.translate(found, '"', "")).otherwise("untitled")


def totals(library: DataFrame) -> DataFrame:
    """library: folder, extract (text or null). Folders, and those whose extract says extracted."""
    return library.groupBy("folder").agg(F.max(F.coalesce(is_extracted(F.col("extract")), F.lit(False))).alias("done")).agg(F.count("*").alias("total"), F.count_if("done").alias("extracted"))


def recent(library: DataFrame, most: int = 5) -> DataFrame:
    """The newest dated folders with titles; each task keeps its own newest only."""
    return library.filter(dated_folder(F.col("folder"))).orderBy(F.col("folder").desc()).limit(most).select("folder", title_line(F.col("extract")).alias("title"))


def dashboard(items: DataFrame) -> DataFrame:
    """Totals by status and destination, with subtotals and the grand total."""
    return items.cube("status", "destination").agg(F.count("*").alias("n"))


def by_domain(items: DataFrame, value: int = 5) -> DataFrame:
    """Classified items of a value, as a grouped view shows them."""
    return items.filter((F.col("status") == "classified") & (F.col("type") == "dump-item") & (F.col("value") == value)).select("domain", "title", "source", "reason")


def vault_status(has_extract: Column, integrated: Column) -> Column:
    """captured, extracted, or integrated; the last only by a person's mark."""
    return F.when(integrated, "integrated").when(has_extract, "extracted").otherwise("captured")


def dump_status(status: Column, has_value: Column, routed: Column) -> Column:
    """unclassified, classified, routed; what a person set stays."""
    kept = status.isin("keep", "skip", "maybe")
    return F.when(kept, status).when(routed, "routed").when(has_value, "classified").otherwise(F.coalesce(present(status), F.lit("unclassified")))
