"""A folder of notes as a stream: an extension, for live imports. Each batch takes the same steps as a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.capture import notes
from tessella.operators.selection import is_item, needs_classification


def note_stream(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of notes as they appear."""
    reader = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).schema("value string")
    return reader.load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def pending(stream: DataFrame, include_unfronted: bool = True) -> DataFrame:
    """Parsed notes that wait for classification; stateless, so no watermark is needed."""
    return notes(stream).filter(is_item(F.col("path")) & needs_classification(F.col("fm"), include_unfronted))


def run(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Gives what is pending to a step, batch by batch, once all that is there is read."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
