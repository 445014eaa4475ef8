"""What the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(name: str) -> Column:
    """The UTF-8 bytes of a text column; null is empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def held_out(name: str) -> Column:
    """True where crc32(id as text) mod 4 is 2: rows that no model learns from. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Bytes that cross to a Python worker at once where rows hold whole texts.
TEXT_BYTES = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bytes a batch to TEXT_BYTES, if they are more: with texts in them, the default of 10,000 rows is tens of
    megabytes, several times over in the executor and its workers."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgt]?)i?b?", spark.conf.get(name).lower()).groups()
    if int(number) << 10 * " kmgt".index(unit or " ") > TEXT_BYTES:
        spark.conf.set(name, str(TEXT_BYTES))


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has `rows` rows at most; a larger one is joined by shuffles. df should be cut off, for it is counted."""
    return F.broadcast(df) if df.count() <= rows else df


def _folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share: the session's, or on one machine a private one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp())
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the folder that all executors share.

    The session's spark.checkpoint.dir is used; a private folder is set only where a local session names none, as in tests.
    """
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As checkpointed(), but kept as compressed Parquet in a folder of its own there, with statistics; for larger tables. Who
    runs the job empties the checkpoint folder after it, or calls discarded()."""
    path = f"{_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Deletes what written() made, if df is such a table."""
    spark = df.sparkSession
    for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
        if re.search(r"/table-[0-9a-f-]{36}$", folder):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
