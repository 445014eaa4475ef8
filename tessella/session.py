"""Session defaults.

Every setting here is a semantic requirement or a default that a cluster's own
configuration overrides; nothing sizes the job to one machine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: UTC keeps date arithmetic equal on every host.
REQUIRED = {"spark.sql.session.timeZone": "UTC"}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tessella")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
    )
    for key, value in (REQUIRED | more).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut through the shared folder in spark.checkpoint.dir; as it is where a session names none. For small
    tables that several jobs or rounds read."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        if folder is None:
            return df
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
