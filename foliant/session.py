"""Session helpers shared by every subpackage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, by any path that Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch where the session keeps Spark's default of 10000, which suits numbers: rows here are long texts.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it, and take texts in batches that fit their memory."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(p for p in (root, env.get("PYTHONPATH", "")) if p)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is named and driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        if named.isDefined():
            named = named.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            named = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def width(spark: SparkSession) -> int:
    """The number of shuffle partitions that this session is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
