"""Reading and writing tables: snapshots as Parquet, change feeds as JSON lines."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A bare scan, dealt out to all cores where its files make fewer tasks than there are cores; larger ones stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else scan


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); a folder of this machine in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/larkspur/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again, so that what follows does not plan or run it twice."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_snapshot(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """SAVE/BGSAVE: the whole table, in place of the last snapshot."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def save_changes(events: DataFrame, path: str) -> None:
    """CDC sink: one JSON envelope a line."""
    events.select("event").write.mode("append").text(path)
