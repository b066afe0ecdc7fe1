"""Structured Streaming counterparts: event sources, windowed counts with late data, blocking pops as batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 100) -> DataFrame:
    """XREAD BLOCK, SUBSCRIBE, WAL tail: new files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def subscribe(stream: DataFrame, channel: str | None = None, pattern: str | None = None) -> DataFrame:
    from ..functions.strings import glob

    return stream.where(F.col("channel") == channel if channel is not None else F.col("channel").rlike(glob(pattern or "*")))


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))


def pop_batches(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """BLPOP and kin: each batch is handed over once; the checkpoint is the consumer's place."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
