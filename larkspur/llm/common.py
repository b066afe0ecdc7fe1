"""Shared helpers of the training-data operators: scratch tables, bounded broadcasts, word columns."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the five ASCII controls from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A side is broadcast only if it has been counted and has at most so many rows.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a folder of this machine serves, which is only right in local mode.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/larkspur/{name}-{uuid.uuid4().hex}"


#: Shuffles of a finished write are deleted at once; nothing else reads them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here, lost executors cost no recomputation."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.format(fmt).option("compression", "zstd").save(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.format(fmt).schema(df.schema).load(path)


def drop_stash(df: DataFrame) -> None:
    """Delete a table made by stash() that nothing will read any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/larkspur/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def release(*stashes: DataFrame) -> None:
    """Delete tables that nothing reads any more, and let Spark's cleaner find the shuffles of finished jobs."""
    for df in stashes:
        drop_stash(df)
    release_shuffles(stashes[0].sparkSession)


def release_shuffles(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows and the bytes of its strings are counted and few; else unhinted, for a shuffled join that AQE can split."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)).cast("long") for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    n, size = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(texts, F.lit(0).cast("long"))), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= most else df


def words(text: Column) -> Column:
    """Words of a text: maximal runs of characters other than space and tab to carriage return; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES, -1), "")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def numbered(df: DataFrame, *names: str) -> tuple:
    """df with its columns named by place, then the new names of the given ones: names an operator adds cannot clash."""
    kept = df.columns
    return df.toDF(*[f"_c{i}" for i in range(len(kept))]), *[f"_c{kept.index(n)}" for n in names]


def free_names(taken: list[str], names: list[str]) -> list[str]:
    """The names for new columns: one that is taken gets underscores until it is free, so the caller's columns stay."""
    out = []
    for n in names:
        while n in taken or n in out:
            n += "_"
        out.append(n)
    return out


def own(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, resolved by position so that further columns with clashing names do no harm."""
    kept = df.columns
    picks = [next(i for i, c in enumerate(kept) if c == n) for n in names]
    if len(set(kept)) == len(kept):
        return df.select(*[F.col(f"`{n}`") for n in names])
    flat = df.toDF(*[f"_c{i}" for i in range(len(kept))])
    return flat.select(*[F.col(f"_c{i}").alias(n) for i, n in zip(picks, names)])
