"""Text indexes as written tables: a catalog folder with postings clustered by term, term counts, and figures of each field.

``<root>/<index>/`` holds postings (field, term, doc_id, tf, dl) in ranges of terms, so that a query reads only the row
groups of its terms; terms (field, term, df, cf); fields (field, kind, n, avgdl).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import B, K1, STOPWORDS, pieces, postings


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def create(docs: DataFrame, root: str, name: str, fields: list[str], *, id: str = "doc_id", prefix: str | None = None, key: str = "key") -> None:
    """FT.CREATE over text fields, for the documents whose key has the prefix; an index of that name is an error."""
    docs = docs if prefix is None else docs.where(F.col(key).startswith(prefix))
    path = f"{root}/{name}"
    single = docs.groupBy(id).count().where("count > 1").isEmpty()
    rows = counted(docs, fields, id) if single else postings(docs, fields, id)
    rows.write.parquet(f"{path}/counted")  # ranges are found from its terms alone, and nothing is counted twice
    rows = docs.sparkSession.read.schema(rows.schema).parquet(f"{path}/counted")
    rows.repartitionByRange("term").sortWithinPartitions("term", "field", "doc_id").write.option("parquet.block.size", str(16 << 20)).parquet(f"{path}/postings")
    drop(docs.sparkSession, path, "counted")
    held = docs.sparkSession.read.parquet(f"{path}/postings")
    held.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    words = docs.sparkSession.read.parquet(f"{path}/terms").groupBy("field").agg(F.sum("cf").alias("words"))  # a row a field
    named = [F.struct(F.lit(f).alias("field"), F.lit("TEXT").alias("kind"), F.col(f"n{i}").alias("n")) for i, f in enumerate(fields)]
    figures = docs.agg(*[F.count(f).alias(f"n{i}") for i, f in enumerate(fields)]).select(F.inline(F.array(*named))).join(F.broadcast(words), "field", "left")
    figures.select("field", "kind", "n", F.try_divide(F.coalesce("words", F.lit(0)), F.col("n")).alias("avgdl")).coalesce(1).write.parquet(f"{path}/fields")


def counted(docs: DataFrame, fields: list[str], id: str) -> DataFrame:
    """`postings` of documents with ids of their own: words are counted where they are read, and not shuffled.

    Each different word of a batch is held against the stopwords once.
    """
    stop = pa.array(STOPWORDS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, field in enumerate(fields):
                words = batch.column(i + 1)
                each = words.flatten().dictionary_encode()
                row = np.repeat(np.arange(len(batch)), pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
                term = each.indices.to_numpy(zero_copy_only=False)
                kept = pc.and_(pc.greater_equal(pc.binary_length(each.dictionary), 2), pc.invert(pc.is_in(each.dictionary, stop))).to_numpy(zero_copy_only=False)
                row, term = (x[kept[term]] if len(term) else x for x in (row, term))
                length, n = np.bincount(row, minlength=len(batch)), max(1, len(each.dictionary))
                pair, tf = np.unique(row * n + term, return_counts=True)
                at, term = pair // n, pair % n
                yield pa.record_batch([pa.repeat(field, len(pair)), batch.column(0).take(pa.array(at)), each.dictionary.take(pa.array(term)), pa.array(tf.astype(np.int64)), pa.array(length[at].astype(np.int32))], names=["field", "doc_id", "term", "tf", "dl"])

    given = docs.select(F.col(id).alias("doc_id"), *[pieces(F.col(f)).alias(f"w{i}") for i, f in enumerate(fields)])
    return given.mapInArrow(rows, f"field string, doc_id {docs.schema[id].dataType.simpleString()}, term string, tf long, dl int")


def drop(spark: SparkSession, root: str, name: str) -> bool:
    """FT.DROPINDEX: whether there was one."""
    at, fs = _folder(spark, f"{root}/{name}")
    return bool(fs.delete(at, True))


def names(spark: SparkSession, root: str) -> list[str]:
    """FT._LIST."""
    at, fs = _folder(spark, root)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def info(spark: SparkSession, root: str, name: str) -> DataFrame:
    """FT.INFO: for each field its kind, documents, mean length, terms and postings."""
    t = spark.read.parquet(f"{root}/{name}/terms").groupBy("field").agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings"))
    return spark.read.parquet(f"{root}/{name}/fields").join(F.broadcast(t), "field", "left")  # a row a field


def compact(spark: SparkSession, root: str, name: str, files: int = 1) -> None:
    """FT.COMPACT: the postings again in so many files, still in order of terms."""
    path = f"{root}/{name}/postings"
    spark.read.parquet(path).repartitionByRange(files, "term").sortWithinPartitions("term", "field", "doc_id").write.parquet(f"{path}-new")
    at, fs = _folder(spark, path)
    fs.delete(at, True)
    fs.rename(_folder(spark, f"{path}-new")[0], at)


def expand(spark: SparkSession, root: str, name: str, field: str, *, prefix: str | None = None, fuzzy: tuple[str, int] | None = None, most: int = 50) -> list[tuple[str, int]]:
    """The terms of a prefix or within an edit distance, the most frequent (df) of them."""
    t = spark.read.parquet(f"{root}/{name}/terms").where(F.col("field") == field)
    t = t.where(F.col("term").startswith(prefix)) if prefix is not None else t.where(F.levenshtein("term", F.lit(fuzzy[0])) <= fuzzy[1])
    return [(r.term, r.df) for r in t.orderBy(F.desc("df"), "term").limit(most).collect()]


def search(spark: SparkSession, root: str, name: str, field: str, groups: list[list[str]], *, k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, score): BM25 summed over groups of terms; a group (expansions of a prefix or fuzzy term) counts with its best term."""
    terms = sorted({t for g in groups for t in g})
    path = f"{root}/{name}"
    mine = F.col("term").isin(terms) & (F.col("field") == field)
    told = spark.read.parquet(f"{path}/terms").where(mine).select("term", "df")  # at most as many rows as terms
    n = spark.read.parquet(f"{path}/fields").where(F.col("field") == field).select("n", "avgdl")
    s = spark.read.parquet(f"{path}/postings").where(mine).join(F.broadcast(told), "term").crossJoin(F.broadcast(n))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.greatest("avgdl", F.lit(1.0))))
    best = s.select("doc_id", "term", score.alias("score")).groupBy("doc_id").agg(*[F.max(F.when(F.col("term").isin(g), F.col("score"))).alias(f"g{i}") for i, g in enumerate(groups)])
    return best.select("doc_id", sum((F.coalesce(f"g{i}", F.lit(0.0)) for i in range(len(groups))), F.lit(0.0)).alias("score"))


def parse_filter(words: list[str]):
    """The hybrid FILTER in prefix form: TAG field value (a final * is a prefix), NUMERIC field low high, AND n .., OR n ..; a Column."""

    def read(i: int):
        if i >= len(words):
            raise ValueError("the filter ends early")
        kind = words[i].upper()
        if kind == "TAG":
            field, value = words[i + 1], words[i + 2].lower()
            c = F.lower(F.col(field))
            return (c.startswith(value[:-1]) if value.endswith("*") else c == value), i + 3
        if kind == "NUMERIC":
            return F.col(words[i + 1]).between(float(words[i + 2]), float(words[i + 3])), i + 4
        if kind in ("AND", "OR"):
            n, at, parts = int(words[i + 1]), i + 2, []
            for _ in range(n):
                part, at = read(at)
                parts.append(part)
            out = parts[0]
            for p in parts[1:]:
                out = out & p if kind == "AND" else out | p
            return out, at
        raise ValueError(f"unknown filter {words[i]}")

    out, end = read(0)
    if end != len(words):
        raise ValueError("words after the filter")
    return out
