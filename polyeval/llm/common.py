"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyeval.session import ensure_checkpoint_dir, ship_package

FOLDS = 5                      # rows whose crc32(doc_id as text) % 5 == 0 are held out
BLOCK_BYTES = 4 << 20          # text handled at once inside a Python task
CACHE_WORDS = 300_000          # entries of a per-task word cache before it is emptied


def prepare(spark: SparkSession) -> None:
    """Package on the workers, checkpoint folder known (the session's own where it names one)."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder, its scheme kept."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{os.urandom(6).hex()}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here, a lost
    executor does not repeat the work, and several readers share it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the rows no model learns from; a null id counts as the empty text (held out)."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS) == 0


def train_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y) of the training fold. Null ids and labels do not train; of repeated rows of an id one remains."""
    return (labels.select(F.col("doc_id").alias("doc_id"), F.col(column).cast("int").alias("y"))
            .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.max("y").alias("y")))


def sample_labels(labels: DataFrame, column: str, max_per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y) of the training fold, about ``max_per_class`` rows of either
    class, and the class counts over the whole fold.

    The sample takes the rows whose doc_id hash lies below the class's share, so
    it needs no sort and is the same at every layout.
    """
    train = train_labels(labels, column)
    counts = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    share = F.lit(1.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, max_per_class / n))).otherwise(share)
    return train.where(unit < share), counts


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, y, text) of a sample's documents. Of repeated rows of an id the one with the
    smallest text hash remains, so there are no more rows than the sample has."""
    text = F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text"))
    return (docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
            .join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min(text).alias("t"))
            .select("doc_id", "y", F.col("t.text").alias("text")))


class HashCache(dict):
    """word -> value of ``make``; emptied when it holds ``limit`` entries."""

    def __init__(self, make, limit: int = CACHE_WORDS):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def crc(data: bytes) -> int:
    return zlib.crc32(data)


def blocks(texts, limit: int = BLOCK_BYTES):
    """Split a sequence of texts into (start, stop) runs of about ``limit`` bytes."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
