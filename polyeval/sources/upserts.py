"""Upserts into a stored table, copy-on-write.

A stored table is a folder of data files that are never changed, and versions of
a manifest (the files that make up the table). An upsert finds the files that
hold a touched key, rewrites only those, and publishes a new manifest; readers of
the old version are not disturbed, and a failed upsert leaves the old version as
it is.

Tables may consist of very many small files. A task therefore writes and reads
many of them, through the file system that the path names (``sources/stores.py``),
and the manifest is a DataFrame all along: its names are dealt out to the tasks,
and neither a listing of the data folder nor a driver's list of names is needed.
A data file counts from the moment that a published manifest names it, so what
failed tasks leave behind is never read.
"""

from __future__ import annotations

import uuid

from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyeval.operators.joins import last_per_key
from polyeval.session import cut_lineage

MANIFEST = "file string, bytes long"
TASK_FILES = 256                  # small files of one task
TASK_BYTES = 128 * 1024 * 1024    # read by one task, where the files are larger
BATCH_ROWS = 10_000               # rows of small files are handed on together


def _manifests(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{MANIFEST}, v long").parquet(f"{path.rstrip('/')}/manifest")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def version(spark: SparkSession, path: str) -> int | None:
    """The newest published version; None for a table that does not exist."""
    m = _manifests(spark, path)
    return None if m is None else m.agg(F.max("v")).first()[0]


def manifest(spark: SparkSession, path: str, v: int | None = None) -> DataFrame:
    """Data files of a version (default: the newest), relative to the table, and their bytes."""
    v = version(spark, path) if v is None else v
    return _manifests(spark, path).where(F.col("v") == v).drop("v")


def files(spark: SparkSession, path: str, v: int | None = None) -> list[str]:
    """The names of ``manifest`` as a sorted list."""
    return sorted(r["file"] for r in manifest(spark, path, v).collect())


def _publish(names: DataFrame, path: str, v: int) -> None:
    names.write.parquet(f"{path.rstrip('/')}/manifest/v={v}")


def _written(df: DataFrame, path: str, v: int, by: str | None = None) -> DataFrame:
    """Writes the data files of a version when it is evaluated: one for each partition, or
    for each run of equal ``by`` in a partition (a column that is not stored). One row a file."""
    root, folder = path.rstrip("/"), f"data/v={v:06d}"

    def put(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        from polyeval.sources.stores import open_store
        store, base = open_store(root)
        store.create_dir(f"{base}/{folder}", recursive=True)
        task = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        names, sizes = [], []
        writer = sink = last = None

        def end():
            writer.close()
            sizes.append(sink.tell())
            sink.close()

        for b in batches:
            if not b.num_rows:
                continue
            cuts = [0, b.num_rows]
            if by is not None:
                g = b.column(b.schema.get_field_index(by))
                b = b.drop_columns([by])
                # nulls are one group
                g = pc.fill_null(pc.binary_join_element_wise("=", g, ""), "")
                ends = pc.indices_nonzero(pc.not_equal(g[1:], g[:-1])).to_pylist()
                cuts = [0, *(e + 1 for e in ends), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                group = None if by is None else g[lo].as_py()
                if writer is None or group != last:
                    if writer is not None:
                        end()
                    names.append(f"{folder}/part-{task}-{len(names):06d}.parquet")
                    sink = store.open_output_stream(f"{base}/{names[-1]}", compression=None)
                    writer = pq.ParquetWriter(sink, b.schema, compression="snappy")
                    last = group
                writer.write_batch(b.slice(lo, hi - lo))
        if writer is not None:
            end()
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64())], ["file", "bytes"])

    return df.mapInArrow(put, MANIFEST)


def create(df: DataFrame, path: str, by: Column | None = None) -> None:
    """A new stored table from the rows of ``df``: one file for each partition that has rows, or, with
    ``by``, for each of its values (null is one)."""
    spark = df.sparkSession
    spark.createDataFrame([], df.schema).write.parquet(f"{path.rstrip('/')}/schema")
    if by is None:
        return _publish(_written(df, path, 0), path, 0)
    n = df.select(by.cast("string").alias("_by")).distinct().count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_FILES))
    dealt = df.withColumn("_by", by.cast("string")).repartition(tasks, "_by").sortWithinPartitions("_by")
    _publish(_written(dealt, path, 0, "_by"), path, 0)


def _rows(names: DataFrame, path: str, schema: T.StructType) -> DataFrame:
    """Rows of the data files ``names`` (columns ``file``, ``bytes``), with the file of each row as ``_file``."""
    root, columns = path.rstrip("/"), schema.fieldNames()
    out = T.StructType([*schema.fields, T.StructField("_file", T.StringType())])
    size = names.agg(F.sum(F.col("bytes") + TASK_BYTES // TASK_FILES)).first()[0] or 0

    def get(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        from polyeval.sources.stores import open_store
        store, base = open_store(root)
        held, rows = [], 0
        for b in batches:
            for name in b.column(0).to_pylist():
                with store.open_input_file(f"{base}/{name}") as f, pq.ParquetFile(f) as p:
                    for part in p.iter_batches(BATCH_ROWS, columns=columns):
                        # columns by name: a file of older code may order them otherwise
                        cells = [part.column(c) for c in columns]
                        held.append(pa.RecordBatch.from_arrays(
                            [*cells, pa.array([name] * part.num_rows, pa.string())], [*columns, "_file"]))
                        rows += part.num_rows
                        if rows >= BATCH_ROWS:
                            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                            held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return names.select("file").repartition(max(1, -(-size // TASK_BYTES))).mapInArrow(get, out)


def _schema(spark: SparkSession, path: str) -> T.StructType:
    return spark.read.parquet(f"{path.rstrip('/')}/schema").schema


def read(spark: SparkSession, path: str, v: int | None = None) -> DataFrame:
    """Rows of a version, with the file of each row as ``_file``. Spark sizes it by the manifest
    alone: as a join's side that must not be broadcast, give it a hint."""
    return _rows(manifest(spark, path, v), path, _schema(spark, path))


def upsert(spark: SparkSession, path: str, updates: DataFrame, key: str, fields: list[str], order: str) -> dict[str, int]:
    """Replace the rows that ``updates`` names (of several updates of a key the last by ``order``;
    keys that the table lacks are left out). Returns the counts of files and of rewritten files."""
    v = version(spark, path)
    old, schema = manifest(spark, path, v), _schema(spark, path)
    keys = _rows(old, path, T.StructType([schema[key]]))
    # one name a file: a part of the manifest
    touched = cut_lineage(keys.join(updates.select(key).distinct(), key, "left_semi").select("_file").distinct())
    names = old.join(touched, old["file"] == touched["_file"], "left_semi")
    done = {"files": old.count(), "rewritten": touched.count()}
    if done["rewritten"]:
        base = _rows(names, path, schema).drop("_file")
        last = last_per_key(updates, key, fields, order).select(
            F.col(key).alias("_k"), F.struct(*fields).alias("_new"))
        merged = base.join(last, base[key] == last["_k"], "left").select(*[
            F.when(F.col("_k").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
            for c in base.columns])
        kept = old.join(touched, old["file"] == touched["_file"], "left_anti")
        _publish(kept.unionByName(_written(merged, path, v + 1)), path, v + 1)
    return done
