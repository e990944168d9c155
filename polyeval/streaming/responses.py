"""Structured Streaming jobs (K1, K2; A17).

K1 ``stream_responses``: model results land as JSON files while a run is in
progress; the stream appends them to a parquet table with a checkpoint, so a
crash keeps every finished record and a restart resumes where it stopped.

K2 ``stream_scores``: accuracy and response-error rate per (dataset, lang,
model) kept up to date while results arrive. Duplicate deliveries (a task
retried after an executor loss repeats its calls) are dropped on
(dataset, model, lang, question_id); the per-row decisions are the same
column rules as the batch scorer, so after all files the table equals the
batch result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyeval.operators import scoring as S

RESPONSE_SCHEMA = T.StructType([
    T.StructField("question_id", T.LongType()), T.StructField("dataset", T.StringType()),
    T.StructField("model", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("system_prompt", T.StringType()), T.StructField("prompt", T.StringType()),
    T.StructField("response", T.StringType()), T.StructField("ground_truth", T.StringType()),
    T.StructField("idx", T.LongType()),
])
KEYS = ["dataset", "lang", "model"]


def read_stream(spark: SparkSession, folder: str, schema: T.StructType = RESPONSE_SCHEMA,
                files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.json(folder)


def stream_responses(spark: SparkSession, folder: str, sink: str, checkpoint: str,
                     files_per_trigger: int | None = None) -> None:
    """K1: append arriving results to parquet; runs until the folder is
    drained (``availableNow``) and can be started again later."""
    q = (read_stream(spark, folder, files_per_trigger=files_per_trigger)
         .writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


DELIVERY_KEYS = ["dataset", "model", "lang", "question_id"]


def first_deliveries(stream: DataFrame, event_time: str | None = None, repeat_within: str = "7 days") -> DataFrame:
    """Each result once. With an event time, a repeat is looked for within ``repeat_within`` of the
    first delivery, and the state of older ids is dropped by the watermark (results that are later
    than that are dropped too); without one, every id is remembered for good."""
    if event_time is None:
        return stream.dropDuplicates(DELIVERY_KEYS)
    return stream.withWatermark(event_time, repeat_within).dropDuplicatesWithinWatermark(DELIVERY_KEYS)


def _scored_counts(stream: DataFrame, event_time: str | None, repeat_within: str) -> DataFrame:
    rows = S.score_rows(first_deliveries(stream, event_time, repeat_within))
    return rows.groupBy(*KEYS).agg(
        F.sum(F.col("right").cast("long")).alias("right"), F.sum(F.col("error").cast("long")).alias("errors"),
        F.count(F.lit(1)).alias("rows"))


def stream_scores(spark: SparkSession, folder: str, table_path: str, checkpoint: str,
                  files_per_trigger: int | None = None, rocksdb: bool = True, event_time: str | None = None,
                  repeat_within: str = "7 days", keep_versions: int = 10, schema: T.StructType = RESPONSE_SCHEMA) -> None:
    """K2: running counts per (dataset, lang, model) in ``update`` mode.

    Every micro-batch merges its changed groups into a new version
    ``table_path/v=<epoch>`` of the score table (one row per group) built
    from the previous version; nothing is overwritten in place, so a replayed
    epoch after a failure rebuilds the same version from intact input.
    Versions older than the last ``keep_versions`` are retired. With ``event_time``
    (a timestamp column of ``schema``) the de-duplication state holds the ids of the
    last ``repeat_within`` only; without it every id seen. ``rocksdb`` keeps the state
    in the RocksDB state store (on local disk, checkpointed) instead of the executor
    heap.
    """
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    if rocksdb:
        spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def merge(batch: DataFrame, epoch: int) -> None:
        sp = batch.sparkSession
        cur = batch.select(*KEYS, "right", "errors", "rows")
        prev = _latest(sp, table_path, before=epoch)
        if prev is not None:
            cur = prev.join(cur.select(*KEYS), KEYS, "left_anti").unionByName(cur)
        cur.write.mode("overwrite").parquet(f"{table_path.rstrip('/')}/v={epoch}")
        retire(sp, table_path, keep_versions)

    try:
        q = (_scored_counts(read_stream(spark, folder, schema, files_per_trigger), event_time, repeat_within)
             .writeStream.outputMode("update").foreachBatch(merge)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:                                # the query keeps the setting it started with
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)
    q.awaitTermination()


def retire(spark: SparkSession, table_path: str, keep: int) -> None:
    """Delete the versions before the last ``keep`` ones (at least the newest two stay: a
    replayed epoch is built from the one before)."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(table_path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath() for s in fs.listStatus(fs_path) if s.getPath().getName().startswith("v=")]
    names.sort(key=lambda p: int(p.getName()[2:]))
    for old in names[:-max(2, keep)]:
        fs.delete(old, True)


def _latest(spark: SparkSession, table_path: str, before: int | None = None) -> DataFrame | None:
    """The newest version of the score table (older than ``before``); None before the
    first version. A version that cannot be read raises."""
    try:
        t = spark.read.parquet(table_path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if before is not None:
        t = t.where(F.col("v") < before)
    top = t.agg(F.max("v")).first()[0]     # one number
    if top is None:
        return None
    return t.where(F.col("v") == top).drop("v")


def score_view(spark: SparkSession, table_path: str) -> DataFrame:
    """Accuracy and RER from the running counts."""
    t = _latest(spark, table_path)
    return t.select(*KEYS, "right", "errors", "rows",
                    F.try_divide(F.col("right").cast("double"), F.col("rows")).alias("accuracy"),
                    F.try_divide(F.col("errors").cast("double"), F.col("rows")).alias("rer"))
