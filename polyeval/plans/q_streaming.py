"""Registered streaming queries.

The fixture responses arrive as JSON files in two waves (the second wave
repeats some rows, as a retried task would); the stream is started, stopped
and started again from its checkpoint. The result must equal the batch twin.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from polyeval.plans import oracle as O
from polyeval.plans.catalog import register
from polyeval.plans.fixtures import fx_responses, with_views
from polyeval.session import scratch_path
from polyeval.streaming import responses as ST

COLS = ["question_id", "dataset", "model", "lang", "system_prompt", "prompt", "response", "ground_truth", "idx"]


def _two_waves(spark, sf, incoming, run):
    r = fx_responses(spark, sf).select(*COLS)
    first = r.where(F.col("question_id") % 2 == 0)
    second = r.where(F.col("question_id") % 2 == 1).unionByName(
        r.where(F.col("question_id") % 10 == 0))          # re-delivered rows
    first.repartition(3).write.mode("append").json(incoming)
    run()                                                 # drain wave 1, stop
    second.repartition(3).write.mode("append").json(incoming)
    run()                                                 # restart from the checkpoint


@register("stream_responses", with_views(
    "SELECT " + ", ".join(COLS) + " FROM fx_responses UNION ALL SELECT " + ", ".join(COLS)
    + " FROM fx_responses WHERE question_id % 10 = 0", "fx_responses"))
def q_stream_responses(spark, sf):
    incoming, sink, ck = (scratch_path(spark, n) for n in ("incoming", "sink", "ckpt"))
    _two_waves(spark, sf, incoming, lambda: ST.stream_responses(spark, incoming, sink, ck, files_per_trigger=2))
    return spark.read.parquet(sink).select(*COLS)


@register("stream_scores", with_views(f"SELECT dataset, lang, model, \"right\", errors, \"rows\", accuracy, rer "
                                      f"FROM ({O.score_table_sql()}) t", "fx_responses"))
def q_stream_scores(spark, sf):
    incoming, table, ck = (scratch_path(spark, n) for n in ("incoming", "scores", "ckpt"))
    _two_waves(spark, sf, incoming, lambda: ST.stream_scores(spark, incoming, table, ck, files_per_trigger=2))
    return ST.score_view(spark, table)
