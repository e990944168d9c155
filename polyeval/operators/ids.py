"""Positions, running counts and ordered concatenation without a single task.

The reference keys everything by the zero-based line number and numbers
missing question ids 1, 2, 3... in input order. Both are global prefix sums.
Here they are computed as Spark jobs that never route all rows through one
task:

* ``with_index``: ``monotonically_increasing_id`` gives (partition, offset in
  partition); one small aggregate counts rows per partition and an exclusive
  prefix sum over partitions (one row per partition) turns that into a dense
  0-based index. The ids are fixed by a reliable checkpoint first, so a
  recomputation after an executor loss cannot change them.
* ``running_count``: prefix sum of a 0/1 flag in index order, chunked by the
  dense index, so each window partition holds at most ``chunk`` rows even when
  one key holds a third of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyeval.session import cut_lineage

_PID_SHIFT = 33  # monotonically_increasing_id = partition << 33 | row-in-partition


def with_index(df: DataFrame, name: str = "idx", order_by: list | None = None,
               checkpoint: bool = True, key: list[str] | None = None,
               by: tuple = ()) -> DataFrame:
    """Add a dense 0-based ``name`` column in scan order (or in ``order_by``
    order, after a range-partitioned global sort).

    ``key``: columns that name a row; then only they and the columns ``by`` that
    ``order_by`` names besides them are sorted and checkpointed, and the positions
    are joined back, so texts are not written a second time. A null is a key
    value like any other; a key that two rows share raises.
    """
    if key and set(key) != set(df.columns):
        more = [c for c in df.columns if c in by and c not in key]
        slim = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in more])
        once = F.when(F.col("_rows") == 1, F.lit(0)).otherwise(F.raise_error(F.lit(f"rows share a key of {key}")))
        slim = with_index(slim.select(*key, *more, once.alias("_rows")), name, order_by, checkpoint)
        slim = slim.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], (F.col(name) + F.col("_rows")).alias(name))
        same = F.lit(True)
        for i, k in enumerate(key):
            same = same & df[k].eqNullSafe(F.col(f"_k{i}"))
        return df.join(slim, same).drop(*[f"_k{i}" for i in range(len(key))])
    if order_by:
        df = df.orderBy(*order_by)
    df = df.withColumn("_mid", F.monotonically_increasing_id())
    if checkpoint:
        df = cut_lineage(df)
    pid = F.shiftright(F.col("_mid"), _PID_SHIFT)
    counts = df.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per input partition: adaptive execution measures it
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = df.join(offsets, pid == F.col("_pid"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid"), _PID_SHIFT)
    return out.withColumn(name, (F.col("_off") + local).cast("bigint")).drop("_mid", "_pid", "_off")


def running_count(df: DataFrame, index_col: str, flag: Column, name: str,
                  chunk: int = 1 << 20) -> DataFrame:
    """Inclusive running count of ``flag`` in ``index_col`` order.

    ``index_col`` must be dense (as made by ``with_index``); chunks of
    ``chunk`` consecutive positions are summed in parallel, a prefix sum over
    the (few) chunk totals gives the offsets, and a window per chunk finishes
    the count inside each chunk.
    """
    c = F.floor(F.col(index_col) / F.lit(chunk)).alias("_chunk")
    d = df.withColumn("_chunk", c).withColumn("_flag", F.coalesce(flag.cast("long"), F.lit(0)))
    totals = d.groupBy("_chunk").agg(F.sum("_flag").alias("_t"))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select("_chunk", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_chunk").orderBy(index_col).rowsBetween(Window.unboundedPreceding, 0)
    # chunk totals: one row per `chunk` input rows; AQE broadcasts it when small
    return (d.join(offs, "_chunk")
            .withColumn(name, F.col("_off") + F.sum("_flag").over(inside))
            .drop("_chunk", "_flag", "_off"))


def question_ids(df: DataFrame, id_col: str = "question_id", index_col: str = "idx",
                 name: str = "question_id") -> DataFrame:
    """Keep a given id, else number the null ids 1, 2, 3... in input order."""
    rc = running_count(df, index_col, F.col(id_col).isNull(), "_nulls")
    return rc.withColumn(name, F.coalesce(F.col(id_col).cast("string"),
                                          F.col("_nulls").cast("string"))).drop("_nulls")


def ordered_concat(df: DataFrame, keys: list[str], order_col: str, text: Column,
                   name: str, sep: str = "", chunk: int = 1024) -> DataFrame:
    """Concatenate ``text`` per key in ``order_col`` order, in two levels.

    Rows are first concatenated per (key, chunk of ``chunk`` consecutive
    places of the order) in parallel; the final step joins one partial string
    per chunk. Rows at one place are ordered by their text, null keys are a
    group, and null texts add nothing.
    The output row holds the whole group's text by definition; no step holds
    more than one chunk of input rows beyond that.
    """
    d = df.select(*keys, F.col(order_col).alias("_o"), text.alias("_t"))
    # one row for each place of the order, with the number of rows before it: a hot key spreads over many tasks
    places = with_index(d.groupBy(*keys, "_o").agg(F.count(F.lit(1)).alias("_rows")), "_pos", order_by=[*keys, "_o"])
    places = places.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_o").alias("_ko"),
                           F.floor(F.col("_pos") / F.lit(chunk)).alias("_chunk"))
    same = F.col("_o").eqNullSafe(F.col("_ko"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    d = d.join(places, same).drop("_ko", *[f"_k{i}" for i in range(len(keys))])
    part = d.groupBy(*keys, "_chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_t"))),
                                 lambda s: s["_t"]), sep).alias("_p"))
    return part.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "_p"))),
                                 lambda s: s["_p"]), sep).alias(name))
