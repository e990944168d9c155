"""Greedy size-bounded packing of requests into files.

Semantics: records in order; a new file starts when the bytes so far plus
the record's size exceed ``max_bytes`` or the file already holds
``max_rows`` records; a first record above the byte limit leaves file 1
empty. The fold is sequential, but only through the *file starts*: once a
file starts at record i, the next start ``next(i)`` depends on i alone. The
job is therefore exact and never routes all records through one task:

1. dense positions (``with_index``) and chunks of ``chunk_rows`` positions,
   each chunk with a halo of ``max_rows`` records of the next chunk;
2. per chunk (``applyInPandas``, at most chunk + halo rows): ``next(i)`` by
   vectorised ``searchsorted`` on the prefix sums, and the map
   ``f_k: entry offset -> exit offset`` (entries lie in the first
   ``max_rows`` records of a chunk, since no file holds more);
3. the entry offset of every chunk by a parallel prefix over the maps
   (log-depth tree of map compositions, ``transform``/``element_at``
   JVM-side);
4. per chunk again: walk the chain from its entry and flag file starts;
5. file number = distributed running count of the flags.

Only (position, size) pairs move; the payload joins back by key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyeval.operators.ids import running_count, with_index
from polyeval.session import cut_lineage


def _next_starts(s: np.ndarray, max_bytes: int, max_rows: int) -> np.ndarray:
    """next(i) for every local record: the first j > i that does not fit in
    a file that starts at i (len(s) when the data ends first)."""
    e = np.cumsum(s, dtype=np.int64)          # inclusive prefix sums
    before = e - s                             # bytes before record i
    fit_end = np.searchsorted(e, before + max_bytes, side="right")  # records x with e[x] <= limit
    idx = np.arange(len(s), dtype=np.int64)
    extra = np.clip(fit_end - idx - 1, 0, max_rows - 1)
    return idx + 1 + extra


def _chunk_maps(chunk_rows: int, max_bytes: int, max_rows: int):
    def fn(key, pdf):
        import pandas as pd
        pdf = pdf.sort_values("pos")
        s = pdf["size"].to_numpy(dtype=np.int64)
        halo = pdf["halo"].to_numpy(dtype=bool)
        m = int((~halo).sum())
        nxt = _next_starts(s, max_bytes, max_rows)
        n_local = len(s)
        exit_ = np.empty(m, dtype=np.int64)
        for i in range(m - 1, -1, -1):          # right to left over own records
            j = nxt[i]
            exit_[i] = j if j >= m else exit_[j]
        f = np.full(max_rows, -1, dtype=np.int64)
        w = min(max_rows, m)
        ex = exit_[:w]
        more = n_local > m                       # a next chunk exists
        f[:w] = np.where(more & (ex < n_local), ex - m, -1)
        return pd.DataFrame({"chunk": [int(key[0])], "f": [f.tolist()]})
    return fn


def _chunk_starts(max_bytes: int, max_rows: int):
    def fn(pdf):
        import pandas as pd
        pdf = pdf.sort_values("pos")
        s = pdf["size"].to_numpy(dtype=np.int64)
        halo = pdf["halo"].to_numpy(dtype=bool)
        m = int((~halo).sum())
        entry = int(pdf["entry"].iloc[0])
        nxt = _next_starts(s, max_bytes, max_rows)
        flag = np.zeros(m, dtype=np.int64)
        i = entry
        while 0 <= i < m:
            flag[i] = 1
            i = nxt[i]
        pos = pdf["pos"].to_numpy(dtype=np.int64)[:m]
        if m and pos[0] == 0 and s[0] > max_bytes:
            flag[0] = 2                          # file 1 stays empty
        return pd.DataFrame({"pos": pos, "start": flag})
    return fn


def record_bytes(columns: list[str]):
    """Bytes of a record as the JSON lines sink writes it, line end included."""
    return F.octet_length(F.to_json(F.struct(*columns))) + 1


def pack(df: DataFrame, order: str, size, max_bytes: int = 104_857_600, max_rows: int = 50_000,
         chunk_rows: int = 1 << 20) -> DataFrame:
    """``file_no`` (1-based) for every row of ``df`` in ``order`` order.

    ``size`` is a column: the bytes of the record as written (``record_bytes``). Returns ``df`` with ``pos`` and
    ``file_no``.
    """
    spark = df.sparkSession
    c = max(int(chunk_rows), int(max_rows))
    sized = df.select(order, (size if not isinstance(size, str) else F.col(size)).cast("long").alias("size"))
    pos = with_index(sized, "pos", order_by=[order])
    chunk = F.floor(F.col("pos") / F.lit(c)).cast("long")
    own = pos.select(chunk.alias("chunk"), "pos", "size", F.lit(False).alias("halo"))
    halo = pos.where((F.col("pos") % c < max_rows) & (F.col("pos") >= c)).select(
        (chunk - 1).alias("chunk"), "pos", "size", F.lit(True).alias("halo"))
    groups = own.unionByName(halo)

    map_schema = T.StructType([T.StructField("chunk", T.LongType()),
                               T.StructField("f", T.ArrayType(T.LongType()))])
    maps = cut_lineage(groups.groupBy("chunk").applyInPandas(_chunk_maps(c, max_bytes, max_rows), map_schema))
    entries = _prefix_entries(maps)

    start_schema = T.StructType([T.StructField("pos", T.LongType()), T.StructField("start", T.LongType())])
    with_entry = groups.join(entries, "chunk")
    starts = with_entry.groupBy("chunk").applyInPandas(_chunk_starts(max_bytes, max_rows), start_schema)
    numbered = running_count(starts, "pos", F.col("start"), "file_no")
    out = pos.join(numbered.select("pos", "file_no"), "pos")
    return df.join(out.select(order, "pos", "file_no"), order)


def _prefix_entries(maps: DataFrame) -> DataFrame:
    """Entry offset of every chunk: entry_0 = 0, entry_{k+1} = f_k[entry_k],
    by an up-sweep of pairwise map compositions and a down-sweep of values.
    Each level holds half the rows of the one below; no step sees all maps."""
    def compose(first, second):  # apply `first`, then `second`
        return F.transform(first, lambda x: F.when(x < 0, F.lit(-1).cast("long")).otherwise(
            F.element_at(second, (x + 1).cast("int"))))

    levels = [maps.select(F.col("chunk").alias("j"), "f")]
    n_chunks = maps.count()                  # one row per chunk: a small action
    size = n_chunks
    while size > 1:
        cur = levels[-1]
        left = cur.where(F.col("j") % 2 == 0).select((F.col("j") / 2).cast("long").alias("j"), F.col("f").alias("a"))
        right = cur.where(F.col("j") % 2 == 1).select(((F.col("j") - 1) / 2).cast("long").alias("j"),
                                                      F.col("f").alias("b"))
        up = left.join(right, "j", "left").select(
            "j", F.when(F.col("b").isNull(), F.col("a")).otherwise(compose(F.col("a"), F.col("b"))).alias("f"))
        levels.append(cut_lineage(up))
        size = (size + 1) // 2
    vals = levels[-1].select("j", F.lit(0).cast("long").alias("entry"))
    for lvl in range(len(levels) - 2, -1, -1):
        cur = levels[lvl]
        parent = vals.join(cur.where(F.col("j") % 2 == 0).select((F.col("j") / 2).cast("long").alias("j"),
                                                                 F.col("f").alias("lf")), "j")
        left = parent.select((F.col("j") * 2).alias("j"), "entry")
        right = parent.select((F.col("j") * 2 + 1).alias("j"), F.when(F.col("entry") < 0, F.lit(-1).cast("long"))
                              .otherwise(F.element_at("lf", (F.col("entry") + 1).cast("int"))).alias("entry"))
        vals = cut_lineage(left.unionByName(right).join(cur.select("j"), "j"))
    return vals.select(F.col("j").alias("chunk"), "entry")


def write_batches(df: DataFrame, path: str, order: str = "pos") -> None:
    """One folder per file number, records in order. A file number holds
    at most ``max_rows`` records, so hashing on it bounds every task."""
    (df.repartition("file_no").sortWithinPartitions("file_no", order)
       .drop(order).write.mode("overwrite").partitionBy("file_no").json(path))
