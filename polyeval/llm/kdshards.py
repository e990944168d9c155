"""K-d tree shards of near equal bytes, DataFrame functions only.

A node that stands for s shards is split where a share floor(s / 2) / s of its
bytes lies below, along the dimension that is widest in it (width as a part of
the whole table's), until every leaf stands for one shard and so holds about
total / shards bytes. Dimensions are numbers from the metadata: source, language
and size; names count by their hash.

The weighted medians of all nodes of a level are found together: rows are summed
into ``CELLS`` cells a node, the cell that holds the median is cut again. Rows
that tie on the dimension go on by the hash of the text and then of the doc_id.
Equal texts take the smallest source and language among them, so they stand
together, and are cut apart only where the cut would miss its bytes by more than
``group_tolerance`` of a shard, as a group holding a third of all rows must be.

Only sums by node and cell reach the driver (at most shards x CELLS numbers);
each level writes the rows' nodes to the shared folder. Slots number each
shard's rows by prefix sums over blocks.

Edge cases: a null text has no bytes, size 16 and checksum 0; null names hash as
empty ones; repeated rows (equal text and doc_id) stay together; an empty table
gives no rows, and a table smaller than the number of shards leaves some empty;
other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyeval.llm import common
from polyeval.llm.common import written

SHARDS = 40
OVERHEAD = 16
CELLS = 1024
TOLERANCE = 0.001              # of a shard's bytes: a cut this close is taken
GROUP_TOLERANCE = 0.02         # the same where the cut would part equal texts
SLOT_BLOCK = 100_000           # rows a slot block holds on average
DIMENSIONS = ("source_key", "lang_key", "size")
_WIDE = 1 << 50


def light_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, checksum and the keys of the tree; no text."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def name(c):
        return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in docs.columns else F.lit(0).cast("long")
    rows = docs.select(
        F.col("doc_id").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        name("lang").alias("lang_key"), name("source").alias("source_key"),
        F.pmod(F.xxhash64(text), F.lit(_WIDE)).alias("text_key"),
        F.pmod(F.xxhash64("doc_id"), F.lit(_WIDE)).alias("id_key"))
    return written(rows, "light")


def grouped(rows: DataFrame) -> DataFrame:
    """Equal texts get one source and language. Only texts that occur with several are joined."""
    # written, so that the join sees two plain exchanges and a hot group can be split
    same = written(rows.groupBy("text_key", "text_crc32", "size")
                   .agg(F.min("lang_key").alias("l"), F.max("lang_key").alias("l2"),
                        F.min("source_key").alias("s"), F.max("source_key").alias("s2"))
                   .where("l < l2 or s < s2").drop("l2", "s2"), "same-texts")
    return (rows.join(same, ["text_key", "text_crc32", "size"], "left")
            .withColumn("lang_key", F.coalesce("l", "lang_key"))
            .withColumn("source_key", F.coalesce("s", "source_key")).drop("l", "s"))


@dataclass
class _Search:
    """A node (shards first .. first + shards - 1) and where its median is sought: the keys
    before this one equal ``at``, this one lies in [lo, hi]."""
    first: int
    shards: int
    dim: int
    want: float                 # bytes that belong left of the cut
    lo: int
    hi: int
    at: tuple = ()
    before: int = 0
    done: bool = False


def _narrow(s: _Search, cells: dict[int, tuple], slack: float, group_slack: float) -> None:
    """Go on in the cell that holds the median; cells: number -> (bytes, smallest and largest key)."""
    before, hit = s.before, None
    for c in sorted(cells):
        if before + cells[c][0] > s.want:
            hit = c
            break
        before += cells[c][0]
    if hit is None:                                    # everything lies left
        s.at, s.done = (*s.at, s.hi), True
        return
    held, lo, hi = cells[hit]
    s.before = before
    near_low, near_high = s.want - before, before + held - s.want
    one_text = len(s.at) == 1 and lo == hi
    if min(near_low, near_high) <= (group_slack if one_text else slack) or (len(s.at) == 2 and lo == hi):
        s.at, s.done = (*s.at, hi if near_high < near_low else lo - 1), True
    elif hi > lo:
        s.lo, s.hi = lo, hi
    else:                                              # one value holds the median: go on inside it
        s.at = (*s.at, lo)
        s.lo, s.hi = 0, _WIDE - 1


def _by_node(values: dict[int, int], shards: int, default: int = -1) -> Column:
    """The value of the row's node, from an array of one number for each shard."""
    return F.get(F.lit([int(values.get(i, default)) for i in range(shards)]), F.col("node"))


def _key(searches: dict[int, _Search], shards: int) -> Column:
    """The key that the row's node is searched by."""
    dims = F.array(*[F.col(d) for d in DIMENSIONS])
    depth = _by_node({k: len(s.at) for k, s in searches.items()}, shards)
    return (F.when(depth == 0, F.get(dims, _by_node({k: s.dim for k, s in searches.items()}, shards)))
            .when(depth == 1, F.col("text_key")).when(depth == 2, F.col("id_key")))


def _search_level(rows: DataFrame, searches: dict[int, _Search], shards: int, slack: float, group_slack: float) -> None:
    while live := {k: s for k, s in searches.items() if not s.done}:
        key = _key(live, shards)
        dims = F.array(*[F.col(d) for d in DIMENSIONS])
        lo = _by_node({k: s.lo for k, s in live.items()}, shards)
        hi = _by_node({k: s.hi for k, s in live.items()}, shards)
        step = _by_node({k: (s.hi - s.lo) // CELLS + 1 for k, s in live.items()}, shards, 1)
        depth = _by_node({k: len(s.at) for k, s in live.items()}, shards)
        first = _by_node({k: s.at[0] for k, s in live.items() if s.at}, shards)
        second = _by_node({k: s.at[1] for k, s in live.items() if len(s.at) > 1}, shards)
        dim = _by_node({k: s.dim for k, s in live.items()}, shards)
        inside = ((F.col("key") >= lo) & (F.col("key") <= hi)
                  & ((depth < 1) | (F.get(dims, dim) == first)) & ((depth < 2) | (F.col("text_key") == second)))
        got = (rows.withColumn("key", key).where(inside)
               .groupBy("node", F.floor((F.col("key") - lo) / step).cast("long").alias("cell"))
               .agg(F.sum("size").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect())
        cells: dict[int, dict] = {k: {} for k in live}
        for r in got:
            cells[r["node"]][r["cell"]] = (r["n"], r["a"], r["b"])
        for k, s in live.items():
            _narrow(s, cells[k], slack, group_slack)


def _descend(searches: dict[int, _Search], shards: int) -> Column:
    """The child of the row's node: right of the cut, or the node's own number."""
    cuts = {k: (*s.at, _WIDE, _WIDE)[:3] for k, s in searches.items()}
    dim = _by_node({k: s.dim for k, s in searches.items()}, shards)
    key = F.get(F.array(*[F.col(d) for d in DIMENSIONS]), dim)
    c0, c1, c2 = (_by_node({k: c[i] for k, c in cuts.items()}, shards) for i in range(3))
    below = (key < c0) | ((key == c0) & ((F.col("text_key") < c1) | ((F.col("text_key") == c1) & (F.col("id_key") <= c2))))
    right = _by_node({k: s.first + s.shards // 2 for k, s in searches.items()}, shards)
    return F.when((dim >= 0) & ~below, right).otherwise(F.col("node")).cast("int")


def grow(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE,
         group_tolerance: float = GROUP_TOLERANCE) -> DataFrame:
    """``rows`` with ``node``: the shard (leaf) each falls into."""
    rows = rows.withColumn("node", F.lit(0))
    edges = [f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("a", F.min), ("b", F.max))]
    spans, unit = None, 0.0
    held = {0: shards}                                 # shards that each node stands for
    while any(n > 1 for n in held.values()):
        found = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("n"), *edges).collect()}
        if spans is None:
            if not found:
                return rows
            spans = {d: max(1, found[0][f"b_{d}"] - found[0][f"a_{d}"]) for d in DIMENSIONS}
            unit = found[0]["n"] / shards
        searches = {}
        for first, r in found.items():
            if held[first] > 1:
                width = [(r[f"b_{d}"] - r[f"a_{d}"]) / spans[d] for d in DIMENSIONS]
                dim = width.index(max(width))
                searches[first] = _Search(first, held[first], dim, r["n"] * (held[first] // 2) / held[first],
                                          r[f"a_{DIMENSIONS[dim]}"], r[f"b_{DIMENSIONS[dim]}"])
        _search_level(rows, searches, shards, tolerance * unit, group_tolerance * unit)
        rows = written(rows.withColumn("node", _descend(searches, shards)), "kd-level")
        held = {f: n for first, s in held.items()
                for f, n in ([(first, s)] if s == 1 else [(first, s // 2), (first + s // 2, s - s // 2)])}
    return rows


def with_slots(rows: DataFrame, group: str = "shard", order: str = "id_key", name: str = "slot",
               block_rows: int = SLOT_BLOCK) -> DataFrame:
    """Gapless numbers from 0 inside each ``group``: blocks of hashed ids are numbered
    apart and moved by the rows of the blocks before. An id that many rows share is dealt
    by the hashes of their texts."""
    total = rows.count()
    n_blocks = max(1, -(-total // block_rows))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(1), *[F.col(c) for c in (order, "text_key") if c in rows.columns]), F.lit(n_blocks)))
    counts = rows.groupBy(group, "block").agg(F.count(F.lit(1)).alias("n"))
    # a table of groups x blocks rows: one for every block_rows rows of input
    before = Window.partitionBy(group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    moved = counts.select(group, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(group, "block").orderBy(order, "doc_id")
    return (rows.withColumn("nth", F.row_number().over(inside)).join(moved, [group, "block"])
            .withColumn(name, (F.col("offset") + F.col("nth") - 1).cast("long")).drop("block", "nth", "offset"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE,
                    group_tolerance: float = GROUP_TOLERANCE, block_rows: int = SLOT_BLOCK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: this law has no growth rule) of every row."""
    common.prepare(docs.sparkSession)
    rows = grow(grouped(light_rows(docs)), shards, tolerance, group_tolerance)
    return with_slots(rows.withColumnRenamed("node", "shard"), block_rows=block_rows).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"))
