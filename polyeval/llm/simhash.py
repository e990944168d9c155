"""SimHash near-duplicates by multi-index hashing.

Fingerprint: lower-case A-Z, words between ASCII white space, shingles of
``shingle`` words (repeats included; fewer words: the whole sequence), XXH64
with seed 42 of each; a bit is 1 when set in over half of them. Texts without
words have fingerprint zero.

Links (at most ``max_bits`` differing bits) are found over distinct
fingerprints, so copies cost one row:

* the 64 bits are cut into ``segments``; the radii of the segments sum to
  ``max_bits - segments + 1``, so any linked pair lies within the radius of at
  least one segment (pigeonhole);
* every fingerprint enters the table of its own segment value and probes all
  values in the Hamming ball of the segment's radius;
* rows meeting at one (segment, value) are compared over all 64 bits. A group
  returns a spanning forest of its links, never all pairs. A group above
  ``group_rows`` is dealt over a grid of cells, so no task holds it whole.

Components come from alternating large-star and small-star steps, each written
to the shared folder. The label of a document is the smallest doc_id reachable.

Edge cases: null and empty texts link like any other (fingerprint zero); rows
without doc_id take part in links, and their component is the smallest doc_id
of the others (null where there is none); repeated rows come back repeated; only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyeval.llm import common
from polyeval.llm.common import written

SHINGLE = 4
MAX_BITS = 4
SEGMENTS = 3
GROUP_ROWS = 20_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        digest, join = xxhash.xxh64_intdigest, b" ".join
        hashes = [digest(join(g), 42) for g in zip(*(words[i:] for i in range(shingle)))]
    ones = np.zeros(64, np.int64)
    for s in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(np.array(hashes[s:s + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8),
                             axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    on = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(on, bitorder="little").view("<u8")[0])


def fingerprint_column(shingle: int = SHINGLE):
    @F.pandas_udf("long")
    def column(parts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in parts], np.uint64).view(np.int64))
    return column


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *more) -> DataFrame:
    """doc_id, the signed 64-bit fingerprint ``fp`` of every row, and the columns ``more``."""
    common.prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").alias("doc_id"), fingerprint_column(shingle)(F.col("text")).alias("fp"), *more)


def layout(segments: int = SEGMENTS, max_bits: int = MAX_BITS) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment; the radii sum to max_bits - segments + 1."""
    segments = min(segments, max_bits + 1)
    cuts = [64 * i // segments for i in range(segments + 1)]
    rest = max_bits - segments + 1
    radii = [rest // segments + (i < rest % segments) for i in range(segments)]
    return [(cuts[i], cuts[i + 1] - cuts[i], radii[i]) for i in range(segments)]


def ball(width: int, radius: int) -> np.ndarray:
    """Masks with at most ``radius`` of ``width`` bits set, zero first."""
    return np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)],
                    np.int64)


def _entry(seg: int, value):
    return lambda mask: F.struct(F.lit(seg).cast("tinyint").alias("seg"), value.bitwiseXOR(mask).alias("value"),
                                 (mask == 0).alias("own"))


def _entries(fps: DataFrame, plan) -> DataFrame:
    """(seg, value, fp, own): the table row (own) and the probes of every fingerprint."""
    parts = []
    for seg, (shift, width, radius) in enumerate(plan):
        value = F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << width) - 1))
        masks = F.array(*[F.lit(int(m)) for m in ball(width, radius)])
        parts.append(F.transform(masks, _entry(seg, value)))
    return fps.select("fp", F.explode(F.concat(*parts)).alias("e")).select("e.seg", "e.value", "fp", "e.own")


def _forest(fp: np.ndarray, max_bits: int):
    """Spanning forest of the link graph of one group, one expansion a node."""
    left = fp.copy()
    out_a, out_b = [], []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            at = stack.pop()
            near = np.bitwise_count(left ^ at) <= max_bits
            if near.any():
                new = left[near]
                left = left[~near]
                out_a.append(np.full(len(new), at))
                out_b.append(new)
                stack.extend(new)
    return out_a, out_b


def _small_groups(fp, own, start, size, max_bits):
    """Links between the table rows and all rows of many small groups at once."""
    t = np.flatnonzero(own)
    g = np.repeat(np.arange(len(size)), size)
    n = size[g[t]]
    a = np.repeat(fp[t], n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[g[t]], n)
    b = fp[at]
    ok = (a != b) & (np.bitwise_count(a ^ b) <= max_bits)
    return np.minimum(a[ok], b[ok]), np.maximum(a[ok], b[ok])


def _links_of(key: np.ndarray, fp: np.ndarray, own: np.ndarray, max_bits: int) -> pa.RecordBatch:
    """Links of whole groups; rows of one key are adjacent."""
    fp = fp.view(np.uint64)
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[edge, len(key)])
    has = np.add.reduceat(own.astype(np.int64), edge) > 0
    a, b = [], []
    small = (size > 1) & (size <= 64) & has
    if small.any():
        take = np.repeat(small, size)
        s = size[small]
        x, y = _small_groups(fp[take], own[take], np.cumsum(s) - s, s, max_bits)
        a.append(x)
        b.append(y)
    for i in np.flatnonzero((size > 64) & has):
        x, y = _forest(np.unique(fp[edge[i]:edge[i] + size[i]]), max_bits)
        a += x
        b += y
    a = np.concatenate(a) if a else np.zeros(0, np.uint64)
    b = np.concatenate(b) if b else np.zeros(0, np.uint64)
    pair = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
    return pa.record_batch({"a": pair[:, 0].copy().view(np.int64), "b": pair[:, 1].copy().view(np.int64)})


def links(fps: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS,
          group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fps.fp`` that connect every pair
    at ``max_bits`` or fewer differing bits, each verified over all 64 bits."""
    plan = layout(segments, max_bits)
    entries = _entries(fps.select("fp"), plan)
    # groups above group_rows: rows / group_rows at most, so a small table
    large = (entries.groupBy("seg", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows)
             .select("seg", "value", F.ceil(F.sqrt(F.col("n") / F.lit(group_rows)) * 2).cast("int").alias("cells")))
    dealt = entries.join(large, ["seg", "value"], "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    # cell (i, j) compares block i with block j; a row of block k goes to every cell naming k
    k = F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int")
    dealt = (dealt.withColumn("k", k)
             .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
             .withColumn("cell", F.least("k", "o") * F.col("cells") + F.greatest("k", "o")))
    # the table rows of a cell may sit in either block: in split groups every row counts as a table row
    dealt = dealt.select(F.xxhash64("seg", "value", "cell").alias("key"), "fp",
                         (F.col("own") | (F.col("cells") > 1)).alias("own"))

    def compare(batches):
        kept: list[tuple] = []
        for batch in batches:
            key, fp, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(key):
                continue
            last = np.searchsorted(key, key[-1])        # keys are sorted: the last group may go on
            if last:
                whole = [np.concatenate(x) for x in zip(*kept, (key[:last], fp[:last], own[:last]))]
                kept = []
                yield _links_of(*whole, max_bits)
            kept.append((key[last:], fp[last:], own[last:]))
        if kept:
            yield _links_of(*[np.concatenate(x) for x in zip(*kept)], max_bits)

    found = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")
    return found.distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of the component, for the nodes of ``edges`` (a, b)."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                  "edges")
    mark = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = written(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))").alias("h"),
                       F.expr("count(distinct u)").alias("k")).first()
        if tuple(seen) == mark and seen["n"] == seen["k"]:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return (now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))


def _labelled(prints: DataFrame, max_bits: int, segments: int, group_rows: int) -> DataFrame:
    """``prints`` with root (a fingerprint of the component) and component_id."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, max_bits, segments, group_rows))
    labelled = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = labelled.join(ids, "root").select("fp", "root", "component_id")
    return prints.join(by_print, "fp", "left")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, segments: int = SEGMENTS,
                    group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) of every row."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    return _labelled(prints, max_bits, segments, group_rows).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, segments: int = SEGMENTS,
                         group_rows: int = GROUP_ROWS) -> DataFrame:
    """One document of each component: a row whose doc_id names the component and whose text lies in
    it (of several such texts the one with the smallest hash), once. Two components may have the same
    name, when one id has texts in both; each keeps its row. Rows without a doc_id cannot be named by
    another and stay."""
    prints = written(fingerprints(docs, shingle, F.xxhash64("text").alias("text_hash")), "fingerprints")
    found = _labelled(prints, max_bits, segments, group_rows).where(F.col("doc_id") == F.col("component_id"))
    keep = found.groupBy("doc_id", "root").agg(F.min("text_hash").alias("kept_hash"))
    keep = keep.select(F.col("doc_id").alias("kept_id"), "kept_hash").distinct()
    named = docs.withColumn("simhash__text", F.xxhash64("text"))
    rows = named.join(keep, (named["doc_id"] == keep["kept_id"]) & (named["simhash__text"] == keep["kept_hash"]), "left_semi")
    first = Window.partitionBy("doc_id", "simhash__text").orderBy(F.lit(0))
    rows = rows.withColumn("simhash__row", F.row_number().over(first)).where("simhash__row = 1")
    return rows.drop("simhash__row", "simhash__text").unionByName(docs.where(F.col("doc_id").isNull()))
