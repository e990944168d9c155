"""Ranked lexical search by dual trees.

A query set (items) against all documents. Terms are the runs of digits,
letters and non-ASCII characters, A-Z lower-cased. A term's weight w is
``floor(1000 ln((2N+2) / (2df+1)))``, its impact in a document is
``(10^9 tf) div (1000 tf + 20 m)`` with the length norm m; a document's score
is the sum of w * impact over the item's terms, all in 64-bit integers.

* One pass over the texts counts the terms that some item holds and each
  document's length; N, L and df come from all documents by aggregation.
* Every task takes its documents in blocks and puts them into a hierarchy
  (documents with the same strongest terms side by side, ``FANOUT`` children a
  node); items have one too. A node holds the coordinate maxima of its rows:
  weights for items, impacts for documents. The product of two nodes bounds the
  score of every pair below them.
* Pairs of nodes descend together. A pair whose bound is below the weakest kth
  score of its items, or equal to it with larger doc_ids only, is dropped with
  all pairs below it; this loses nothing. What remains is scored exactly, best
  bounds first, so that the kth scores rise early.
* Each task returns at most k rows an item; a window over those gives the ranks.

Items go through in blocks of ``ITEM_BYTES`` of text at most (one larger item
is a block of its own), so what is broadcast is bounded; the documents are read
once for each block of items.

Edge cases: null texts and texts without a term are no documents of the
statistics and are never found; items without a term return no row; a repeated
item row counts once, and an item_id with several texts is ranked for each;
repeated documents are ranked like different ones; rows without doc_id come
last among equal scores; only ``doc_id`` and ``text``, ``item_id`` and ``text``
are read. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyeval.llm import common
from polyeval.llm.common import written

K = 50
FANOUT = 16                    # documents a leaf, children an inner node
BLOCK_DOCS = 2_048             # documents of one hierarchy
BLOCK_CELLS = 8 << 20          # impacts of one block held densely
GROUP_ITEMS = 64               # items of one hierarchy
GROUP_TERMS = 4_096
ITEM_BYTES = 8 << 20           # text of the items that go through together

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_KEEP).split() if text else []


def _counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, term, tf): length and counts of the vocabulary's terms of every document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        known = shared.value
        for batch in batches:
            ids, n, size, term, tf = [], [], [0], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                terms = terms_of(text.as_py())
                if not terms:
                    continue
                ids.append(doc_id)
                n.append(len(terms))
                for t, c in Counter(terms).items():
                    at = known.get(t)
                    if at is not None:
                        term.append(at)
                        tf.append(c)
                size.append(len(term))
            at = pa.array(size, pa.int32())
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64()),
                                   "term": pa.ListArray.from_arrays(at, pa.array(term, pa.int32())),
                                   "tf": pa.ListArray.from_arrays(at, pa.array(tf, pa.int64()))})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return texts.mapInArrow(count, "doc_id long, n long, term array<int>, tf array<long>")


class _Group:
    """A few items: local columns of their terms, weights, and the levels of their hierarchy."""

    def __init__(self, rows: list[int], items: list[np.ndarray], weight: np.ndarray):
        self.rows = np.array(rows)
        self.columns = np.unique(np.concatenate([items[r] for r in rows]))
        self.w = np.zeros((len(rows), len(self.columns)), np.int64)
        for i, r in enumerate(rows):
            at = np.searchsorted(self.columns, items[r])
            self.w[i, at] = weight[items[r]]
        if int(self.w.max(axis=0).sum()) * 1_000_000 < 1 << 53:      # doubles hold every sum exactly
            self.w = self.w.astype(float)
        # inner nodes of 8 items and the root, by coordinate maxima
        self.inner = np.maximum.reduceat(self.w, np.arange(0, len(rows), 8), axis=0)
        self.root = self.w.max(axis=0, keepdims=True)


def _groups(items: list[np.ndarray], weight: np.ndarray) -> list[_Group]:
    """Items with the same strongest terms side by side, in groups of bounded size."""
    def strongest(r):
        t = items[r]
        return [int(x) for x in t[np.lexsort((t, -weight[t]))][:4]]
    order = sorted((r for r in range(len(items)) if len(items[r])), key=strongest)
    out, now, held = [], [], 0
    for r in order:
        if now and (len(now) == GROUP_ITEMS or held + len(items[r]) > GROUP_TERMS):
            out.append(_Group(now, items, weight))
            now, held = [], 0
        now.append(r)
        held += len(items[r])
    if now:
        out.append(_Group(now, items, weight))
    return out


class _Best:
    """The k best documents of every item so far."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.score = [np.zeros(0, np.int64)] * n_items
        self.doc = [np.zeros(0, np.int64)] * n_items
        self.null = [np.zeros(0, bool)] * n_items
        self.floor = np.zeros(n_items, np.int64)            # weakest kth score, 0 while there are fewer
        self.last = np.full(n_items, np.iinfo(np.int64).max)    # its doc_id

    def add(self, item: int, score, doc, null) -> None:
        s, d, z = (np.concatenate(x) for x in ((self.score[item], score), (self.doc[item], doc), (self.null[item], null)))
        order = np.lexsort((d, z, -s))[:self.k]
        self.score[item], self.doc[item], self.null[item] = s[order], d[order], z[order]
        if len(order) == self.k:
            end = order[-1]
            self.floor[item] = s[end]
            self.last[item] = np.iinfo(np.int64).max if z[end] else d[end]


def _maxima(level: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(level, np.arange(0, len(level), FANOUT), axis=0)


def _search(group: _Group, best: _Best, doc, null, start, term, impact) -> None:
    """All documents of one block (CSR rows ``start`` of term, impact) against the items of a group."""
    n_docs = len(doc)
    at = np.searchsorted(group.columns, term)
    at[at == len(group.columns)] = 0
    hit = group.columns[at] == term
    row = np.repeat(np.arange(n_docs), np.diff(start))[hit]
    dense = np.zeros((n_docs, len(group.columns)), group.w.dtype)
    dense[row, at[hit]] = impact[hit]
    least = np.where(null, np.iinfo(np.int64).max, doc)
    levels, ids = [dense], [least]
    while len(levels[-1]) > 1:
        levels.append(_maxima(levels[-1]))
        ids.append(np.minimum.reduceat(ids[-1], np.arange(0, len(ids[-1]), FANOUT)))
    floor, last = best.floor[group.rows], best.last[group.rows]

    def alive(bound, low, high, smallest):
        """Node pairs that may hold one of the k best: bound over the weakest kth score, or equal and a smaller id."""
        return (bound > low[:, None]) | ((bound == low[:, None]) & (bound > 0) & (smallest[None, :] < high[:, None]))

    # the roots, then inner item nodes, then single items, each a level further down the documents
    eights = np.arange(0, len(group.rows), 8)
    if not alive(group.root @ levels[-1].T, floor.min(keepdims=True), last.max(keepdims=True), ids[-1]).any():
        return
    depth = len(levels) - 1
    open_pairs = np.ones((len(eights), len(levels[depth])), bool)
    if depth:
        depth -= 1
        open_pairs = alive(group.inner @ levels[depth].T, np.minimum.reduceat(floor, eights),
                           np.maximum.reduceat(last, eights), ids[depth])
    open_pairs = np.repeat(open_pairs, 8, axis=0)[:len(group.rows)]
    while depth > 1:
        depth -= 1
        nodes = np.repeat(open_pairs, FANOUT, axis=1)[:, :len(levels[depth])]
        use = np.flatnonzero(nodes.any(axis=0))
        open_pairs = np.zeros((len(group.rows), len(levels[depth])), bool)
        if len(use):
            open_pairs[:, use] = nodes[:, use] & alive(group.w @ levels[depth][use].T, floor, last, ids[depth][use])
    for i in np.flatnonzero(open_pairs.any(axis=1)):
        item = int(group.rows[i])
        nodes = np.flatnonzero(open_pairs[i])
        cols = np.flatnonzero(group.w[i])
        if depth:                                        # nodes are leaves: best bounds first
            bound = levels[1][np.ix_(nodes, cols)] @ group.w[i, cols]
            order = np.argsort(-bound, kind="stable")
            nodes, bound = nodes[order], bound[order]
        for part in range(0, len(nodes), 8):
            some = nodes[part:part + 8]
            if depth:
                b = bound[part:part + 8]
                some = some[(b > best.floor[item]) | ((b == best.floor[item]) & (ids[1][some] < best.last[item]))]
                some = (some[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                some = some[some < n_docs]
            if not len(some):
                continue
            score = (dense[np.ix_(some, cols)] @ group.w[i, cols]).astype(np.int64)
            low = best.floor[item]
            ok = (score > low) | ((score == low) & (score > 0) & (least[some] < best.last[item]))
            if ok.any():
                best.add(item, score[ok], doc[some][ok], null[some][ok])


def _top(counted: DataFrame, items: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best rows of every task."""
    shared = counted.sparkSession.sparkContext.broadcast((items, weight))

    def search(batches):
        items, weight = shared.value
        groups = _groups(items, weight)
        best = _Best(len(items), k)
        wide = max((len(g.columns) for g in groups), default=1)
        step = max(FANOUT, min(BLOCK_DOCS, BLOCK_CELLS // wide))
        for batch in batches:
            ids = batch.column(0)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            doc = ids.fill_null(0).to_numpy(zero_copy_only=False)
            start = batch.column(2).offsets.to_numpy()
            term, tf = batch.column(2).values.to_numpy(), batch.column(3).values.to_numpy()
            m = batch.column(1).to_numpy(zero_copy_only=False)
            m = 50 + (50 * m * n_docs) // n_terms
            size = np.diff(start)
            term, tf = term[start[0]:start[-1]], tf[start[0]:start[-1]]
            start = start - start[0]
            impact = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, size))
            # documents by their strongest terms, so that neighbours share maxima
            row = np.repeat(np.arange(len(doc)), size)
            by = np.lexsort((-(weight[term] * impact), row))
            lead = np.full((2, len(doc)), -1)
            for j in range(2):
                has = size > j
                lead[j, has] = term[by[start[:-1][has] + j]]
            order = np.lexsort((lead[1], lead[0]))
            order = order[size[order] > 0]
            for s in range(0, len(order), step):
                take = order[s:s + step]
                at = np.repeat(start[take] - np.r_[0, np.cumsum(size[take])[:-1]], size[take]) + np.arange(size[take].sum())
                first = np.r_[0, np.cumsum(size[take])]
                for g in groups:
                    _search(g, best, doc[take], null[take], first, term[at], impact[at])
        for i in range(len(items)):
            if len(best.score[i]):
                yield pa.record_batch({"item": pa.array(np.full(len(best.score[i]), i, np.int32)),
                                       "doc_id": pa.array(best.doc[i], mask=best.null[i]),
                                       "score": pa.array(best.score[i])})

    return counted.mapInArrow(search, "item int, doc_id long, score long")


def _item_blocks(items: DataFrame):
    """Item rows in lists of about ``ITEM_BYTES`` of text; only one list is on the driver at a time."""
    rows = items.select(F.col("item_id").alias("item_id"), F.col("text").alias("text")).where("text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = max(1, -(-size // (ITEM_BYTES // 2)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))) if n > 1 else rows.withColumn("block", F.lit(0))
    if n > 1:
        rows = written(rows, "items")
    for block in range(n):
        got = rows.where(F.col("block") == block).select("item_id", "text").collect()
        if got:
            yield sorted(got, key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))


def _search_block(docs: DataFrame, block: list, k: int, item_type) -> DataFrame | None:
    spark = docs.sparkSession
    sets = [sorted(set(terms_of(r["text"]))) for r in block]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*sets)))}
    if not vocabulary:
        return None
    counted = written(_counted(docs, vocabulary), "counts")
    total = counted.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not total["docs"]:
        return None
    # one number for each term of the block's items, so bounded like the block
    df = np.zeros(len(vocabulary), np.int64)
    for r in counted.select(F.explode("term").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect():
        df[r["t"]] = r["n"]
    weight = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    items = [np.array([vocabulary[t] for t in s], np.int64) for s in sets]
    found = _top(counted, items, weight, total["docs"], total["terms"], k)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"item int, item_id {item_type}")
    ranked = found.withColumn("rank", F.row_number().over(
        Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
    # the names are one block of items: bounded by ITEM_BYTES
    return ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of every item, scores above 0."""
    spark = docs.sparkSession
    common.prepare(spark)
    kind = items.schema["item_id"].dataType.simpleString()
    found = None
    for block in _item_blocks(items):
        part = _search_block(docs, block, k, kind)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return found
