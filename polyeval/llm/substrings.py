"""Repeated passages by prefix-partitioned (sparse) suffix trees.

A word run of ``window`` words counts as repeated in a document when the same
run also starts in a document with a smaller doc_id; every word under such a
run is removed.

* Suffixes are indexed at synchronising positions only: the places where the
  hash of the next ``prefix`` words is smallest among the starts inside some
  window. Equal windows have equal synchronising places, so each window holds
  at least one, and no repeat is missed (about one word in twenty is indexed).
* The ``prefix``-word hash is the first, shared edge of a subtree; a prefix met
  in one document only has no deep node and ends there. Suffixes with equal
  surroundings (``window`` words to the right, the rest of a window to the
  left) are one leaf with its smallest and largest doc_id, so copies cost one.
* A prefix with one leaf is answered by that leaf. The others fetch the words
  of one occurrence of each leaf; a task builds the subtrees of its prefixes
  level by level, to the right and to the left of the synchronising place. The
  nodes ``left`` words above and ``window - left`` words below a place give the
  class of equal windows and its smallest doc_id.
* Prefixes have variable length. A group stands for the windows that begin ``a``
  to ``b`` words before the place, and its prefix is the ``a`` words before it and
  the ``window - b`` words from it on, which all of them share; the first group of
  a place is a = 0, b = window - prefix. A group with more than ``group_rows``
  leaves is cut in two halves of its range, whose prefixes are longer, until all
  groups fit a task. At the end of the cuts a prefix is one whole window, a single
  node whose leaves need no subtree: their smallest doc_id is an aggregate.

Edge cases: null texts have no words; texts below ``window`` words lose none; a
row without doc_id neither removes nor loses words; equal doc_ids do not remove
from each other, so repeated rows come back alike; other columns may have any
name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyeval.llm import common
from polyeval.llm.common import HashCache, blocks, written

WINDOW = 50
PREFIX = 10
GROUP_ROWS = 50_000            # leaves of one subtree (about 75 MB in a task); larger groups get longer prefixes
PLACES_AT_ONCE = 20_000        # places whose surroundings a task holds at once
TREE_ROWS = 16_000             # leaves a task turns into subtrees at once, whole prefixes
_NONE = np.iinfo(np.int64).max
_CONSTANTS = np.random.default_rng(20).integers(1, 1 << 63, (2, 4096), dtype=np.uint64) | np.uint64(1)


def _code_cache() -> HashCache:
    return HashCache(lambda w: xxhash.xxh64_intdigest(w, 1))


def _codes(words: list[bytes], cache: HashCache) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _span_min(x: np.ndarray, n: int, pick=np.minimum) -> np.ndarray:
    """Minimum (or ``pick``) over every run of n values."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = pick(x[:-step], x[step:])
        have += step
    return x


def _anchors(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, window: int, prefix: int):
    """Synchronising places of several documents laid end to end, and their prefix hashes."""
    n, reach = len(codes), window - prefix + 1
    h = np.zeros(n - prefix + 1, np.uint64)
    for j in range(prefix):
        h += codes[j:n - prefix + 1 + j] * _CONSTANTS[0, j]
    h = _mix(h)
    low = _span_min(h, reach)                        # low[i]: smallest prefix hash of window i
    inside = np.zeros(n + 1, np.int64)               # windows that stay in their document
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + sizes - window + 1, -1)
    low[np.cumsum(inside)[:len(low)] == 0] = 0
    pad = np.zeros(reach - 1, np.uint64)
    high = _span_min(np.r_[pad, low, pad], reach, np.maximum)   # over the windows that hold place p
    at = np.flatnonzero((high[:len(h)] == h) & (h > 0))
    return at, h[at]


def _surroundings(codes, at, first, last, window: int, prefix: int) -> np.ndarray:
    """Words around each place, zero outside the document [first, last)."""
    left = window - prefix
    where = at[:, None] + np.arange(-left, window)
    ok = (where >= first[:, None]) & (where < last[:, None])
    return np.where(ok, codes[np.clip(where, 0, len(codes) - 1)], np.uint64(0))


def _leaf_hash(words: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    h = (words * _CONSTANTS[1, :words.shape[1]]).sum(axis=1, dtype=np.uint64)
    return _mix(h + low.astype(np.uint64) * _CONSTANTS[1, 4000] + high.astype(np.uint64) * _CONSTANTS[1, 4001])


def _offsets(at, first, last, window: int, prefix: int):
    """Smallest and largest number of words that a window may hold before the place."""
    return np.maximum(0, window - (last - at)), np.minimum(window - prefix, at - first)


PLACES = "doc_id long, text_hash long, pos int, low int, high int, prefix long, leaf long"


def _places(window: int, prefix: int):
    def run(batches):
        cache = _code_cache()
        for batch in batches:
            ids, hashes, texts = (batch.column(i) for i in range(3))
            texts = texts.to_pylist()
            for s, e in blocks(texts, 1 << 20):
                words = [t.encode("utf-8", "replace").split() if t else [] for t in texts[s:e]]
                size = np.array([len(w) for w in words], np.int64)
                use = np.flatnonzero(size >= window)
                if not len(use):
                    continue
                codes = np.concatenate([_codes(words[i], cache) for i in use])
                sizes = size[use]
                ends = np.cumsum(sizes)
                at, h = _anchors(codes, ends - sizes, sizes, window, prefix)
                doc = np.searchsorted(ends, at, side="right")
                first, last = (ends - sizes)[doc], ends[doc]
                low, high = _offsets(at, first, last, window, prefix)
                leaf = np.concatenate([_leaf_hash(_surroundings(codes, *(x[c:c + PLACES_AT_ONCE] for x in (at, first, last)),
                                                                window, prefix),
                                                  low[c:c + PLACES_AT_ONCE], high[c:c + PLACES_AT_ONCE])
                                       for c in range(0, max(1, len(at)), PLACES_AT_ONCE)])
                row = pa.array(use[doc] + s)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(row), hashes.take(row), pa.array((at - first).astype(np.int32)),
                     pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)),
                     pa.array(h.view(np.int64)), pa.array(leaf.view(np.int64))],
                    names=["doc_id", "text_hash", "pos", "low", "high", "prefix", "leaf"])
    return run


LEAVES = "prefix long, leaf long, least long, most long, low int, high int, words binary"
#: a leaf in a group: ``key`` tells the prefix, ``a`` and ``b`` the range of its windows
GROUPED = "key long, a int, b int, " + LEAVES


def _leaf_words(window: int, prefix: int):
    """Rows with a text and its wanted places -> the words around each place."""
    def run(batches):
        cache = _code_cache()
        for batch in batches:
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("repeat__places").to_pylist()):
                codes = _codes(text.encode("utf-8", "replace").split(), cache)
                for s in range(0, len(wanted), 2000):
                    part = wanted[s:s + 2000]
                    at = np.array([w["pos"] for w in part], np.int64)
                    around = _surroundings(codes, at, np.zeros_like(at), np.full_like(at, len(codes)), window, prefix)
                    col = lambda k, t: pa.array([w[k] for w in part], t)
                    yield pa.RecordBatch.from_arrays(
                        [col("prefix", pa.int64()), col("leaf", pa.int64()), col("least", pa.int64()),
                         col("most", pa.int64()), col("low", pa.int32()), col("high", pa.int32()),
                         pa.array([r.tobytes() for r in around], pa.binary())],
                        names=["prefix", "leaf", "least", "most", "low", "high", "words"])
    return run


def _renumber(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.uint64)


def _subtrees(group, words, least, low, high, window: int, prefix: int) -> np.ndarray:
    """[leaf, left]: smallest doc_id in the leaf's group that holds the window starting ``left`` words before
    the leaf's place (a leaf of the range low to high)."""
    left_max = window - prefix
    below = {prefix: _renumber(group)}                # node ids by depth to the right
    for depth in range(prefix + 1, window + 1):
        below[depth] = _renumber(_mix(below[depth - 1] + words[:, left_max + depth - 1] * _CONSTANTS[0, 0]))
    above = np.zeros(len(words), np.uint64)           # and to the left
    out = np.full((len(words), left_max + 1), _NONE)
    for left in range(left_max + 1):
        if left:
            above = _renumber(_mix(above + words[:, left_max - left] * _CONSTANTS[0, 0]))
        at = np.flatnonzero((low <= left) & (left <= high))
        if not len(at):
            continue
        node = below[window - left][at] * np.uint64(len(words)) + above[at]
        order = np.argsort(node, kind="stable")
        node = node[order]
        edge = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        best = np.minimum.reduceat(least[at][order], edge)
        out[at[order], left] = np.repeat(best, np.diff(np.r_[edge, len(node)]))
    return out


RUNS = "prefix long, leaf long, from_left int, to_left int, least long"


def _runs(prefix_col, leaf_col, most, classes):
    """Stretches of ``left`` with one smallest doc_id, where some document of the leaf is larger."""
    value = np.where(classes < most[:, None], classes, _NONE)
    edge = np.ones(value.shape, bool)
    edge[:, 1:] = value[:, 1:] != value[:, :-1]
    row, start = np.nonzero(edge)
    stop = np.r_[start[1:], 0]
    stop[np.r_[row[1:] != row[:-1], True]] = value.shape[1]
    v = value[row, start]
    ok = v != _NONE
    return pa.RecordBatch.from_arrays(
        [pa.array(prefix_col[row[ok]]), pa.array(leaf_col[row[ok]]), pa.array(start[ok].astype(np.int32)),
         pa.array((stop[ok] - 1).astype(np.int32)), pa.array(v[ok])],
        names=["prefix", "leaf", "from_left", "to_left", "least"])


def _grow(window: int, prefix: int):
    """Rows sorted by group -> runs; whole groups, about TREE_ROWS leaves at a time."""
    def solve(kept):
        key, a, b, p, leaf, least, most, low, high = (np.concatenate([k[i] for k in kept]) for i in range(9))
        words = np.concatenate([k[9] for k in kept])
        return _runs(p, leaf, most, _subtrees(key.view(np.uint64), words, least, np.maximum(low, a), np.minimum(high, b),
                                              window, prefix))

    def run(batches):
        kept: list = []
        rows = 0
        for batch in batches:
            for s in range(0, batch.num_rows, 4000):
                part = batch.slice(s, 4000)
                cols = [part.column(i).to_numpy(zero_copy_only=False) for i in range(9)]
                words = np.frombuffer(b"".join(part.column(9).to_pylist()), np.uint64).reshape(part.num_rows, -1)
                if rows >= TREE_ROWS:
                    cut = int(np.searchsorted(cols[0], kept[-1][0][-1], side="right"))
                    kept.append([*(c[:cut] for c in cols), words[:cut]])
                    if cut == len(words):
                        rows += cut
                        continue
                    yield solve(kept)
                    kept, rows = [], 0
                    cols, words = [c[cut:] for c in cols], words[cut:]
                kept.append([*cols, words])
                rows += len(words)
        if kept:
            yield solve(kept)
    return run


def _longer(window: int, prefix: int):
    """Rows of groups that are too large -> the same in the two halves of their range, by longer prefixes."""
    left = window - prefix

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                part = batch.slice(s, 2000)
                a, b = (part.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                low, high = (part.column(i).to_numpy(zero_copy_only=False) for i in (7, 8))
                words = np.frombuffer(b"".join(part.column(9).to_pylist()), np.uint64).reshape(part.num_rows, -1)
                mid = (a + b) // 2
                place = np.arange(words.shape[1])
                for lo, hi in ((a, mid), (mid + 1, b)):
                    use = np.flatnonzero((low <= hi) & (high >= lo))
                    if not len(use):
                        continue
                    lo, hi = lo[use], hi[use]
                    # the words that all windows of the range hold
                    shared = (place >= (left - lo)[:, None]) & (place < (left + window - hi)[:, None])
                    h = (np.where(shared, words[use], np.uint64(0)) * _CONSTANTS[1, :words.shape[1]]).sum(axis=1, dtype=np.uint64)
                    h = _mix(_mix(h + lo.astype(np.uint64) * _CONSTANTS[1, 4000]) + hi.astype(np.uint64) * _CONSTANTS[1, 4001])
                    rest = part.take(pa.array(use))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)),
                         *(rest.column(i) for i in range(3, 10))], names=[c.split()[0] for c in GROUPED.split(", ")])
    return run


def _named(docs: DataFrame) -> DataFrame:
    """Rows with a doc_id, and what tells texts of one doc_id apart. Every join with texts starts
    from this frame with all its columns, so that the texts are shuffled once and reused."""
    return docs.where(F.col("doc_id").isNotNull()).withColumn("repeat__hash", F.xxhash64("text"))


def repeat_spans(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX,
                 group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, text_hash, spans): word ranges [start, stop) under repeated windows, for documents that have some."""
    common.prepare(docs.sparkSession)
    named = _named(docs)
    places = written(named.where("text is not null").select(F.col("doc_id").cast("long"), "repeat__hash", "text")
                     .mapInArrow(_places(window, prefix), PLACES), "places")
    # written, so that both sides of the next join are plain exchanges and a hot prefix can be split
    several = written(places.groupBy("prefix").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
                      .where("a < b").select("prefix"), "prefixes")
    places = written(places.join(several, "prefix"), "repeated-places")
    leaves = written(places.groupBy("prefix", "leaf").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min_by("text_hash", "doc_id").alias("text_hash"), F.min_by("pos", "doc_id").alias("pos")), "leaves")
    sizes = written(leaves.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")), "sizes")
    leaves = leaves.join(sizes, "prefix")
    runs = leaves.where("n = 1 and least < most").select(
        "prefix", "leaf", F.col("low").alias("from_left"), F.col("high").alias("to_left"), "least")

    wanted = leaves.where("n > 1").select(
        F.col("least").alias("repeat__id"), F.col("text_hash").alias("repeat__text"),
        F.struct("pos", "prefix", "leaf", "least", "most", "low", "high").alias("place"))
    # places of one document, at most as many as it has words
    wanted = wanted.groupBy("repeat__id", "repeat__text").agg(F.collect_list("place").alias("repeat__places"))
    source = named.join(wanted, (named["doc_id"].cast("long") == wanted["repeat__id"])
                        & (named["repeat__hash"] == wanted["repeat__text"]))
    grouped = written(source.select(*named.columns, "repeat__places").mapInArrow(_leaf_words(window, prefix), LEAVES).select(
        F.col("prefix").alias("key"), F.lit(0).alias("a"), F.lit(window - prefix).alias("b"), "*"), "leaf-words")
    # every round makes the prefixes of the groups that are too large longer; a range halves, so there are few rounds
    while True:
        size = grouped.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        large = written(size.where(F.col("n") > group_rows).select("key"), "large-groups")
        whole = large.isEmpty()
        fits = grouped if whole else grouped.join(large, "key", "left_anti")
        runs = runs.unionByName(fits.repartition("key").sortWithinPartitions("key").mapInArrow(_grow(window, prefix), RUNS))
        if whole:
            break
        rest = written(grouped.join(large, "key", "left_semi").select(*grouped.columns), "large-leaves")
        single = rest.where("a = b")                     # one window: a node whose leaves share all its words
        least = single.groupBy("key").agg(F.min("least").alias("best"))
        runs = runs.unionByName(single.join(least, "key").where("best < most").select(
            "prefix", "leaf", F.col("a").alias("from_left"), F.col("a").alias("to_left"), F.col("best").alias("least")))
        grouped = written(rest.where("a < b").mapInArrow(_longer(window, prefix), GROUPED), "leaf-words")
    hit = places.select("doc_id", "text_hash", "pos", "prefix", "leaf").join(
        runs, ["prefix", "leaf"]).where("least < doc_id")
    span = F.struct((F.col("pos") - F.col("to_left")).alias("start"),
                    (F.col("pos") - F.col("from_left") + F.lit(window)).alias("stop"))
    return hit.groupBy("doc_id", "text_hash").agg(F.collect_set(span).alias("spans"))


def _covered(n: int, spans) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    for s in spans if spans is not None else ():
        step[s["start"]] += 1
        step[s["stop"]] -= 1
    return np.cumsum(step[:n]) > 0


def _with_spans(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with a column ``repeat__spans`` (null where nothing repeats)."""
    spans = repeat_spans(docs, **options).select(
        F.col("doc_id").alias("repeat__id"), F.col("text_hash").alias("repeat__text"), F.col("spans").alias("repeat__spans"))
    named = _named(docs)
    rows = named.join(spans, (named["doc_id"].cast("long") == spans["repeat__id"])
                      & (named["repeat__hash"] == spans["repeat__text"]), "left")
    unnamed = docs.where(F.col("doc_id").isNull()).withColumn("repeat__spans", F.lit(None).cast(spans.schema["repeat__spans"].dataType))
    return rows.select(*docs.columns, "repeat__spans").unionByName(unnamed)


def _digest(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for text, found in zip(texts, spans):
        words = text.encode("utf-8", "replace").split() if text else []
        if found is not None and len(found):
            gone = _covered(len(words), found)
            kept = [w for w, g in zip(words, gone.tolist()) if not g]
        else:
            kept = words
        rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])


def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, found in zip(texts, spans):
        if found is None or not len(found):
            out.append(text)
            continue
        data = text.encode("utf-8", "replace")
        words = data.split()
        gone = _covered(len(words), found)
        parts, at = [], 0
        for w, g in zip(words, gone.tolist()):         # each word with the white space before it
            stop = data.index(w, at) + len(w)
            if not g:
                parts.append(data[at:stop])
            at = stop
        out.append((b"".join(parts) + data[at:]).decode("utf-8").strip() if parts else "")
    return pd.Series(out, dtype=object)


def repeat_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space) of every row."""
    rows = _with_spans(docs.select("doc_id", "text"), **options)
    digest = F.pandas_udf(_digest, "n_words long, n_removed long, kept_sha256 string")
    return rows.select("doc_id", digest("text", "repeat__spans").alias("d")).select("doc_id", "d.*")


def strip_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the repeated words cut from ``text`` (white space between kept
    words as it was, ``n_chars`` brought up to date where there is one); rows that
    lose all their words go."""
    rows = _with_spans(docs, **options)
    rows = rows.withColumn("text", F.pandas_udf(_cut, "string")("text", "repeat__spans"))
    rows = rows.where(F.col("repeat__spans").isNull() | (F.col("text") != "")).drop("repeat__spans")
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
