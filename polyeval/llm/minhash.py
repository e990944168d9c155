"""MinHash near-duplicates.

A document's set: its distinct shingles of ``shingle`` words (A-Z lower-cased,
words between ASCII white space; fewer words: the whole sequence as one), each a
64-bit hash. Two documents link when the Jaccard similarity of their sets is at
least ``percent``.

* Equal sets are one class (a 128-bit digest), so copies cost one row.
* ``BANDS * ROWS`` minima under universal (multiply-shift) hash functions make
  the signature; classes that agree on all rows of a band meet in a bucket. A
  pair of similarity 0.8 meets in no bucket with a probability of 5e-9.
* Inside a bucket, one byte of every minimum is compared; the number that must
  agree comes from the binomial tail (``MISS``). A bucket returns a spanning
  forest of such pairs, and alternating large-star and small-star steps join
  the forests to clusters that no link leaves.
* Inside a cluster links are confirmed on the full sets, again as a spanning
  forest, so a pair that fails costs no other link; the components of the
  confirmed links are the result.
* Buckets and clusters above a bound of rows or bytes are dealt over a grid of
  cells (block against block), so no task holds one whole.

Edge cases: null, empty and blank texts have an empty set and link with nothing;
repeated rows come back repeated; rows without doc_id take part in links, their
component is the smallest doc_id of the others (null where there is none, and
then they are kept); only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyeval.llm import common
from polyeval.llm.common import HashCache, blocks, written
from polyeval.llm.simhash import components

SHINGLE = 2
PERCENT = 80
BANDS, ROWS = 48, 5
MISS = 1e-9                    # share of links that the comparison of signatures may lose
GROUP_ROWS = 20_000            # classes of one cell of a bucket
CELL_BYTES = 64 << 20          # set bytes of one cell of a cluster
BROADCAST_ROWS = 2_000_000     # bucket keys or ids (8 bytes each) that are broadcast at most; more are shuffled
STEP = 1 << 15                 # shingles hashed at once

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of ``n`` multiply-shift functions, from a counter."""
    seed = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _ODD)
    return seed[:n] | np.uint64(1), seed[n:]


def least_agreeing(n: int, percent: int, miss: float) -> int:
    """Smallest number of equal minima that a pair at the threshold reaches but for ``miss``."""
    s, below = percent / 100, 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * s ** k * (1 - s) ** (n - k)
        if below > miss:
            return k
    return n


def shingle_set(words: list[bytes], cache: HashCache, shingle: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one document."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter((cache[w] for w in words), np.uint64, len(words))
    width = min(shingle, len(words))
    key = np.full(len(h) - width + 1, np.uint64(width))
    for j in range(width):
        key = _mix(key * _ODD + h[j:len(h) - width + 1 + j])
    return np.unique(key)


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def _cache() -> HashCache:
    return HashCache(lambda w: xxhash.xxh64_intdigest(w, 7))


def minima(sets: list[np.ndarray], factor: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """[set, function] 32-bit minima of sets that are not empty."""
    out = np.empty((len(sets), len(factor)), np.uint32)
    at = 0
    for s, e in blocks(sets, STEP):
        part = sets[s:e]
        x = np.concatenate(part)
        first = np.r_[0, np.cumsum([len(p) for p in part])[:-1]]
        for i in range(len(factor)):
            out[at:at + len(part), i] = np.minimum.reduceat((x * factor[i] + offset[i]) >> np.uint64(32), first)
        at += len(part)
    return out


def prints(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n, digest, keys, sig) of every row: set size, digest of the set, band keys and one
    byte of every minimum; the last three are null for an empty set."""

    def make(batches):
        factor, offset = hash_functions(bands * rows)
        cache = _cache()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for s, e in blocks(texts):
                sets = [shingle_set(_words(t), cache, shingle) for t in texts[s:e]]
                has = [i for i, x in enumerate(sets) if len(x)]
                low = minima([sets[i] for i in has], factor, offset)
                key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(has), bands))
                for j in range(rows):
                    key = _mix(key * _ODD + low[:, j::rows])
                sig = (low & np.uint32(255)).astype(np.uint8)
                digest, keys, sigs = ([None] * len(sets) for _ in range(3))
                for at, i in enumerate(has):
                    digest[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                    keys[i] = key[at].view(np.int64)
                    sigs[i] = sig[at].tobytes()
                yield pa.record_batch({"doc_id": batch.column(0).slice(s, e - s), "n": pa.array([len(x) for x in sets], pa.int64()),
                                       "digest": pa.array(digest, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64())),
                                       "sig": pa.array(sigs, pa.binary())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    return texts.mapInArrow(make, f"doc_id {kind}, n long, digest binary, keys array<long>, sig binary")


def _forest(n_rows: int, similar):
    """Edges of a spanning forest of the graph that ``similar(row, rows) -> mask`` defines."""
    left = np.arange(n_rows)
    a, b = [], []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            at = stack.pop()
            near = similar(at, left)
            if near.any():
                new = left[near]
                left = left[~near]
                a.append(np.full(len(new), at))
                b.append(new)
                stack.extend(new)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def _whole_groups(batches):
    """Lists of rows with one key; rows come sorted by their first column."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if row[0] != now:
                if len(held) > 1:
                    yield held
                now, held = row[0], []
            held.append(row)
    if len(held) > 1:
        yield held


def _edges(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    pairs = list(set(pairs))
    return pa.record_batch({"a": pa.array([p[0] for p in pairs], pa.binary()), "b": pa.array([p[1] for p in pairs], pa.binary())})


def _dealt(rows: DataFrame, node: str) -> DataFrame:
    """Rows of a group over a grid: cell (i, j) compares block i with block j, a row of block k
    goes to every cell that names k. ``cells`` is the grid's width; the key tells group and cell."""
    k = F.pmod(F.xxhash64(node, F.lit(1)), F.col("cells")).cast("int")
    return (rows.withColumn("k", k).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
            .withColumn("cell", F.least("k", "o") * F.col("cells") + F.greatest("k", "o")))


def _width(size, bound):
    return F.when(size > bound, F.ceil(F.sqrt(size / F.lit(bound)) * 2)).otherwise(F.lit(1)).cast("int")


def _small(keys: DataFrame) -> DataFrame:
    """A one-column side of a join: broadcast where a count shows that it is small, so that the other side stays put."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def candidate_links(distinct: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS,
                    group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b) digests: a spanning forest, bucket by bucket, of the classes whose signatures agree enough."""
    entries = distinct.select("digest", F.explode("keys").alias("key"))
    shared = written(entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
                     .select("key", _width(F.col("size"), group_rows).alias("cells")), "shared")
    met = written(entries.join(_small(shared), "key"), "buckets")
    enough = least_agreeing(bands * rows, percent, MISS)

    def compare(batches):
        found = []
        for group in _whole_groups(batches):
            sig = np.frombuffer(b"".join(r[2] for r in group), np.uint8).reshape(len(group), -1)
            a, b = _forest(len(group), lambda at, left: (sig[left] == sig[at]).sum(axis=1) >= enough)
            found += [tuple(sorted((group[i][1], group[j][1]))) for i, j in zip(a, b)]
            if len(found) > 50_000:
                yield _edges(found)
                found = []
        if found:
            yield _edges(found)

    signed = _dealt(met, "digest").select(F.xxhash64("key", "cell").alias("key"), "digest").join(
        distinct.select("digest", "sig"), "digest").select("key", "digest", "sig")
    return signed.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a binary, b binary").distinct()


def confirmed_links(clusters: DataFrame, distinct: DataFrame, docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT,
                    bands: int = BANDS, rows: int = ROWS, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """(a, b) digests: a spanning forest, cluster by cluster, of the pairs whose full sets link.

    ``clusters``: (node, root) of the classes that may link. One document of each class is read again."""
    members = clusters.join(distinct, clusters["node"] == distinct["digest"]).select("digest", "root", "least", "n", "sig")
    width = members.groupBy("root").agg(F.sum("n").alias("s")).select(
        "root", _width(F.col("s") * 8, cell_bytes).alias("cells"))
    members = written(members.join(width, "root"), "members")

    def sets(batches):
        cache = _cache()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for s, e in blocks(texts):
                made = [shingle_set(_words(t), cache, shingle).tobytes() for t in texts[s:e]]
                yield pa.record_batch({"digest": pa.array([xxhash.xxh3_128_digest(x) for x in made], pa.binary()),
                                       "hashes": pa.array(made, pa.binary())})

    wanted = _small(members.select(F.col("least").alias("doc_id")).distinct())
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    texts = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi").select("text")
    full = texts.mapInArrow(sets, "digest binary, hashes binary").groupBy("digest").agg(F.first("hashes").alias("hashes"))
    enough = least_agreeing(bands * rows, percent, MISS)

    def confirm(batches):
        for group in _whole_groups(batches):
            size = np.array([r[2] for r in group], np.int64)
            sig = np.frombuffer(b"".join(r[3] for r in group), np.uint8).reshape(len(group), -1)
            full = [np.frombuffer(r[4], np.uint64) for r in group]

            def links(at, left):
                n = size[left]
                out = np.minimum(n, size[at]) * 100 >= np.maximum(n, size[at]) * percent
                out[out] = (sig[left[out]] == sig[at]).sum(axis=1) >= enough
                some = np.flatnonzero(out)
                for s, e in blocks([full[i] for i in left[some]], 1 << 20):
                    part = left[some[s:e]]
                    x = np.concatenate([full[i] for i in part])
                    j = np.searchsorted(full[at], x)
                    j[j == len(full[at])] = 0
                    common_n = np.add.reduceat((full[at][j] == x).astype(np.int64), np.r_[0, np.cumsum(size[part])[:-1]])
                    out[some[s:e]] = 100 * common_n >= percent * (size[part] + size[at] - common_n)
                return out

            a, b = _forest(len(group), links)
            if len(a):
                yield _edges([tuple(sorted((group[i][1], group[j][1]))) for i, j in zip(a, b)])

    ready = _dealt(members.join(full, "digest"), "digest").select(
        F.xxhash64("root", "cell").alias("key"), "digest", "n", "sig", "hashes")
    return ready.repartition("key").sortWithinPartitions("key").mapInArrow(confirm, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS,
                    group_rows: int = GROUP_ROWS, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept (it is the row's own) of every row."""
    common.prepare(docs.sparkSession)
    seen = written(prints(docs, shingle, bands, rows), "prints")
    distinct = written(seen.where("n > 0").groupBy("digest").agg(
        F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sig").alias("sig")),
        "distinct")
    near = components(candidate_links(distinct, percent, bands, rows, group_rows))
    sure = components(confirmed_links(near, distinct, docs, shingle, percent, bands, rows, cell_bytes))
    linked = sure.join(distinct.select(F.col("digest").alias("node"), "least"), "node")
    least = linked.groupBy("root").agg(F.min("least").alias("of_root"))
    linked = linked.join(least, "root").select(F.col("node").alias("digest"), "of_root")
    # one row a class; classes without links stand for themselves
    named = distinct.select("digest", "least").join(linked, "digest", "left").select(
        "digest", F.coalesce("of_root", "least").alias("component_id"))
    out = seen.select("doc_id", "n", "digest").join(named, "digest", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"),
                      F.col("doc_id").eqNullSafe(own).alias("kept"))
