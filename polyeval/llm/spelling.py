"""Spelling variants by k-d trees over letter-count vectors.

Words are maximal runs of ``A-Za-z`` and U+00C0 to U+00FF, A-Z lower-cased. A
fixed share of the occurrences (``DAMAGE``: a checksum of doc_id and word) loses
one letter, which plants typing errors at known places. Words of
``MIN_LETTERS`` letters and ``MIN_COUNT`` occurrences take part.

One edit (a letter inserted, deleted or replaced) changes the letter counts by
an L1 distance of at most two: two for words of equal length, one for lengths
that differ by one. So for every pair of lengths:

* a top tree over the letter counts of the index words (fitted on a bounded
  sample, which only balances it) cuts them into cells of about ``CELL_WORDS``
  words; every index word lies in one cell. Words whose counts no cut can
  separate are dealt over parts of their cell by hash;
* a query word is sent to every cell that its L1 ball meets;
* in the cell a k-d tree with tight boxes is searched for whole batches of
  queries; boxes beyond the radius are pruned, and what a leaf leaves is
  compared letter by letter. No pair leaves the task, only the count of near
  words and the best form of every query word.

A word's form is its near word of largest count, if that is at least twice its
own; following forms (which at least double) leads to the root, found by
doubling the step.

Edge cases: null and empty texts hold no word; a null doc_id is the empty text
before the colon of the checksum; repeated rows count each time; only ``doc_id``
and ``text`` are read. Empty tables give an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyeval.llm import common
from polyeval.llm.common import HashCache, written

DAMAGE = 97
MIN_LETTERS = 5
MIN_COUNT = 3
RATIO = 2
CELL_WORDS = 50_000
SAMPLE_WORDS = 200_000         # words the top tree is fitted on, at most (about)
LEAF = 48
BATCH = 8_192                  # query words searched at once
FLUSH = 400_000                # words a task counts before it hands them on

_RUN = re.compile("[a-zÀ-ÿ]+")
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _runs(piece: bytes) -> tuple[str, ...]:
    return tuple(_RUN.findall(piece.decode("utf-8", "replace")))


def word_counts(docs: DataFrame, damage: int = DAMAGE, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words that take part, with their occurrences over all documents."""

    def count(batches):
        runs, total = HashCache(_runs), Counter()

        def flush():
            out = pa.record_batch({"word": pa.array(list(total), pa.string()),
                                   "n": pa.array(list(total.values()), pa.int64())})
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                seen: Counter = Counter()
                for piece, n in Counter(text.encode("utf-8", "replace").translate(_SPLIT).split()).items():
                    for run in runs[piece]:
                        seen[run] += n
                start = zlib.crc32(f"{doc_id or ''}:".encode())
                for run, n in seen.items():
                    h = zlib.crc32(run.encode("utf-8"), start)
                    if h % damage == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                    if len(run) >= min_letters:
                        total[run] += n
                if len(total) >= FLUSH:
                    yield flush()
        if total:
            yield flush()

    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("text"))
    return (texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count))


# ----- letter counts

def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in one array (a to z as 0-25, the others from 26), and the word starts."""
    size = np.array([len(w) for w in words], np.int64)
    code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    return np.where(code < 0xC0, code - 97, code - 0xC0 + 26).astype(np.uint8), np.r_[0, np.cumsum(size)]


def count_vectors(words: list[str]) -> np.ndarray:
    """[word, 32] letter counts: a to z, and the 64 others in six sums. Summing
    dimensions never lengthens a distance, so pruning by them stays exact."""
    code, start = _letters(words)
    dim = np.where(code < 26, code, 26 + (code - 26) % 6)
    row = np.repeat(np.arange(len(words)), np.diff(start))
    return np.bincount(row * 32 + dim, minlength=32 * len(words)).reshape(-1, 32).astype(np.int32)


_SPREAD = np.array([(1 << i) - 1 for i in range(5)], np.uint64)


def _sketch(v: np.ndarray) -> np.ndarray:
    """Counts in unary, four bits a dimension: differing bits never exceed the L1 distance."""
    u = _SPREAD[np.minimum(v, 4)]
    shift = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return np.stack([np.bitwise_or.reduce(u[:, :16] << shift, axis=1), np.bitwise_or.reduce(u[:, 16:] << shift, axis=1)], axis=1)


# ----- the tree of one cell

class _Tree:
    """k-d tree with tight boxes over count vectors; nodes in arrays."""

    def __init__(self, v: np.ndarray):
        self.low, self.high, self.kids, self.rows = [], [], [], []
        self._grow(v, np.arange(len(v)))

    def _grow(self, v, rows) -> int:
        at = len(self.low)
        part = v[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.kids.append(None)
        self.rows.append(rows)
        if len(rows) > LEAF and (high > low).any():
            dim = int(np.argmax(part.var(axis=0)))
            left = _cut(part[:, dim])
            self.rows[at] = None
            self.kids[at] = (self._grow(v, rows[left]), self._grow(v, rows[~left]))
        return at

    def leaves(self, q: np.ndarray, radius: int):
        """(query indexes, leaf rows) for every leaf whose box some query's ball meets."""
        stack = [(0, np.arange(len(q)))]
        while stack:
            at, idx = stack.pop()
            part = q[idx]
            gap = np.maximum(self.low[at] - part, 0).sum(axis=1) + np.maximum(part - self.high[at], 0).sum(axis=1)
            idx = idx[gap <= radius]
            if not len(idx):
                continue
            if self.kids[at] is None:
                yield idx, self.rows[at]
            else:
                stack += [(k, idx) for k in self.kids[at]]


def _cut(values: np.ndarray) -> np.ndarray:
    """True for the lower side of the cut nearest to the median that leaves neither side empty."""
    mid = np.partition(values, len(values) // 2)[len(values) // 2]
    low, high = values < mid, values <= mid
    if high.all() or (low.any() and len(values) - 2 * low.sum() < 2 * high.sum() - len(values)):
        return low
    return high


class _Words:
    """Words of one length (or a batch of them) as a matrix of letters."""

    def __init__(self, words: list[str]):
        self.words = words
        code, start = _letters(words)
        self.code = code.reshape(len(words), -1) if words else code.reshape(0, 0)
        self.vector = count_vectors(words)
        self.sketch = _sketch(self.vector)


def _one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def _one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """The long word without one letter is the short one: common prefix and suffix cover the short one."""
    n = short.shape[1]
    front = (np.cumprod(short == long[:, :n], axis=1)).sum(axis=1)
    back = (np.cumprod((short == long[:, 1:])[:, ::-1], axis=1)).sum(axis=1)
    return front + back >= n


def near_pairs(index: _Words, tree: _Tree, query: _Words):
    """(query row, index row) arrays of all words one edit apart."""
    gap = query.code.shape[1] - index.code.shape[1]
    radius = 2 if gap == 0 else 1
    chunk = max(1, (1 << 22) // max(1, index.code.shape[1]))
    for idx, rows in tree.leaves(query.vector, radius):
        qs, rs = query.sketch[idx], index.sketch[rows]
        step = max(1, (1 << 19) // len(rows))
        for s in range(0, len(idx), step):
            far = (np.bitwise_count(qs[s:s + step, None, 0] ^ rs[None, :, 0])
                   + np.bitwise_count(qs[s:s + step, None, 1] ^ rs[None, :, 1]))
            i, j = np.nonzero(far <= radius)
            i, j = idx[s:s + step][i], rows[j]
            for t in range(0, len(i), chunk):
                a, b = query.code[i[t:t + chunk]], index.code[j[t:t + chunk]]
                ok = _one_replaced(a, b) if gap == 0 else _one_inserted(a, b) if gap < 0 else _one_inserted(b, a)
                if ok.any():
                    yield i[t:t + chunk][ok], j[t:t + chunk][ok]


def _answer(index: _Words, index_n: np.ndarray, tree: _Tree, words: list[str]):
    """(words, near count, best count, best word) of the query words with a near word."""
    query = _Words(words)
    found = list(near_pairs(index, tree, query))
    if not found:
        return None
    q, r = (np.concatenate(x) for x in zip(*found))
    rank = np.empty(len(index.words), np.int64)             # largest count first, ties in code-point order
    rank[sorted(range(len(index.words)), key=lambda j: (-index_n[j], index.words[j]))] = np.arange(len(index.words))
    best = np.full(len(words), len(index.words))
    np.minimum.at(best, q, rank[r])
    by_rank = np.argsort(rank)
    near = np.bincount(q, minlength=len(words))
    hit = np.flatnonzero(near)
    top = by_rank[best[hit]]
    return pa.record_batch({"word": pa.array([words[i] for i in hit], pa.string()), "n_near": pa.array(near[hit]),
                            "best_n": pa.array(index_n[top]), "best": pa.array([index.words[i] for i in top], pa.string())})


# ----- the top tree

class _Cells:
    """Cuts of one word length: (dimension, largest count of the left side, left, right), leaves as cell numbers."""

    def __init__(self):
        self.nodes: list[tuple] = []

    def build(self, v: np.ndarray, scale: float, cell_words: int, cells: list[int]) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if len(v) * scale <= cell_words or not (v.max(axis=0) > v.min(axis=0)).any():
            # words that no cut separates: several parts, each word in one by its hash
            cells.append(max(1, int(-(-len(v) * scale // cell_words))))
            self.nodes[at] = (len(cells) - 1,)
            return at
        dim = int(np.argmax(v.var(axis=0)))
        left = _cut(v[:, dim])
        edge = int(v[left, dim].max())
        a = self.build(v[left], scale, cell_words, cells)
        b = self.build(v[~left], scale, cell_words, cells)
        self.nodes[at] = (dim, edge, a, b)
        return at

    def visit(self, q: np.ndarray, radius: int):
        """(cell, query indexes) of the cells that the queries' balls meet. The gap to a
        half-space adds up over dimensions; of several cuts in one dimension the widest counts."""
        stack = [(0, np.arange(len(q)), np.zeros((len(q), 0), np.int32), ())]
        while stack:
            at, idx, gaps, dims = stack.pop()
            node = self.nodes[at]
            if len(node) == 1:
                yield node[0], idx
                continue
            dim, edge, a, b = node
            value = q[idx, dim]
            for kid, gap in ((a, np.maximum(value - edge, 0)), (b, np.maximum(edge + 1 - value, 0))):
                if dim in dims:
                    wide = gaps.copy()
                    c = dims.index(dim)
                    wide[:, c] = np.maximum(wide[:, c], gap)
                    names = dims
                else:
                    wide, names = np.concatenate([gaps, gap[:, None].astype(np.int32)], axis=1), dims + (dim,)
                near = wide.sum(axis=1) <= radius
                if near.any():
                    stack.append((kid, idx[near], wide[near], names))


def _top_trees(words: DataFrame, cell_words: int):
    """{length: _Cells} and the number of parts of every cell, from a bounded sample of the words."""
    count = {r["k"]: r["n"] for r in words.groupBy(F.length("word").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(count.values())
    share = min(1.0, SAMPLE_WORDS / max(1, total))
    unit = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    sample: dict[int, list[str]] = {}
    for r in words.where(unit).select("word").collect():
        sample.setdefault(len(r["word"]), []).append(r["word"])
    trees, parts = {}, []
    for k, n in sorted(count.items()):
        rows = sample.get(k, [])
        trees[k] = _Cells()
        trees[k].build(count_vectors(rows), n / max(1, len(rows)), cell_words, parts) if rows else \
            trees[k].build(np.zeros((1, 32), np.int32), n, cell_words, parts)
    return trees, parts


def near_words(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) of every word with a near word: how many there are,
    and the one of largest count (ties: smallest in code-point order)."""
    spark = words.sparkSession
    trees, parts = _top_trees(words, cell_words)
    first = np.r_[0, np.cumsum(parts)].astype(np.int64)     # numbers of the parts of each cell
    shared = spark.sparkContext.broadcast((trees, parts, first))

    def send(batches):
        trees, parts, first = shared.value
        for batch in batches:
            by: dict[int, list[int]] = {}
            names, n = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for i, w in enumerate(names):
                by.setdefault(len(w), []).append(i)
            for k, at in by.items():
                at = np.array(at)
                some = [names[i] for i in at]
                v = count_vectors(some)
                for other in (k - 1, k, k + 1):
                    if other not in trees:
                        continue
                    for cell, idx in trees[other].visit(v, 2 if other == k else 1):
                        for part in range(parts[cell]):
                            yield pa.record_batch({
                                "cell": pa.array(np.full(len(idx), first[cell] + part), pa.int32()), "own": pa.array(np.zeros(len(idx), bool)),
                                "word": pa.array([some[i] for i in idx], pa.string()), "n": pa.array(n[at[idx]])})
                for cell, idx in trees[k].visit(v, 0):
                    part = np.array([zlib.crc32(some[i].encode()) % parts[cell] for i in idx], np.int64)
                    yield pa.record_batch({
                        "cell": pa.array(first[cell] + part, pa.int32()), "own": pa.array(np.ones(len(idx), bool)),
                        "word": pa.array([some[i] for i in idx], pa.string()), "n": pa.array(n[at[idx]])})

    def answer(batches):
        now, held, held_n, tree, index = None, [], [], None, None
        by: dict[int, list[str]] = {}

        def ask(limit):
            for k in [k for k, w in by.items() if len(w) >= limit]:
                out = _answer(index, index_n, tree, by.pop(k))
                if out is not None:
                    yield out

        index_n = None
        for batch in batches:
            for cell, own, word, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if cell != now:
                    if tree is not None:
                        yield from ask(0)
                    now, held, held_n, tree, by = cell, [], [], None, {}
                if own:
                    held.append(word)
                    held_n.append(n)
                    continue
                if not held:
                    continue
                if tree is None:
                    index, index_n = _Words(held), np.array(held_n, np.int64)
                    tree = _Tree(index.vector)
                by.setdefault(len(word), []).append(word)
                if len(by[len(word)]) >= BATCH:
                    yield from ask(BATCH)
        if tree is not None:
            yield from ask(0)

    sent = words.select("word", "n").mapInArrow(send, "cell int, own boolean, word string, n long")
    found = (sent.repartitionById(max(1, int(first[-1])), F.col("cell")).sortWithinPartitions("cell", F.desc("own"))
             .mapInArrow(answer, "word string, n_near long, best_n long, best string"))
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))).alias("b")
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
            .select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best")))


def roots(forms: DataFrame, max_rounds: int = 12) -> DataFrame:
    """(word, root) from (word, form): counts double along a chain, so it has under 64 steps,
    and every round doubles the step."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max_rounds):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return now
    raise RuntimeError("a chain of forms did not end")


def spelling_variants(docs: DataFrame, damage: int = DAMAGE, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT,
                      cell_words: int = CELL_WORDS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the documents."""
    common.prepare(docs.sparkSession)
    words = written(word_counts(docs, damage, min_letters, min_count), "words")
    near = near_words(words, cell_words)
    has = F.col("best_n") >= RATIO * F.col("n")
    formed = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "forms")
    root = roots(formed.where("form is not null"))
    return formed.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"),
                                                    "n", "n_near", "form_n")
