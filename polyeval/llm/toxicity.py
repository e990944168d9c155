"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed terms: every word (lower case, ASCII
punctuation cut) and the word's first 4, 5 and 6 bytes, so that inflected forms
of one stem share a term. The machine scores

    w0 + sum_i w_i + sum_{i<j} <v_i, v_j>

over the terms present; the pairwise part sees combinations (an insult beside a
group mention) that additive weights miss.

Terms enter the machine in two ways, none of them with a limit on their number:

* alone, by a chi-square test counted in Spark over all labelled training rows
  (folds as in ``common.held_out``; an id with several rows counts once in all);
* in pairs, by a score test against the machine fitted on the former: words whose
  joint presence moves the label beyond what the machine expects, also such that
  say nothing alone. The tests of a block of words run in one task.

The fit reads a bounded sample of labelled rows (``max_per_class`` of either
class) and is a numpy loop on the driver over the rows' chosen terms; pair terms
start from the weights the score test estimates. Scoring runs in every task over
whole texts.

Edge cases: null and empty texts have no terms and score the base rate; a
training set without both classes gives the constant base rate; repeated rows
score alike; only ``doc_id`` and ``text`` are read, so other columns may have
any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyeval.llm import common
from polyeval.llm.common import HashCache, crc, sample_labels, written

BITS = 18
MAX_PER_CLASS = 8_000          # labelled rows of either class a fit uses at most
FACTORS = 8
EPOCHS = 12
MIN_CHI2 = 10.83               # 0.1 % point of chi-square with one degree of freedom
MIN_PAIR_CHI2 = 43.0           # the same for pairs: below one false pair in 10^10
MIN_VARIANCE = 3.0             # label variance of a pair's rows from which the test's approximation holds
PAIR_BLOCK = 64                # words whose pairs one task tests at once
ROWS_AT_ONCE = 500             # rows of one word whose other words are counted at once
CACHE_WORDS = 100_000          # words a task keeps the buckets of, about 350 bytes each
BROADCAST_LABELS = 2_000_000   # labelled ids (24 bytes each) sent to every task at most; more are joined by a shuffle
UNIT = 1 << 20                 # weight of an id in the counts, dealt over its rows
STEMS = (4, 5, 6)

_CUT = bytes(b if (48 <= b <= 57 or 97 <= b <= 122 or b >= 128) else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_CUT).split() if text else []


def buckets_of(word: bytes) -> tuple[int, ...]:
    mask = (1 << BITS) - 1
    return (crc(word) & mask, *(crc(b"^" + word[:n]) & mask for n in STEMS if len(word) > n))


@dataclass
class Machine:
    """Bias, weights and factors by slot; ``slot`` maps a bucket to its slot or -1."""
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    slot: np.ndarray

    def scorer(self):
        slot, w, v = self.slot, self.weight, self.factor
        v2 = (v ** 2).sum(axis=1)
        cache = HashCache(lambda word: tuple(s for s in (int(slot[b]) for b in buckets_of(word)) if s >= 0),
                          CACHE_WORDS)

        def score(text: str | None) -> float:
            found: set[int] = set()
            for s in filter(None, map(cache.__getitem__, set(words_of(text)))):
                found.update(s)
            if not found:
                return 1.0 / (1.0 + np.exp(-self.bias))
            at = np.array(sorted(found))
            pair = 0.5 * ((v[at].sum(axis=0) ** 2).sum() - v2[at].sum())
            return 1.0 / (1.0 + np.exp(-np.clip(self.bias + w[at].sum() + pair, -30, 30)))
        return score


def _terms_udf():
    @F.pandas_udf("struct<terms:array<int>,words:array<int>>")
    def terms(parts: pd.Series) -> pd.DataFrame:
        cache = HashCache(buckets_of, CACHE_WORDS)
        terms, words = [], []
        for t in parts:
            found = list(map(cache.__getitem__, set(words_of(t))))
            terms.append(np.array(sorted(set().union(*found)), np.int32))
            words.append(np.array(sorted({b[0] for b in found}), np.int32))
        return pd.DataFrame({"terms": terms, "words": words})
    return terms


def term_counts(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> DataFrame:
    """(t, b, a): the weight of the training ids of label 0 and 1 whose text holds term ``t``, over
    all labelled rows; an id weighs ``UNIT``. At most 2^BITS rows leave a task."""
    train = common.train_labels(labels, column)
    rows = docs.groupBy(F.col("doc_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    train = written(train.join(rows, "doc_id").select("doc_id", "y", F.floor(F.lit(UNIT) / F.col("n")).cast("long").alias("u")), "train")
    side = F.broadcast(train) if train.count() <= BROADCAST_LABELS else train
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).join(side, "doc_id").select("y", "u", "text")

    def count(batches):
        cache = HashCache(buckets_of, CACHE_WORDS)
        total = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            y, u = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, text in enumerate(batch.column(2)):
                found = set().union(*map(cache.__getitem__, set(words_of(text.as_py()))))
                total[y[i], np.fromiter(found, np.int64, len(found))] += u[i]
        t = np.flatnonzero(total.any(axis=0))
        yield pa.record_batch({"t": pa.array(t, pa.int32()), "b": pa.array(total[0, t]), "a": pa.array(total[1, t])})
    return (texts.mapInArrow(count, "t int, b long, a long").groupBy("t")
            .agg(F.sum("b").alias("b"), F.sum("a").alias("a")))


def telling_terms(counts: DataFrame, counted: dict[int, int]) -> list[int]:
    """Terms that the chi-square test over ``counted`` ids of either label sets apart, ascending."""
    n0, n1 = float(counted[0]), float(counted[1])
    a, b = F.col("a") / F.lit(float(UNIT)), F.col("b") / F.lit(float(UNIT))
    chi2 = (n0 + n1) * F.pow(a * n0 - b * n1, 2) / (n1 * n0 * (a + b) * F.greatest(F.lit(n0 + n1) - a - b, F.lit(0.5)))
    return sorted(r["t"] for r in counts.where(chi2 > MIN_CHI2).select("t").collect())


@dataclass
class Sample:
    """Sample rows as lists of slots: row i holds ``at[start[i]:start[i + 1]]`` of ``width`` slots."""
    start: np.ndarray
    at: np.ndarray
    width: int

    def __len__(self) -> int:
        return len(self.start) - 1

    def batch(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slots met, 0/1 matrix of the rows over them)."""
        size = self.start[rows + 1] - self.start[rows]
        row = np.repeat(np.arange(len(rows)), size)
        at = self.at[np.repeat(self.start[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        slots, col = np.unique(at, return_inverse=True)
        x = np.zeros((len(rows), len(slots)), np.float32)
        x[row, col] = 1.0
        return slots, x


def _sample_of(rows: DataFrame, field: str, ids: list[int]) -> tuple[Sample, np.ndarray]:
    """The sample's rows over the terms ``ids`` of the array ``field``, by doc_id, and their labels."""
    slot = np.full(1 << BITS, -1, np.int32)
    slot[ids] = np.arange(len(ids))
    shipped = rows.sparkSession.sparkContext.broadcast(slot)       # 1 MB

    @F.pandas_udf("array<int>")
    def slots(parts: pd.Series) -> pd.Series:
        return parts.map(lambda t: (lambda s: s[s >= 0])(shipped.value[np.asarray(t, np.int64)]))
    got = rows.select("doc_id", "y", slots(F.col(field)).alias("s")).toArrow().sort_by("doc_id")
    shipped.unpersist()
    lists = got["s"].combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    size = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    return (Sample(np.r_[0, np.cumsum(size)], lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), len(ids)),
            got["y"].to_numpy().astype(np.float32))


def _block_pairs(sample: Sample, holders: tuple, resid: np.ndarray, var: np.ndarray, first: int, stop: int):
    """Pairs (t, u), t in [first, stop) and u > t, whose rows depart from the fitted labels: (t, u, step)."""
    start, row = holders                               # slot -> its rows
    for t in range(first, stop):
        v, r = np.zeros(sample.width), np.zeros(sample.width)
        for s in range(start[t], start[t + 1], ROWS_AT_ONCE):
            mine = row[s:min(s + ROWS_AT_ONCE, start[t + 1])]
            size = sample.start[mine + 1] - sample.start[mine]
            other = sample.at[np.repeat(sample.start[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            v += np.bincount(other, np.repeat(var[mine], size), sample.width)
            r += np.bincount(other, np.repeat(resid[mine], size), sample.width)
        v[:t + 1] = 0
        for u in np.flatnonzero((v >= MIN_VARIANCE) & (r ** 2 > MIN_PAIR_CHI2 * v)):
            yield t, int(u), float(r[u] / v[u])


def telling_pairs(rows: DataFrame, machine_of_rows: np.ndarray) -> list[tuple[int, int, float]]:
    """(term, term, step) of the words whose joint presence the fitted probabilities do not explain;
    ``step`` is the pair's weight after one Newton step from them.

    A pair's rows need a label variance of ``MIN_VARIANCE``, so words of fewer than four times as many
    rows cannot pass and are left out beforehand."""
    spark = rows.sparkSession
    words = sorted(r["t"] for r in rows.select(F.explode("words").alias("t")).groupBy("t")
                   .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 4 * MIN_VARIANCE).collect())
    sample, y = _sample_of(rows, "words", words)
    order = np.argsort(sample.at, kind="stable")
    row = np.repeat(np.arange(len(sample), dtype=np.int32), np.diff(sample.start))[order]
    holders = (np.r_[0, np.cumsum(np.bincount(sample.at, minlength=len(words)))], row)
    p = machine_of_rows
    # the sample's terms and labels: bounded by its rows, 2 * max_per_class at most
    shipped = spark.sparkContext.broadcast((sample, holders, y - p, p * (1 - p)))

    def test(batches):
        for batch in batches:
            found = [x for b in batch.column(0).to_pylist()
                     for x in _block_pairs(*shipped.value, b * PAIR_BLOCK, min(len(words), (b + 1) * PAIR_BLOCK))]
            t, u, step = zip(*found) if found else ((), (), ())
            yield pa.record_batch({"t": pa.array(t, pa.int32()), "u": pa.array(u, pa.int32()), "step": pa.array(step, pa.float64())})
    n_blocks = -(-len(words) // PAIR_BLOCK)
    got = spark.range(0, n_blocks, 1, max(1, min(n_blocks, 64))).mapInArrow(test, "t int, u int, step double").collect()
    shipped.unpersist()
    return sorted((words[r["t"]], words[r["u"]], r["step"]) for r in got)


def _start_factors(pairs: list[tuple[int, int, float]], width: int) -> np.ndarray:
    """Factors whose products come near the pairs' steps: leading eigenvectors of the pair matrix by
    subspace iteration (shifted, so that the largest eigenvalues lead, not the largest in size)."""
    t, u = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
    step = np.clip(np.array([p[2] for p in pairs]), -8, 8)
    load = np.zeros(width)
    np.add.at(load, np.r_[t, u], np.abs(np.r_[step, step]))
    shift = load.max()
    used = np.unique(np.r_[t, u])
    q = np.zeros((width, FACTORS))
    q[used] = np.random.default_rng(11).normal(size=(len(used), FACTORS))

    def product(v):
        out = np.zeros_like(v)
        np.add.at(out, t, step[:, None] * v[u])
        np.add.at(out, u, step[:, None] * v[t])
        return out
    k = min(FACTORS, len(used))
    q = np.linalg.qr(q[:, :k])[0]
    for _ in range(60):
        q = np.linalg.qr(product(q) + shift * q)[0]
    value = np.maximum((q * product(q)).sum(axis=0), 0)
    out = np.zeros((width, FACTORS), np.float32)
    out[:, :k] = q * np.sqrt(value)
    return out


def _constant(counts: dict[int, int]) -> Machine:
    p = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1.0)
    return Machine(float(np.log(p / (1 - p))), np.zeros(0), np.zeros((0, FACTORS)), np.full(1 << BITS, -1, np.int32))


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic",
        max_per_class: int = MAX_PER_CLASS, seed: int = 7) -> Machine:
    common.prepare(docs.sparkSession)
    sample, counts = sample_labels(labels, column, max_per_class)
    if min(counts.get(0, 0), counts.get(1, 0)) == 0:
        return _constant(counts)
    # at most 2 * max_per_class rows by construction of the sample
    rows = written(common.sampled_texts(docs, sample).select("doc_id", "y", _terms_udf()(F.col("text")).alias("found"))
                   .select("doc_id", "y", "found.terms", "found.words"), "fm-sample")
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return _constant(counts)
    ids = telling_terms(term_counts(docs, labels, column), counts)
    x, y = _sample_of(rows, "terms", ids)
    bias, w, v = _train(x, y, seed)
    pairs = telling_pairs(rows, _probabilities(x, bias, w, v))
    if pairs:
        ids = sorted({*ids, *(t for pair in pairs for t in pair[:2])})
        at = {t: i for i, t in enumerate(ids)}
        x, y = _sample_of(rows, "terms", ids)
        bias, w, v = _train(x, y, seed, _start_factors([(at[t], at[u], s) for t, u, s in pairs], len(ids)))
    # the sample has other class shares than the fold: shift the bias to the fold's
    bias += float(np.log(counts[1] / counts[0]) - np.log(n1 / n0))
    slot = np.full(1 << BITS, -1, np.int32)
    slot[ids] = np.arange(len(ids))
    return Machine(bias, w, v, slot)


def _logit(xb: np.ndarray, b: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    xv = xb @ v
    return b + xb @ w + 0.5 * ((xv ** 2).sum(1) - xb @ (v ** 2).sum(1)), xv


def _probabilities(x: Sample, b: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for s in range(0, len(x), 512):
        slots, xb = x.batch(np.arange(s, min(len(x), s + 512)))
        out[s:s + 512] = 1 / (1 + np.exp(-np.clip(_logit(xb, b, w[slots], v[slots])[0], -30, 30)))
    return out


def _train(x, y: np.ndarray, seed: int, factors: np.ndarray | None = None):
    """AdaGrad on the logistic loss of the machine, with weight decay on the slots a batch meets.

    ``x``: a ``Sample``, or a 0/1 matrix. ``factors``: added to the random start."""
    rng = np.random.default_rng(seed)
    d = x.width if isinstance(x, Sample) else x.shape[1]
    b = float(np.log(y.mean() / (1 - y.mean())))
    w, v = np.zeros(d, np.float32), rng.normal(0, 0.02, (d, FACTORS)).astype(np.float32)
    v = v if factors is None else v + factors
    gb, gw, gv = 1e-6, np.full(d, 1e-6, np.float32), np.full((d, FACTORS), 1e-6, np.float32)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for s in range(0, len(y), 512):
            i = order[s:s + 512]
            at, xb = x.batch(i) if isinstance(x, Sample) else (slice(None), x[i])
            z, xv = _logit(xb, b, w[at], v[at])
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) / len(i)).astype(np.float32)
            dw = xb.T @ g + 2e-5 * w[at]
            dv = xb.T @ (g[:, None] * xv) - (xb.T @ g)[:, None] * v[at] + 2e-4 * v[at]
            db = float(g.sum())
            gb += db * db
            gw[at] += dw * dw
            gv[at] += dv * dv
            b -= 0.1 * db / gb ** 0.5
            w[at] -= 0.1 * dw / np.sqrt(gw[at])
            v[at] -= 0.02 * dv / np.sqrt(gv[at])
    return b, w.astype(np.float64), v.astype(np.float64)


def score_column(machine: Machine, spark):
    """A column function text -> probability of label 1."""
    shipped = spark.sparkContext.broadcast(machine)      # at most 2^18 slots with FACTORS factors: 20 MB

    @F.pandas_udf("double")
    def score(parts: pd.Series) -> pd.Series:
        one = shipped.value.scorer()
        return pd.Series([one(t) for t in parts], dtype="float64")
    return score


def score_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.5 on)."""
    score = score_column(machine, docs.sparkSession)
    scored = docs.select(F.col("doc_id").alias("doc_id"), score(F.col("text")).alias("score"))
    return scored.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of ``docs`` scoring below 0.5, columns unchanged."""
    score = score_column(machine, docs.sparkSession)
    return docs.where(score(F.col("text")) < 0.5)
