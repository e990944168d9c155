"""Document quality: base rules with boosted trees, and a sparse rule ensemble.

``score_rules`` (rule ensemble): boosted trees over text measures give their
paths as conjunctive rules; a lasso-penalised logistic regression keeps a few of
them; the kept rules are compiled into a Spark column expression, which scores
every row next to the measures.

``apply_rules`` (quality rules): fixed base rules, then the verdict of
gradient-boosted trees with monotonic constraints (more symbols, repeats or
shouting never raises the score), scored from flattened node arrays.

Both learn from a bounded sample of the labelled training fold (``max_per_class``
rows of either class); counts and scores cover all rows and whole texts.

Edge cases: null and empty texts have zero counts, fail the base rules and get
the score of such a text; a training fold without both classes gives a constant
score; repeated rows score alike; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyeval.llm import common, trees
from polyeval.llm.measures import FEATURES, measure_column, sample_features

MAX_PER_CLASS = 10_000
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: More of these never raises the quality of a text.
MONOTONE = tuple(-1 if f in ("symbol_share", "bang_share", "dup_line_share", "repeat_share") else 0 for f in FEATURES)

Condition = tuple[int, bool, float]                   # feature, x <= threshold, threshold


@dataclass
class RuleModel:
    bias: float
    rules: list[tuple[tuple[Condition, ...], float]]

    def holds(self, x: np.ndarray) -> np.ndarray:
        return rule_matrix([r for r, _ in self.rules], x)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.bias + self.holds(x) @ np.array([w for _, w in self.rules]) if self.rules else np.full(len(x), self.bias)
        return 1 / (1 + np.exp(-z))

    def column(self, prefix: str = "") -> Column:
        """The score as a column expression over the measures."""
        z = F.lit(self.bias)
        for rule, w in self.rules:
            test = F.lit(True)
            for j, low, t in rule:
                c = F.col(prefix + FEATURES[j])
                test &= (c <= F.lit(t)) if low else (c > F.lit(t))
            z = z + F.when(test, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def tree_rules(forest: trees.Forest) -> list[tuple[Condition, ...]]:
    """All paths from a root, inner nodes included, as sorted conditions without repeats."""
    found: dict[tuple, None] = {}

    def walk(at: int, path: tuple):
        if path:
            tight: dict[tuple[int, bool], float] = {}
            for j, low, t in path:                     # of several bounds on one feature the tightest
                old = tight.get((j, low))
                tight[j, low] = t if old is None else min(old, t) if low else max(old, t)
            found.setdefault(tuple(sorted((j, low, t) for (j, low), t in tight.items())))
        j = int(forest.feature[at])
        if j >= 0:
            t = float(forest.threshold[at])
            walk(int(forest.left[at]), (*path, (j, True, t)))
            walk(int(forest.right[at]), (*path, (j, False, t)))
    for root in forest.roots:
        walk(int(root), ())
    return list(found)


def rule_matrix(rules, x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float32)
    for k, rule in enumerate(rules):
        for j, low, t in rule:
            out[:, k] *= (x[:, j] <= t) if low else (x[:, j] > t)
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 400):
    """Accelerated proximal gradient; the bias carries no penalty."""
    n, d = r.shape
    mean = np.average(r, axis=0, weights=weight)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-4))
    a = ((r - mean) / spread).astype(np.float64)
    share = weight / weight.sum()
    v = np.random.default_rng(0).normal(size=d)
    for _ in range(20):                                # largest curvature by power iteration
        v = a.T @ (share * (a @ v))
        size = np.linalg.norm(v)
        v /= max(size, 1e-12)
    step = 1 / (0.25 * max(size, 1.0) * 1.05)
    base = float(np.average(y, weights=weight))
    w, b, w0, b0, t0 = np.zeros(d), float(np.log(base / (1 - base))), np.zeros(d), 0.0, 1.0
    wy, by = w.copy(), b
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ wy + by, -30, 30)))
        e = share * (p - y)
        w1 = wy - step * (a.T @ e)
        w1 = np.sign(w1) * np.maximum(np.abs(w1) - step * penalty, 0)
        b1 = by - step * e.sum()
        t1 = (1 + (1 + 4 * t0 * t0) ** 0.5) / 2
        wy, by = w1 + (t0 - 1) / t1 * (w1 - w), b1 + (t0 - 1) / t1 * (b1 - b)
        w, b, t0 = w1, b1, t1
    w = w / spread
    return w, b - float(w @ mean)


def fit_rules(docs: DataFrame, labels: DataFrame, column: str = "quality", max_per_class: int = MAX_PER_CLASS,
              penalty: float = 1e-3) -> RuleModel:
    common.prepare(docs.sparkSession)
    x, y, weight = sample_features(docs, labels, column, max_per_class)
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1.0)
        return RuleModel(float(np.log(p / (1 - p))), [])
    forest = trees.fit(x, y, weight, trees=30, depth=3, rate=0.3, subsample=0.6, min_rows=min(8, max(2, len(y) // 40)))
    rules = tree_rules(forest)
    if not rules:
        return RuleModel(forest.bias, [])
    w, b = lasso_logistic(rule_matrix(rules, x), y, weight, penalty)
    return RuleModel(b, [(r, float(v)) for r, v in zip(rules, w) if v])


def score_rules(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    common.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).select(
        "doc_id", measure_column().alias("m")).select("doc_id", "m.*")
    return rows.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), model.column().alias("score")).select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def fit_trees(docs: DataFrame, labels: DataFrame, column: str = "quality",
              max_per_class: int = MAX_PER_CLASS) -> trees.Forest:
    common.prepare(docs.sparkSession)
    x, y, weight = sample_features(docs, labels, column, max_per_class)
    return trees.fit(x, y, weight, MONOTONE, min_rows=min(8, max(2, len(y) // 40)))


def apply_rules(docs: DataFrame, forest: trees.Forest, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept of every row."""
    common.prepare(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(forest)    # a few hundred nodes
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).select(
        "doc_id", measure_column(("score", lambda: shipped.value.score)).alias("m")).select("doc_id", "m.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), "score")
