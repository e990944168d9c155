import os
import random
import re
import sys
import zlib

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_rows import SCHEMA, edge_documents, prose, row  # noqa: E402

from polyeval.llm import measures, quality, toxicity, trees  # noqa: E402
from polyeval.llm.queries import op8_rule_ensemble, op9_toxicity, op10_boosted_rules  # noqa: E402

SF = "/root/testdata/sf0.01"
SPACE = r"[^\x20\x09-\x0D]"
LABELS = "doc_id long, quality int, toxic int"


def base_counts(text):
    text = text or ""
    words = re.findall(SPACE + "+", text)
    where = {}
    for i in range(len(words) - 4):
        where.setdefault(tuple(words[i:i + 5]), []).append(i)
    inside = {j for v in where.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(SPACE, line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside),
            n < 10 or 100 * len(inside) > 20 * n)


def test_base_counts_of_edge_rows(spark):
    rows = edge_documents() + [row(60, "a b c d e f a b c d e\na b\na b\n \n \n<p>|x|"), row(61, "x y\r\nx y\nx y"),
                               row(62, "\n".join(["same line of some words here"] * 5))]
    forest = trees.fit(np.zeros((0, len(measures.FEATURES))), np.zeros(0), np.zeros(0))
    got = quality.apply_rules(spark.createDataFrame(rows, SCHEMA), forest).collect()
    assert sorted(map(str, [tuple(r)[:7] for r in got])) == sorted(map(str, [(r[0], *base_counts(r[1])) for r in rows]))
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.apply_rules(spark.createDataFrame([], SCHEMA), forest).collect() == []


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def accuracy(rows, labels, field, value="predicted"):
    pairs = [(int(getattr(r, value)), labels[r.doc_id]) for r in rows if r.doc_id in labels and held(r.doc_id)]
    return sum(a == b for a, b in pairs) / len(pairs)


def test_model_queries_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good, bad = {r.doc_id: r.quality for r in labels}, {r.doc_id: r.toxic for r in labels}
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    for query, want, threshold in ((op8_rule_ensemble, good, 0.3), (op9_toxicity, bad, 0.5)):
        got = query(spark, SF).collect()
        assert len(got) == len(texts) and query(spark, SF).columns == ["doc_id", "held_out", "score", "predicted"]
        for r in got:
            assert r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= threshold)
        assert accuracy(got, want, "predicted") >= 0.95
    got = op10_boosted_rules(spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in got} == {k: base_counts(t) for k, t in texts.items()}
    rest = {k: v for k, v in good.items() if not base_counts(texts[k])[-1]}
    assert accuracy(got, rest, "quality", "kept") >= 0.9


def test_training_ignores_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    flipped = [(d, 1 - q, 1 - t) if held(d) else (d, q, t) for d, q, t in labels]
    models = [toxicity.fit(docs, spark.createDataFrame(x, LABELS)) for x in (labels, flipped)]
    assert models[0].bias == models[1].bias and (models[0].weight == models[1].weight).all()


def test_models_score_edge_rows_and_survive_poor_labels(spark):
    rows = edge_documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    for labels in ([], [(1, None, None), (None, 1, 1)], [(i, 1, 0) for i in range(50)],
                   [(i, i % 2, i % 2) for i in range(50)] * 2):
        table = spark.createDataFrame(labels, LABELS)
        for got in (toxicity.score_documents(docs, toxicity.fit(docs, table)),
                    quality.score_rules(docs, quality.fit_rules(docs, table))):
            got = got.collect()
            assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
            assert all(r.held_out for r in got if r.doc_id is None)
        assert quality.apply_rules(docs, quality.fit_trees(docs, table)).count() == len(rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert toxicity.score_documents(empty, toxicity.fit(empty, table)).collect() == []
    assert quality.score_rules(empty, quality.fit_rules(empty, table)).collect() == []


def test_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    slot = np.full(1 << toxicity.BITS, -1, np.int32)
    words = [b"alpha", b"beta", b"gamma"]
    buckets = sorted({b for w in words for b in toxicity.buckets_of(w)})
    slot[buckets] = np.arange(len(buckets))
    machine = toxicity.Machine(0.1, rng.normal(size=len(buckets)), rng.normal(size=(len(buckets), 4)), slot)
    on = sorted({slot[b] for w in (b"alpha", b"gamma") for b in toxicity.buckets_of(w)})
    z = 0.1 + sum(machine.weight[i] for i in on) + sum(machine.factor[i] @ machine.factor[j]
                                                       for a, i in enumerate(on) for j in on[a + 1:])
    assert abs(machine.scorer()("Alpha, GAMMA! gamma none") - 1 / (1 + np.exp(-z))) < 1e-12


def test_machine_learns_a_pair_that_weights_miss():
    """Label 1 only where both terms stand together."""
    rng = np.random.default_rng(1)
    x = (rng.random((3000, 4)) < 0.5).astype(np.float32)
    y = (x[:, 0] * x[:, 1]).astype(np.float32)
    old, toxicity.EPOCHS = toxicity.EPOCHS, 80
    try:
        b, w, v = toxicity._train(x, y, 3)
    finally:
        toxicity.EPOCHS = old
    z = b + x @ w + 0.5 * (((x @ v) ** 2).sum(1) - x @ (v ** 2).sum(1))
    assert ((z > 0) == (y > 0)).mean() > 0.98


def test_trees_are_monotone_and_flat_scoring_walks_them():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) + x[:, 1] + 0.2 * rng.normal(size=2000)) > 1).astype(float)
    forest = trees.fit(x, y, np.ones(2000), (1, 0, -1), trees=40, depth=3)
    assert ((forest.score(x) > 0.5) == (y > 0.5)).mean() > 0.85
    for feature, sign in ((0, 1), (2, -1)):
        line = np.repeat(rng.random((50, 3)), 40, axis=0)
        line[:, feature] = np.tile(np.linspace(0, 1, 40), 50)
        step = np.diff(forest.score(line).reshape(50, 40), axis=1) * sign
        assert (step >= -1e-12).all()


def test_rules_compile_to_the_same_scores(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([row(i, prose(i, rng.randint(5, 60)) + (" ### ***" * (i % 3)), "en") for i in range(300)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(300)], LABELS)
    model = quality.fit_rules(docs, labels)
    assert model.rules
    rows = docs.select("doc_id", measures.measure_column().alias("m")).select(
        "doc_id", "m.*").withColumn("score", model.column()).collect()
    x = np.array([[r[f] for f in measures.FEATURES] for r in rows])
    assert np.abs(model.score(x) - np.array([r.score for r in rows])).max() < 1e-6


def test_lasso_drops_useless_rules():
    rng = np.random.default_rng(5)
    r = (rng.random((4000, 12)) < 0.5).astype(float)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(4 * r[:, 0] - 4 * r[:, 1])))).astype(float)
    w, _ = quality.lasso_logistic(r, y, np.ones(4000), 0.02)
    assert w[0] > 1 and w[1] < -1 and (np.abs(w[2:]) < 0.1).all() and (w == 0).sum() >= 6


def test_repeated_ids_stay_within_the_sample(spark):
    labels = [(i, i % 2, i % 2) for i in range(1, 61)]
    rows = [row(i, prose(i, 30) + (" vile idiot" if i % 2 else " kind friend")) for i in range(1, 61)]
    hot = next(i for i in range(1, 61) if zlib.crc32(str(i).encode()) % 5)
    docs = spark.createDataFrame(rows + [row(hot, f"again {k} " + prose(k, 8)) for k in range(300)] + [row(hot, None)], SCHEMA)
    table = spark.createDataFrame(labels, LABELS)
    trained = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(1, 61))
    x, y, _ = measures.sample_features(docs, table, "quality", 100)
    assert len(x) == len(y) == trained
    one = docs.where(f"doc_id <> {hot}")
    kept = measures.sample_features(one, table, "quality", 100)[0]
    assert len(kept) == trained - 1
    again = measures.sample_features(docs.repartition(7, "text"), table, "quality", 100)[0]
    assert np.array_equal(x, again)
    biases = [toxicity.fit(d, table).bias for d in (docs, docs.repartition(7, "text"))]
    assert biases[0] == biases[1] and abs(biases[0]) < 3


def test_terms_that_matter_in_pairs_only_enter_the_machine(spark):
    """Label 1 where both words stand or neither does: neither word says anything alone."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(1, 2001):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = prose(i, 12).split() + ["wolves"] * a + ["bridge"] * b
        rng.shuffle(words)
        rows.append(row(i, " ".join(words)))
        labels.append((i, 0, int(a == b)))
    docs, table = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    counts = toxicity.sample_labels(table, "toxic", 8_000)[1]
    pair = {toxicity.buckets_of(w)[0] for w in (b"wolves", b"bridge")}
    assert not pair & set(toxicity.telling_terms(toxicity.term_counts(docs, table), counts))
    machine = toxicity.fit(docs, table)
    assert all(machine.slot[t] >= 0 for t in pair)
    got = toxicity.score_documents(docs, machine).collect()
    assert accuracy(got, {d: t for d, _, t in labels}, "predicted") >= 0.95


def test_term_counts_cover_every_labelled_row(spark):
    rows = [row(i, f"word{i % 3} Shared", "en") for i in range(1, 401)] + [row(1, "word1 shared")] * 3 + [row(2, None)]
    labels = [(i, 0, i % 2) for i in range(1, 301)] + [(2, 0, 0), (None, 0, 1), (5, 0, None)]
    got = {r["t"]: (r["b"], r["a"]) for r in toxicity.term_counts(
        spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()}
    want = {}
    share = {1: 4, 2: 2}
    for d, text, *_ in rows:
        if 1 <= d <= 300 and not held(d) and text:
            for t in set().union(*(toxicity.buckets_of(w) for w in toxicity.words_of(text))):
                a = want.setdefault(t, [0, 0])
                a[d % 2] += toxicity.UNIT // share.get(d, 1)
    assert got == {t: tuple(a) for t, a in want.items()}
