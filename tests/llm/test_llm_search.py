import math
import os
import random
import re
import sys
import zlib
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_rows import SCHEMA, edge_documents, prose, row  # noqa: E402

from polyeval.llm import lexical, minhash, spelling  # noqa: E402
from polyeval.llm.queries import op11_dual_tree_search, op12_spelling_variants, op13_minhash_near_dedup  # noqa: E402

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def by_id(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


# ----- ranked search

def brute_search(docs, items, k=50):
    docs = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs]
    docs = [(d, Counter(t), len(t)) for d, t in docs if t]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        if text is None:
            continue
        found = []
        for d, c, n in docs:
            m = 50 + 50 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
                    for t in set(TERM.findall(text.translate(LOWER))) if t in c)
            if s > 0:
                found.append((-s, d is None, d))
        for r, (s, _, d) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k]):
            out.append((item, r + 1, d, -s))
    return out


ITEM_SCHEMA = "item_id long, text string, score double, item int, rank string"


def items_of(rows):
    return [(i, t, 0.5, 1, "x") for i, t in rows]


@pytest.mark.parametrize("item_bytes,k", [(8 << 20, 3), (400, 2), (8 << 20, 50)])
def test_search_edges_equal_brute_force(spark, monkeypatch, item_bytes, k):
    monkeypatch.setattr(lexical, "ITEM_BYTES", item_bytes)
    docs = edge_documents()
    items = [(1, prose(1, 20)), (1, prose(1, 20)), (2, prose(2, 60)), (2, "one"), (3, None), (4, ""), (5, "!? --"), (None, "ka lo Mi"),
             (6, "漢字 ÀÉ ñandú 😀 B a"), (7, prose(3, 3000)), (8, "nowhere xyzzy")]
    got = lexical.search(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items_of(items), ITEM_SCHEMA), k).collect()
    assert by_id(got) == by_id(brute_search([r[:2] for r in docs], items, k))


def test_search_ties_go_by_doc_id_across_blocks(spark, monkeypatch):
    """One text in thousands of copies: the smallest ids win, whatever block or task they are in."""
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 64)
    rng = random.Random(1)
    ids = rng.sample(range(10_000), 3000)
    docs = [row(i, "alpha beta gamma" if i % 3 else f"alpha delta {i % 7}") for i in ids]
    got = lexical.search(spark.createDataFrame(docs, SCHEMA).repartition(5),
                         spark.createDataFrame(items_of([(1, "alpha beta"), (2, "delta 5"), (3, "gamma delta")]), ITEM_SCHEMA)).collect()
    assert by_id(got) == by_id(brute_search([r[:2] for r in docs], [(1, "alpha beta"), (2, "delta 5"), (3, "gamma delta")]))


def test_search_prunes(monkeypatch):
    """Bounds leave few documents to score: topics far from the item are never multiplied out."""
    import numpy as np
    n, terms = 2_048, 64
    topic = np.repeat(np.arange(terms), n // terms)
    weight = np.full(terms, 1000)
    group = lexical._groups([np.array([3])], weight)[0]
    best = lexical._Best(1, 5)
    scored = []
    add = best.add
    best.add = lambda item, s, d, z: (scored.append(len(s)), add(item, s, d, z))
    lexical._search(group, best, np.arange(n), np.zeros(n, bool), np.arange(n + 1), topic, np.full(n, 500))
    assert list(best.doc[0]) == [96, 97, 98, 99, 100] and sum(scored) <= 128


def test_search_empty_tables(spark):
    docs, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], ITEM_SCHEMA)
    some = spark.createDataFrame(items_of([(1, "a")]), ITEM_SCHEMA)
    assert lexical.search(docs, items).collect() == [] and lexical.search(docs, some).collect() == []
    full = spark.createDataFrame(edge_documents(), SCHEMA)
    assert lexical.search(full, items).collect() == []


def test_search_query_equals_brute_force(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert by_id(op11_dual_tree_search(spark, SF).collect()) == by_id(brute_search(documents(spark), items))


# ----- spelling variants

def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_spelling(docs, damage=97, letters=5, least=3):
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % damage == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= letters and c >= least}
    by = {}
    for w in n:
        by.setdefault(len(w), []).append(w)
    form, out = {}, []
    for w, c in n.items():
        close = [v for k in (-1, 0, 1) for v in by.get(len(w) + k, ()) if near(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * c else None
        out.append((w, len(close)))
    rows = []
    for w, k in out:
        r = w
        while form[r]:
            r = form[r]
        rows.append((w, form[w], r, n[w], k, n[form[w]] if form[w] else None))
    return rows


@pytest.mark.parametrize("cell_words", [50_000, 40, 3])
def test_spelling_edges_equal_brute_force(spark, cell_words):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(4, 9))) for _ in range(150)]
    words = []
    for w in base:
        i = rng.randrange(len(w))
        words += [w] * rng.randint(1, 40) + [w[:i] + w[i + 1:]] * rng.randint(1, 9) + [w[:i] + rng.choice("abñ×") + w[i + 1:]] * rng.randint(1, 9)
    words += ["stop", "spot", "Stops", "SPOTS", "posts"] * 4 + ["a" * 300] * 5 + ["a" * 299 + "b"] * 11 + ["ÀÉÎÕÜ", "àÉÎÕÜ"] * 3
    rng.shuffle(words)
    docs = edge_documents() + [row(100 + i, " ".join(words[i::20])) for i in range(20)] + [row(None, "words words, words; wordz wordz wordz")]
    got = spelling.spelling_variants(spark.createDataFrame(docs, SCHEMA), cell_words=cell_words).collect()
    assert by_id(got) == by_id(brute_spelling([r[:2] for r in docs]))


def test_spelling_query_equals_brute_force(spark):
    assert by_id(op12_spelling_variants(spark, SF).collect()) == by_id(brute_spelling(documents(spark)))


def test_spelling_chains_end_at_the_root(spark):
    forms = [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(40)]
    got = dict(tuple(r) for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect())
    assert got == {w: "w40" for w, _ in forms}


def test_spelling_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([row(1, None), row(2, "few")], SCHEMA)).collect() == []


# ----- minhash

def shingles(text):
    words = [w for w in re.split("[ \t-\r]+", (text or "").translate(LOWER)) if w]
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset(words)


def brute_near(rows, percent=80):
    sets = [(d, shingles(t)) for d, t in rows]
    keys = list({s for _, s in sets if s})
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                root[find(a)] = find(b)
    least = {}
    for d, s in sets:
        if s and d is not None:
            least[find(s)] = min(d, least.get(find(s), d))
    out = []
    for d, s in sets:
        c = least.get(find(s)) if s else d
        out.append((d, len(s), c, d == c))
    return out


def near_copies():
    """A chain and a star of near copies at and around the threshold."""
    rng = random.Random(8)
    base = prose(20, 60).split()
    rows = [row(1000, " ".join(base))]
    for i in range(60):                                     # each near the base, few near each other
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        rows.append(row(1001 + i, " ".join(w)))
    w = prose(21, 50).split()
    for i in range(30):                                     # a chain, its ends share nothing
        w = w[2:] + [f"y{i}", f"z{i}"]
        rows.append(row(900 - i, " ".join(w)))
    rows += [row(2000, "a b c d e f"), row(2001, "a b c d e g"), row(2002, "A b"), row(2003, "a  B"), row(2004, "b a")]
    return rows


@pytest.mark.parametrize("group_rows,cell_bytes", [(20_000, 64 << 20), (3, 2_000)])
def test_minhash_edges_equal_brute_force(spark, group_rows, cell_bytes):
    rows = edge_documents() + near_copies()
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), group_rows=group_rows, cell_bytes=cell_bytes).collect()
    assert by_id(got) == by_id(brute_near([r[:2] for r in rows]))


def test_minhash_query_equals_brute_force(spark):
    assert by_id(op13_minhash_near_dedup(spark, SF).collect()) == by_id(brute_near(documents(spark)))


def test_minhash_one_id_with_two_texts(spark):
    """Classes are told by their text, not by the id: one id may stand in two components."""
    a, b = prose(30, 40), prose(31, 40)
    rows = [row(1, a), row(2, a), row(2, b), row(3, b)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert by_id(got) == by_id(brute_near([r[:2] for r in rows]))


def test_minhash_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    got = minhash.near_duplicates(spark.createDataFrame([row(1, None), row(2, " ")], SCHEMA)).collect()
    assert by_id(got) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_signature_threshold():
    enough = minhash.least_agreeing(240, 80, 1e-9)
    assert 150 <= enough <= 155
    assert (1 - .8 ** minhash.ROWS) ** minhash.BANDS < 1e-8
