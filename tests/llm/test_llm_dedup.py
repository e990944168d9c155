import hashlib
import os
import sys

import pytest
import xxhash

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_rows import SCHEMA, edge_documents, prose, row  # noqa: E402

from polyeval.llm import simhash, substrings  # noqa: E402
from polyeval.llm.queries import op3_simhash_near_dedup, op4_substring_dedup  # noqa: E402

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def split(text):
    for c in SPACE:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def print_of(text, n=4):
    words = split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, bits=4):
    """[(doc_id, fingerprint, component)] by comparing all fingerprints."""
    prints = [(d, print_of(t)) for d, t in rows]
    keys = sorted({f for _, f in prints})
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                root[find(b)] = find(a)
    least = {}
    for d, f in prints:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [(d, f, least.get(find(f))) for d, f in prints]


def brute_repeats(rows, window=50):
    least = {}
    for d, t in rows:
        w = split(t)
        for i in range(len(w) - window + 1):
            if d is not None:
                k = tuple(w[i:i + window])
                least[k] = min(d, least.get(k, d))
    out = []
    for d, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and least[tuple(w[i:i + window])] < d:
                gone[i:i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def by_id(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def signed(f):
    return f - (1 << 64) if f >> 63 else f


@pytest.mark.parametrize("group_rows", [20_000, 1])
def test_simhash_edges_equal_brute_force(spark, group_rows):
    rows = edge_documents()
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), group_rows=group_rows).collect()
    want = [(d, signed(f), c) for d, f, c in brute_components([r[:2] for r in rows])]
    assert by_id(got) == by_id(want)


def test_simhash_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = op3_simhash_near_dedup(spark, SF).collect()
    assert by_id(got) == by_id([(d, f"{f:016x}", c) for d, f, c in brute_components(rows)])


def test_simhash_links_every_close_pair(spark):
    """Chains of fingerprints at every distance up to five, in every segment."""
    import random
    rng = random.Random(3)
    prints = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(4):
            prints.add(f)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                f ^= 1 << b
    prints = sorted(prints)
    df = spark.createDataFrame([(signed(f),) for f in prints], "fp long")
    for segments in (2, 3, 5):
        for group_rows in (20_000, 2):
            found = {(r.a, r.b) for r in simhash.links(df, segments=segments, group_rows=group_rows).collect()}
            root = {signed(f): signed(f) for f in prints}

            def find(k):
                while root[k] != k:
                    k = root[k]
                return k
            for a, b in found:
                assert ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 4
                root[find(b)] = find(a)
            for i, a in enumerate(prints):
                for b in prints[i + 1:]:
                    if (a ^ b).bit_count() <= 4:
                        assert find(signed(a)) == find(signed(b))


def test_simhash_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.drop_near_duplicates(empty).collect() == []


def test_one_id_in_two_components_keeps_both(spark):
    a, b, d, e = (prose(40 + i, 60) for i in range(4))
    rows = [row(1, a), row(2, a), row(2, b), row(4, d), row(4, e), row(9, d), row(4, d)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, a), (2, b), (4, d), (4, e)])


def test_drop_near_duplicates_keeps_one_row_of_each_component(spark):
    rows = edge_documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    want = sorted({d for d, _, c in brute_components([r[:2] for r in rows]) if d is not None and d == c})
    assert sorted(i for i in ids if i is not None) == want
    assert ids.count(None) == 2


@pytest.mark.parametrize("group_rows", [50_000, 3, 1])
def test_repeats_edges_equal_brute_force(spark, group_rows):
    rows = edge_documents()
    got = substrings.repeat_report(spark.createDataFrame(rows, SCHEMA), group_rows=group_rows).collect()
    assert by_id(got) == by_id(brute_repeats([r[:2] for r in rows]))


def test_repeats_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert by_id(op4_substring_dedup(spark, SF).collect()) == by_id(brute_repeats(rows))


def test_repeats_small_windows_random(spark):
    import random
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for group_rows in (50_000, 2):
        got = substrings.repeat_report(df, window=8, prefix=3, group_rows=group_rows).collect()
        assert by_id(got) == by_id(brute_repeats(rows, 8))


def test_strip_repeats_cuts_text_and_keeps_columns(spark):
    passage, own = prose(1, 60), prose(2, 20)
    docs = spark.createDataFrame([row(1, passage), row(2, own + "\n\n" + passage + "\nend here"), row(3, passage), row(4, None),
                                  row(5, "  as  it\nwas ")], SCHEMA)
    got = {r.doc_id: r for r in substrings.strip_repeats(docs).collect()}
    assert substrings.strip_repeats(docs).columns == docs.columns
    assert set(got) == {1, 2, 4, 5}                    # 3 lost all its words
    assert got[1].text == passage and got[4].text is None and got[5].text == "  as  it\nwas "
    assert got[2].text == own + "\nend here" and got[2].n_chars == len(got[2].text)


def test_repeats_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substrings.repeat_report(empty).collect() == []
    assert substrings.strip_repeats(empty).collect() == []
