import hashlib
import os
import random
import re
import sys

import pytest
import regex

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_rows import SCHEMA, edge_documents, prose, row  # noqa: E402

from polyeval.llm import decontam, licenses, pieces  # noqa: E402
from polyeval.llm.queries import (op1_benchmark_decontamination, op6_license_scan, op7_sentencepiece,  # noqa: E402
                                  piece_model)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


def expected(library, text):
    ids = library.encode(text or "")
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_tokens_equal_the_library_on_edges(spark, library):
    rows = edge_documents()
    got = pieces.token_report(spark.createDataFrame(rows, SCHEMA), piece_model()).collect()
    have = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, r.source_bytes) for r in got)
    spans = {(r.ids_sha256, r.spans_sha256) for r in got}
    assert have == sorted((str(r[0]), *expected(library, r[1]), len((r[1] or "").encode())) for r in rows)
    encoded = pieces.encode_documents(spark.createDataFrame(rows, SCHEMA), piece_model())
    assert spans == {tuple(hashlib.sha256(x.encode()).hexdigest() for x in (
        ",".join(map(str, r.ids)), ",".join(map(str, r.begins)) + "/" + ",".join(map(str, r.ends)))) for r in encoded.collect()}
    again = pieces.decode_rows(encoded, piece_model()).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in again) == \
        sorted((str(r[0]), library.decode(library.encode(r[1] or ""))) for r in rows)
    assert pieces.token_report(spark.createDataFrame([], SCHEMA), piece_model()).collect() == []


def test_tokens_query_equals_the_library(spark, library):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: tuple(r)[1:4] for r in op7_sentencepiece(spark, SF).collect()}
    assert got == {k: expected(library, t) for k, t in texts.items()}


def test_random_texts_and_ids(library):
    rng = random.Random(1)
    model = pieces.Model.load(piece_model())
    encoder, decoder = pieces.Encoder(model), pieces.Decoder(model)
    letters = list("abcde THE the  \n\t.,!▁éßñ😀漢字\x00ing") + ["  ", "<s>", "<unk>", "<0x41>", "ﬁ"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(600)] + ["", " ", "▁", "a" * 3000]
    ids, begins, ends, at = encoder.encode_block(texts)
    for i, text in enumerate(texts):
        mine = ids[at[i]:at[i + 1]].tolist()
        assert mine == library.encode(text) and decoder.decode(mine) == library.decode(mine)
        b, e = begins[at[i]:at[i + 1]].tolist(), ends[at[i]:at[i + 1]].tolist()
        if b:                                          # spans tile the source bytes
            assert b[0] == 0 and e[-1] == len(text.encode()) and b[1:] == e[:-1]
            for piece, x, y in zip(mine, b, e):
                if model.kinds[piece] == 1 and "▁" not in model.pieces[piece]:
                    assert text.encode()[x:y].decode() == model.pieces[piece]
    for _ in range(800):
        some = [rng.randrange(len(model.pieces)) for _ in range(rng.randint(0, 8))] + \
               [rng.randrange(3, 259) for _ in range(rng.randint(0, 5))]
        assert decoder.decode(some) == library.decode(some)


def test_normalisation_through_a_compiled_character_map():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb
    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    proto = pb.ModelProto()
    proto.ParseFromString(rule.serialized_model_proto())
    spec = proto.normalizer_spec
    model = pieces.Model.load(piece_model())
    model.charsmap, model.squeeze = spec.precompiled_charsmap, spec.remove_extra_whitespaces
    encoder = pieces.Encoder(model)
    rng = random.Random(2)
    letters = list("ab  \t\nＡＢ①ﬁ½éé漢ｶﾞ　­😀")
    for _ in range(500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        norm, origin = encoder.normalise(text)
        assert norm == rule.Normalize(text)
        assert len(origin) == len(norm.encode()) + 1 and (origin[1:] >= origin[:-1]).all()
    norm, origin = encoder.normalise("ＡＢ①  x ﬁ")
    assert norm == "▁AB1▁x▁fi" and origin.tolist() == [0, 0, 0, 0, 3, 6, 9, 9, 9, 11, 12, 12, 12, 13, 13, 16]


def base_hits(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
                       re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    hits = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    starts = [i for i, _ in hits]
    return (len(words), len(hits), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in hits})))


def test_license_base_columns(spark):
    texts = ["MIT License mit-license", "apache\nLICENSE, general public license; mit license " + "x " * 3000,
             "mit  licenses", licenses.TEMPLATES["mit"][0], "Général public license", prose(1, 50), None, ""]
    rows = edge_documents() + [row(100 + i, t) for i, t in enumerate(texts)]
    got = licenses.scan_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got])) == \
        sorted(map(str, [(r[0], *base_hits(r[1])) for r in rows]))
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert licenses.scan_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_license_query_base_columns(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
           for r in op6_license_scan(spark, SF).collect()}
    assert got == {k: base_hits(t) for k, t in texts.items()}


def test_license_matching_statistics_against_brute_force():
    rng = random.Random(4)
    templates = {"a": ("p q r s t u v w", "r s t x y z"), "b": ("u v w p q r s",)}
    automaton = licenses.Automaton(templates, {"s t": "st", "q r s": "qrs"})
    known = [t.split() for ts in templates.values() for t in ts]
    grams = {tuple(t[i:j]) for t in known + [["s", "t"], ["q", "r", "s"]] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for _ in range(300):
        words = [rng.choice("pqrstuvwxyzk") for _ in range(30)]
        if rng.random() < .7:
            t = rng.choice(known)
            words[5:5] = t
        hits, runs = automaton.scan([w.encode() for w in words])
        want = sorted((i, k) for k, p in enumerate((["s", "t"], ["q", "r", "s"])) for i in range(len(words))
                      if words[i:i + len(p)] == p)
        assert sorted(hits) == want
        longest = [next(n for n in range(i + 1, -1, -1) if n == 0 or tuple(words[i + 1 - n:i + 1]) in grams)
                   for i in range(len(words))]
        top = [(i + 1 - n, i + 1) for i, n in enumerate(longest) if n >= licenses.MIN_MATCH
               and (i + 1 == len(words) or longest[i + 1] != n + 1)]
        assert [(a, b) for a, b, _ in runs] == top


def test_license_template_with_a_gap():
    automaton = licenses.Automaton()
    text = licenses.TEMPLATES["mit"][0].replace("modify, merge", "modify, EXTRA merge")
    found = licenses.scan_text(automaton, "intro words " + text)
    assert found["labels"] == "mit" and found["spans"][0]["start"] == 2 and found["n_base"] == 0


ITEM = ("Tom has 3 kg of green apples in his basket and gives 2 kg of them to Mary before they walk 5 miles "
        "to the old market near the river where Tom buys 3 pears")


def test_reparameterised_question_is_found(spark):
    other = ITEM.replace("Tom", "Ann").replace("Mary", "Bob").replace("3", "7").replace("2 ", "4 ").replace("5", "9")
    mixed = ITEM.replace("Tom has 3", "Ann has 7").replace("Mary", "Ann").replace("Tom buys", "Eve buys")
    rows = edge_documents() + [row(50, prose(9, 40) + " " + ITEM + " " + prose(10, 40)), row(51, other), row(52, mixed),
                               row(53, "Some text. " + ITEM[:40]), row(54, prose(11, 300)), row(50, ITEM), row(None, ITEM)]
    docs = spark.createDataFrame(rows, SCHEMA)
    bench = spark.createDataFrame([(1, ITEM, 9), (2, None, 9), (3, "short one", 9), (None, ITEM, 9), (4, prose(12, 30), 9)],
                                  "item_id long, text string, pos int")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, bench).collect()}
    assert set(got) == {(50, 1), (51, 1)}
    assert got[50, 1].kind == "copy" and got[50, 1].coverage == 1.0
    assert got[51, 1].kind == "reparameterised" and got[51, 1].n_changed >= 3
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows if r[0] not in (50, 51))
    empty = spark.createDataFrame([], SCHEMA)
    assert decontam.contaminated(empty, bench).collect() == []
    assert decontam.contaminated(docs, bench.limit(0)).collect() == []


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = sorted(map(tuple, decontam.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    assert sorted(map(tuple, decontam.contaminated(docs, bench).collect())) == one


def brute_contaminated(docs, items, width=decontam.WIDTH):
    """Documents and items by comparing every window of tokens, slots and all."""
    def cut(text):
        words = regex.findall(decontam.TOKEN, text or "")
        out = []
        for w in words:
            amount = any(c in "0123456789" for c in w)
            kind = (1 if w[0].isdigit() and w[-1].isdigit() else 2) if amount else 3 if w[0] != w[0].lower() else 0
            out.append((kind, w))
        found = {}
        for i in range(len(out) - width + 1):
            part = out[i:i + width]
            if sum(k == 0 for k, _ in part) >= decontam.MIN_LITERAL:
                found[i] = (tuple(w if k == 0 else k for k, w in part), [w for k, w in part if k])
        return found
    cut_items = {i: cut(t) for i, t in items}
    where = {}
    for i, found in cut_items.items():
        for p, (template, slots) in found.items():
            where.setdefault(template, []).append((i, p, slots))
    out = set()
    for d, t in docs:
        lines = {}
        for p, (template, slots) in cut(t).items():
            for i, q, theirs in where.get(template, ()):
                lines.setdefault((i, p - q), []).append((q, slots, theirs))
        places = {}
        for (i, _), met in lines.items():
            pairs = {x for _, a, b in met for x in zip(b, a)}
            fits = len({x for x, _ in pairs}) == len(pairs) == len({x for _, x in pairs})
            places.setdefault(i, set()).update(q for q, a, b in met if fits or a == b)
        out |= {(d, i) for i, p in places.items() if len(p) >= decontam.MIN_COVERAGE * len(cut_items[i])}
    return out


def test_decontamination_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in op1_benchmark_decontamination(spark, SF).collect()}
    assert got == brute_contaminated(rows, items)
    assert {(d, i) for d, t in rows for i, x in items if x in (t or "")} <= got


def test_short_and_long_runs_merge_alike():
    model = pieces.Model.load(piece_model())
    encoder = pieces.Encoder(model)
    rng = random.Random(6)
    runs = list({"▁" * rng.randint(0, 3) + "".join(rng.choice("theingationsé😀xq\nœ") for _ in range(rng.randint(1, 60)))
                 for _ in range(400)} | {"a", "▁", "\n", "😀"})
    encoder._learn(runs)
    for run in runs:
        i = encoder.code[run]
        at = slice(encoder.start[i], encoder.start[i] + encoder.length[i])
        assert list(zip(encoder.flat_id[at], encoder.flat_end[at])) == encoder.merge(run)
        assert encoder.norm_bytes[i] == len(run.encode())


PROBLEMS = ("a farmer sells {} eggs on monday and {} more on tuesday then packs {} boxes with {} cups for the fair and keeps {} "
            "eggs at home how many eggs are left",
            "the train leaves with {} people on board and at the next stop {} people get off while {} get on so after {} "
            "more stops with {} people each how many are left",
            "Anna reads {} pages before lunch and {} pages after lunch while her brother reads {} pages and skips {} pages "
            "of the same book with {} chapters how many pages remain")


def test_independently_drawn_numbers_are_found(spark):
    rng = random.Random(8)
    items = [(i, PROBLEMS[i % 3].format(*rng.sample(range(2, 21), 5))) for i in range(3)]
    rows = [row(i, PROBLEMS[i % 3].format(*[rng.randint(2, 20) for _ in range(5)])) for i in range(300)]
    twice = "a shop has {} apples and also {} plums in one big box near the old door of the hall"
    items.append((9, twice.format(3, 3)))
    rows += [row(900, twice.format(7, 9)), row(901, twice.format(4, 4))]
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(
        spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(i, i % 3) for i in range(300)} | {(900, 9), (901, 9)}
    assert got[900, 9].kind == "reparameterised" and got[900, 9].n_changed == 2 and got[900, 9].coverage == 1.0


def test_items_without_plain_words_are_found(spark):
    texts = ["Who wrote Faust?", "What is 12 + 7 * 3 - 4 / 2 + 18 - 5 + 66 + 9 ?",
             "WHICH PLANET IS CLOSEST TO THE SUN AND HAS NO MOON AT ALL", "Zürich", "12 plus 7", "太陽系で一番大きい惑星はどれですか",
             "中国的首都是哪里？", "ดาวเคราะห์ดวงใดใหญ่ที่สุด", "Mercury Venus Earth Mars Jupiter Saturn Uranus Neptune Pluto"]
    items = list(enumerate(texts)) + [(100, " ?! "), (101, "")]
    glue = {5: "答え：問題は{}と言う", 6: "问{}答"}
    rows = [row(i, glue.get(i, "so they say: {} - and more follows here").format(x)) for i, x in enumerate(texts)]
    rows += [row(50, "What is 12 + 7 * 4 - 4 / 2 + 19 - 5 + 67 + 9 ?"), row(51, "who wrote another Faust"), row(52, "大きい惑星"),
             row(53, "112 plus 7, 12 plus 75"), row(54, None), row(55, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(len(texts))]
    assert all(r.coverage == 1.0 and r.kind in ("copy", "short") for r in got)


RECASED = ("The river Danube flows through Vienna, Budapest and Belgrade before it reaches the Black Sea near Romania and Ukraine",
           "Die Straße nach Berlin führt an einem See vorbei und der Fahrer hält vor dem Haus seiner Mutter mit 5 kg Äpfeln",
           "which of these rivers flows through more than 3 of the large towns named in the list of the first lesson")


def test_copies_in_other_letter_case_are_found(spark):
    rows = [row(10 * i + j, prose(j, 20) + " " + make(x) + " " + prose(j + 9, 20)) for i, x in enumerate(RECASED)
            for j, make in enumerate((str, str.lower, str.upper, str.title))]
    got = decontam.contaminated(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(
        list(enumerate(RECASED)), "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted((r[0], r[0] // 10) for r in rows)
    assert all(r.coverage == 1.0 and r.kind == "copy" and r.n_changed == 0 for r in got)


def test_short_items_are_reported_and_drop_nothing(spark):
    docs = spark.createDataFrame([row(1, "He went to Paris in spring."), row(2, "What is it? " + prose(50, 40)), row(3, prose(51, 30))], SCHEMA)
    items = spark.createDataFrame([(1, "Paris"), (2, "What is it?"), (3, prose(51, 30))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontam.contaminated(docs, items).collect()}
    assert got == {(1, 1): "short", (2, 2): "short", (3, 3): "copy"}
    assert sorted(r.doc_id for r in decontam.drop_contaminated(docs, items).collect()) == [1, 2]


def test_the_sieve_grows_with_the_item_windows(spark):
    from pyspark.sql import functions as F
    assert [decontam.sieve_bits(n) for n in (0, 100, 16_384, 16_385, 200_000, 10_000_000)] == \
        [1 << 18, 1 << 18, 1 << 18, 1 << 19, 1 << 22, 1 << 24]
    items = spark.range(40_000).select(F.xxhash64("id").alias("hash"))
    sieve, size = decontam._sieve(items)
    assert size == 1 << 20

    def passing(rows):
        h = F.col("hash").bitwiseAND(F.lit(size - 1))
        word = F.get(sieve, F.shiftright(h, 6).cast("int"))
        return rows.where(F.bit_get(word, h.bitwiseAND(F.lit(63)).cast("int")) == 1).count()
    assert passing(items) == 40_000
    assert passing(spark.range(1_000_000, 1_040_000).select(F.xxhash64("id").alias("hash"))) < 2_400
