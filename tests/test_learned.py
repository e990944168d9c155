"""Learned profiles, merge tables, stored upserts, call slots, positions by key and bootstrap intervals."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from polyeval.functions import prompts as P
from polyeval.operators import analysis as A
from polyeval.operators import bpe as BPE
from polyeval.operators import ids as I
from polyeval.operators import joins as J
from polyeval.operators import language as LG
from polyeval.operators import runner as RN
from polyeval.plans import q_learned as Q
from polyeval.sources import files as FS
from polyeval.sources import sinks as SK
from polyeval.sources import upserts as UP


# --- positions by key -------------------------------------------------------------------------------
def test_positions_keep_null_keys_and_refuse_repeated_ones(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k long, t string")
    got = I.with_index(df, "pos", order_by=["k"], key=["k"]).collect()
    assert sorted((r["pos"], r["t"]) for r in got) == [(0, "b"), (1, "a"), (2, "c")]
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "k long, t string")
    with pytest.raises(Exception, match="share a key"):
        I.with_index(twice, "pos", order_by=["k"], key=["k"]).collect()


@pytest.mark.parametrize("chunk", [1, 2, 1024])
def test_ordered_concat_keeps_ties_and_null_groups(spark, chunk):
    rows = [("g", 1, "x"), ("g", 1, "y"), ("g", 2, "z"), (None, 1, "n"), (None, None, "m"), ("g", 1, "x"), ("h", 5, None)]
    df = spark.createDataFrame(rows, "g string, o int, t string")
    got = {r["g"]: r["s"] for r in I.ordered_concat(df, ["g"], "o", F.col("t"), "s", chunk=chunk).collect()}
    assert got == {"g": "xxyz", None: "mn", "h": ""}


def test_the_last_update_counts(spark):
    up = spark.createDataFrame([(1, "zzz first", 1), (1, "aaa last", 2)], "idx long, t string, seq int")
    assert J.last_per_key(up, "idx", ["t"], "seq").collect()[0]["t"] == "aaa last"
    with pytest.raises(TypeError):
        J.last_per_key(up, "idx", ["t"])


def test_letters_go_on_after_the_alphabet(spark):
    df = spark.range(130).select(P.letter(F.col("id")).alias("a"), P.letter(F.col("id"), "bangla").alias("b"), "id")
    for r in df.collect():
        assert r["a"] == chr(65 + r["id"]) and r["b"] == chr(0x0995 + r["id"])


# --- B35 ----------------------------------------------------------------------------------------------
def test_language_profiles_reach_the_bar_on_held_out_documents(spark):
    got = Q._profiled(spark, "/root/testdata/sf0.01").where(F.col("doc_id") % 5 == 0).groupBy("lang").agg(
        F.avg((F.col("lang") == F.col("detected")).cast("double")).alias("a")).collect()
    assert len(got) >= 4 and all(r["a"] >= 0.95 for r in got), got


def test_language_edges(spark):
    train = spark.createDataFrame([("aaab aaab", "x"), ("zzzy zzzy", "y"), ("ignored", None), (None, "x")], "text string, lang string")
    profiles = LG.learn_profiles(train, "text", "lang")
    rows = [(1, "AAAB"), (2, "zzzy zzzy aaab"), (3, ""), (4, None), (5, "123 !!"), (None, "zzzy"), (7, "a" * 200_000)]
    df = spark.createDataFrame(rows, "k long, text string")
    got = {r["k"]: r["detected"] for r in LG.detect(df, profiles, "k", "text").collect()}
    assert got == {1: "x", 2: "y", 3: "und", 4: "und", 5: "und", None: "y", 7: "x"}
    none = LG.learn_profiles(train.where("false"), "text", "lang")
    assert {r["detected"] for r in LG.detect(df, none, "k", "text").collect()} == {"und"}
    plan = LG.detect(df, profiles, "k", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


# --- J5 -------------------------------------------------------------------------------------------------
def brute_merge(word, ranks):
    sym = list(word)
    while True:
        found = [(ranks[p], i) for i, p in enumerate(zip(sym, sym[1:])) if p in ranks]
        if not found:
            return sym
        _, i = min(found)
        sym[i:i + 2] = [sym[i] + sym[i + 1]]


def test_byte_pair_merges_equal_brute_force(spark):
    rng = random.Random(1)
    for _ in range(300):
        pool = ["a", "b", "c"]
        ranks = {}
        for r in range(12):
            pair = (rng.choice(pool), rng.choice(pool))
            if pair not in ranks:
                ranks[pair] = r
                pool.append(pair[0] + pair[1])
        word = "".join(rng.choice("abc") for _ in range(rng.randint(0, 25)))
        assert BPE.merge_word(word, ranks) == brute_merge(word, ranks)


def test_byte_pair_counts_on_edges(spark):
    merges = spark.createDataFrame([(0, "a", "b"), (1, "ab", "ab"), (5, "a", "b")], "rank int, left string, right string")
    rows = [(1, "abab ab, x"), (2, None), (3, ""), (None, "ab"), (4, "abab"), (4, "a")]
    df = spark.createDataFrame(rows, "k long, text string")
    got = {r["k"]: r["bpe"] for r in BPE.count_tokens(df, "text", merges, "k").collect()}
    assert got == {1: 4, 2: 0, 3: 0, None: 1, 4: 2}


# --- D4 -------------------------------------------------------------------------------------------------
def test_stored_upsert_rewrites_only_touched_files(spark, tmp_path):
    path = str(tmp_path / "table")
    base = spark.range(40).select("id", F.lit("old").alias("t"), (F.col("id") * 2).alias("other"))
    UP.create(base.repartitionById(4, F.floor(F.col("id") / 10).cast("int")), path)
    first = set(UP.files(spark, path))
    up = spark.createDataFrame([(3, "b", 1), (3, "a", 2), (17, None, 1), (99, "new", 1)], "id long, t string, seq int")
    assert UP.upsert(spark, path, up, "id", ["t"], "seq") == {"files": 4, "rewritten": 2}
    second = set(UP.files(spark, path))
    assert len(first & second) == 2                           # untouched files are shared
    got = {r["id"]: (r["t"], r["other"]) for r in UP.read(spark, path).collect()}
    assert got == {i: ("a" if i == 3 else None if i == 17 else "old", 2 * i) for i in range(40)}
    assert {r["t"] for r in UP.read(spark, path, 0).collect()} == {"old"}     # the old version is still there
    assert UP.upsert(spark, path, up.where("id = 99"), "id", ["t"], "seq") == {"files": len(second), "rewritten": 0}
    assert UP.version(spark, path) == 1


# --- J7 -------------------------------------------------------------------------------------------------
def test_slots_hold_the_limit_over_all_tasks(spark):
    """200 tasks of one row, retries included: in no minute more calls than the limit."""
    from polyeval.plans.q_runner import VirtualClock
    clock, seen = VirtualClock(), {}

    def answer(k):                            # with the times of its calls; every row fails on its first one
        seen.setdefault(k, []).append(clock.now())
        if len(seen[k]) == 1:
            raise RuntimeError("429 rate limit")
        return ",".join(map(str, seen[k]))

    df = spark.range(200, numPartitions=200).withColumnRenamed("id", "k")
    out = RN.batch_infer(df, answer, ["k"], "k", calls_per_minute=50, concurrency=1, clock=clock.now, sleep=clock.sleep)
    times = sorted(float(t) for r in out.collect() for t in r["response"].split(","))
    assert len(times) == 400
    assert all(sum(1 for u in times if t <= u < t + 60 - 1e-6) <= 50 for t in times)


def test_a_late_lane_does_not_catch_up():
    now = [100.0]
    s = RN.SlotSchedule(60, lane=1, lanes=4, clock=lambda: now[0], sleep=lambda x: now.__setitem__(0, now[0] + x))
    got = []
    for _ in range(3):
        s.take()
        got.append(round(now[0], 6))
    assert got == [101.0, 105.0, 109.0]


# --- E17, E19 -------------------------------------------------------------------------------------------
def test_first_files_are_chosen_before_reading(spark, tmp_path):
    path = str(tmp_path / "tree")
    rows = [(i, d, f"p{i}") for i in range(30) for d in ("x", "y")]
    df = spark.createDataFrame(rows, "idx long, dataset string, prompt string").select(
        F.col("idx").alias("question_id"), "dataset", F.lit("m").alias("model"), F.lit("s").alias("system_prompt"), "prompt",
        F.lit("r").alias("response"), F.lit("g").alias("ground_truth"), "idx",
        F.lpad(F.floor(F.col("idx") / 10).cast("string"), 3, "0").alias("part"))
    SK.write_response_tree(df, path, ["dataset", "part"])
    got = FS.read_first_files(spark, path, "dataset")
    assert len(got.inputFiles()) == 2 and all("part=000" in f for f in got.inputFiles())
    assert sorted((r["dataset"], r["prompt"]) for r in got.collect()) == sorted((d, f"p{i}") for i in range(10) for d in ("x", "y"))


def test_bootstrap_is_repeatable_and_covers(spark):
    rng = random.Random(2)
    rows = [("k" if i % 2 else None, i, rng.gauss(0.5, 0.1)) for i in range(400)] + [("k", 1000, None)]
    df = spark.createDataFrame(rows, "k string, i long, score double")
    a = sorted(map(tuple, A.mean_bootstrap(df, ["k"], ["i"]).collect()), key=str)
    b = sorted(map(tuple, A.mean_bootstrap(df.repartition(7), ["k"], ["i"]).collect()), key=str)
    assert a == b and len(a) == 2
    for _, mean, low, high, n in a:
        assert n == 200 and low < mean < high and 0.02 < high - low < 0.045     # 4 * 0.1 / sqrt(200) = 0.028


# --- A15 ------------------------------------------------------------------------------------------------
def test_bloom_filter_spares_the_join_and_loses_nothing(spark):
    todo = spark.range(5000).withColumnRenamed("id", "k").unionByName(spark.createDataFrame([(None,), (None,)], "k long"))
    done = spark.range(0, 5000, 7).select(F.col("id").alias("k"), (F.col("id") % 3).alias("f")).unionByName(
        spark.createDataFrame([(None, 9), (10_000, 9)], "k long, f long"))
    blooms = J.bloom_filter(done, ["k"], "f")
    assert {r["file"] for r in blooms.select("file").distinct().collect()} == {"0", "1", "2", "9"}
    got = sorted(r["k"] for r in J.skip_finished(todo, done, blooms, ["k"]).collect())
    assert got == [i for i in range(5000) if i % 7]
    reached = J.maybe_done(todo, blooms, ["k"]).where("_maybe").count()
    assert 717 <= reached < 760                       # 715 finished ids, two nulls, few false hits
    empty = J.bloom_filter(done.where("false"), ["k"])
    assert J.skip_finished(todo, done.where("false"), empty, ["k"]).count() == 5002


# --- K2 -------------------------------------------------------------------------------------------------
def test_stream_state_and_versions_are_bounded(spark, tmp_path):
    from pyspark.sql import types as T
    from polyeval.streaming import responses as ST
    schema = T.StructType(ST.RESPONSE_SCHEMA.fields + [T.StructField("at", T.TimestampType())])
    folder, table, ck = (str(tmp_path / n) for n in ("in", "scores", "ck"))

    def deliver(first, n, day):
        rows = [(i, "boolq", "m", "en", "s", "p", "true", "true", i) for i in range(first, first + n)]
        spark.createDataFrame(rows, ST.RESPONSE_SCHEMA).withColumn(
            "at", F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp")).coalesce(1).write.mode("append").json(folder)

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for day in range(1, 7):                        # 20 new results a day, 10 of the day before come again
            deliver(20 * day - 10 if day > 1 else 20, 30 if day > 1 else 20, day)
            ST.stream_scores(spark, folder, table, ck, event_time="at", repeat_within="2 days", keep_versions=3, schema=schema)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = ST.score_view(spark, table).first()
    assert (got["rows"], got["right"]) == (120, 120)
    import os
    versions = [n for n in os.listdir(table) if n.startswith("v=")]
    assert len(versions) <= 3
    states = [spark.read.format("statestore").load(ck, operatorId=int(op)) for op in os.listdir(f"{ck}/state") if op.isdigit()]
    dedup = [t for t in states if "question_id" in t.select("key.*").columns]
    assert len(dedup) == 1 and dedup[0].count() <= 90             # not the 120 ids seen
