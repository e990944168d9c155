"""Cases that earlier rounds got wrong: duplicate updates, half translations, batch
file sizes, unreadable score versions, rate limits that count retries."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from polyeval.functions import prompts as P
from polyeval.functions import text as X
from polyeval.operators import joins as J
from polyeval.operators import packing as PK
from polyeval.operators import runner as RN
from polyeval.session import scratch_path
from polyeval.sources import files as FS
from polyeval.streaming import responses as ST


def test_updates_of_one_index_do_not_multiply_rows(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "idx long, t string")
    up = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (9, "z", 1)], "idx long, t string, n int")
    merged, rest = J.upsert_by_index(base, up, "idx", ["t"], order="n")
    assert sorted(map(tuple, merged.collect())) == [(1, "y", True), (2, "b", False)]
    assert [r.idx for r in rest.collect()] == [9]


def test_half_a_translation_is_not_used(spark):
    base = spark.createDataFrame([(1, "q1", "a1"), (2, "q2", "a2"), (3, "q3", "a3")], "idx long, q string, a string")
    tr = spark.createDataFrame([(1, "Q", None, 1), (2, "Z", "A", 1), (2, "Q", "A", 2)], "idx long, q string, a string, n int")
    got = sorted(map(tuple, J.fallback_to_original(base, tr, "idx", ["q", "a"], order="n").collect()))
    assert got == [(1, "q1", "a1", "original"), (2, "Q", "A", "translated"), (3, "q3", "a3", "original")]


def test_batch_files_stay_below_the_limit(spark):
    rows = [(i, 'say "x"\n\\ ' + "ü" * (i % 40)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = scratch_path(spark, "test-batches")
    PK.write_batches(PK.pack(df, "doc_id", PK.record_bytes(["doc_id", "text"]), 1500, 30, chunk_rows=64), path)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f")).collect()
    size, count = {}, {}
    for r in lines:
        size[r.f] = size.get(r.f, 0) + len(r.value.encode()) + 1
        count[r.f] = count.get(r.f, 0) + 1
    assert len(lines) == 400 and max(size.values()) <= 1500 and max(count.values()) <= 30
    assert {json.loads(r.value)["doc_id"] for r in lines} == set(range(400))


def test_unreadable_score_version_raises(spark):
    path = scratch_path(spark, "test-versions")
    assert ST._latest(spark, path) is None
    os.makedirs(path.removeprefix("file:") + "/v=0")
    with open(path.removeprefix("file:") + "/v=0/part-0.parquet", "wb") as f:
        f.write(b"not a parquet file")
    with pytest.raises(Exception):
        ST._latest(spark, path).collect()


def test_slots_counts_retries():
    now = [0.0]

    def sleep(s):
        now[0] += s
    slots = RN.SlotSchedule(60, clock=lambda: now[0], sleep=sleep)
    for _ in range(5):
        slots.take()
    assert slots.waits >= 4 and now[0] == pytest.approx(4, abs=0.01)
    assert isinstance(slots.lock, type(threading.Lock()))


def test_judge_prompt_carries_examples(spark):
    df = spark.createDataFrame([("q {prompt}", "t", "a")], "p string, t string, a string")
    got = df.select(P.judge_prompt(F.col("p"), F.col("t"), F.col("a"))).first()[0]
    assert got.count("Example ") == len(P.JUDGE_EXAMPLES) and got.endswith("Question:\nq {prompt}\n\nReference answer:\nt\n\nModel answer:\na\n")
    assert '{"reasoning": ' in got


def test_language_by_script_and_words(spark):
    rows = ["আমি ভাত খাই and you", "the cat is in the house", "der Hund ist nicht da und", "", None, "123"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r[0] for r in df.select(X.detect_language("t")).collect()] == ["bn", "en", "de", "und", "und", "und"]


def test_option_letters_end_with_an_error(spark):
    df = spark.range(1).select(F.array(*[F.lit(str(i)) for i in range(12)]).alias("o"))
    assert df.select(P.lettered_options(F.col("o"), on_more="keep")).first()[0].count("(") == 12
    assert df.select(P.lettered_options(F.col("o"), on_more="cut")).first()[0].count("(") == 10
    with pytest.raises(Exception, match="more than 10 options"):
        df.select(P.lettered_options(F.col("o"))).collect()


def test_left_over_tags_go(spark):
    df = spark.createDataFrame([("<bangla_translation>{} <translator_notes>x",)], "t string")
    assert df.select(X.strip_notes("t")).first()[0] == "{}"


def test_lines_are_numbered_in_the_order_of_file_numbers(spark):
    path = scratch_path(spark, "test-lines").removeprefix("file:")
    os.makedirs(path)
    for n in (99999, 100000, 2):
        with open(f"{path}/part-{n}.txt", "w") as f:
            f.write(f"a{n}\nb{n}\n")
    got = sorted((r.line_no, r.value) for r in FS.line_index(spark, path).collect())
    assert [v for _, v in got] == ["a2", "b2", "a99999", "b99999", "a100000", "b100000"]
    assert [n for n, _ in got] == list(range(6))


def test_no_text_below_a_checkpoint(spark):
    from polyeval.operators import ids as I
    df = spark.createDataFrame([(i, "x" * 10) for i in range(20)], "k long, text string")
    out = I.with_index(df, "pos", order_by=["k"], key=["k"])
    assert [r.pos for r in out.orderBy("k").collect()] == list(range(20))
    plan = out._jdf.queryExecution().analyzed().toString()
    scans = [x for x in plan.split("\n") if "LogicalRDD" in x]
    assert any("text" not in x for x in scans if "_mid" in x) and not any("text" in x for x in scans if "_mid" in x)


@pytest.mark.parametrize("name", ["import_result_tree", "last_value_wins", "first_file_per_dataset", "union_models",
                                  "repair_json", "prompt_choices_literal"])
def test_documents_are_scanned_once(spark, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, "/root/testdata/sf0.001")
    files = df._jdf.queryExecution().optimizedPlan().toString()
    assert files.count("Relation [doc_id") <= (2 if "quality" in files else 1), files


def test_named_layouts_conform(spark):
    from polyeval.sources import registry as REG
    df = spark.createDataFrame([("i", "a", "b", 1)], "instruction string, output_1 string, output_2 string, preference int")
    got = REG.conform(df, "alpaca_farm_human_annotations")
    assert got.columns[:4] == ["instruction", "output_1", "output_2", "preference"] and got.columns[-1] == "sample_mode"
    assert got.dtypes[3] == ("preference", "bigint") and got.first().generator is None
    assert len(REG.BBH_TASKS) == 26
    assert REG.conform(df, "bbh/snarks").columns == ["input", "target"]
