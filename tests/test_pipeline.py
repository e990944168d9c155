"""Fixture totals, properties, plan shape and a DuckDB oracle sweep."""

import json
import os
import random
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from polyeval.functions import text as X
from polyeval.operators import joins as J
from polyeval.operators import packing as PK
from polyeval.operators import scoring as S
from polyeval.operators import tokens as TK
from polyeval.plans.fixtures import TABLES, fx_responses, table

from conftest import SF001, SF01

# Reference totals of FIXTURES.md (fx_responses at sf0.01, summed over models)
EXPECTED = {
    ("boolq", "bn"): (33, 23, 75), ("boolq", "en"): (45, 24, 92),
    ("cqsa", "bn"): (30, 15, 65), ("cqsa", "en"): (50, 23, 102),
    ("gsm8k", "bn"): (29, 14, 60), ("gsm8k", "en"): (48, 28, 107),
    ("hellaswag", "bn"): (28, 15, 58), ("hellaswag", "en"): (47, 38, 108),
    ("openbookqa", "bn"): (35, 7, 66), ("openbookqa", "en"): (46, 18, 100),
    ("winogrande", "bn"): (29, 14, 56), ("winogrande", "en"): (51, 20, 111),
}


def test_fixture_totals(spark):
    t = S.score_table(fx_responses(spark, SF01), ("dataset", "lang"))
    got = {(r["dataset"], r["lang"]): (r["right"], r["errors"], r["rows"]) for r in t.collect()}
    assert got == EXPECTED


def test_accuracy_independent_of_partitions(spark):
    r = fx_responses(spark, SF01)
    a = sorted(S.score_table(r).collect())
    b = sorted(S.score_table(r.repartition(13)).collect())
    c = sorted(S.score_table(r.orderBy(F.rand(7))).collect())
    assert a == b == c


def test_upsert_empty_is_identity(spark):
    d = table(spark, SF001, "documents").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    empty = d.limit(0)
    merged, unmatched = J.upsert_by_index(d, empty, "doc_id", ["quality", "toxic"], order="doc_id")
    assert sorted(merged.drop("updated").collect()) == sorted(d.collect())
    assert unmatched.count() == 0


def test_digits_round_trip(spark):
    df = table(spark, SF001, "documents").select(F.col("doc_id").cast("string").alias("x"))
    back = df.select(X.transliterate_digits(X.transliterate_digits(F.col("x"), "bangla"), "latin").alias("y"), "x")
    assert back.where(F.col("x") != F.col("y")).count() == 0


def _pack_ref(sizes, max_bytes, max_rows):
    """The sequential fold, written out for comparison."""
    out, f, b, k = [], 1, 0, 0
    for s in sizes:
        if b + s > max_bytes or k >= max_rows:
            f, b, k = f + 1, 0, 0
        b, k = b + s, k + 1
        out.append(f)
    return out


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=120), min_size=1, max_size=60),
       st.integers(min_value=50, max_value=300), st.integers(min_value=1, max_value=7),
       st.integers(min_value=1, max_value=16))
def test_pack_matches_fold(spark, sizes, max_bytes, max_rows, chunk):
    df = spark.createDataFrame(list(enumerate(sizes)), "k long, s long")
    got = [r[0] for r in PK.pack(df, "k", F.col("s"), max_bytes, max_rows, chunk)
           .orderBy("k").select("file_no").collect()]
    assert got == _pack_ref(sizes, max_bytes, max_rows)


def test_member_values_are_encoded(spark):
    from polyeval.operators import repair as RP

    def encoded(texts, kind, encode):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        return [r["o"] for r in df.select("i", RP.encode_members(F.col("t"), kind, encode).alias("o")).orderBy("i").collect()]
    objects = [{"a": "x \"y\" z", "b": "ক\nখ"}, {"question": "plain", "answer": "A"}, {"question": "ab\n\\ \"" * 20_000, "answer": "A"}]
    texts = [json.dumps(o, ensure_ascii=False) for o in objects]
    assert [json.loads(t) for t in encoded(texts, "text", RP.bare_quotes)] == objects
    assert encoded(['{"a": "x\\y"}', None, "", "no member"], "text", RP.json_text) == ['{"a": "x\\\\y"}', None, "", "no member"]
    assert encoded(['{"a": "say "hi" now", "b": "1\n2"}'], "text", RP.bare_quotes) == ['{"a": "say \\"hi\\" now", "b": "1\\n2"}']
    # only the text pattern lets an escaped quote stand before a comma
    text = '{"a": "he said \\"hi\\", then left"}'
    assert encoded([text], "text", RP.json_text) == ['{"a": "he said \\\\\\"hi\\\\\\", then left"}']
    assert encoded([text], "task", RP.json_text) == ['{"a": "he said \\\\\\"hi\\\\", then left"}']


def test_repair_runs_without_python(spark):
    for name in ("repair_json", "repair_json_sentences", "repair_json_tasks", "repair_json_maths", "repair_json_labels"):
        assert "EvalPython" not in E.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()


def test_maths_rules(spark):
    from polyeval.operators import repair as RP
    cases = {'("1 2")': "(1 2)", "$x$'": "$x$", '"7"': "7", '"%"': "%", '"a"': "a", '"$x+1$"': "$x+1$"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.u for r in df.select("t", RP.r9(F.col("t")).alias("u")).collect()} == cases


def test_repair_profiles_of_data_sets(spark):
    from polyeval.operators import repair as RP
    schema = "struct<query:string,response:string>"
    rows = [("mr-gsm8k-training", "{\"query\": \"it's\" \"response\": \"say \"x\",}", None),
            ("mr-gsm8k-training", '{"query": "a", }, "response": “b”}', ("a", "b"))]
    df = spark.createDataFrame(rows, "d string, t string, want struct<q:string,r:string>")
    got = RP.repair_dataset(df, "t", schema, "mr-gsm8k-training").collect()
    assert [None if r.parsed is None else tuple(r.parsed) for r in got][1:] == [("a", "b")]
    assert {f for f, _, _ in RP.DATASET_PROFILES.values()} == {"Q", "S", "T"} and len(RP.DATASET_PROFILES) == 19


def test_topk_plan_has_group_limit(spark):
    from polyeval.operators import analysis as A
    from polyeval.plans.fixtures import fx_scores
    plan = A.topk_models(fx_scores(spark, SF001), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_token_udf_is_one_python_stage(spark):
    d = table(spark, SF001, "documents")
    udf = TK.count_tokens_udf({"a": len, "b": lambda t: len(t.split())})
    plan = d.select(udf(F.col("text")).alias("t"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_scan_prunes_and_pushes(spark):
    d = table(spark, SF001, "documents").where(F.col("lang") == "en").select("doc_id")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:4] == ["lang", "metric_type", "model_ordinal", "model"]


def test_queries_import_without_session():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 150


SWEEP = os.environ.get("POLYEVAL_FULL_SWEEP") == "1"
# a representative subset runs by default; POLYEVAL_FULL_SWEEP=1 runs all keys
SUBSET = ["leaderboard", "score_table", "rank_models", "box_summary", "token_stats", "greedy_pack_chunked",
          "import_result_tree", "normalize_whitespace", "option_lines", "prompt_choices_literal",
          "log_error_index", "batch_infer", "question_id", "join_scores_tokens", "mean_by_sets"]


def _norm(v):
    if v is None:
        return "<null>"
    if isinstance(v, float):
        return f"{round(v, 9):.9f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()) if SWEEP else SUBSET)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    df = E.queries()[name](spark, SF01)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    order = [dcols.index(c) for c in cols]
    want = sorted(tuple(_norm(r[i]) for i in order) for r in res.fetchall())
    assert got == want


def test_seeded_sample_positions(spark):
    n = table(spark, SF01, "benchmark").count()
    rng = random.Random(42)
    want = sorted(rng.sample(range(n), min(20, n)))
    got = sorted(r["pos"] for r in E.queries()["seeded_sample"](spark, SF01).collect())
    assert got == want


def test_distributed_rank_equals_window_rank(spark):
    from polyeval.operators import analysis as A
    rows = [("a", float(v % 7)) for v in range(200)] + [("b", float(v % 3)) for v in range(31)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, score double").repartition(5)
    w = sorted((r["g"], r["score"], r["rank"]) for r in A.rank_models(df, ["g"]).collect())
    d = sorted((r["g"], r["score"], r["rank"]) for r in A.rank_desc_distributed(df, ["g"]).collect())
    assert w == d


def test_token_join_broadcast_at_runtime(spark):
    """Scores and token measures come from one pass over the documents; of their sums, a few
    rows, the token table is measured at run time and broadcast."""
    df = E.queries()["join_scores_tokens"](spark, SF001)
    assert df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "FileScan" not in plan


def test_valid_json_unchanged_by_attempt_chain(spark):
    from polyeval.operators import repair as RP
    rows = [(i, json.dumps({"question": f"q {i} \"x\"", "answer": "ক"}, ensure_ascii=False)) for i in range(20)]
    df = spark.createDataFrame(rows, "idx long, t string")
    out = RP.repair_attempts(df, "t", "struct<question:string,answer:string>", ["question", "answer"]).collect()
    assert {r["status"] for r in out} == {"parsed"}
    assert sorted((r["idx"], r["parsed"]["question"]) for r in out) == [(i, f'q {i} "x"') for i in range(20)]


def test_line_index_across_many_splits(spark):
    import glob
    from polyeval.session import scratch_path
    from polyeval.sources import files as FS
    path = scratch_path(spark, "split-lines")
    table(spark, SF01, "documents").orderBy("doc_id").select("text").coalesce(2).write.mode("overwrite").text(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32768")
    try:
        got = [r["value"] for r in FS.line_index(spark, path).orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = []
    for f in sorted(glob.glob(os.path.join(path.replace("file:", ""), "part-*"))):
        with open(f, encoding="utf-8") as fh:
            want.extend(line.rstrip("\n") for line in fh)
    assert got == want


def test_retry_calls_model_once_per_row_and_pass(spark):
    """The first pass is materialised before it feeds two branches."""
    from polyeval.operators import runner as RN
    from polyeval.session import scratch_path
    log = scratch_path(spark, "calls")
    os.makedirs(log.replace("file:", ""), exist_ok=True)

    def model(text, temperature=0.0):
        with open(os.path.join(log.replace("file:", ""), f"{os.getpid()}-{os.urandom(4).hex()}"), "w") as f:
            f.write(text)
        return None if int(text) % 3 == 0 and temperature == 0.0 else "ok"

    df = spark.createDataFrame([(i, str(i)) for i in range(30)], "k long, req string")
    first = RN.translate(df, lambda r: model(r), "req", "k", sleep=lambda s: None, partitions=3)
    out = RN.retry_translate(first, F.col("message").isNull(), model, "req", "k",
                             sleep=lambda s: None, partitions=3)
    rows = out.collect()                      # one action
    assert len(rows) == 30 and all(r["message"] == "ok" for r in rows)
    assert len(os.listdir(log.replace("file:", ""))) == 30 + 10


def test_leaderboard_reads_documents_once(spark):
    """One aggregation; the fixed model axis is exploded against it, so the
    documents are scanned once (no self-join of the scores)."""
    df = E.queries()["leaderboard"](spark, SF001)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[doc_id#\d+L,text", plan)) == 1


def test_stream_scores_restart_is_idempotent(spark):
    from polyeval.session import scratch_path
    from polyeval.streaming import responses as ST
    incoming, table_path, ck = (scratch_path(spark, n) for n in ("in", "scores", "ck"))
    r = fx_responses(spark, SF001).select(*[f.name for f in ST.RESPONSE_SCHEMA.fields])
    r.repartition(3).write.mode("append").json(incoming)
    ST.stream_scores(spark, incoming, table_path, ck, files_per_trigger=1)
    first = sorted(tuple(x) for x in ST.score_view(spark, table_path).collect())
    ST.stream_scores(spark, incoming, table_path, ck, files_per_trigger=1)   # restart, nothing new
    again = sorted(tuple(x) for x in ST.score_view(spark, table_path).collect())
    batch = sorted(tuple(x) for x in S.score_table(fx_responses(spark, SF001)).collect())
    assert first == again == batch


def test_batch_sink_one_file_per_batch(spark):
    import glob
    from polyeval.session import scratch_path
    d = table(spark, SF001, "documents").select("doc_id", "text")
    packed = PK.pack(d, "doc_id", F.octet_length("text") + 1, 20_000, 7, chunk_rows=16)
    path = scratch_path(spark, "batches-edge")
    PK.write_batches(packed, path)
    folders = glob.glob(os.path.join(path.replace("file:", ""), "file_no=*"))
    assert folders and all(len(glob.glob(os.path.join(f, "part-*"))) == 1 for f in folders)
    back = spark.read.schema("doc_id bigint, text string, file_no bigint").json(path)
    sizes = back.groupBy("file_no").agg(F.count(F.lit(1)).alias("n"),
                                        F.sum(F.octet_length("text") + 1).alias("b")).collect()
    assert all(r["n"] <= 7 and (r["b"] <= 20_000 or r["n"] == 1) for r in sizes)
