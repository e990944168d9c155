"""Edge rows of FIXTURES.md section 3, one check per operator."""

import pytest
from pyspark.sql import functions as F

from polyeval.functions import prompts as P
from polyeval.functions import text as X
from polyeval.operators import analysis as A
from polyeval.operators import ids as I
from polyeval.operators import names as N
from polyeval.operators import packing as PK
from polyeval.operators import repair as RP
from polyeval.operators import scoring as S
from polyeval.operators import tokens as TK


def one(spark, value, col, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(col.alias("y")).first()["y"]


def test_strip_reasoning(spark):
    assert one(spark, "<think>a\nb</think>  B", X.strip_reasoning(F.col("x"))) == "B"
    assert one(spark, "<think>a", X.strip_reasoning(F.col("x"))) == "<think>a"
    assert one(spark, " A\n", X.strip_reasoning(F.col("x"))) == "A"


def _rer(spark, rows):
    df = spark.createDataFrame(rows, "dataset string, lang string, prompt string, response string, ground_truth string")
    return [r["error"] for r in S.score_rows(df).select("error").collect()]


def test_rer_generic(spark):
    rows = [("openbookqa", "en", "Options:\nA: x", "", "A"), ("openbookqa", "en", "Q", "", "A"),
            ("openbookqa", "en", "Options:\nA: x", "AB", "A"), ("openbookqa", "en", "Options:\nA: x", "x", "A")]
    # prompt "Q" has no delimiter: options = whole prompt "Q" (non-empty) -> no error for ''
    assert _rer(spark, rows) == [False, False, True, False]
    assert _rer(spark, [("openbookqa", "en", "Options:", "", "A")]) == [True]


def test_accuracy_and_rer_rules(spark):
    df = spark.createDataFrame([
        ("boolq", "bn", "p", "সত্য", "True"),
        ("gsm8k", "en", "p", "<answer>1\n2</answer>", "1\n2"),
        ("gsm8k", "en", "p", "<answer>1,000</answer>", "1000"),
        ("winogrande", "en", "p", "a", "1"),
        ("hellaswag", "en", "p", "a", "0"),
    ], "dataset string, lang string, prompt string, response string, ground_truth string")
    r = S.score_rows(df).select("right", "error").collect()
    assert r[0]["right"] is True
    assert r[1]["right"] is False            # tag must be on one line
    assert r[2]["error"] is False            # 1,000 is a number after removing ','
    assert r[3]["error"] is True             # case-sensitive
    assert r[4]["error"] is False


def test_options_section_and_marker(spark):
    assert one(spark, " no delimiter ", X.options_section(F.col("x"), F.lit("en"))) == "no delimiter"
    assert one(spark, "x #### 5 #### 7", X.answer_after_marker(F.col("x"))) == "7"


def test_prompt_letters(spark):
    df = spark.createDataFrame([([0, 1, 1],), ([0, 0],)], "l array<int>")
    out = df.select(P.first_correct_letter(F.col("l")).alias("s"),
                    P.all_correct_letters(F.col("l")).alias("m")).collect()
    assert out[0]["s"] == "B" and out[0]["m"] == ["B", "C"]
    assert out[1]["s"] is None and out[1]["m"] is None
    bn = spark.createDataFrame([([1],)], "l array<int>").select(P.first_correct_letter(F.col("l"), "bangla")).first()[0]
    assert bn == "ক"


def test_question_id(spark):
    df = spark.createDataFrame([(0, None), (1, "q"), (2, None)], "idx long, qid string")
    out = I.question_ids(df, "qid", "idx", "question_id").orderBy("idx").select("question_id").collect()
    assert [r[0] for r in out] == ["1", "q", "2"]


def test_map_label_strict(spark):
    m = {"A": "ক", "B": "খ", "C": "গ", "D": "ঘ"}
    assert one(spark, "E", X.map_label(F.col("x"), m)) == "E"
    with pytest.raises(Exception):
        one(spark, "E", X.map_label(F.col("x"), m, strict=True))


def test_parse_result_name(spark):
    df = spark.createDataFrame([("r/gsm8k-main_qwen-x_llm_judge_accuracy.txt",),
                                ("r/bigbenchhard-date_understanding_translated_m_rer.txt",)], "path string")
    out = N.parse_result_name(df).select("dataset", "model", "metric").collect()
    assert tuple(out[0]) == ("gsm8k-main", "qwen-x", "llm_judge_accuracy")
    assert out[1]["dataset"] == "bigbenchhard-date"
    assert one(spark, out[1]["dataset"], N.rename(F.col("x"), N.DATASET_RENAMING)) is None


def test_model_size_and_suffix(spark):
    assert one(spark, "llama-3.1-70B", A.model_size("x"), "string") == 70000000
    assert one(spark, "x", A.model_size("x"), "string") is None
    df = spark.createDataFrame([("arc-easy-bn",)], "x string")
    assert tuple(df.select(*N.split_lang_suffix(F.col("x"))).first()) == ("arc-easy", "bn")


def test_parse_json_strict(spark):
    schema = "struct<a:bigint>"
    for bad in ["{'a':1}", '{"a":1,}', '{"a":1} x']:
        assert one(spark, bad, X.parse_json_strict(F.col("x"), schema)) is None
    assert one(spark, '{"a":1,"a":2}', X.parse_json_strict(F.col("x"), schema))["a"] == 2


def test_repair_r5(spark):
    assert one(spark, '{"label": 0}', RP.r5(F.col("x"))) == '{ "label": "0"}'


def test_ratios(spark):
    df = spark.createDataFrame([(300, 100), (301, 100)], "t int, o int")
    assert [r[0] for r in df.select(X.length_ratio_flag(F.col("t"), F.col("o"))).collect()] == [False, True]
    assert one(spark, "", X.ascii_flag(F.col("x"))) is False
    assert one(spark, "abc1234567", X.ascii_flag(F.col("x"))) is True   # exactly 0.3


def _pack(spark, sizes, max_bytes, max_rows, chunk=1 << 20):
    df = spark.createDataFrame(list(enumerate(sizes)), "k long, s long")
    out = PK.pack(df, "k", F.col("s"), max_bytes, max_rows, chunk).orderBy("k").select("file_no").collect()
    return [r[0] for r in out]


def test_pack_edges(spark):
    assert _pack(spark, [60, 60, 60], 100, 50) == [1, 2, 3]
    assert _pack(spark, [150], 100, 50) == [2]


def test_judge_accuracy(spark):
    df = spark.createDataFrame([("d", "Correct"), ("d", ""), ("d", "Incorrect"), ("d", None)], "g string, v string")
    assert S.judge_accuracy(df, ["g"], "v").first()["judge_accuracy"] == 0.25


def test_rank_with_null(spark):
    df = spark.createDataFrame([("m1", 1.0), ("m2", 1.0), ("m3", 0.5), ("m4", None)], "model string, score double") \
        .withColumn("lang", F.lit("en")).withColumn("dataset", F.lit("d")).withColumn("metric_type", F.lit("m"))
    out = {r["model"]: r["rank"] for r in A.rank_models(df).collect()}
    assert out == {"m1": 1, "m2": 1, "m3": 3}


def test_lang_std_and_corr(spark):
    df = spark.createDataFrame([("f", "en", 0.5), ("f", "en", 0.7)], "model_family string, lang string, score double")
    assert A.lang_std(df, ["model_family"]).first()["lang_std"] is None
    c = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert A.corr_matrix(c, "x", "y").first()["corr"] is None


def test_token_ratios(spark):
    df = spark.createDataFrame([(0, 10, 0, 0)], "t int, b int, w int, base int")
    r = TK.token_ratios(F.col("t"), F.col("b"), F.col("w"), F.col("base"))
    row = df.select(*[v.alias(k) for k, v in r.items()]).first()
    assert row["bytes_per_token"] == 0.0 and row["tokens_per_word"] == 0.0 and row["nsl"] == 0.0


def test_box_quartiles(spark):
    df = spark.createDataFrame([("g", float(v)) for v in [1, 2, 3, 10]], "k string, score double")
    row = A.box_summary(df, ["k"]).first()
    assert (row["q1"], row["median"], row["q3"]) == (1.75, 2.5, 4.75)
    assert row["outliers"] == 1 and row["whisker_high"] == 3.0


def test_response_csv_compat_na(spark):
    from polyeval.session import scratch_path
    from polyeval.sources import files as FS
    from polyeval.sources import sinks as SK
    rows = [(1, "d", "m", "s", "p", "NA", "None", 0), (2, "d", "m", "s", "p", "x", "null", 1)]
    df = spark.createDataFrame(rows, "question_id long, dataset string, model string, system_prompt string, "
                                     "prompt string, response string, ground_truth string, idx long")
    plain, compat = scratch_path(spark, "csv-plain"), scratch_path(spark, "csv-compat")
    SK.write_response_csv(df, plain)
    SK.write_response_csv(df, compat, compat_na=True)
    a = sorted((r["response"], r["ground_truth"]) for r in FS.read_response_csv(spark, plain).collect())
    b = sorted((r["response"], r["ground_truth"]) for r in FS.read_response_csv(spark, compat).collect())
    assert a == [("NA", "None"), ("x", "null")]
    assert b == [("", ""), ("x", "")]


def _render_choices_py(prefix, stem, labels, texts, header="Options:", sep=". "):
    out = prefix + f"{stem}\n{header}\n"
    for label, choice in zip(labels, texts):
        out += f"{label}{sep}{choice}\n"
    return out


def test_renderers_match_python_statement(spark):
    """Prompts are byte-identical to a direct Python statement of the rules."""
    from conftest import SF001
    from polyeval.plans.fixtures import table
    docs = table(spark, SF001, "documents").select("doc_id", "text").orderBy("doc_id").limit(50).collect()
    rows = []
    for d in docs:
        words = [w for w in d["text"].split(" ") if w != ""][1:5]
        rows.append((d["doc_id"], d["text"], words, ["A", "B", "C", "D"][:len(words)]))
    df = spark.createDataFrame(rows, "doc_id long, stem string, choices array<string>, labels array<string>")
    pre = P.mcq_template("en", 4)
    got = df.select("doc_id",
                    P.render_choices(F.lit(pre), F.col("stem"), F.col("labels"), F.col("choices"), "en", ". ").alias("a"),
                    P.render_choice_map(F.lit(pre), F.col("stem"), F.map_from_arrays("labels", "choices"), "en").alias("b"),
                    P.render_positional(F.lit(pre), F.col("stem"), F.col("choices"), "bn", "bangla").alias("c"),
                    P.render_passage(F.lit(P.BOOLQ_TEMPLATE["en"]), F.lit("Q?"), F.col("stem"), "en").alias("d")
                    ).orderBy("doc_id").collect()
    for (doc_id, stem, words, labels), g in zip(rows, got):
        assert g["a"] == _render_choices_py(pre, stem, labels, words)
        assert g["b"] == _render_choices_py(pre, stem, labels, words, sep=": ")
        bn = [chr(0x0995 + i) for i in range(len(words))]
        assert g["c"] == _render_choices_py(pre, stem, bn, words, header="বিকল্পসমূহ:", sep=": ")
        assert g["d"] == P.BOOLQ_TEMPLATE["en"] + "Q?\nPassage:\n" + stem + "\n"


def test_option_prefix_and_solution(spark):
    df = spark.createDataFrame([(["(A)  x", "(B) y", "no label", "(Z) z"],)], "o array<string>")
    assert df.select(X.map_option_prefix(F.col("o"))).first()[0] == ["(ক) x", "(খ) y", "no label", "(Z) z"]
    assert one(spark, "Answer : see A and B", X.map_solution_labels(F.col("x"))) == "উত্তর : see ক and খ"


def test_options_from_text(spark):
    got = one(spark, "Q\nOptions:\n(A) yes \n(B)  no", X.options_from_text(F.col("x")))
    assert got == ["(ক) yes", "(খ) no"]
    with pytest.raises(Exception):
        one(spark, "no section", X.options_from_text(F.col("x")))


def test_zip_to_map_last_wins_first_order(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["1", "2", "3"])], "k array<string>, v array<string>")
    m = df.select(F.map_entries(X.zip_to_map(F.col("k"), F.col("v")))).first()[0]
    assert [(e["key"], e["value"]) for e in m] == [("a", "3"), ("b", "2")]


def test_whitespace_forms(spark):
    s = ' {  "a" :  1 ,\n "b": [ 2 ] } '
    assert one(spark, s, X.normalize_whitespace(F.col("x"), "a")) == '{ "a" : 1 , "b": [ 2 ] }'
    assert one(spark, s, X.normalize_whitespace(F.col("x"), "b")) == '{"a": 1, "b": [ 2 ]}'
    assert one(spark, s, X.normalize_whitespace(F.col("x"), "c")) == '{"a":1,"b":[2]}'


def test_message_content_defaults(spark):
    schema = "struct<choices:array<struct<message:struct<content:string>>>>"
    df = spark.createDataFrame([('{"choices": []}',), ('{"choices": [{"message": {"content": "hi"}}]}',), ("{}",)],
                               "t string")
    got = [r[0] for r in df.select(X.message_content(F.from_json("t", schema))).collect()]
    assert got == ["", "hi", ""]


def test_patch_field_gaps(spark):
    schema = "struct<label:string,text:string,endings:array<string>>"
    got = one(spark, '{"label": , "text": "  t  "}',
              X.patch_field_gaps(F.col("x"), schema, text_fields=["text"], list_fields=["endings"]))
    assert got["label"] is None and got["text"] == "t" and got["endings"] == []


def test_combine_numbered_files_reports_bad(spark):
    from pyspark.sql import types as T
    from polyeval.session import scratch_path
    from polyeval.sources import files as FS
    from polyeval.sources import sinks as SK
    base = scratch_path(spark, "numbered-edge")
    files = spark.createDataFrame([("item_10.json", '{"k": 10}'), ("item_2.json", '{"k": 2}'),
                                   ("readme.json", '{"k": 0}'), ("bad_5.json", "{oops")], "path string, content string")
    SK.write_files(files, base, "path", "content")
    good, bad = FS.combine_numbered_files(spark, base, T.StructType([T.StructField("k", T.LongType())]))
    assert [r["k"] for r in good.orderBy("position").collect()] == [2, 10, 0]
    assert [r["file"] for r in bad.collect()] == ["bad_5.json"]


def test_normalize_model(spark):
    assert one(spark, "meta-llama-Llama-3.1-8B-Instruct-Turbo", N.normalize_model(F.col("x"))) == \
        "meta-llama-meta-llama-3.1-8b-instruct-turbo"
    assert one(spark, "Qwen-Qwen2.5-7B-Instruct-Turbo", N.normalize_model(F.col("x"))) == "qwen-qwen2.5-7b-instruct-turbo"
    assert one(spark, "Some-Model", N.normalize_model(F.col("x"))) == "some-model"


def test_classify_error_and_backoff(spark):
    from polyeval.operators import runner as RN
    df = spark.createDataFrame([("Rate Limit hit",), ("x status_code=abc y",), ("HTTP 429",), ("status_code=503 busy",)],
                               "e string")
    got = df.select(RN.is_rate_limit(F.col("e")), RN.status_code(F.col("e"))).collect()
    assert [tuple(r) for r in got] == [(True, None), (False, None), (True, None), (False, 503)]
    b = spark.range(1).select(RN.backoff(F.lit(10), F.lit(True), F.lit(1.2)).alias("a"),
                              RN.backoff(F.lit(1), F.lit(False), F.lit(0.8)).alias("b")).first()
    assert b["a"] == 60.0 and b["b"] == pytest.approx(1.6)


def test_learning_curve_auc(spark):
    import math
    df = spark.createDataFrame([(160, 0.5), (640, 0.6), (2558, 0.7)], "train_size int, accuracy double")
    x = [math.log2(s) for s in (160, 640, 2558)]
    y = [0.5, 0.6, 0.7]
    want = sum((x[i] - x[i - 1]) * (y[i] + y[i - 1]) / 2 for i in (1, 2)) / (x[-1] - x[0])
    assert A.learning_curve_auc(df).first()["auc"] == pytest.approx(want, abs=1e-9)


def test_slots_wait_with_fake_clock():
    from polyeval.operators.runner import SlotSchedule
    now = [0.0]
    waits = []

    def sleep(s):
        waits.append(s)
        now[0] += s
    b = SlotSchedule(60.0, clock=lambda: now[0], sleep=sleep)   # one call per second
    for _ in range(3):
        b.take()
    assert len(waits) == 2 and all(w == pytest.approx(1.0) for w in waits)


def test_log_line_matching_two_patterns(spark):
    df = spark.createDataFrame([(1, "ERROR:JSON decoding error at index 7 and Error processing index 9")],
                               "line_no long, line string")
    got = sorted((r["kind"], r["idx"]) for r in RP.log_error_index(df, dedupe=False).collect())
    assert got == [("error_processing", 9), ("json_decoding", 7)]


def test_ordered_concat_two_levels(spark):
    rows = [(k % 3, k, f"t{k};") for k in range(40)]
    df = spark.createDataFrame(rows, "g long, o long, t string").repartition(4)
    got = {r["g"]: r["s"] for r in I.ordered_concat(df, ["g"], "o", F.col("t"), "s", chunk=3).collect()}
    want = {g: "".join(t for gg, o, t in sorted(rows, key=lambda r: r[1]) if gg == g) for g in range(3)}
    assert got == want


def test_exact_quantiles_match_numpy(spark):
    import random as _r

    import numpy as np
    rng = _r.Random(7)
    rows = [(g, rng.random() * 10) for g in ("a", "b", "c") for _ in range(rng.randint(1, 60))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {(r["g"], r["p"]): r["q"] for r in A.exact_quantiles(df, ["g"], "v", [0.1, 0.25, 0.5, 0.9]).collect()}
    for g in ("a", "b", "c"):
        vals = [v for gg, v in rows if gg == g]
        for p in (0.1, 0.25, 0.5, 0.9):
            assert got[(g, p)] == pytest.approx(float(np.percentile(vals, p * 100)), abs=1e-9)


def test_running_count_across_chunks(spark):
    import random as _r
    rng = _r.Random(3)
    flags = [rng.random() < 0.4 for _ in range(100)]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(flags)], "idx long, f boolean").repartition(6)
    got = [r["c"] for r in I.running_count(df, "idx", F.col("f"), "c", chunk=7).orderBy("idx").collect()]
    want, s = [], 0
    for f in flags:
        s += int(f)
        want.append(s)
    assert got == want


def test_with_index_dense_in_order(spark):
    df = spark.createDataFrame([(k * 3 % 101,) for k in range(101)], "k long").repartition(7)
    rows = I.with_index(df, "pos", order_by=["k"]).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(101))
    assert [r["k"] for r in rows] == sorted(r["k"] for r in rows)


def test_template_registry_and_overrides(spark):
    t = P.template_table(spark, overrides={("boolq", "en"): ("sys", "inp")})
    items = spark.createDataFrame([("boolq", "en"), ("gsm8k-main", "bn"), ("unknown", "en")], "dataset string, lang string")
    got = {r["dataset"]: (r["system_prompt"], r["input_prompt"]) for r in P.with_templates(items, t).collect()}
    assert got["boolq"] == ("sys", "inp")
    assert got["gsm8k-main"] == (P.SYSTEM_GSM8K["bn"], P.GSM8K_TEMPLATE["bn"])
    assert got["unknown"] == (None, None)


def test_schema_registry_conform(spark):
    from polyeval.sources import registry as REG
    df = spark.createDataFrame([("1", "q", "x")], "id string, question string, extra string")
    out = REG.conform(df, "arc")
    assert out.columns == ["id", "question", "choices", "answerKey"]
    row = out.first()
    assert row["id"] == "1" and row["choices"] is None and row["answerKey"] is None
    with pytest.raises(KeyError):
        REG.conform(df, "no-such-dataset")


def test_validate_lengths_raises_and_pair_ids(spark):
    from polyeval.operators import joins as J
    a = spark.createDataFrame([(0, "x", None), (1, "y", "id1")], "idx long, t string, id string")
    b = spark.createDataFrame([(0, "u"), (1, "v")], "idx long, s string")
    assert J.validate_lengths(a, b).first()["equal"] is True
    with pytest.raises(Exception):
        J.validate_lengths(a, b.limit(1)).collect()
    got = {r["idx"]: (r["sample_id"], r["left_json"]) for r in J.pair_corpora(a, b, "idx", id_col="id").collect()}
    assert got == {0: ("0", '{"t":"x"}'), 1: ("id1", '{"t":"y"}')}


def test_small_column_rules(spark):
    df = spark.createDataFrame([("a", None, "c")], "x string, y string, z string")
    assert df.select(X.detection_text("x", "y", "z")).first()[0] == "a  c"
    assert one(spark, "tiny-350m", A.model_size("x")) == 350000
    row = spark.createDataFrame([("nodash",)], "x string").select(*N.split_lang_suffix(F.col("x"))).first()
    assert tuple(row) == ("", "")
    assert one(spark, "org/model-1", X.file_safe_name(F.col("x"))) == "org-model-1"
    assert one(spark, "<উত্তর>৩</উত্তর>", X.answer_tag(F.col("x"), F.lit("bn"))) == "৩"
    assert one(spark, "<answer>3</answer>", X.answer_tag(F.col("x"), F.lit("bn"))) is None
