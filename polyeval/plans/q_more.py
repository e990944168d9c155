"""Registered queries for the remaining inventory items (A11, B17 strict, B45,
B50, D6, D7, E16, F3, G5, H4 on imported scores, J5 through a pandas UDF, J8)."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from polyeval.functions import text as X
from polyeval.operators import analysis as A
from polyeval.operators import ids as I
from polyeval.operators import names as N
from polyeval.operators import scoring as S
from polyeval.operators import tokens as TK
from polyeval.plans import oracle as O
from polyeval.plans.catalog import register
from polyeval.plans.fixtures import fx_responses, fx_scores, table, with_views
from polyeval.plans.oracle import q
from polyeval.session import scratch_path
from polyeval.sources import files as FS
from polyeval.sources import registry as REG
from polyeval.sources import sinks as SK

# --- B45 adherence rate -------------------------------------------------------------------------------
register("adherence_rate", with_views(
    f"SELECT dataset, lang, model, 'rar' AS metric_type, 1 - rer AS score FROM ({O.score_table_sql()}) t",
    "fx_responses"))(
    lambda spark, sf: A.adherence(S.scores_long(fx_responses(spark, sf))).where(F.col("metric_type") == "rar")
    .select("dataset", "lang", "model", "metric_type", "score"))

# --- B50 rename, reorder, drop id keys, move a column behind another ---------------------------------------
register("rename_reorder_drop", with_views(
    "SELECT model AS \"Model Name\", dataset AS \"Dataset Name\", prompt AS \"Prompt\", ground_truth AS \"Ground Truth\", "
    "response AS \"Model Response\" FROM fx_responses", "fx_responses"))(
    lambda spark, sf: fx_responses(spark, sf).drop("question_id", "idx")
    .withColumnRenamed("model", "Model Name").withColumnRenamed("dataset", "Dataset Name")
    .select("Model Name", "Dataset Name", F.col("prompt").alias("Prompt"),
            F.col("ground_truth").alias("Ground Truth"), F.col("response").alias("Model Response")))


# --- D6 two files zipped by position, cut at the shorter ------------------------------------------------------
@register("zip_metrics", with_views(f"""SELECT a.position, a.c = b.ground_truth AS equal FROM
  (SELECT row_number() OVER (ORDER BY idx) - 1 AS position, {O.clean('response')} AS c FROM fx_responses) a
  JOIN (SELECT row_number() OVER (ORDER BY idx) - 1 AS position, ground_truth FROM fx_responses
        WHERE idx > (SELECT min(idx) FROM fx_responses)) b ON a.position = b.position""", "fx_responses"))
def q_zip_metrics(spark, sf):
    """Predictions of one file against the answers of another (here the
    answers without their first line), zipped by line position; the inner
    join on position cuts at the shorter file, as ``zip`` does."""
    r = fx_responses(spark, sf)
    preds = I.with_index(r.select("idx", X.strip_reasoning("response").alias("c")), "position", order_by=["idx"])
    # the answer file without its first line: positions shift by one
    gold = I.with_index(r.select("idx", "ground_truth"), "p", order_by=["idx"]) \
        .where(F.col("p") > 0).select((F.col("p") - 1).alias("position"), "ground_truth")
    return preds.join(gold, "position").select(
        "position", (F.col("c") == F.col("ground_truth")).alias("equal"))


# --- D7 lookup dictionaries as a (small, literal) broadcast join -------------------------------------------
@register("join_lookup", with_views(f"""SELECT dataset, {N.rename_sql('dataset', N.DATASET_RENAMING)} AS short_name,
  {N.rename_sql('dataset', A.CATEGORY_MAP)} AS category FROM (SELECT DISTINCT dataset FROM fx_scores) d""", "fx_scores"))
def q_join_lookup(spark, sf):
    rows = [(k, N.DATASET_RENAMING.get(k), A.CATEGORY_MAP.get(k)) for k in
            sorted(set(N.DATASET_RENAMING) | set(A.CATEGORY_MAP))]
    dim = spark.createDataFrame(rows, "dataset string, short_name string, category string")
    d = fx_scores(spark, sf).select("dataset").distinct()
    return d.join(F.broadcast(dim), "dataset", "left")   # literal dimension: fixed size


# --- E16 several files for one cell: the last path wins ----------------------------------------------------
register("last_value_wins", with_views(f"""SELECT {N.dataset_part_sql('path')} AS dataset, {N.raw_model_sql('path')} AS model,
  {N.metric_part_sql('path')} AS metric, arg_max(TRY_CAST({O.strip('content')} AS DOUBLE), path) AS score
FROM ({N.result_files_sql()}) f GROUP BY 1, 2, 3""", "fx_responses"))(
    lambda spark, sf: A.last_value_wins(
        N.fx_result_files(spark, sf).select(N.dataset_part(F.col("path")).alias("dataset"),
                                            N.raw_model(F.col("path")).alias("model"),
                                            N.metric_part(F.col("path")).alias("metric"), "path",
                                            X.py_strip(F.col("content")).try_cast("double").alias("score")),
        ["dataset", "model", "metric"], "score", "path"))

# --- F3 running count of null ids ---------------------------------------------------------------------------
register("running_ids", """SELECT doc_id AS idx, CAST(sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END)
  OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS null_ids_so_far
FROM documents d LEFT JOIN labels l USING (doc_id)""")(
    lambda spark, sf: I.running_count(
        I.with_index(table(spark, sf, "documents").select(F.col("doc_id").alias("idx"))
                     .join(table(spark, sf, "labels").select(F.col("doc_id").alias("idx"), "quality"), "idx", "left"),
                     "pos", order_by=["idx"], key=["idx"]),
        "pos", F.col("quality").isNull(), "null_ids_so_far").select("idx", "null_ids_so_far"))


# --- G5 seeded sample: 20 positions drawn with the standard generator seeded 42 ------------------------------
# the positions for the row counts of the given tables, written out
_PICKS = {40: [0, 1, 2, 5, 6, 7, 8, 14, 15, 16, 17, 19, 20, 27, 29, 31, 33, 37, 38, 39], 200: [6, 7, 8, 22, 23, 26, 28, 35, 55, 57, 59, 62, 70, 108, 139, 151, 163, 173, 188, 189]}
_PICK_SQL = " OR ".join(f"(n = {n} AND pos IN ({', '.join(map(str, p))}))" for n, p in _PICKS.items())


@register("seeded_sample", f"""SELECT pos, item_id FROM (
  SELECT row_number() OVER (ORDER BY item_id) - 1 AS pos, item_id, count(*) OVER () AS n FROM benchmark) x WHERE {_PICK_SQL}""")
def q_seeded_sample(spark, sf):
    """Same positions as ``random.seed(42); random.sample(range(n), 20)``:
    only the count reaches the driver; the 20 positions go back as a
    literal list (a semi join on positions)."""
    d = I.with_index(table(spark, sf, "benchmark").select("item_id", "text"), "pos", order_by=["item_id"], key=["item_id"])
    n = d.count()
    rng = random.Random(42)
    picks = rng.sample(range(n), min(20, n))
    return d.where(F.col("pos").isin(picks)).select("pos", "item_id")


# --- H4 leaderboard of imported scores on the fixed axes of the aggregator ------------------------------------
def _lb_sql():
    cols = ", ".join(f"max(CASE WHEN dataset = {q(d)} THEN score END) AS {O.q(d).replace(chr(39), chr(34))}"
                     for d in N.DATASET_ORDER)
    models = ", ".join(f"({i}, {q(m)})" for i, m in enumerate(N.MODEL_ORDER))
    return f"""SELECT f.lang, f.metric_type, m.model_ordinal, m.model, {", ".join('w.' + chr(34) + d + chr(34) for d in N.DATASET_ORDER)}
FROM (SELECT DISTINCT lang, metric_type FROM imp) f CROSS JOIN (VALUES {models}) m(model_ordinal, model)
LEFT JOIN (SELECT lang, metric_type, model, {cols} FROM imp GROUP BY lang, metric_type, model) w
  ON w.lang = f.lang AND w.metric_type = f.metric_type AND w.model = m.model"""


register("leaderboard_import", with_views(f"WITH imp AS ({N.import_sql()}) {_lb_sql()}", "fx_responses"))(
    lambda spark, sf: A.leaderboard(N.import_scores(N.fx_result_files(spark, sf)), N.MODEL_ORDER, N.DATASET_ORDER))


# --- J5 user tokenizer through one pandas UDF ----------------------------------------------------------------
def _bytes4(t):
    return (len(t.encode("utf-8")) + 3) // 4


def _words(t):
    return len(t.split())


@register("count_tokens_udf", """SELECT doc_id, CAST((strlen(text) + 3) // 4 AS INTEGER) AS bytes4,
  CAST(len(list_filter(regexp_split_to_array(text, '""" + X.WS_CLASS + """+'), lambda w: w <> '')) AS INTEGER) AS words
FROM documents""")
def q_count_tokens_udf(spark, sf):
    udf = TK.count_tokens_udf({"bytes4": _bytes4, "words": _words})
    return table(spark, sf, "documents").select("doc_id", udf(F.col("text")).alias("t")).select("doc_id", "t.*")


# --- J8 a user-registered dataset goes through the same plan ----------------------------------------------------
@register("register_dataset", """SELECT item_id, 'Q: ' || text || chr(10) AS prompt, CAST(item_id % 2 AS VARCHAR) AS ground_truth
FROM benchmark""")
def q_register_dataset(spark, sf):
    REG.register_dataset(REG.DatasetSpec(
        name="benchmark_items", schema="struct<item_id:bigint,text:string>",
        prompt=lambda lang: F.concat(F.lit("Q: "), F.col("text"), F.lit("\n")),
        truth=lambda: (F.col("item_id") % 2).cast("string")))
    b = REG.conform(table(spark, sf, "benchmark"), "benchmark_items")
    return REG.render(b, "benchmark_items", "en").select("item_id", "prompt", "ground_truth")


# --- A11 response CSV: every row under the header in the reference's column order ------------------------------
@register("sink_response_csv", with_views(f"""SELECT {q(','.join(FS.RESPONSE_CSV_COLUMNS))} AS header,
  CAST(question_id AS VARCHAR) AS question_id, dataset, model, md5(system_prompt) AS system_md5, md5(prompt) AS prompt_md5,
  md5(response) AS response_md5, ground_truth FROM fx_responses""", "fx_responses"))
def q_sink_csv(spark, sf):
    path = scratch_path(spark, "responses-csv-header")
    SK.write_response_csv(fx_responses(spark, sf), path, "idx")
    heads = spark.read.text(path, wholetext=True).select(
        F.regexp_replace(F.substring_index("value", "\n", 1), '"', "").alias("header"),
        F.col("_metadata.file_name").alias("f"))
    rows = FS.read_response_csv(spark, path, with_file=True)
    return rows.join(heads, "f").select("header", "question_id", "dataset", "model", F.md5("system_prompt").alias("system_md5"),
                                        F.md5("prompt").alias("prompt_md5"), F.md5("response").alias("response_md5"), "ground_truth")


# --- Item -> prompt -> model -> score, end to end ----------------------------------------------
class LetterModel:
    """Stand-in model: answers with the option letter picked by the prompt's
    length (Bangla letters when the prompt has the Bangla options header)."""

    def __call__(self, prompt):
        letters = "কখগঘ" if "বিকল্পসমূহ:" in prompt else "ABCD"
        return letters[len(prompt) % 4]


def _evaluate_items(spark, sf):
    from polyeval.functions import prompts as P
    from polyeval.operators import runner as RN
    from polyeval.plans.q_prompts import by_lang, fx_items, prefix
    items = fx_items(spark, sf)
    prompts = items.select("doc_id", "lang", by_lang(lambda lg: P.render_choices(
        prefix(lg), F.col("stem"), F.col("labels"), F.col("choices"), lg, ". ")).alias("prompt"),
        F.col("answer_key").alias("ground_truth"))
    runs = RN.batch_infer(prompts, LetterModel(), ["prompt"], "doc_id", sleep=lambda s: None)
    responses = runs.select("lang", "prompt", "response", "ground_truth", F.lit("openbookqa").alias("dataset"))
    return S.score_table(responses, ("dataset", "lang"))


def _evaluate_items_sql():
    from polyeval.plans.q_prompts import _b1_sql
    body = _b1_sql(". ", False)          # WITH fx_items AS (...) SELECT doc_id, prompt, answer_key FROM fx_items
    head, tail = body.rsplit("SELECT doc_id, ", 1)   # the outer select of the item prompts
    with_lang = head + "SELECT doc_id, lang, " + tail
    resp = (f"SELECT 'openbookqa' AS dataset, lang, prompt, answer_key AS ground_truth, "
            f"CASE WHEN contains(prompt, 'বিকল্পসমূহ:') THEN substr('কখগঘ', CAST(length(prompt) % 4 AS INTEGER) + 1, 1) "
            f"ELSE substr('ABCD', CAST(length(prompt) % 4 AS INTEGER) + 1, 1) END AS response FROM ({with_lang}) p")
    scored = (f"SELECT s.*, {O.right('s.clean_response', 's.ground_truth', 's.v', 's.lang')} AS r, "
              f"{O.error('s.clean_response', 's.options', 's.v', 's.lang')} AS e FROM ("
              f"SELECT f.*, {O.clean('f.response')} AS clean_response, {O.options('f.prompt', 'f.lang')} AS options, "
              f"{O.variant('f.dataset', 'f.lang')} AS v FROM ({resp}) f) s")
    return (f"SELECT dataset, lang, CAST(sum(CAST(r AS BIGINT)) AS BIGINT) AS \"right\", "
            f"CAST(sum(CAST(e AS BIGINT)) AS BIGINT) AS errors, count(*) AS \"rows\", "
            f"CAST(sum(CAST(r AS BIGINT)) AS DOUBLE) / count(*) AS accuracy, "
            f"CAST(sum(CAST(e AS BIGINT)) AS DOUBLE) / count(*) AS rer FROM ({scored}) x GROUP BY dataset, lang")


register("evaluate_items", _evaluate_items_sql())(_evaluate_items)


# --- B35 with a user detector run as one pandas UDF (here a Python restatement of the built-in rule) ----------
def _python_detector(text):
    import regex
    from polyeval.functions.text import STOPWORDS
    words = regex.split(r"[^\p{L}]+", text.lower())
    counts = {lang: sum(1 for w in words if w in set(sw)) for lang, sw in STOPWORDS.items()}
    best = max(counts.values())
    return next(lang for lang, c in counts.items() if c == best) if best > 0 else "und"


def _detect_udf(spark, sf):
    from polyeval.functions.pyudfs import language_detector
    detect = language_detector(_python_detector)
    return table(spark, sf, "documents").select("doc_id", "lang", detect(F.col("text")).alias("detected"))


def _detect_sql():
    from polyeval.plans.q_text import _detect_sql as d
    return f"SELECT doc_id, lang, {d('text')} AS detected FROM documents"


register("detect_language_udf", _detect_sql())(_detect_udf)


# --- H4 sink: the leaderboard written per (lang, metric) and read back ---------------------------------------
from polyeval.plans.q_analysis import _lb_sql_text  # noqa: E402


@register("sink_leaderboard", with_views(
    """SELECT lang, metric_type, model AS "Model", openbookqa, commonsenseqa, boolq, "gsm8k-main", winogrande, hellaswag
FROM (""" + _lb_sql_text + """) b""", "fx_scores"))
def q_sink_leaderboard(spark, sf):
    from polyeval.plans.q_analysis import DATASETS, MODELS
    path = scratch_path(spark, "leaderboard")
    SK.write_leaderboard(A.leaderboard(fx_scores(spark, sf), MODELS, DATASETS), path)
    back = spark.read.option("header", True).csv(path)
    return back.select("lang", "metric_type", "Model",
                       *[F.col(f"`{d}`").try_cast("double").alias(d) for d in DATASETS])
