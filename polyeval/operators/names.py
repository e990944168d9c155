"""Importer for existing result trees: names, lookups and metric files.

A result tree holds one small text file per (language folder, dataset,
model, metric) with the score inside. The engine's own scores never take
this detour; it exists so that published trees can be read (A5, B39-B49,
E16). Each Column rule has a DuckDB twin (``*_sql``) for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyeval.functions.text import py_strip
from polyeval.operators import analysis as A

# ---------------------------------------------------------------------------
# The aggregator's renames and display order
# ---------------------------------------------------------------------------
DATASET_RENAMING = {
    "openbookqa": "OBQA",
    "arc-easy": "ARC-E",
    "arc-challenge": "ARC-C",
    "commonsenseqa": "CSQA",
    "boolq": "BoolQ",
    "gsm8k-main": "GSM8K-M",
    "truthfulqa": "TruthfulQA",
    "winogrande": "Winogrande",
    "hellaswag": "HellaSwag",
    "mmlu": "MMLU",
    "bigbenchhard-date_understanding_translated": "Date",
    "bigbenchhard-disambiguation_qa_translated": "DQA",
    "bigbenchhard-geometric_shapes_translated": "GS",
    "bigbenchhard-hyperbaton_translated": "HB",
    "bigbenchhard-logical_deduction_three_objects_translated": "L-3",
    "bigbenchhard-logical_deduction_five_objects_translated": "L-5",
    "bigbenchhard-logical_deduction_seven_objects_translated": "L-7",
    "bigbenchhard-movie_recommendation_translated": "Movie",
    "bigbenchhard-penguins_in_a_table_translated": "Peng.",
    "bigbenchhard-reasoning_about_colored_objects_translated": "Reason",
    "bigbenchhard-ruin_names_translated": "RN",
    "bigbenchhard-salient_translation_error_detection_translated": "SL",
    "bigbenchhard-snarks_translated": "SN",
    "bigbenchhard-temporal_sequences_translated": "Temp.",
    "bigbenchhard-tracking_shuffled_objects_three_objects": "T-3",
    "bigbenchhard-tracking_shuffled_objects_five_objects": "T-5",
    "bigbenchhard-tracking_shuffled_objects_seven_objects": "T-7",
}
MODEL_RENAMING = {
    "meta-llama-meta-llama-3.1-8b-instruct-turbo": "llama3.1:8b",
    "meta-llama-meta-llama-3.1-70b-instruct-turbo": "llama3.1:70b",
    "meta-llama-llama-3.2-3b-instruct-turbo": "llama3.2:3b",
    "meta-llama-llama-3.3-70b-instruct-turbo": "llama3.3:70b",
    "deepseek-ai-deepseek-r1-distill-qwen-14b": "deepseek-r1:14b",
    "deepseek-ai-deepseek-r1-distill-llama-70b": "deepseek-r1:70b",
    "qwen-qwen2.5-7b-instruct-turbo": "qwen2.5:7b",
    "qwen-qwen2.5-72b-instruct-turbo": "qwen2.5:72b",
    "mistralai-mistral-7b-instruct-v0.3": "mistral:7b",
    "mistralai-mistral-small-24b-instruct-2501": "mistral:24b",
}
MODEL_ORDER = ["llama3.1:8b", "llama3.1:70b", "llama3.2:3b", "llama3.3:70b", "qwen2.5:7b",
               "qwen2.5:72b", "mistral:7b", "mistral:24b", "deepseek-r1:14b", "deepseek-r1:70b"]
DATASET_ORDER = ["OBQA", "CSQA", "ARC-E", "ARC-C", "BoolQ", "GSM8K-M", "Winogrande", "HellaSwag", "MMLU"]
METRIC_TYPES = {"accuracy": "accuracy", "rer": "rer", "llm_judge_accuracy": "llm_eval"}
# first hit wins when the scorer guesses the dataset from a file name
FILENAME_DATASETS = [("boolq", "boolq"), ("gsm8k", "gsm8k"), ("commonsenseqa", "cqsa"),
                     ("winogrande", "winogrande"), ("hellaswag", "hellaswag")]
NAME_PATTERN = r"^(.*?)_(.*?)_([^_]+(?:_[^_]+)*)\.txt$"
LLAMA_SHORT, LLAMA_LONG = "meta-llama-llama", "meta-llama-meta-llama"

# Raw model names under which the fixture models are written as result files.
FIXTURE_RAW_MODELS = {"model-0": "meta-llama-Llama-3.1-8B-Instruct-Turbo",
                      "model-1": "Qwen-Qwen2.5-72B-Instruct-Turbo",
                      "model-2": "mistralai-Mistral-7B-Instruct-v0.3",
                      "model-3": "deepseek-ai-DeepSeek-R1-Distill-Llama-70B"}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(mapping: dict, x: str, default: str = "NULL") -> str:
    return f"(CASE {x} {' '.join(f'WHEN {q(k)} THEN {q(v)}' for k, v in mapping.items())} ELSE {default} END)"


# ---------------------------------------------------------------------------
# path pieces
# ---------------------------------------------------------------------------
def file_name(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*/", "")


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


def folder_sql(p: str) -> str:
    return f"regexp_extract({p}, '([^/]*)/[^/]*$', 1)"


def file_sql(p: str) -> str:
    return f"regexp_replace({p}, '^.*/', '')"


def _part(path: Column, i: int) -> Column:
    return F.try_element_at(F.split(file_name(path), "_"), F.lit(i))


def dataset_part(path: Column) -> Column:
    return _part(path, 1)


def raw_model(path: Column) -> Column:
    return _part(path, 2)


def metric_part(path: Column) -> Column:
    return F.try_element_at(F.split(_part(path, 3), r"\."), F.lit(1))


def dataset_part_sql(p: str) -> str:
    return f"string_split({file_sql(p)}, '_')[1]"


def raw_model_sql(p: str) -> str:
    return f"string_split({file_sql(p)}, '_')[2]"


def metric_part_sql(p: str) -> str:
    return f"string_split(string_split({file_sql(p)}, '_')[3], '.')[1]"


# ---------------------------------------------------------------------------
# B39 parse_result_name, B40 split_path_columns
# ---------------------------------------------------------------------------
def parse_result_name(df: DataFrame, path: str = "path") -> DataFrame:
    """``dataset_model_metric.txt``; names that do not match are dropped."""
    f = file_name(F.col(path))
    return (df.where(f.rlike(NAME_PATTERN))
              .withColumn("dataset", F.regexp_extract(f, NAME_PATTERN, 1))
              .withColumn("model", F.regexp_extract(f, NAME_PATTERN, 2))
              .withColumn("metric", F.regexp_extract(f, NAME_PATTERN, 3)))


def parse_name_sql(p: str) -> str:
    f = file_sql(p)
    return ", ".join(f"regexp_extract({f}, {q(NAME_PATTERN)}, {i}) AS {n}"
                     for i, n in [(1, "dataset"), (2, "model"), (3, "metric")])


def split_path_columns(df: DataFrame, path: str = "path") -> DataFrame:
    """lang = last ``-`` part of the folder; dataset, model, metric =
    ``_`` parts of the file; family = first ``-`` part of the model."""
    p = F.col(path)
    lang = F.element_at(F.split(folder(p), "-"), -1)
    return (df.withColumn("lang", lang).withColumn("dataset", dataset_part(p))
              .withColumn("model", raw_model(p)).withColumn("metric", metric_part(p))
              .withColumn("model_family", F.substring_index(raw_model(p), "-", 1)))


def split_path_sql(p: str) -> str:
    return (f"string_split({folder_sql(p)}, '-')[-1] AS lang, {dataset_part_sql(p)} AS dataset, "
            f"{raw_model_sql(p)} AS model, {metric_part_sql(p)} AS metric, "
            f"split_part({raw_model_sql(p)}, '-', 1) AS model_family")


# ---------------------------------------------------------------------------
# B41-B49
# ---------------------------------------------------------------------------
def normalize_model(m: Column) -> Column:
    """Lower case; unknown 3.1-8b / 3.1-70b names get the doubled vendor
    prefix (first occurrence only) when that makes them known."""
    norm = F.lower(m)
    known = F.array(*[F.lit(k) for k in MODEL_RENAMING])
    at = F.locate(LLAMA_SHORT, norm)
    alt = F.when(at > 0, F.concat(norm.substr(F.lit(1), at - 1), F.lit(LLAMA_LONG),
                                  norm.substr(at + len(LLAMA_SHORT), F.lit(1 << 30)))).otherwise(norm)
    fixable = (~F.array_contains(known, norm)) & (norm.contains("3.1-8b") | norm.contains("3.1-70b")) \
        & F.array_contains(known, alt)
    return F.when(fixable, alt).otherwise(norm)


def normalize_model_sql(m: str) -> str:
    norm = f"lower({m})"
    known = "[" + ", ".join(q(k) for k in MODEL_RENAMING) + "]"
    at = f"strpos({norm}, {q(LLAMA_SHORT)})"
    alt = (f"(CASE WHEN {at} > 0 THEN substr({norm}, 1, {at} - 1) || {q(LLAMA_LONG)} || "
           f"substr({norm}, {at} + {len(LLAMA_SHORT)}) ELSE {norm} END)")
    return (f"(CASE WHEN NOT list_contains({known}, {norm}) AND (contains({norm}, '3.1-8b') OR "
            f"contains({norm}, '3.1-70b')) AND list_contains({known}, {alt}) THEN {alt} ELSE {norm} END)")


def rename(x: Column, mapping: dict) -> Column:
    """Lookup; unknown gives null (the caller drops, keeps or reports)."""
    return F.try_element_at(A.map_lit(mapping), x)


def rename_sql(x: str, mapping: dict) -> str:
    return _case(mapping, x)


def metric_type(m: Column) -> Column:
    """Accuracy / rer / llm_judge_accuracy -> llm_eval; else null."""
    return F.try_element_at(A.map_lit(METRIC_TYPES), m)


def metric_type_sql(m: str) -> str:
    return _case(METRIC_TYPES, m)


def model_size(m: Column) -> Column:
    return A.model_size(m)


def model_size_sql(m: str) -> str:
    up = f"upper({m})"
    return (f"CASE WHEN regexp_matches({up}, '(\\d+)(B|M)') THEN "
            f"CAST(regexp_extract({up}, '(\\d+)(B|M)', 1) AS BIGINT) * "
            f"(CASE WHEN regexp_extract({up}, '(\\d+)(B|M)', 2) = 'M' THEN 1000 ELSE 1000000 END) END")


def split_lang_suffix(name: Column) -> list[Column]:
    """``name-lang`` cut at the last ``-``."""
    pat = r"^(.*)-([^-]*)$"
    return [F.regexp_extract(name, pat, 1).alias("name"), F.regexp_extract(name, pat, 2).alias("lang")]


def lang_from_folder(f: Column, lower: bool = True) -> Column:
    """``bn`` when the folder name contains it, else ``en``."""
    g = F.lower(f) if lower else f
    return F.when(g.contains("bn"), F.lit("bn")).otherwise(F.lit("en"))


def lang_from_folder_sql(f: str) -> str:
    return f"(CASE WHEN contains(lower({f}), 'bn') THEN 'bn' ELSE 'en' END)"


def dataset_from_filename(path: Column, whole_path: bool = False) -> Column:
    """First hit of a known dataset in the file name (or in the whole
    given path), else 'generic'."""
    f = path if whole_path else file_name(path)
    out = F.lit("generic")
    for key, name in reversed(FILENAME_DATASETS):
        out = F.when(f.contains(key), F.lit(name)).otherwise(out)
    return out


def dataset_from_filename_sql(p: str) -> str:
    f = file_sql(p)
    whens = " ".join(f"WHEN contains({f}, {q(k)}) THEN {q(v)}" for k, v in FILENAME_DATASETS)
    return f"(CASE {whens} ELSE 'generic' END)"


def try_number(df: DataFrame, col: str, name: str) -> DataFrame:
    """Text to double; rows that do not parse are dropped."""
    return df.withColumn(name, py_strip(F.col(col)).try_cast("double")).where(F.col(name).isNotNull())


# ---------------------------------------------------------------------------
# Fixture: result files derived from the fixture scores
# ---------------------------------------------------------------------------
def fx_result_files(spark, sf) -> DataFrame:
    """(path, content) of the metric files a scorer would write for the
    fixture responses, plus an archived copy of the boolq accuracy files (so
    several files fill one cell) and unreadable content for one model."""
    from polyeval.operators import scoring as S
    from polyeval.plans.fixtures import FIXTURE_DATASET_NAMES, fx_responses

    keys = ("dataset", "lang", "model")
    rows = S.score_rows(fx_responses(spark, sf))
    c = F.col("clean_response")
    correct = (c != "") & (c == F.coalesce(F.col("ground_truth"), F.lit("")))
    # accuracy, RER and the rule judge's share in one pass over the responses
    t = rows.groupBy(*keys).agg(
        (F.sum(F.col("right").cast("long")).cast("double") / F.count(F.lit(1))).alias("accuracy"),
        (F.sum(F.col("error").cast("long")).cast("double") / F.count(F.lit(1))).alias("rer"),
        (F.count_if(correct).cast("double") / F.count(F.lit(1))).alias("judge_accuracy"))
    long = t.select(*keys, F.expr("stack(3, 'accuracy', accuracy, 'rer', rer, "
                                  "'llm_judge_accuracy', judge_accuracy) AS (metric, score)"))
    ds = F.coalesce(F.try_element_at(A.map_lit(FIXTURE_DATASET_NAMES), F.col("dataset")), F.col("dataset"))
    raw = F.try_element_at(A.map_lit(FIXTURE_RAW_MODELS), F.col("model"))
    content = F.when((F.col("model") == "model-3") & (F.col("metric") == "llm_judge_accuracy")
                     & (F.col("lang") == "bn"), F.lit("n/a")).otherwise(F.col("score").cast("string"))

    def path(fold):
        return F.concat(F.lit("inference-outputs/"), fold, F.lit("/"), ds, F.lit("_"), raw, F.lit("_"),
                        F.col("metric"), F.lit(".txt"))
    main = F.struct(path(F.concat(F.lit("results-"), F.col("lang"))).alias("path"), content.alias("content"))
    copy = F.struct(path(F.concat(F.lit("archive-"), F.col("lang"))).alias("path"), F.lit(" 0.5 ").alias("content"))
    archived = (F.col("dataset") == "boolq") & (F.col("metric") == "accuracy")
    files = F.when(archived, F.array(main, copy)).otherwise(F.array(main))
    return long.select(F.explode(files).alias("f")).select("f.path", "f.content")


def result_files_sql() -> str:
    from polyeval.plans import oracle as O
    from polyeval.plans.fixtures import FIXTURE_DATASET_NAMES

    judge = f"""SELECT dataset, lang, model,
               coalesce(CAST(count(*) FILTER (WHERE verdict = 'Correct') AS DOUBLE) / count(*), 0.0) AS judge_accuracy
        FROM (SELECT dataset, lang, model,
                     CASE WHEN c = '' THEN '' WHEN c = coalesce(ground_truth, '') THEN 'Correct' ELSE 'Incorrect' END AS verdict
              FROM (SELECT f.*, {O.clean('f.response')} AS c FROM fx_responses f) x) y
        GROUP BY dataset, lang, model"""
    t = f"SELECT s.*, j.judge_accuracy FROM ({O.score_table_sql()}) s JOIN ({judge}) j USING (dataset, lang, model)"
    long = f"""SELECT dataset, lang, model, 'accuracy' AS metric, accuracy AS score FROM t0
               UNION ALL SELECT dataset, lang, model, 'rer', rer FROM t0
               UNION ALL SELECT dataset, lang, model, 'llm_judge_accuracy', judge_accuracy FROM t0"""
    ds = _case(FIXTURE_DATASET_NAMES, "dataset", "dataset")
    raw = _case(FIXTURE_RAW_MODELS, "model")

    def path(fold):
        return f"'inference-outputs/' || {fold} || '/' || {ds} || '_' || {raw} || '_' || metric || '.txt'"
    content = ("CASE WHEN model = 'model-3' AND metric = 'llm_judge_accuracy' AND lang = 'bn' THEN 'n/a' "
               "ELSE CAST(score AS VARCHAR) END")
    return f"""WITH t0 AS ({t}), l0 AS ({long})
SELECT {path("'results-' || lang")} AS path, {content} AS content FROM l0
UNION ALL
SELECT {path("'archive-' || lang")} AS path, ' 0.5 ' AS content FROM l0 WHERE dataset = 'boolq' AND metric = 'accuracy'"""


# ---------------------------------------------------------------------------
# Importer end to end (aggregator semantics) and E16
# ---------------------------------------------------------------------------
def import_scores(files: DataFrame) -> DataFrame:
    """Parse names, normalise and rename model and dataset, keep known
    metrics, parse the number, and let the last file (by path) win per cell."""
    p = parse_result_name(files)
    p = (p.withColumn("lang", lang_from_folder(folder(F.col("path"))))
          .withColumn("model", rename(normalize_model(F.col("model")), MODEL_RENAMING))
          .withColumn("dataset", rename(F.col("dataset"), DATASET_RENAMING))
          .withColumn("metric_type", metric_type(F.col("metric")))
          .where(F.col("model").isNotNull() & F.col("dataset").isNotNull() & F.col("metric_type").isNotNull()))
    p = try_number(p, "content", "score")
    return A.last_value_wins(p, ["lang", "dataset", "model", "metric_type"], "score", "path")


def import_sql(exclude: str | None = None) -> str:
    f = file_sql("path")
    ds = f"regexp_extract({f}, {q(NAME_PATTERN)}, 1)"
    mdl = f"regexp_extract({f}, {q(NAME_PATTERN)}, 2)"
    met = f"regexp_extract({f}, {q(NAME_PATTERN)}, 3)"
    from polyeval.plans import oracle as O
    num = f"TRY_CAST({O.strip('content')} AS DOUBLE)"
    skip = f" AND NOT contains(path, {q(exclude)})" if exclude else ""
    return f"""SELECT lang, dataset, model, metric_type, arg_max(score, path) AS score FROM (
  SELECT path, {lang_from_folder_sql(folder_sql('path'))} AS lang,
         {rename_sql(normalize_model_sql(mdl), MODEL_RENAMING)} AS model,
         {rename_sql(ds, DATASET_RENAMING)} AS dataset, {metric_type_sql(met)} AS metric_type, {num} AS score
  FROM ({result_files_sql()}) f WHERE regexp_matches({f}, {q(NAME_PATTERN)}){skip}) x
WHERE model IS NOT NULL AND dataset IS NOT NULL AND metric_type IS NOT NULL AND score IS NOT NULL
GROUP BY lang, dataset, model, metric_type"""
