"""Scoring: accuracy (E1), response-error rate (E2) and judge accuracy.

Per-row decisions are column expressions (no Python); the aggregates are
``sum`` of 0/1 over ``count``, which Spark runs as a partial (map-side)
aggregate followed by a small final aggregate per (dataset, lang, model).
A hot group therefore never lands in one task: each task pre-aggregates its
share before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyeval.functions.text import answer_tag, options_section, strip_reasoning

# ---------------------------------------------------------------------------
# Label maps of the scoring rules
# ---------------------------------------------------------------------------
BOOLQ_MAP = {"সত্য": "true", "মিথ্যা": "false"}
CQSA_BN_MAP = {"ক": "A", "খ": "B", "গ": "C", "ঘ": "D", "ঙ": "E"}
WINOGRANDE_BN_MAP = {"ক": "1", "খ": "2"}
WINOGRANDE_EN_MAP = {"A": "1", "B": "2"}
HELLASWAG_BN_MAP = {"ক": "0", "খ": "1", "গ": "2", "ঘ": "3"}
HELLASWAG_EN_MAP = {"A": "0", "B": "1", "C": "2", "D": "3"}
BOOLQ_OPTIONS = ["true", "false"]
WINOGRANDE_BN_OPTIONS = ["ক", "খ"]
WINOGRANDE_EN_OPTIONS = ["A", "B"]
HELLASWAG_BN_OPTIONS = ["ক", "খ", "গ", "ঘ"]
HELLASWAG_EN_OPTIONS = ["a", "b", "c", "d"]  # compared after lower-casing
GSM8K_NUMBER = {"en": r"(?d)^[0-9]+$", "bn": r"(?d)^[০-৯]+$"}

# Which rule a (dataset, lang) pair uses; everything else is 'generic'.
VARIANTS = ["boolq", "gsm8k", "cqsa_bn", "winogrande_bn", "winogrande_en",
            "hellaswag_en", "hellaswag_bn", "generic"]


def _lookup(mapping: dict, x: Column) -> Column:
    m = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.coalesce(F.try_element_at(m, x), x)


def variant(dataset, lang) -> Column:
    d, lg = F.col(dataset) if isinstance(dataset, str) else dataset, \
        F.col(lang) if isinstance(lang, str) else lang
    return (F.when(d == "boolq", "boolq").when(d == "gsm8k", "gsm8k")
            .when((d == "cqsa") & (lg == "bn"), "cqsa_bn")
            .when((d == "winogrande") & (lg == "bn"), "winogrande_bn")
            .when((d == "winogrande") & (lg == "en"), "winogrande_en")
            .when((d == "hellaswag") & (lg == "en"), "hellaswag_en")
            .when((d == "hellaswag") & (lg == "bn"), "hellaswag_bn")
            .otherwise("generic"))


def is_right(r: Column, ans: Column, v: Column, lang: Column) -> Column:
    """Accuracy rule of section 2.3 on a cleaned response ``r``."""
    ans = F.coalesce(ans, F.lit(""))
    tag = answer_tag(r, lang)
    right = (F.when(v == "boolq", F.lower(_lookup(BOOLQ_MAP, r)) == F.lower(ans))
             .when(v == "gsm8k", F.coalesce(tag == ans, F.lit(False)))
             .when(v == "cqsa_bn", _lookup(CQSA_BN_MAP, r) == ans)
             .when(v == "winogrande_bn", _lookup(WINOGRANDE_BN_MAP, r) == ans)
             .when(v == "winogrande_en", _lookup(WINOGRANDE_EN_MAP, r) == ans)
             .when(v == "hellaswag_en", F.lower(_lookup(HELLASWAG_EN_MAP, r)) == F.lower(ans))
             .when(v == "hellaswag_bn", F.lower(_lookup(HELLASWAG_BN_MAP, r)) == F.lower(ans))
             .otherwise(r == ans))
    return F.coalesce(right, F.lit(False))


def is_error(r: Column, options: Column, v: Column, lang: Column,
             compat_swapped_digits: bool = False) -> Column:
    """Response-error rule of section 2.3 (answer is not a legal option)."""
    tag = answer_tag(r, lang)
    digits = F.replace(F.replace(tag, F.lit(","), F.lit("")), F.lit(" "), F.lit(""))
    en_pat, bn_pat = GSM8K_NUMBER["en"], GSM8K_NUMBER["bn"]
    if compat_swapped_digits:  # X1: reproduce the swapped digit sets
        en_pat, bn_pat = bn_pat, en_pat
    num_ok = F.when(lang == "bn", digits.rlike(bn_pat)).otherwise(digits.rlike(en_pat))
    mapped_cqsa = _lookup(CQSA_BN_MAP, r)
    cqsa_ok = F.lit(False)
    for bn_letter, latin in CQSA_BN_MAP.items():
        cqsa_ok = cqsa_ok | ((mapped_cqsa == latin) & options.contains(bn_letter))
    generic_ok = ((r == "") & (options != "")) | ((F.length(r) == 1) & (F.instr(options, r) > 0))
    err = (F.when(v == "boolq", ~F.lower(_lookup(BOOLQ_MAP, r)).isin(BOOLQ_OPTIONS))
           .when(v == "gsm8k", F.when(tag.isNull(), F.lit(True)).otherwise(~num_ok))
           .when(v == "cqsa_bn", ~cqsa_ok)
           .when(v == "winogrande_bn", ~r.isin(WINOGRANDE_BN_OPTIONS))
           .when(v == "winogrande_en", ~r.isin(WINOGRANDE_EN_OPTIONS))
           .when(v == "hellaswag_bn", ~F.lower(r).isin(HELLASWAG_BN_OPTIONS))
           .when(v == "hellaswag_en", ~F.lower(r).isin(HELLASWAG_EN_OPTIONS))
           .otherwise(~generic_ok))
    return F.coalesce(err, F.lit(True))


def score_rows(responses: DataFrame, compat_swapped_digits: bool = False) -> DataFrame:
    """Add ``clean_response``, ``options``, ``right`` and ``error`` columns.

    Input columns: dataset, lang, prompt, response, ground_truth.
    """
    r = strip_reasoning(F.col("response"))
    df = responses.withColumn("clean_response", r) \
        .withColumn("options", options_section(F.col("prompt"), F.col("lang"))) \
        .withColumn("_variant", variant("dataset", "lang"))
    v, lang = F.col("_variant"), F.col("lang")
    return (df.withColumn("right", is_right(F.col("clean_response"), F.col("ground_truth"), v, lang))
              .withColumn("error", is_error(F.col("clean_response"), F.col("options"), v, lang,
                                            compat_swapped_digits))
              .drop("_variant"))


def score_table(responses: DataFrame, by=("dataset", "lang", "model"),
                compat_swapped_digits: bool = False) -> DataFrame:
    """E1 + E2 in one pass: right, errors, rows, accuracy and rer per group."""
    scored = score_rows(responses, compat_swapped_digits)
    return scored.groupBy(*by).agg(
        F.sum(F.col("right").cast("long")).alias("right"),
        F.sum(F.col("error").cast("long")).alias("errors"),
        F.count(F.lit(1)).alias("rows"),
    ).select(*by, "right", "errors", "rows",
             F.try_divide(F.col("right").cast("double"), F.col("rows")).alias("accuracy"),
             F.try_divide(F.col("errors").cast("double"), F.col("rows")).alias("rer"))


def accuracy(responses: DataFrame, by=("dataset", "lang", "model")) -> DataFrame:
    """Share of rows whose mapped response equals the answer."""
    return score_table(responses, by).select(*by, "accuracy")


def response_error_rate(responses: DataFrame, by=("dataset", "lang", "model"),
                        compat_swapped_digits: bool = False) -> DataFrame:
    """Share of rows whose answer is not a legal option."""
    return score_table(responses, by, compat_swapped_digits).select(*by, "rer")


def scores_long(responses: DataFrame, by=("dataset", "lang", "model")) -> DataFrame:
    """Accuracy and RER unpivoted to ``(…, metric_type, score)``."""
    t = score_table(responses, by)
    return t.select(*by, F.expr("stack(2, 'accuracy', accuracy, 'rer', rer) AS (metric_type, score)"))


def judge_accuracy(judgements: DataFrame, by=("dataset", "lang", "model"),
                   verdict: str = "judge_verdict") -> DataFrame:
    """count(verdict = 'Correct') / all rows; blanks and errors count as
    wrong; no rows gives 0.0."""
    return judgements.groupBy(*by).agg(
        F.coalesce(F.try_divide(F.count_if(F.col(verdict) == "Correct").cast("double"),
                                F.count(F.lit(1))), F.lit(0.0)).alias("judge_accuracy"))


def score_files(responses: DataFrame) -> DataFrame:
    """The scorer over a response tree: language from the language folder
    (``bn`` when its name contains it), dataset guessed from the file's path
    below it, accuracy and RER per file."""
    from polyeval.operators import names as N
    d = responses.withColumn("lang", N.lang_from_folder(F.col("lang_folder"), lower=False)) \
        .withColumn("dataset", N.dataset_from_filename(F.col("file"), whole_path=True))
    return score_table(d, ("lang_folder", "file", "dataset", "lang")).select(
        "lang_folder", "file", "dataset", "lang", "accuracy", "rer")
