"""Registered scoring queries (E1, E2, E3 and the per-variant keys)."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyeval.operators import scoring as S
from polyeval.plans import oracle as O
from polyeval.plans.catalog import register
from polyeval.plans.fixtures import fx_responses, with_views

KEYS = ("dataset", "lang", "model")


def _table(spark, sf_dir, where=None):
    r = fx_responses(spark, sf_dir)
    if where is not None:
        r = r.where(where)
    return S.score_table(r, KEYS)


def _sql(cols: str, where: str = "") -> str:
    return with_views(f"SELECT {cols} FROM ({O.score_table_sql(where)}) t", "fx_responses")


register("score_table", _sql("dataset, lang, model, \"right\", errors, \"rows\", accuracy, rer"))(
    lambda spark, sf: _table(spark, sf))

register("accuracy", _sql("dataset, lang, model, accuracy"))(
    lambda spark, sf: _table(spark, sf).select(*KEYS, "accuracy"))

register("response_error_rate", _sql("dataset, lang, model, rer"))(
    lambda spark, sf: _table(spark, sf).select(*KEYS, "rer"))

# one key per rule variant, restricted to the rows that use it
for _v in S.VARIANTS:
    def _mk(v):
        wsql = f"{O.variant('dataset', 'lang')} = '{v}'"
        register(f"accuracy_{v}", _sql("dataset, lang, model, accuracy", wsql))(
            lambda spark, sf: _table(spark, sf, S.variant("dataset", "lang") == v).select(*KEYS, "accuracy"))
        register(f"rer_{v}", _sql("dataset, lang, model, rer", wsql))(
            lambda spark, sf: _table(spark, sf, S.variant("dataset", "lang") == v).select(*KEYS, "rer"))
    _mk(_v)


@register("scores_long", with_views(
    f"""SELECT dataset, lang, model, 'accuracy' AS metric_type, accuracy AS score FROM ({O.score_table_sql()}) a
        UNION ALL
        SELECT dataset, lang, model, 'rer' AS metric_type, rer AS score FROM ({O.score_table_sql()}) b""",
    "fx_responses"))
def q_scores_long(spark, sf):
    return S.scores_long(fx_responses(spark, sf), KEYS)


# E3 over verdicts of a rule judge (J2's default callable): the judge is
# a user function; the built-in one calls an answer Correct when it equals
# the ground truth, leaves empty answers blank and marks the rest Incorrect.
def rule_verdict(clean_col, truth_col):
    return (F.when(clean_col == "", F.lit(""))
            .when(clean_col == F.coalesce(truth_col, F.lit("")), F.lit("Correct"))
            .otherwise(F.lit("Incorrect")))


@register("judge_accuracy", with_views(
    f"""SELECT dataset, lang, model,
               coalesce(CAST(count(*) FILTER (WHERE verdict = 'Correct') AS DOUBLE) / count(*), 0.0) AS judge_accuracy
        FROM (SELECT dataset, lang, model,
                     CASE WHEN c = '' THEN '' WHEN c = coalesce(ground_truth, '') THEN 'Correct' ELSE 'Incorrect' END AS verdict
              FROM (SELECT f.*, {O.clean('f.response')} AS c FROM fx_responses f) x) y
        GROUP BY dataset, lang, model""", "fx_responses"))
def q_judge_accuracy(spark, sf):
    r = fx_responses(spark, sf)
    c = S.strip_reasoning(F.col("response"))
    j = r.select(*KEYS, rule_verdict(c, F.col("ground_truth")).alias("judge_verdict"))
    return S.judge_accuracy(j, KEYS)
