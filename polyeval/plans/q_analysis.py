"""Registered analysis queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyeval.operators import analysis as A
from polyeval.plans.catalog import register
from polyeval.plans.fixtures import (FIXTURE_DATASET_NAMES, FIXTURE_MODEL_NAMES, fx_responses,
                                     fx_scores, with_views)
from polyeval.operators import scoring as S

MODELS = list(FIXTURE_MODEL_NAMES.values())
# fixed dataset axis of the leaderboard, in display order
DATASETS = ["openbookqa", "commonsenseqa", "boolq", "gsm8k-main", "winogrande", "hellaswag"]
LANGS = ["bn", "en"]
METRICS = ["accuracy", "llm-judge", "rar"]


def sc(sql: str) -> str:
    return with_views(sql, "fx_scores")


def qi(c: str) -> str:
    return '"' + c + '"'


# --- H4 leaderboard (flagship) ------------------------------------------------
_models_values = ", ".join(f"({i}, '{m}')" for i, m in enumerate(MODELS))
_ds_cols = ", ".join(f"avg(CASE WHEN dataset = '{d}' THEN score END) AS {qi(d)}" for d in DATASETS)
_lb_sql_text = f"""
SELECT f.lang, f.metric_type, m.model_ordinal, m.model, {", ".join("w." + qi(d) for d in DATASETS)}
FROM (SELECT DISTINCT lang, metric_type FROM fx_scores) f
CROSS JOIN (VALUES {_models_values}) m(model_ordinal, model)
LEFT JOIN (SELECT lang, metric_type, model, {_ds_cols} FROM fx_scores
           WHERE dataset IN ({", ".join(f"'{d}'" for d in DATASETS)}) GROUP BY lang, metric_type, model) w
  ON w.lang = f.lang AND w.metric_type = f.metric_type AND w.model = m.model"""
register("leaderboard", sc(_lb_sql_text))(
    lambda spark, sf: A.leaderboard(fx_scores(spark, sf), MODELS, DATASETS))

# --- G2 fixed axis order -----------------------------------------------------
_ds_values = ", ".join(f"({i}, '{d}')" for i, d in enumerate(DATASETS))
register("fixed_axis_order", sc(f"""
SELECT f.lang, f.metric_type, m.model_ordinal, m.model, d.dataset_ordinal, d.dataset, c.score
FROM (SELECT DISTINCT lang, metric_type FROM fx_scores) f
CROSS JOIN (VALUES {_models_values}) m(model_ordinal, model)
CROSS JOIN (VALUES {_ds_values}) d(dataset_ordinal, dataset)
LEFT JOIN (SELECT lang, metric_type, model, dataset, avg(score) AS score FROM fx_scores
           GROUP BY lang, metric_type, model, dataset) c
  ON c.lang = f.lang AND c.metric_type = f.metric_type AND c.model = m.model AND c.dataset = d.dataset"""))(
    lambda spark, sf: A.fixed_axis_order(fx_scores(spark, sf), MODELS, DATASETS))

# --- F1 / F2 / C8 ranks ------------------------------------------------------------
_rank_sql = """SELECT lang, dataset, metric_type, model, score,
       rank() OVER (PARTITION BY lang, dataset, metric_type ORDER BY score DESC) AS rank
FROM fx_scores WHERE score IS NOT NULL"""
register("rank_models", sc(_rank_sql))(
    lambda spark, sf: A.rank_models(fx_scores(spark, sf)).select(
        "lang", "dataset", "metric_type", "model", "score", "rank"))
register("rank_models_distributed", sc(_rank_sql))(
    lambda spark, sf: A.rank_desc_distributed(fx_scores(spark, sf), ["lang", "dataset", "metric_type"]).select(
        "lang", "dataset", "metric_type", "model", "score", "rank"))
register("topk_models", sc(f"SELECT * FROM ({_rank_sql}) r WHERE rank <= 3"))(
    lambda spark, sf: A.topk_models(fx_scores(spark, sf), 3).select(
        "lang", "dataset", "metric_type", "model", "score", "rank"))
register("filter_top_rank", sc(f"SELECT lang, dataset, model, score, rank FROM ({_rank_sql}) r WHERE rank <= 3"))(
    lambda spark, sf: A.topk_models(fx_scores(spark, sf), 3).select("lang", "dataset", "model", "score", "rank"))

# --- E8 mean_by ----------------------------------------------------------------
GROUPINGS = {
    "lang_dataset": ["lang", "dataset"],
    "lang_size_metric": ["lang", "model_size", "metric_type"],
    "metric_lang": ["metric_type", "lang"],
    "family_metric_lang": ["model_family", "metric_type", "lang"],
    "family_lang": ["model_family", "lang"],
    "category_lang_metric": ["dataset_category", "lang", "metric_type"],
    "model_family_size_dataset_lang": ["model", "model_family", "model_size", "dataset", "lang"],
}
for _name, _keys in GROUPINGS.items():
    def _mk(keys, name):
        k = ", ".join(keys)
        register(f"mean_by_{name}", sc(
            f"SELECT {k}, round(avg(score), 10) AS mean_score, count(score) AS n FROM fx_scores GROUP BY {k}"))(
            lambda spark, sf: A.mean_by(fx_scores(spark, sf), keys))
    _mk(_keys, _name)

_sets = [["lang", "dataset"], ["metric_type", "lang"], ["model_family", "lang"]]
_cols = ["lang", "dataset", "metric_type", "model_family"]


def _label_sql():
    parts = []
    for g in _sets:
        bits = sum(1 << (len(_cols) - 1 - i) for i, c in enumerate(_cols) if c not in g)
        parts.append(f"WHEN {bits} THEN '{','.join(g)}'")
    return f"CASE grouping({', '.join(_cols)}) {' '.join(parts)} END"


register("mean_by_sets", sc(f"""
SELECT {", ".join(_cols)}, round(avg(score), 10) AS mean_score, count(score) AS n, {_label_sql()} AS "grouping"
FROM fx_scores GROUP BY GROUPING SETS ({", ".join("(" + ", ".join(g) + ")" for g in _sets)})"""))(
    lambda spark, sf: A.mean_by_sets(fx_scores(spark, sf), _sets))

# --- E9 profiles ------------------------------------------------------------------
PROFILE_COLS = ["lang", "dataset", "model", "model_family", "model_size", "metric_type"]
register("nunique_profile", sc(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS nunique FROM fx_scores"
    for c in PROFILE_COLS)))(lambda spark, sf: A.nunique_profile(fx_scores(spark, sf), PROFILE_COLS))
register("distinct_profile", sc(" UNION ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM fx_scores" for c in PROFILE_COLS)))(
    lambda spark, sf: A.distinct_profile(fx_scores(spark, sf), PROFILE_COLS))

# --- E11 / G6 language robustness ------------------------------------------------------
_std_sql = """SELECT model_family, round(stddev_samp(m), 10) AS lang_std
FROM (SELECT model_family, lang, avg(score) AS m FROM fx_scores GROUP BY model_family, lang) x
GROUP BY model_family"""
register("lang_std", sc(_std_sql))(lambda spark, sf: A.lang_std(fx_scores(spark, sf), ["model_family"]))
_std_metric_sql = """SELECT model_family, metric_type, round(stddev_samp(m), 10) AS lang_std
FROM (SELECT model_family, metric_type, lang, avg(score) AS m FROM fx_scores
      GROUP BY model_family, metric_type, lang) x GROUP BY model_family, metric_type"""
register("sort_ascending_robust", sc(
    f"SELECT * FROM ({_std_metric_sql}) s ORDER BY lang_std ASC NULLS LAST, model_family, metric_type LIMIT 10"))(
    lambda spark, sf: A.top_n(A.lang_std(fx_scores(spark, sf), ["model_family", "metric_type"]),
                              [F.col("lang_std").asc_nulls_last(), "model_family", "metric_type"], 10))

# --- E12 box summary --------------------------------------------------------------------------
register("box_summary", sc("""
WITH q AS (SELECT model_family, lang,
                  quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS median,
                  quantile_cont(score, 0.75) AS q3
           FROM fx_scores WHERE score IS NOT NULL GROUP BY model_family, lang)
SELECT q.model_family, q.lang, round(q.q1, 10) AS q1, round(q.median, 10) AS median, round(q.q3, 10) AS q3,
       round(min(CASE WHEN s.score >= q.q1 - 1.5 * (q.q3 - q.q1) THEN s.score END), 10) AS whisker_low,
       round(max(CASE WHEN s.score <= q.q3 + 1.5 * (q.q3 - q.q1) THEN s.score END), 10) AS whisker_high,
       count(*) FILTER (WHERE NOT (s.score >= q.q1 - 1.5 * (q.q3 - q.q1) AND s.score <= q.q3 + 1.5 * (q.q3 - q.q1))) AS outliers
FROM fx_scores s JOIN q ON s.model_family IS NOT DISTINCT FROM q.model_family AND s.lang IS NOT DISTINCT FROM q.lang
WHERE s.score IS NOT NULL
GROUP BY q.model_family, q.lang, q.q1, q.median, q.q3"""))(
    lambda spark, sf: A.box_summary(fx_scores(spark, sf), ["model_family", "lang"]))

# --- E19 mean with interval by size ---------------------------------------------------------------
register("mean_ci_by_size", sc("""
SELECT model_size, lang, metric_type, round(avg(score), 10) AS mean_score,
       round(avg(score) - 1.959963984540054 * stddev_samp(score) / sqrt(count(score)), 10) AS ci_low,
       round(avg(score) + 1.959963984540054 * stddev_samp(score) / sqrt(count(score)), 10) AS ci_high,
       count(score) AS n
FROM fx_scores GROUP BY model_size, lang, metric_type"""))(
    lambda spark, sf: A.mean_ci(fx_scores(spark, sf), ["model_size", "lang", "metric_type"]))


# --- H1-H3 pivots, H5 gap, G3 top gaps ---------------------------------------------------
def _pivot_sql(index, column, values, where=""):
    k = ", ".join(index)
    nn = " AND ".join(f"{c} IS NOT NULL" for c in index)
    cols = ", ".join(f"round(avg(CASE WHEN {column} = '{v}' THEN score END), 10) AS {qi(v)}" for v in values)
    return f"SELECT {k}, {cols} FROM fx_scores WHERE {nn} GROUP BY {k}"


H1_INDEX = ["model", "model_family", "model_size", "dataset", "metric_type"]
register("pivot_lang", sc(_pivot_sql(H1_INDEX, "lang", LANGS)))(
    lambda spark, sf: A.pivot_mean(fx_scores(spark, sf), H1_INDEX, "lang", LANGS))
register("pivot_dataset", sc(_pivot_sql(["lang"], "dataset", DATASETS)))(
    lambda spark, sf: A.pivot_mean(fx_scores(spark, sf), ["lang"], "dataset", DATASETS))
register("pivot_metric_size", sc(_pivot_sql(["model_size"], "metric_type", METRICS)))(
    lambda spark, sf: A.pivot_mean(fx_scores(spark, sf), ["model_size"], "metric_type", METRICS))
register("pivot_metric_lang", sc(_pivot_sql(["metric_type"], "lang", LANGS)))(
    lambda spark, sf: A.pivot_mean(fx_scores(spark, sf), ["metric_type"], "lang", LANGS))

_gap_sql = f"SELECT *, round(en - bn, 10) AS score_gap FROM ({_pivot_sql(H1_INDEX, 'lang', LANGS)}) p"
register("score_gap", sc(_gap_sql))(lambda spark, sf: A.score_gap(fx_scores(spark, sf), H1_INDEX))

# mean over metrics first, then the gap (second form of H5)
H5_INDEX = ["model", "model_family", "model_size", "dataset"]
_avg_gap_sql = f"""SELECT *, round(en - bn, 10) AS score_gap FROM (
  SELECT {", ".join(H5_INDEX)},
         round(avg(CASE WHEN lang = 'bn' THEN m END), 10) AS bn, round(avg(CASE WHEN lang = 'en' THEN m END), 10) AS en
  FROM (SELECT {", ".join(H5_INDEX)}, lang, avg(score) AS m FROM fx_scores
        WHERE {" AND ".join(c + " IS NOT NULL" for c in H5_INDEX)} GROUP BY {", ".join(H5_INDEX)}, lang) a
  GROUP BY {", ".join(H5_INDEX)}) p"""


def _avg_gap(spark, sf):
    s = fx_scores(spark, sf)
    m = s.groupBy(*H5_INDEX, "lang").agg(F.avg("score").alias("score"))
    return A.score_gap(m, H5_INDEX)


register("score_gap_mean", sc(_avg_gap_sql))(_avg_gap)
register("topn_gap", sc(f"""SELECT model, dataset, metric_type, score_gap FROM ({_gap_sql}) g
WHERE score_gap IS NOT NULL ORDER BY score_gap DESC, model, dataset, metric_type LIMIT 20"""))(
    lambda spark, sf: A.top_n(A.score_gap(fx_scores(spark, sf), H1_INDEX).where(F.col("score_gap").isNotNull()),
                              [F.col("score_gap").desc(), "model", "dataset", "metric_type"], 20)
    .select("model", "dataset", "metric_type", "score_gap"))
register("topn_gap_mean", sc(f"""SELECT model, dataset, score_gap FROM ({_avg_gap_sql}) g
WHERE score_gap IS NOT NULL ORDER BY score_gap DESC, model, dataset LIMIT 5"""))(
    lambda spark, sf: A.top_n(_avg_gap(spark, sf).where(F.col("score_gap").isNotNull()),
                              [F.col("score_gap").desc(), "model", "dataset"], 5)
    .select("model", "dataset", "score_gap"))

# --- G7 datasets in name order (position made checkable) ---------------------------------
register("sort_folders", sc("""SELECT dataset, CAST(row_number() OVER (ORDER BY dataset) - 1 AS BIGINT) AS position
FROM (SELECT DISTINCT dataset FROM fx_scores) d"""))(
    lambda spark, sf: A.with_order_position(fx_scores(spark, sf).select("dataset").distinct(), ["dataset"]))


# --- E13 per-category accuracy over scored rows -------------------------------------------------
def _cat_rows(spark, sf):
    r = S.score_rows(fx_responses(spark, sf))
    return r.select(F.col("dataset").alias("category"), "right")


register("per_category_accuracy", with_views("""
WITH g AS (SELECT dataset AS category, count(*) FILTER (WHERE "right") AS "right",
                  count(*) FILTER (WHERE NOT "right") AS wrong FROM (""" + __import__(
    "polyeval.plans.oracle", fromlist=["x"]).scored_rows_sql() + """) s GROUP BY dataset)
SELECT category, "right", wrong, CAST("right" AS DOUBLE) / ("right" + wrong) AS accuracy,
       CAST(sum("right") OVER (ORDER BY category ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_right,
       CAST(sum("right" + wrong) OVER (ORDER BY category ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_rows
FROM g""", "fx_responses"))(
    lambda spark, sf: A.per_category_accuracy(_cat_rows(spark, sf), "category", "right"))

del FIXTURE_DATASET_NAMES
