"""Analysis layer over a long score table.

Input is ``scores`` = (lang, dataset, dataset_category, model, model_family,
model_size, metric_type, score), one row per cell. Means and standard
deviations are rounded to 10 digits so that engines that add in a different
order agree (SURVEY 7, hard part 5).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyeval.operators.ids import with_index

R = 10  # digits kept on derived doubles


def rnd(c: Column) -> Column:
    return F.round(c, R)


# ---------------------------------------------------------------------------
# Dataset categories and metric renames of the analysis
# ---------------------------------------------------------------------------
CATEGORY_MAP = {
    "hellaswag": "commonsense",
    "winogrande": "commonsense",
    "commonsenseqa": "commonsense",
    "boolq": "commonsense",
    "openbookqa": "commonsense",
    "arc-easy": "science",
    "arc-challenge": "science",
    "gsm8k-main": "math",
    "mmlu": "multidomain",
}


def map_lit(mapping: dict) -> Column:
    return F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])


def model_size(model) -> Column:
    """First ``(\\d+)(B|M)`` of the upper-cased name; B x 1e6, M x 1e3."""
    up = F.upper(model if isinstance(model, Column) else F.col(model))
    pat = r"(\d+)(B|M)"
    n = F.regexp_extract(up, pat, 1).cast("long")
    unit = F.regexp_extract(up, pat, 2)
    return F.when(up.rlike(pat), F.when(unit == "M", n * 1000).otherwise(n * 1000000))


def model_family(model) -> Column:
    """First ``-`` part of the model name."""
    m = model if isinstance(model, Column) else F.col(model)
    return F.substring_index(m, "-", 1)


def adherence(df: DataFrame) -> DataFrame:
    """Rer becomes rar = 1 - rer."""
    is_rer = F.col("metric_type") == "rer"
    return (df.withColumn("score", F.when(is_rer, 1 - F.col("score")).otherwise(F.col("score")))
              .withColumn("metric_type", F.when(is_rer, F.lit("rar")).otherwise(F.col("metric_type"))))


# ---------------------------------------------------------------------------
# F: ranks
# ---------------------------------------------------------------------------
def rank_models(scores: DataFrame, by=("lang", "dataset", "metric_type")) -> DataFrame:
    """F1: rank by score descending, ties share the smallest rank; null
    scores get no rank (dropped first)."""
    w = Window.partitionBy(*by).orderBy(F.col("score").desc())
    return scores.where(F.col("score").isNotNull()).withColumn("rank", F.rank().over(w).cast("bigint"))


def rank_desc_distributed(df: DataFrame, by: list[str], value: str = "score", name: str = "rank") -> DataFrame:
    """F1 for large inputs: the same ranks (descending, ties share the
    smallest) without a window per group. A range-partitioned global sort on
    (group, value desc) spreads a hot group over many tasks; a dense position
    per row, the first position of each group and of each (group, value) -
    two small aggregates joined back by key, skew handled by AQE - give
    ``rank = first position of the value - first position of the group + 1``."""
    d = df.where(F.col(value).isNotNull())
    s = with_index(d, "_pos", order_by=[*by, F.col(value).desc()])
    g = s.groupBy(*by).agg(F.min("_pos").alias("_g"))
    t = s.groupBy(*by, value).agg(F.min("_pos").alias("_t"))
    out = s.join(g, by).join(t, [*by, value])
    return out.withColumn(name, (F.col("_t") - F.col("_g") + 1).cast("bigint")).drop("_pos", "_g", "_t")


def topk_models(scores: DataFrame, k: int = 3, by=("lang", "dataset", "metric_type")) -> DataFrame:
    """Ranks 1..k with ties. Catalyst plans a WindowGroupLimit below the
    shuffle, so each task keeps at most the top rows of its share of a group."""
    return rank_models(scores, by).where(F.col("rank") <= k)


# ---------------------------------------------------------------------------
# E: aggregates
# ---------------------------------------------------------------------------
def mean_by(scores: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    """Mean score by any grouping."""
    return scores.groupBy(*keys).agg(rnd(F.avg(value)).alias("mean_score"),
                                     F.count(value).alias("n"))


def mean_by_sets(scores: DataFrame, groupings: list[list[str]], value: str = "score") -> DataFrame:
    """Several groupings in one pass with GROUPING SETS; ``grouping``
    names the set each row belongs to."""
    cols = []
    for g in groupings:
        for c in g:
            if c not in cols:
                cols.append(c)
    gid = F.grouping_id(*cols)
    label = F.lit(None).cast("string")
    for g in groupings:
        bits = sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in g)
        label = F.when(F.col("_gid") == bits, F.lit(",".join(g))).otherwise(label)
    sets = [[F.col(c) for c in g] for g in groupings]
    return (scores.groupingSets(sets, *cols)
            .agg(rnd(F.avg(value)).alias("mean_score"), F.count(value).alias("n"), gid.alias("_gid"))
            .withColumn("grouping", label).drop("_gid"))


def nunique_profile(scores: DataFrame, cols: list[str]) -> DataFrame:
    """Number of distinct non-null values per column (one row, long form)."""
    aggs = [F.count_distinct(F.col(c)).alias(c) for c in cols]
    wide = scores.agg(*aggs)
    stack = ", ".join(f"'{c}', CAST(`{c}` AS BIGINT)" for c in cols)
    return wide.select(F.expr(f"stack({len(cols)}, {stack}) AS (column_name, nunique)"))


def distinct_profile(scores: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct values per column, null listed too (as its own row)."""
    parts = [scores.select(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
             for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def corr_matrix(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Pearson correlation on rows where both values are present;
    undefined (constant column) gives null, never a divide-by-zero error."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    by = by or []
    num = F.covar_pop(x, y)
    den = F.stddev_pop(x) * F.stddev_pop(y)
    return d.groupBy(*by).agg(rnd(F.try_divide(num, F.when(den != 0, den))).alias("corr"),
                              F.count(F.lit(1)).alias("n"))


def corr_measures(df: DataFrame, x: str, measures: list[str]) -> DataFrame:
    """E10 for several measures in one pass: per measure, the rows where both
    values are present (conditional aggregates), then the small result is
    unpivoted to (measure, corr, n)."""
    aggs = []
    for i, m in enumerate(measures):
        both = F.col(x).isNotNull() & F.col(m).isNotNull()
        xs, ms = F.when(both, F.col(x)), F.when(both, F.col(m))
        aggs += [F.covar_pop(xs, ms).alias(f"_c{i}"), F.stddev_pop(xs).alias(f"_sx{i}"),
                 F.stddev_pop(ms).alias(f"_sm{i}"), F.count_if(both).alias(f"_n{i}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(m).alias("measure"),
                     rnd(F.try_divide(F.col(f"_c{i}"), F.when((F.col(f"_sx{i}") * F.col(f"_sm{i}")) != 0,
                                                              F.col(f"_sx{i}") * F.col(f"_sm{i}")))).alias("corr"),
                     F.col(f"_n{i}").alias("n")) for i, m in enumerate(measures)]
    return wide.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def lang_std(scores: DataFrame, key: list[str], lang: str = "lang") -> DataFrame:
    """Sample std over the per-language means; null with one language."""
    per_lang = scores.groupBy(*key, lang).agg(F.avg("score").alias("m"))
    return per_lang.groupBy(*key).agg(rnd(F.stddev_samp("m")).alias("lang_std"))


def _sorted_positions(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Non-null values with their dense position in (keys, value) order
    (range-partitioned global sort; checkpointed by ``with_index``)."""
    v = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    return with_index(v, "_pos", order_by=[*keys, "_v"])


def _quantiles_at(s: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    st = s.groupBy(*keys).agg(F.min("_pos").alias("_start"), F.count(F.lit(1)).alias("_n"))
    t = st.select(*keys, "_start", "_n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
    pos = F.col("p") * (F.col("_n") - 1)
    t = t.select(*keys, "p", (F.col("_start") + F.floor(pos)).alias("_lo"),
                 (F.col("_start") + F.ceil(pos)).alias("_hi"), (pos - F.floor(pos)).alias("_f"))
    at = s.select(F.col("_pos"), F.col("_v"))
    lo = at.withColumnRenamed("_pos", "_lo").withColumnRenamed("_v", "_vlo")
    hi = at.withColumnRenamed("_pos", "_hi").withColumnRenamed("_v", "_vhi")
    j = t.join(lo, "_lo").join(hi, "_hi")
    return j.select(*keys, "p", (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_f")).alias("q"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str,
                    probs: list[float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group, fully distributed.

    A global range sort on (keys, value) spreads even a hot group over many
    tasks; a dense position per row, the first position and size of each
    group (a small aggregate) give the two ranks around ``p*(n-1)``, and an
    equi-join on position fetches their values. No group is gathered.
    Output: keys, p, q.
    """
    return _quantiles_at(_sorted_positions(df, keys, value), keys, probs)


def box_summary(scores: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    """Quartiles, whiskers inside 1.5 IQR and outlier count per group
    (the box-plot numbers). The sorted, checkpointed values serve both the
    quartiles and the whisker pass, so the input is evaluated once."""
    s = _sorted_positions(scores, keys, value)
    qs = _quantiles_at(s, keys, [0.25, 0.5, 0.75])
    wide = qs.groupBy(*keys).agg(
        F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q1"),
        F.max(F.when(F.col("p") == 0.5, F.col("q"))).alias("median"),
        F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    wide = wide.withColumn("_lf", F.col("q1") - 1.5 * iqr).withColumn("_uf", F.col("q3") + 1.5 * iqr)
    d = s.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_v")
    cond = [F.col(f"_k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    j = d.join(wide, cond).select(*keys, "_v", "q1", "median", "q3", "_lf", "_uf")
    inside = (F.col("_v") >= F.col("_lf")) & (F.col("_v") <= F.col("_uf"))
    return j.groupBy(*keys).agg(
        rnd(F.first("q1")).alias("q1"), rnd(F.first("median")).alias("median"),
        rnd(F.first("q3")).alias("q3"),
        rnd(F.min(F.when(F.col("_v") >= F.col("_lf"), F.col("_v")))).alias("whisker_low"),
        rnd(F.max(F.when(F.col("_v") <= F.col("_uf"), F.col("_v")))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))


def per_category_accuracy(rows: DataFrame, category: str, right: str) -> DataFrame:
    """Right, wrong and share per category; running totals over the
    category order (a window over one row per category)."""
    g = rows.groupBy(category).agg(F.count_if(F.col(right)).alias("right"),
                                   F.count_if(~F.col(right)).alias("wrong"))
    w = Window.orderBy(category).rowsBetween(Window.unboundedPreceding, 0)
    return g.select(category, "right", "wrong",
                    F.try_divide(F.col("right").cast("double"), F.col("right") + F.col("wrong")).alias("accuracy"),
                    F.sum("right").over(w).alias("running_right"),
                    F.sum(F.col("right") + F.col("wrong")).over(w).alias("running_rows"))


def learning_curve_auc(acc_by_size: DataFrame, size: str = "train_size",
                       acc: str = "accuracy") -> DataFrame:
    """Trapezoid area of accuracy over log2(size), divided by the x range.
    Input has one row per size (a handful), so the window is tiny."""
    x = F.log2(F.col(size).cast("double"))
    w = Window.orderBy(size)
    d = acc_by_size.select(F.col(size), x.alias("x"), F.col(acc).alias("y"))
    d = d.withColumn("px", F.lag("x").over(w)).withColumn("py", F.lag("y").over(w))
    return d.agg(rnd(F.sum((F.col("x") - F.col("px")) * (F.col("y") + F.col("py")) / 2)
                     / (F.max("x") - F.min("x"))).alias("auc"))


def last_value_wins(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Several values for one cell, the one with the largest ``order``
    (documented, e.g. file path) wins."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def first_per_group(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keep the rows of the smallest ``order`` value per group (semi join)."""
    first = df.groupBy(*keys).agg(F.min(order).alias(order))
    return df.join(first, [*keys, order], "left_semi")


def mean_ci(scores: DataFrame, keys: list[str], value: str = "score", z: float = 1.959963984540054) -> DataFrame:
    """Mean with a normal 95% interval (std / sqrt(n))."""
    g = scores.groupBy(*keys).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"),
                                  F.count(value).alias("n"))
    half = F.lit(z) * F.col("s") / F.sqrt(F.col("n"))
    return g.select(*keys, rnd(F.col("m")).alias("mean_score"), rnd(F.col("m") - half).alias("ci_low"),
                    rnd(F.col("m") + half).alias("ci_high"), "n")


# ---------------------------------------------------------------------------
# G / H: orders, pivots, leaderboards
# ---------------------------------------------------------------------------
def axis(values: list[str], name: str) -> Column:
    """A fixed axis as (ordinal, value) structs to explode; it is literal and
    small, so no join is needed to attach it."""
    return F.explode(F.array(*[F.struct(F.lit(i).alias(f"{name}_ordinal"), F.lit(v).alias(name))
                               for i, v in enumerate(values)]))


def fixed_axis_order(scores: DataFrame, models: list[str], datasets: list[str],
                     by=("lang", "metric_type")) -> DataFrame:
    """Every (model, dataset) of the fixed axes for each (lang, metric),
    missing cells as null, with ordinals for the display order.

    One aggregation; its cells on the axes are gathered per (lang, metric) into a
    map keyed by (model, dataset) - at most one entry a cell of the axes, whatever
    the table holds - and the fixed axes are exploded against it, so the scores
    are read once and no self-join is needed."""
    cells = scores.groupBy(*by, "model", "dataset").agg(F.avg("score").alias("score"))
    on_axes = F.col("model").isin(models) & F.col("dataset").isin(datasets)
    g = cells.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.when(on_axes, F.struct(
        F.concat_ws("\u0001", "model", "dataset"), "score")))).alias("_cells"))
    out = (g.select(*by, "_cells", axis(models, "model").alias("_m")).select(*by, "_cells", "_m.*")
            .select(*by, "_cells", "model_ordinal", "model", axis(datasets, "dataset").alias("_d"))
            .select(*by, "_cells", "model_ordinal", "model", "_d.*"))
    key = F.concat_ws("\u0001", "model", "dataset")
    return out.select(*by, "model_ordinal", "model", "dataset_ordinal", "dataset",
                      F.try_element_at("_cells", key).alias("score"))


def leaderboard(scores: DataFrame, models: list[str], datasets: list[str],
                by=("lang", "metric_type")) -> DataFrame:
    """H4: one row per (lang, metric, model) in the fixed model order, one
    column per dataset in the fixed order; missing cells null (an empty string
    only at a CSV sink).

    One two-phase pivot (value list given); its rows on the axis are gathered per
    (lang, metric) into a map keyed by model (one entry a model of the axis)
    and the fixed model axis is exploded against it: the scores are read once
    and no self-join is needed."""
    wide = scores.groupBy(*by, "model").pivot("dataset", datasets).agg(F.avg("score"))
    vals = F.struct(*[F.col(f"`{d}`").alias(d) for d in datasets])
    g = wide.groupBy(*by).agg(F.map_from_entries(F.collect_list(
        F.when(F.col("model").isin(models), F.struct("model", vals)))).alias("_rows"))
    out = g.select(*by, "_rows", axis(models, "model").alias("_m")).select(*by, "_rows", "_m.*")
    row = F.try_element_at("_rows", F.col("model"))
    return out.select(*by, "model_ordinal", "model", *[row[d].alias(d) for d in datasets])


def pivot_mean(scores: DataFrame, index: list[str], column: str, values: list[str],
               value: str = "score") -> DataFrame:
    """H1-H3: mean of ``value`` with the given ``column`` values as columns;
    null index keys are dropped (as a pivot table does). The value list is
    given so that no extra job runs to find it."""
    d = scores
    for k in index:
        d = d.where(F.col(k).isNotNull())
    p = d.groupBy(*index).pivot(column, values).agg(F.avg(value))
    return p.select(*index, *[rnd(F.col(f"`{v}`")).alias(v) for v in values])


def score_gap(scores: DataFrame, index: list[str], hi: str = "en", lo: str = "bn") -> DataFrame:
    """H5: ``hi - lo`` of the per-language mean; null when one side is missing."""
    p = pivot_mean(scores, index, "lang", [lo, hi])
    return p.withColumn("score_gap", rnd(F.col(hi) - F.col(lo)))


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """``orderBy(...).limit(n)`` (planned as TakeOrderedAndProject:
    each task keeps n rows, the final merge sees n x tasks rows)."""
    return df.orderBy(*order).limit(n)


def with_order_position(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """Make a sort order checkable as a dense 0-based position."""
    return with_index(df, name, order_by=order)


def log2(x: float) -> float:
    return math.log2(x)


# Distribution function of the Poisson distribution of mean one, in 2^32nds
POISSON_STEPS = [int((1 << 32) * p) for p in (
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
    0.9994058151824183, 0.999916758850712)]


def poisson_weight(*parts) -> Column:
    """How often a row is drawn in a replicate: a Poisson number from the hash of row and replicate."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")
    out = F.lit(len(POISSON_STEPS))
    for k, step in reversed(list(enumerate(POISSON_STEPS))):
        out = F.when(u < step, F.lit(k)).otherwise(out)
    return out


def mean_bootstrap(scores: DataFrame, keys: list[str], row: list[str], value: str = "score", replicates: int = 200,
                   low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Mean with the percentile interval of a bootstrap, in one pass. Every row weighs in each
    replicate by a Poisson number that its identity ``row`` fixes, so the result is the same at every
    layout; sums of weights are partial aggregates, and only the replicate means meet in the end."""
    d = scores.where(F.col(value).isNotNull()).withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    d = d.withColumn("_w", poisson_weight(*[F.col(c).cast("string") for c in row], F.col("_r").cast("string")))
    means = d.groupBy(*keys, "_r").agg((F.sum(F.col("_w") * F.col(value)) / F.nullif(F.sum("_w"), F.lit(0))).alias("_m"))
    ends = means.groupBy(*keys).agg(F.percentile("_m", F.array(F.lit(low), F.lit(high))).alias("_q"))
    mean = scores.groupBy(*keys).agg(rnd(F.avg(value)).alias("mean_score"), F.count(value).alias("n"))
    same = F.lit(True)
    for k in keys:
        same = same & mean[k].eqNullSafe(F.col(f"_k_{k}"))
    ends = ends.select(*[F.col(k).alias(f"_k_{k}") for k in keys], rnd(F.col("_q")[0]).alias("boot_low"),
                       rnd(F.col("_q")[1]).alias("boot_high"))
    return mean.join(ends, same, "left").select(*keys, "mean_score", "boot_low", "boot_high", "n")
