"""Registered tokenizer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyeval.functions.text import WORD_CHAR, WS_CLASS, prompt_text
from polyeval.operators import analysis as A
from polyeval.operators import joins as J
from polyeval.operators import names as N
from polyeval.operators import tokens as TK
from polyeval.plans import oracle as O
from polyeval.plans.catalog import register
from polyeval.plans.fixtures import (FIXTURE_DATASET_NAMES, fixture_dataset, fx_chat, fx_responses, score_sums, scores_of,
                                     table, with_views)
from polyeval.plans.oracle import q
from polyeval.session import cut_lineage

NAMES = ["blank", "word_punct", "char", "byte"]
# which built-in tokenizer stands in for each fixture model
TOKENIZER_OF_MODEL = {"llama-3.1-8B": "blank", "qwen2.5-72B": "word_punct",
                      "mistral-7B": "char", "deepseek-llama-70B": "byte"}

_WP = (f"{WORD_CHAR}+|[^\\p{{L}}\\p{{N}}_\\x{{9}}-\\x{{D}}\\x{{1C}}-\\x{{20}}\\x{{85}}\\x{{A0}}\\x{{1680}}"
       f"\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]")


def _count_sql(t: str) -> dict[str, str]:
    t = f"coalesce({t}, '')"
    return {
        "blank": f"len(list_filter(regexp_split_to_array({t}, '{WS_CLASS}+'), lambda w: w <> ''))",
        "word_punct": f"len(regexp_extract_all({t}, {q(_WP)}))",
        "char": f"length({t})",
        "byte": f"strlen({t})",
    }


def _stats_sql(src: str, text: str, keys: list[str]) -> str:
    """Per-row counts then averages, mirroring ``token_stats``."""
    c = _count_sql(text)
    k = ", ".join(keys)
    rows = (f"SELECT {k}, {', '.join(f'{v} AS {n}' for n, v in c.items())}, strlen(coalesce({text}, '')) AS nb, "
            f"greatest({c['blank']}, 1) AS nw FROM {src}")
    parts = []
    for n in NAMES:
        parts.append(f"""SELECT {k}, '{n}' AS tokenizer, round(avg({n}), 10) AS avg_tokens_per_row,
  round(avg({n} / greatest(nw, 1)), 10) AS avg_tokens_per_word,
  round(avg(CASE WHEN {n} > 0 THEN nb / {n} ELSE 0.0 END), 10) AS avg_bytes_per_token,
  round(avg({n} / greatest({NAMES[0]}, 1)), 10) AS avg_normalized_seq_len
FROM r0 GROUP BY {k}""")
    return f"WITH r0 AS ({rows})\n" + "\nUNION ALL\n".join(parts)


def _docs(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("dataset"), "lang", "text")
    return TK.token_stats(d, F.col("text"), ["dataset", "lang"], NAMES)


register("token_stats", _stats_sql("(SELECT source AS dataset, lang, text FROM documents) d", "text",
                                   ["dataset", "lang"]))(_docs)

for _key, _col in [("avg_tokens_per_row", "avg_tokens_per_row"), ("avg_tokens_per_word", "avg_tokens_per_word"),
                   ("avg_bytes_per_token", "avg_bytes_per_token"), ("avg_nsl", "avg_normalized_seq_len")]:
    def _mk(key, col):
        register(key, f"SELECT dataset, lang, tokenizer, {col} FROM ("
                      f"{_stats_sql('(SELECT source AS dataset, lang, text FROM documents) d', 'text', ['dataset', 'lang'])}) s")(
            lambda spark, sf: _docs(spark, sf).select("dataset", "lang", "tokenizer", col))
    _mk(_key, _col)


@register("count_tokens", "SELECT doc_id, " + ", ".join(f"{v} AS {n}" for n, v in _count_sql("text").items())
          + " FROM documents")
def q_count_tokens(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", TK.count_tokens(F.col("text"), NAMES).alias("t")).select("doc_id", "t.*")


_pt = O.strip("coalesce(system_prompt, '') || ' ' || coalesce(prompt, '')")


@register("token_ratios", with_views(f"""SELECT conv_id, turn,
  CASE WHEN t > 0 THEN nb / t ELSE 0.0 END AS bytes_per_token, t / greatest(nw, 1) AS tokens_per_word,
  t / greatest(b, 1) AS nsl
FROM (SELECT conv_id, turn, {_count_sql(_pt)['word_punct']} AS t, {_count_sql(_pt)['blank']} AS b,
             strlen({_pt}) AS nb, greatest({_count_sql(_pt)['blank']}, 1) AS nw FROM fx_chat) x""", "fx_chat"))
def q_token_ratios(spark, sf):
    c = fx_chat(spark, sf)
    t = prompt_text("system_prompt", "prompt")
    r = TK.token_ratios(TK.word_punct_tokens(t), F.octet_length(t), TK.blank_tokens(t), TK.blank_tokens(t))
    return c.select("conv_id", "turn", *[v.alias(k) for k, v in r.items()])


# --- token table of the fixture prompts, per model ----------------------------------------
_ds_case = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in FIXTURE_DATASET_NAMES.items())
_PROMPTS_SQL = (f"(SELECT CASE dataset {_ds_case} ELSE dataset END AS dataset, lang, "
                f"{_pt} AS text FROM fx_responses) p")


def _prompt_tokens(spark, sf):
    r = fx_responses(spark, sf)
    ds = F.coalesce(F.try_element_at(A.map_lit(FIXTURE_DATASET_NAMES), F.col("dataset")), F.col("dataset"))
    p = r.select(ds.alias("dataset"), "lang", prompt_text("system_prompt", "prompt").alias("text"))
    s = TK.token_stats(p, F.col("text"), ["dataset", "lang"], NAMES)
    inv = {v: k for k, v in TOKENIZER_OF_MODEL.items()}
    return s.select(F.try_element_at(A.map_lit(inv), F.col("tokenizer")).alias("model"), "dataset", "lang",
                    "avg_tokens_per_row", "avg_tokens_per_word", "avg_bytes_per_token", "avg_normalized_seq_len")


_model_case = " ".join(f"WHEN {q(v)} THEN {q(k)}" for k, v in TOKENIZER_OF_MODEL.items())
_PT_STATS_SQL = f"""SELECT CASE tokenizer {_model_case} END AS model, dataset, lang, avg_tokens_per_row,
  avg_tokens_per_word, avg_bytes_per_token, avg_normalized_seq_len
FROM ({_stats_sql(_PROMPTS_SQL, 'text', ['dataset', 'lang'])}) s"""

register("token_stats_prompts", with_views(_PT_STATS_SQL, "fx_responses"))(_prompt_tokens)

_D1_SQL = f"""SELECT s.lang, s.dataset, s.model, s.metric_type, s.score, t.avg_tokens_per_row,
  t.avg_bytes_per_token, t.avg_normalized_seq_len, t.avg_tokens_per_word
FROM fx_scores s LEFT JOIN ({_PT_STATS_SQL}) t ON s.model = t.model AND s.dataset = t.dataset AND s.lang = t.lang"""


def _d1(spark, sf):
    """Scores and token measures come from one pass over the documents: sums by (dataset, lang,
    model), a few rows, from which both tables are made."""
    sums = cut_lineage(score_sums(spark, sf, *TK.measure_sums(prompt_text("system_prompt", "prompt"), NAMES)))
    wide = sums.groupBy(fixture_dataset().alias("dataset"), "lang").agg(*[
        F.round(F.sum(f"{n}__{m}") / F.sum("_rows"), TK.R).alias(f"{n}__{m}") for n in NAMES for m in ("tpr", "tpw", "bpt", "nsl")])
    of_model = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"{n}__tpr").alias("avg_tokens_per_row"),
                                  F.col(f"{n}__tpw").alias("avg_tokens_per_word"), F.col(f"{n}__bpt").alias("avg_bytes_per_token"),
                                  F.col(f"{n}__nsl").alias("avg_normalized_seq_len")) for m, n in TOKENIZER_OF_MODEL.items()])
    tokens = wide.select("dataset", "lang", F.explode(of_model).alias("_m")).select("dataset", "lang", "_m.*")
    return J.join_scores_tokens(scores_of(sums), tokens).select(
        "lang", "dataset", "model", "metric_type", "score", "avg_tokens_per_row", "avg_bytes_per_token",
        "avg_normalized_seq_len", "avg_tokens_per_word")


register("join_scores_tokens", with_views(_D1_SQL, "fx_scores"))(_d1)

MEASURES = ["avg_tokens_per_row", "avg_bytes_per_token", "avg_normalized_seq_len"]


@register("corr_score_measure", with_views(" UNION ALL ".join(
    f"""SELECT '{m}' AS measure, round(CASE WHEN stddev_pop(score) * stddev_pop({m}) <> 0
        THEN covar_pop(score, {m}) / (stddev_pop(score) * stddev_pop({m})) END, 10) AS corr, count(*) AS n
    FROM ({_D1_SQL}) d WHERE score IS NOT NULL AND {m} IS NOT NULL""" for m in MEASURES), "fx_scores"))
def q_corr(spark, sf):
    return A.corr_measures(_d1(spark, sf), "score", MEASURES)


@register("first_file_per_dataset", with_views(f"""SELECT path FROM ({N.result_files_sql()}) f
WHERE path IN (SELECT min(path) FROM ({N.result_files_sql()}) g GROUP BY {N.dataset_part_sql('path')})""",
                                               "fx_responses"))
def q_first_file(spark, sf):
    f = N.fx_result_files(spark, sf).withColumn("dataset", N.dataset_part(F.col("path")))
    # a path names one file, so the smallest path of a dataset is its first file
    return f.groupBy("dataset").agg(F.min("path").alias("path")).select("path")


# --- H2 for the token measures: language x dataset means over the joined table ---------------------------
PIVOT_DATASETS = ["openbookqa", "commonsenseqa", "boolq", "gsm8k-main", "winogrande", "hellaswag"]
for _key, _measure in [("pivot_dataset_nsl", "avg_normalized_seq_len"),
                       ("pivot_dataset_tokens_per_word", "avg_tokens_per_word"),
                       ("pivot_dataset_bytes_per_token", "avg_bytes_per_token")]:
    def _mk_pivot(key, measure):
        cols = ", ".join(f"round(avg(CASE WHEN dataset = '{d}' THEN {measure} END), 10) AS \"{d}\""
                         for d in PIVOT_DATASETS)
        register(key, with_views(f"SELECT lang, {cols} FROM ({_D1_SQL}) d WHERE lang IS NOT NULL GROUP BY lang",
                                 "fx_scores"))(
            lambda spark, sf: A.pivot_mean(_d1(spark, sf), ["lang"], "dataset", PIVOT_DATASETS, value=measure))
    _mk_pivot(_key, _measure)
