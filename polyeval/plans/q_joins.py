"""Registered join/filter queries (A15, A18, C1, C2, C5, C6, C9, D2-D5, D8-D10,
E14, E15, H6, H7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyeval.functions import prompts as P
from polyeval.functions import text as X
from polyeval.operators import analysis as A
from polyeval.operators import ids as I
from polyeval.operators import joins as J
from polyeval.operators import names as N
from polyeval.operators import tokens as TK
from polyeval.plans import oracle as O
from polyeval.plans.catalog import register
from polyeval.plans.fixtures import (fx_log, fx_messages, fx_predictions, fx_responses,
                                     table, with_views, word_choices, word_choices_sql)
from polyeval.plans.oracle import q

_tag_pat = "(?s)<bangla_translation>(.*?)</bangla_translation>"
_TRANSLATION_SQL = O.strip(
    f"split_part((CASE WHEN regexp_matches(message, {q(_tag_pat)}) THEN "
    f"{O.strip(f'regexp_extract(message, {q(_tag_pat)}, 1)')} ELSE message END), '<translator_notes>', 1)")


def _translation(col="message"):
    return X.strip_notes(X.extract_tag(col, "bangla_translation", "whole"))


# --- C1 keep only indexes named in the log --------------------------------------------------
_LOG_IDX_SQL = "SELECT CAST(regexp_extract(line, 'index (\\d+)', 1) AS BIGINT) AS idx FROM fx_log WHERE regexp_matches(line, 'index (\\d+)')"


@register("filter_affected", with_views(f"SELECT idx FROM fx_messages WHERE idx IN ({_LOG_IDX_SQL})",
                                        "fx_messages", "fx_log"))
def q_filter_affected(spark, sf):
    log = fx_log(spark, sf)
    idx = log.where(F.col("line").rlike(r"index (\d+)")).select(
        F.regexp_extract("line", r"index (\d+)", 1).cast("bigint").alias("idx"))
    return J.filter_affected(fx_messages(spark, sf), idx).select("idx")


# --- C2 drop unknown dataset / model / metric of imported names -----------------------------
@register("filter_known", with_views(f"""SELECT path FROM ({N.result_files_sql()}) f
WHERE regexp_matches({N.file_sql('path')}, {q(N.NAME_PATTERN)})
  AND {N.rename_sql(N.normalize_model_sql(f"regexp_extract({N.file_sql('path')}, {q(N.NAME_PATTERN)}, 2)"), N.MODEL_RENAMING)} IS NOT NULL
  AND {N.rename_sql(f"regexp_extract({N.file_sql('path')}, {q(N.NAME_PATTERN)}, 1)", N.DATASET_RENAMING)} IS NOT NULL
  AND {N.metric_type_sql(f"regexp_extract({N.file_sql('path')}, {q(N.NAME_PATTERN)}, 3)")} IS NOT NULL""",
                                     "fx_responses"))
def q_filter_known(spark, sf):
    p = N.parse_result_name(N.fx_result_files(spark, sf))
    p = p.withColumn("model", N.normalize_model(F.col("model")))
    return J.filter_known(p, {"model": list(N.MODEL_RENAMING), "dataset": list(N.DATASET_RENAMING),
                              "metric": list(N.METRIC_TYPES)}).select("path")


# --- D2 + C5: originals with their response; the ones without ---------------------------------
register("join_original_response", with_views("""SELECT d.doc_id AS idx, m.message IS NOT NULL AS has_message
FROM documents d LEFT JOIN fx_messages m ON m.idx = d.doc_id""", "fx_messages"))(
    lambda spark, sf: J.join_original_response(
        table(spark, sf, "documents").select(F.col("doc_id").alias("idx")), fx_messages(spark, sf))
    .select("idx", F.col("message").isNotNull().alias("has_message")))

register("filter_failed", with_views("""SELECT d.doc_id AS idx FROM documents d LEFT JOIN fx_messages m ON m.idx = d.doc_id
WHERE m.message IS NULL""", "fx_messages"))(
    lambda spark, sf: J.filter_failed(J.join_original_response(
        table(spark, sf, "documents").select(F.col("doc_id").alias("idx")), fx_messages(spark, sf)),
        "message").select("idx"))

# --- C6 non-blank lines of whole documents ------------------------------------------------------
register("filter_blank_lines", f"""SELECT doc_id, count(*) AS lines FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents) x
WHERE {O.strip('value')} <> '' GROUP BY doc_id""")(
    lambda spark, sf: J.filter_blank_lines(table(spark, sf, "documents").select(
        "doc_id", F.explode(F.split("text", "\n", -1)).alias("value"))).groupBy("doc_id")
    .agg(F.count(F.lit(1)).alias("lines")))

# --- C9 equal row counts --------------------------------------------------------------------------
register("validate_lengths", with_views("""SELECT (SELECT count(*) FROM documents) AS n_a,
  (SELECT count(*) FROM fx_responses) AS n_b, true AS equal""", "fx_responses"))(
    lambda spark, sf: J.validate_lengths(table(spark, sf, "documents"), fx_responses(spark, sf)))


# --- D3 failed translation falls back to the original -----------------------------------------------
@register("fallback_to_original", with_views(f"""SELECT d.doc_id AS idx,
  CASE WHEN t.q IS NOT NULL THEN t.q ELSE d.text END AS question,
  CASE WHEN t.q IS NOT NULL THEN 'translated' ELSE 'original' END AS status
FROM documents d LEFT JOIN (
  SELECT idx, CASE WHEN json_valid(t) AND starts_with(t, '{{') THEN json_extract_string(t, '$.question') END AS q
  FROM (SELECT idx, {_TRANSLATION_SQL} AS t FROM fx_messages) x) t ON t.idx = d.doc_id""", "fx_messages"))
def q_fallback(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), F.col("text").alias("question"))
    m = fx_messages(spark, sf)
    p = X.parse_json_strict(_translation(), "struct<question:string,answer:string>")
    t = m.select("idx", F.lit(1).alias("attempt"), p["question"].alias("question"))
    return J.fallback_to_original(d, t, "idx", ["question"], order="attempt")


def _corrected(spark, sf):
    """Labels as updates in two passes, the first one wrong."""
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    wrong = lab.select("doc_id", (1 - F.col("quality")).alias("quality"), (1 - F.col("toxic")).alias("toxic"))
    return lab.withColumn("pass", F.lit(2)).unionByName(wrong.withColumn("pass", F.lit(1)))


# --- D4 upsert labels onto documents ---------------------------------------------------------------------
@register("upsert_by_index", """SELECT d.doc_id,
  CASE WHEN l.doc_id IS NOT NULL THEN l.quality ELSE CAST(d.n_chars % 2 AS INTEGER) END AS quality,
  CASE WHEN l.doc_id IS NOT NULL THEN l.toxic ELSE 0 END AS toxic, l.doc_id IS NOT NULL AS updated
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def q_upsert(spark, sf):
    """Every label is corrected once: of the two updates of an index the later one counts."""
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"),
                                              F.lit(0).alias("toxic"))
    merged, _unmatched = J.upsert_by_index(d, _corrected(spark, sf), "doc_id", ["quality", "toxic"], order="pass")
    return merged


register("upsert_unmatched", "SELECT l.doc_id FROM labels l ANTI JOIN documents d ON d.doc_id = l.doc_id")(
    lambda spark, sf: J.upsert_by_index(
        table(spark, sf, "documents").select("doc_id", F.lit(0).alias("quality"), F.lit(0).alias("toxic")),
        table(spark, sf, "labels").withColumn("pass", F.lit(1)), "doc_id", ["quality", "toxic"], order="pass")[1].select("doc_id"))


# --- D5 paired corpora by row number -----------------------------------------------------------------
@register("pair_corpora", """SELECT a.idx, a.sample_id, a.left_json, b.right_json FROM
  (SELECT row_number() OVER (ORDER BY item_id) - 1 AS idx, CAST(item_id AS VARCHAR) AS sample_id,
          CAST(to_json({'text': text}) AS VARCHAR) AS left_json FROM benchmark) a
  JOIN (SELECT row_number() OVER (ORDER BY page_id) - 1 AS idx, CAST(to_json({'url': url}) AS VARCHAR) AS right_json FROM pages) b
  ON a.idx = b.idx""")
def q_pair(spark, sf):
    a = I.with_index(table(spark, sf, "benchmark").select("item_id", "text"), "idx", order_by=["item_id"], key=["item_id"])
    b = I.with_index(table(spark, sf, "pages").select("page_id", "url"), "idx", order_by=["page_id"], key=["page_id"])
    return J.pair_corpora(a, b, "idx", id_col="item_id", b_id_col="page_id")


# --- D9 + E15 predictions per training size and the learning-curve area -------------------------------------
SIZES = [160, 640, 2558, 10234, 40398]


def _pairs(spark, sf):
    return J.predictions_vs_gold(fx_predictions(spark, sf), "gold", "preds", SIZES)


_PAIRS_SQL = " UNION ALL ".join(
    f"SELECT idx, {s} AS train_size, trim(gold) AS gold, trim(string_split(preds, ',')[{i + 1}]) AS pred FROM fx_predictions"
    for i, s in enumerate(SIZES))
register("predictions_vs_gold", with_views(f"""SELECT train_size,
  CAST(count(*) FILTER (WHERE pred = gold) AS DOUBLE) / count(*) AS accuracy FROM ({_PAIRS_SQL}) p GROUP BY train_size""",
                                           "fx_predictions"))(
    lambda spark, sf: J.accuracy_by_size(_pairs(spark, sf)))

register("learning_curve_auc", with_views(f"""SELECT round(sum((x - px) * (y + py) / 2) / (max(x) - min(x)), 10) AS auc FROM (
  SELECT log2(train_size) AS x, accuracy AS y, lag(log2(train_size)) OVER (ORDER BY train_size) AS px,
         lag(accuracy) OVER (ORDER BY train_size) AS py
  FROM (SELECT train_size, CAST(count(*) FILTER (WHERE pred = gold) AS DOUBLE) / count(*) AS accuracy
        FROM ({_PAIRS_SQL}) p GROUP BY train_size) a) b""", "fx_predictions"))(
    lambda spark, sf: A.learning_curve_auc(J.accuracy_by_size(_pairs(spark, sf))))

# --- D10 / H7 id differences ------------------------------------------------------------------------
register("anti_ids", """SELECT 'only_documents' AS side, doc_id FROM (SELECT DISTINCT doc_id FROM documents) a
  WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'only_labels', doc_id FROM (SELECT DISTINCT doc_id FROM labels) b
  WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")(
    lambda spark, sf: (lambda p: p[0].select(F.lit("only_documents").alias("side"), "doc_id").unionByName(
        p[1].select(F.lit("only_labels").alias("side"), "doc_id")))(
        J.anti_ids(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")))

register("id_difference", """SELECT count(*) FILTER (WHERE side = 'a') AS only_documents,
  count(*) FILTER (WHERE side = 'b') AS only_labels FROM (
  SELECT 'a' AS side FROM (SELECT DISTINCT doc_id FROM documents) a WHERE doc_id NOT IN (SELECT doc_id FROM labels)
  UNION ALL SELECT 'b' FROM (SELECT DISTINCT doc_id FROM labels) b WHERE doc_id NOT IN (SELECT doc_id FROM documents)) x""")(
    lambda spark, sf: (lambda p: p[0].select(F.lit("a").alias("side")).unionByName(p[1].select(F.lit("b").alias("side"))))(
        J.anti_ids(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id"))
    .agg(F.count_if(F.col("side") == "a").alias("only_documents"),
         F.count_if(F.col("side") == "b").alias("only_labels")))


# --- H6 one table per tokenizer stacked with the model as a column -----------------------------------
@register("union_models", """SELECT source AS dataset, lang, tok AS model, round(avg(n), 10) AS avg_tokens_per_row FROM (
  SELECT source, lang, 'blank' AS tok, len(list_filter(regexp_split_to_array(text, '""" + X.WS_CLASS + """+'), lambda w: w <> '')) AS n FROM documents
  UNION ALL SELECT source, lang, 'char', length(text) FROM documents
  UNION ALL SELECT source, lang, 'byte', strlen(text) FROM documents) x GROUP BY source, lang, tok""")
def q_union_models(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("dataset"), "lang", "text")
    names = ["blank", "char", "byte"]
    wide = d.groupBy("dataset", "lang").agg(*[F.round(F.avg(TK.BUILTIN[n](F.col("text"))), 10).alias(n) for n in names])
    return J.stack_models(wide, ["dataset", "lang"], {n: n for n in names}, "avg_tokens_per_row")


# --- E14 few-shot prefix per category, D8 joined to items --------------------------------------------------
def _piece():
    words = F.filter(F.split("text", " "), lambda w: w != "")
    return F.concat(F.lit("Q: "), F.col("text"), F.lit("\n"), P.lettered_options(word_choices(F.col("text"))),
                    F.lit("\nA: "), F.element_at(words, 1), F.lit("\n\n"))


_PIECE_SQL = (f"'Q: ' || text || chr(10) || 'Options are:' || chr(10) || array_to_string(list_transform("
              f"{word_choices_sql('text')}, "
              f"lambda c, i: '(' || substr({q(P.LATIN_LETTERS)}, i, 1) || '): ' || c || chr(10)), '') || "
              f"chr(10) || 'A: ' || list_filter(string_split(text, ' '), lambda w: w <> '')[1] || chr(10) || chr(10)")
SHOTS = 5   # examples in front of an item: categories of five items grow in number, not in size
_PREFIX_SQL = (f"SELECT item_id // {SHOTS} AS category, string_agg({_PIECE_SQL}, '' ORDER BY item_id) AS prefix "
               f"FROM benchmark GROUP BY item_id // {SHOTS}")


def _prefixes(spark, sf):
    b = table(spark, sf, "benchmark").select(F.floor(F.col("item_id") / F.lit(SHOTS)).alias("category"), "item_id", "text")
    return I.ordered_concat(b, ["category"], "item_id", _piece(), "prefix")


register("fewshot_prefix", f"SELECT category, md5(prefix) AS prefix_md5, length(prefix) AS n_chars FROM ({_PREFIX_SQL}) p")(
    lambda spark, sf: _prefixes(spark, sf).select("category", F.md5("prefix").alias("prefix_md5"),
                                                  F.length("prefix").cast("bigint").alias("n_chars")))


@register("join_fewshot", f"""SELECT d.doc_id, md5(p.prefix || 'Q: ' || d.text || chr(10)) AS query_md5
FROM documents d JOIN ({_PREFIX_SQL}) p ON p.category = d.doc_id % (SELECT max(item_id // {SHOTS}) + 1 FROM benchmark)""")
def q_join_fewshot(spark, sf):
    last = table(spark, sf, "benchmark").agg(F.max(F.floor(F.col("item_id") / F.lit(SHOTS)))).first()[0]   # one number
    items = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % (last + 1)).alias("category"),
                                                  F.col("text").alias("stem"))
    j = J.join_fewshot(items, _prefixes(spark, sf), "category")
    return j.select("doc_id", F.md5(F.concat("prefix", F.lit("Q: "), "stem", F.lit("\n"))).alias("query_md5"))


# --- A18 chunks of 50, results matched back by index ------------------------------------------------------
@register("chunk_requests", with_views(f"""SELECT d.doc_id AS idx, CAST(floor(d.doc_id / 50) AS BIGINT) AS chunk,
  coalesce(t.t, d.text) AS text
FROM documents d LEFT JOIN (SELECT idx, {_TRANSLATION_SQL} AS t FROM fx_messages) t ON t.idx = d.doc_id""", "fx_messages"))
def q_chunks(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), F.col("text").alias("original"))
    req = J.chunk_requests(d, "idx", 50)
    res = fx_messages(spark, sf).select("idx", F.lit(1).alias("attempt"), _translation().alias("text"))
    return J.merge_chunk_results(req, res, "idx", "text", "original", order="attempt").select("idx", "chunk", "text")


# --- A15 skip runs whose output is there ----------------------------------------------------------------
@register("skip_existing", with_views(f"""SELECT DISTINCT dataset, lang, model FROM fx_responses r
WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT lang FROM fx_responses) x WHERE r.dataset = 'boolq' AND r.lang = x.lang AND r.model IN ('model-0', 'model-1'))""",
                                      "fx_responses"))
def q_skip(spark, sf):
    todo = fx_responses(spark, sf).select("dataset", "lang", "model").distinct()
    done = todo.where((F.col("dataset") == "boolq") & F.col("model").isin("model-0", "model-1"))
    return J.skip_existing(todo, done, ["dataset", "lang", "model"])
