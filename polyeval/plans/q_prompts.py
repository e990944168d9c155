"""Registered prompt-rendering queries (B1-B16) over ``fx_items``.

``fx_items`` turns each document into a multiple-choice item: the stem is the
whole document, the choices are its words 2-5, labels are Latin for English
documents and Bangla otherwise; the passage item asks about the source with
the whole document as passage.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from polyeval.functions import prompts as P
from polyeval.functions.text import strip_reasoning
from polyeval.plans.catalog import register
from polyeval.plans.fixtures import (FIXTURE_DATASET_NAMES, fx_chat, fx_responses, table, with_views, word_choices,
                                     word_choices_sql)
from polyeval.plans.oracle import clean, q

LAT = ["A", "B", "C", "D"]
BEN = ["ক", "খ", "গ", "ঘ"]


def fx_items(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    bn = F.col("lang") != "en"
    labels = F.when(bn, F.array(*[F.lit(x) for x in BEN])).otherwise(F.array(*[F.lit(x) for x in LAT]))
    d = d.withColumn("choices", word_choices(F.col("text")))
    choices = F.col("choices")
    out = d.select(
        "doc_id", F.when(bn, "bn").otherwise("en").alias("lang"),
        F.col("text").alias("stem"),
        F.concat(F.lit("Is this text from "), F.col("source"), F.lit("?")).alias("question"),
        F.col("text").alias("passage"),
        choices.alias("choices"),
        F.slice(labels, 1, F.size(choices)).alias("labels"),
        F.element_at(labels, (F.col("doc_id") % 4 + 1).cast("int")).alias("answer_key"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("source")).alias("concept"),
    )
    flags = F.transform("choices", lambda c, i: F.when(i == (F.col("doc_id") % 5), 1).otherwise(0))
    multi = F.transform("choices", lambda c, i: F.when((i + F.col("doc_id")) % 2 == 0, 1).otherwise(0))
    return out.withColumn("flags", flags).withColumn("multi_flags", multi)


FX_ITEMS_SQL = f"""
SELECT doc_id, lang, stem, question, passage, choices,
       list_slice(lbl, 1, len(choices)) AS labels, lbl[doc_id % 4 + 1] AS answer_key, concept,
       list_transform(choices, lambda c, i: CASE WHEN i - 1 = doc_id % 5 THEN 1 ELSE 0 END) AS flags,
       list_transform(choices, lambda c, i: CASE WHEN (i - 1 + doc_id) % 2 = 0 THEN 1 ELSE 0 END) AS multi_flags
FROM (SELECT doc_id, CASE WHEN lang <> 'en' THEN 'bn' ELSE 'en' END AS lang,
             text AS stem, 'Is this text from ' || source || '?' AS question, text AS passage,
             {word_choices_sql('text')} AS choices,
             CASE WHEN lang <> 'en' THEN {[*BEN]} ELSE {[*LAT]} END AS lbl,
             CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS concept
      FROM documents) d
"""


def it(sql: str) -> str:
    return f"WITH fx_items AS ({FX_ITEMS_SQL})\n{sql}"


def by_lang(fn):
    """Pick the renderer of the row's language (headers differ)."""
    return F.when(F.col("lang") == "bn", fn("bn")).otherwise(fn("en"))


def prefix(lang: str, n: int = 4):
    return F.lit(P.mcq_template(lang, n))


def sql_prefix(n: int = 4) -> str:
    return f"CASE WHEN lang = 'bn' THEN {q(P.mcq_template('bn', n))} ELSE {q(P.mcq_template('en', n))} END"


def sql_header() -> str:
    return f"CASE WHEN lang = 'bn' THEN {q(P.OPTIONS_HEADER['bn'])} ELSE {q(P.OPTIONS_HEADER['en'])} END"


def sql_zip_lines(sep: str) -> str:
    return (f"array_to_string(list_transform(list_zip(labels, choices), "
            f"lambda e: e[1] || {q(sep)} || e[2] || chr(10)), '')")


# --- B1 choices struct (three separators / concept variants) ----------------------------------------
def _b1(sep, concept):
    def build(spark, sf):
        i = fx_items(spark, sf)
        return i.select("doc_id", by_lang(lambda lg: P.render_choices(
            prefix(lg), F.col("stem"), F.col("labels"), F.col("choices"), lg, sep,
            F.col("concept") if concept else None)).alias("prompt"), "answer_key")
    return build


def _b1_sql(sep, concept):
    c = ""
    if concept:
        c = (f" || (CASE WHEN coalesce(concept, '') <> '' THEN (CASE WHEN lang = 'bn' THEN {q(P.CONCEPT_HEADER['bn'])} "
             f"ELSE {q(P.CONCEPT_HEADER['en'])} END) || concept || chr(10) ELSE '' END)")
    return it(f"""SELECT doc_id, {sql_prefix()} || stem || chr(10){c} || {sql_header()} || chr(10) || {sql_zip_lines(sep)} AS prompt,
       answer_key FROM fx_items""")


register("prompt_choices_struct", _b1_sql(". ", False))(_b1(". ", False))
register("prompt_choices_science", _b1_sql(": ", False))(_b1(": ", False))
register("prompt_choices_concept", _b1_sql(". ", True))(_b1(". ", True))


# --- B2 choices map --------------------------------------------------------------------------
@register("prompt_choices_map", it(f"""SELECT doc_id, {sql_prefix(5)} || stem || chr(10) || {sql_header()} || chr(10) ||
  array_to_string(list_transform(list_zip(labels, choices), lambda e: e[1] || ': ' || e[2] || chr(10)), '') AS prompt
FROM fx_items"""))
def q_choices_map(spark, sf):
    i = fx_items(spark, sf).withColumn("m", F.map_from_arrays("labels", "choices"))
    return i.select("doc_id", by_lang(lambda lg: P.render_choice_map(
        prefix(lg, 5), F.col("stem"), F.col("m"), lg)).alias("prompt"))


# --- B3 list literals --------------------------------------------------------------------------
@register("prompt_choices_literal", it(f"""SELECT doc_id,
  CASE WHEN len(list_filter(choices, lambda c: contains(c, '''') OR contains(c, '\\') OR contains(c, chr(10))
                                         OR contains(c, chr(13)))) > 0 THEN NULL
       ELSE {sql_prefix()} || stem || chr(10) || {sql_header()} || chr(10) || {sql_zip_lines('. ')} END AS prompt
FROM fx_items"""))
def q_choices_literal(spark, sf):
    i = fx_items(spark, sf)
    def lit(a):  # Python's repr of a list of strings
        return F.when(F.size(a) == 0, F.lit("[]")).otherwise(
            F.concat(F.lit("['"), F.array_join(a, "', '"), F.lit("']")))
    i = i.select("doc_id", "lang", "stem", lit(F.col("choices")).alias("choices_text"),
                 lit(F.col("labels")).alias("choices_label"))
    parsed = i.withColumn("c", P.parse_list_literal(F.col("choices_text"))) \
              .withColumn("l", P.parse_list_literal(F.col("choices_label")))
    # Python sees the text of the rows that the JSON reader rejected, null for the others
    ev = P.literal_eval_udf()
    both = (parsed.withColumn("c", F.coalesce("c", ev(F.when(F.col("c").isNull(), F.col("choices_text")))))
            .withColumn("l", F.coalesce("l", ev(F.when(F.col("l").isNull(), F.col("choices_label"))))))
    return both.select("doc_id", by_lang(lambda lg: P.render_choices(
        prefix(lg), F.col("stem"), F.col("l"), F.col("c"), lg, ". ")).alias("prompt"))


# --- B4 fixed columns -------------------------------------------------------------------------
@register("prompt_fixed_columns", it(f"""SELECT doc_id, {sql_prefix(2)} || stem || chr(10) || {sql_header()} || chr(10) ||
  (CASE WHEN lang = 'bn' THEN 'ক' ELSE 'A' END) || ': ' || choices[1] || chr(10) ||
  (CASE WHEN lang = 'bn' THEN 'খ' ELSE 'B' END) || ': ' || choices[2] || chr(10) AS prompt
FROM fx_items WHERE len(choices) >= 2"""))
def q_fixed(spark, sf):
    i = fx_items(spark, sf).where(F.size("choices") >= 2)
    labs = {"en": ["A", "B"], "bn": ["ক", "খ"]}
    return i.select("doc_id", by_lang(lambda lg: P.render_fixed(
        prefix(lg, 2), F.col("stem"), [F.element_at("choices", 1), F.element_at("choices", 2)],
        labs[lg], lg)).alias("prompt"))


# --- B5 positional letters + ground truth ------------------------------------------------------
_bn_letters = P.BANGLA_LETTERS
_letter_sql = (f"CASE WHEN lang = 'bn' THEN substr({q(_bn_letters)}, i, 1) "
               f"ELSE substr({q(P.LATIN_LETTERS)}, i, 1) END")


@register("prompt_positional_letters", it(f"""SELECT doc_id,
  {sql_prefix(13)} || stem || chr(10) || {sql_header()} || chr(10) ||
  array_to_string(list_transform(choices, lambda c, i: {_letter_sql} || ': ' || c || chr(10)), '') AS prompt,
  CASE WHEN list_position(flags, 1) > 0 THEN
       (CASE WHEN lang = 'bn' THEN substr({q(_bn_letters)}, list_position(flags, 1), 1)
             ELSE substr({q(P.LATIN_LETTERS)}, list_position(flags, 1), 1) END) END AS ground_truth,
  CASE WHEN len(list_filter(multi_flags, lambda x: x = 1)) > 0 THEN
       array_to_string(list_filter(list_transform(multi_flags, lambda x, i: CASE WHEN x = 1 THEN {_letter_sql} END),
                                   lambda y: y IS NOT NULL), ',') END AS ground_truth_multi
FROM fx_items"""))
def q_positional(spark, sf):
    i = fx_items(spark, sf)
    sc = lambda lg: "bangla" if lg == "bn" else "latin"
    return i.select(
        "doc_id",
        by_lang(lambda lg: P.render_positional(prefix(lg, 13), F.col("stem"), F.col("choices"), lg, sc(lg)))
        .alias("prompt"),
        by_lang(lambda lg: P.first_correct_letter(F.col("flags"), sc(lg))).alias("ground_truth"),
        by_lang(lambda lg: F.array_join(P.all_correct_letters(F.col("multi_flags"), sc(lg)), ","))
        .alias("ground_truth_multi"))


# --- B6 passage ----------------------------------------------------------------------------------
@register("prompt_passage", it(f"""SELECT doc_id,
  (CASE WHEN lang = 'bn' THEN {q(P.BOOLQ_TEMPLATE['bn'])} ELSE {q(P.BOOLQ_TEMPLATE['en'])} END) || question || chr(10) ||
  (CASE WHEN lang = 'bn' THEN {q(P.PASSAGE_HEADER['bn'])} ELSE {q(P.PASSAGE_HEADER['en'])} END) || chr(10) || passage || chr(10) AS prompt
FROM fx_items"""))
def q_passage(spark, sf):
    i = fx_items(spark, sf)
    return i.select("doc_id", by_lang(lambda lg: P.render_passage(
        F.lit(P.BOOLQ_TEMPLATE[lg]), F.col("question"), F.col("passage"), lg)).alias("prompt"))


# --- B8 option list, B16 lettered options ------------------------------------------------------------
@register("prompt_option_list", it(f"""SELECT doc_id, {sql_prefix()} || stem || chr(10) || {sql_header()} || chr(10) ||
  array_to_string(list_transform(choices, lambda c, i: '(' || substr({q(P.LATIN_LETTERS)}, i, 1) || ') ' || c || chr(10)), '') AS prompt
FROM fx_items"""))
def q_option_list(spark, sf):
    i = fx_items(spark, sf)
    opts = F.transform("choices", lambda c, i: F.concat(F.lit("("), P.letter(i), F.lit(") "), c))
    return i.select("doc_id", by_lang(lambda lg: P.render_option_list(
        prefix(lg), F.col("stem"), opts, lg)).alias("prompt"))


@register("lettered_options", it(f"""SELECT doc_id, 'Options are:' || chr(10) ||
  array_to_string(list_transform(choices, lambda c, i: '(' || substr({q(P.LATIN_LETTERS)}, i, 1) || '): ' || c || chr(10)), '') AS options
FROM fx_items"""))
def q_lettered(spark, sf):
    return fx_items(spark, sf).select("doc_id", P.lettered_options(F.col("choices")).alias("options"))


# --- continuation items (context + endings), with the Bangla phrase replacements (B9) --------------
def _ctx_sql():
    ctx = "stem"
    for a, b in P.CONTEXT_REPLACEMENTS_BN:
        ctx = f"replace({ctx}, {q(a)}, {q(b)})"
    lines = (f"array_to_string(list_transform(choices, lambda c, i: {_letter_sql} || '. ' || c || chr(10)), '')")
    return it(f"""SELECT doc_id,
  CASE WHEN lang = 'bn' THEN {q(P.mcq_template('bn', 4) + P.CONTEXT_HEADER['bn'] + chr(10))} || {ctx} || {q(chr(10) + P.CONTINUATION_QUESTION['bn'] + chr(10) + P.OPTIONS_HEADER['bn'] + chr(10))}
       ELSE {q(P.mcq_template('en', 4) + P.CONTEXT_HEADER['en'] + chr(10))} || stem || {q(chr(10) + P.CONTINUATION_QUESTION['en'] + chr(10) + P.OPTIONS_HEADER['en'] + chr(10))} END
  || {lines} AS prompt
FROM fx_items""")


register("prompt_context", _ctx_sql())(
    lambda spark, sf: fx_items(spark, sf).select("doc_id", by_lang(lambda lg: P.render_context(
        prefix(lg), F.col("stem"), F.col("choices"), lg)).alias("prompt")))


# --- B10 template registry --------------------------------------------------------------------
def _templates_sql():
    rows = ", ".join(f"({q(d)}, {q(lg)}, {q(s)}, {q(i)})" for d, lg, s, i in P.template_rows())
    return f"(VALUES {rows}) t(dataset, lang, system_prompt, input_prompt)"


_ds_rename = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in FIXTURE_DATASET_NAMES.items())


@register("template_registry", with_views(f"""SELECT r.question_id, r.dataset, r.lang, t.system_prompt, t.input_prompt
FROM (SELECT question_id, CASE dataset {_ds_rename} ELSE dataset END AS dataset, lang FROM fx_responses) r
LEFT JOIN {_templates_sql()} ON t.dataset = r.dataset AND t.lang = r.lang""", "fx_responses"))
def q_templates(spark, sf):
    from polyeval.operators.analysis import map_lit
    r = fx_responses(spark, sf)
    ds = F.coalesce(F.try_element_at(map_lit(FIXTURE_DATASET_NAMES), F.col("dataset")), F.col("dataset"))
    r = r.select("question_id", ds.alias("dataset"), "lang")
    return P.with_templates(r, P.template_table(spark)).select(
        "question_id", "dataset", "lang", "system_prompt", "input_prompt")


# --- B11 chat messages, B14 batch task (JSON text) ---------------------------------------------------
@register("chat_messages", with_views("""SELECT conv_id, turn,
  CAST(to_json({'model': 'model-x', 'messages': [{'role': 'system', 'content': system_prompt}, {'role': 'user', 'content': prompt}],
           'metadata': {'ground_truth': response, 'question_id': conv_id}}) AS VARCHAR) AS request
FROM fx_chat""", "fx_chat"))
def q_chat(spark, sf):
    c = fx_chat(spark, sf)
    req = P.chat_messages(F.col("system_prompt"), F.col("prompt"), "model-x", F.col("conv_id"), F.col("response"))
    return c.select("conv_id", "turn", F.to_json(req, {"ignoreNullFields": "false"}).alias("request"))


@register("batch_task", with_views("""SELECT conv_id, turn,
  CAST(to_json({'custom_id': 'task-' || CAST(conv_id * 1000 + turn AS VARCHAR), 'method': 'POST', 'url': '/v1/chat/completions',
           'body': {'model': 'model-x', 'temperature': 0.5,
                    'messages': [{'role': 'system', 'content': coalesce(system_prompt, '')}, {'role': 'user', 'content': prompt}]}}) AS VARCHAR) AS task
FROM fx_chat""", "fx_chat"))
def q_batch_task(spark, sf):
    c = fx_chat(spark, sf)
    return c.select("conv_id", "turn", P.batch_task(F.col("conv_id") * 1000 + F.col("turn"), "model-x",
                                                     F.coalesce("system_prompt", F.lit("")), F.col("prompt"),
                                                     0.5).alias("task"))


# --- B13 translation request (both quality levels) ----------------------------------------------------
GUIDE = "Translate the JSON values above into Bangla. Keep the keys."


@register("translation_request", it(f"""SELECT doc_id,
  '<english_text>' || chr(10) || to_json({{'question': stem, 'answer': answer_key}}) || chr(10) || '</english_text>' || chr(10) || chr(10) || {q(GUIDE)} AS dumped,
  '<english_text>' || chr(10) || '{{"question": "' || coalesce(stem, 'None') || '", "answer": "' || coalesce(answer_key, 'None') || '"}}' || chr(10) || '</english_text>' || chr(10) || chr(10) || {q(GUIDE)} AS raw
FROM fx_items"""))
def q_translation_request(spark, sf):
    i = fx_items(spark, sf)
    f = {"question": F.col("stem"), "answer": F.col("answer_key")}
    return i.select("doc_id", P.translation_request(f, GUIDE, "dumped").alias("dumped"),
                    P.translation_request(f, GUIDE, "raw").alias("raw"))


# --- B15 judge prompt ---------------------------------------------------------------------------
def judge_prompt_expr() -> str:
    """The judge prompt over columns prompt, ground_truth and c (the cleaned answer)."""
    import re
    shown = P.judge_example_block(P.JUDGE_EXAMPLES).replace("{", "{{").replace("}", "}}")
    parts = re.split(r"(?<!\{)(\{prompt\}|\{ground_truth\}|\{answer\})", P.JUDGE_TEMPLATE.replace("{examples}", shown))
    m = {"{prompt}": "coalesce(prompt, '')", "{ground_truth}": "coalesce(ground_truth, '')",
         "{answer}": "coalesce(c, '')"}
    exprs = [m[p] if p in m else q(p.replace("{{", "{").replace("}}", "}")) for p in parts if p]
    return " || ".join(exprs)


def _judge_sql():
    return with_views(f"SELECT question_id, {judge_prompt_expr()} AS judge_prompt "
                      f"FROM (SELECT f.*, {clean('f.response')} AS c FROM fx_responses f) x", "fx_responses")


@register("judge_prompt", _judge_sql())
def q_judge_prompt(spark, sf):
    r = fx_responses(spark, sf)
    return r.select("question_id", P.judge_prompt(F.col("prompt"), F.col("ground_truth"),
                                                  strip_reasoning(F.col("response"))).alias("judge_prompt"))
