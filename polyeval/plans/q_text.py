"""Registered text-column queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyeval.functions import text as X
from polyeval.functions.text import WORD_CHAR, WS_CLASS
from polyeval.operators import scoring as S
from polyeval.operators import names as N
from polyeval.plans import oracle as O
from polyeval.plans.catalog import register
from polyeval.plans.fixtures import (fx_chat, fx_messages, fx_responses,
                                     table, with_views, word_choices, word_choices_sql)
from polyeval.plans.oracle import q

R = with_views  # short alias


def resp(sql):
    return R(sql, "fx_responses")


# --- B21, B22, B23, B29 on fx_responses ------------------------------------------------
register("strip_reasoning", resp(f"SELECT question_id, {O.clean('response')} AS clean_response FROM fx_responses"))(
    lambda spark, sf: fx_responses(spark, sf).select("question_id", X.strip_reasoning("response").alias("clean_response")))

register("options_section", resp(f"SELECT question_id, {O.options('prompt', 'lang')} AS options FROM fx_responses"))(
    lambda spark, sf: fx_responses(spark, sf).select("question_id", X.options_section("prompt", "lang").alias("options")))

_starts = " OR ".join(f"starts_with(x, {q(s)})" for s in X.OPTION_LINE_STARTS)
register("option_lines", resp(f"""SELECT question_id,
  array_to_string(list_transform(list_filter(string_split(coalesce(prompt, ''), chr(10)), lambda x: {_starts}),
                                 lambda x: {O.strip('x')}), chr(10)) AS option_lines
FROM fx_responses"""))(
    lambda spark, sf: fx_responses(spark, sf).select(
        "question_id", F.array_join(X.option_lines("prompt"), "\n").alias("option_lines")))

register("answer_tag", resp(f"SELECT question_id, lang, {O.tag(O.clean('response'), 'lang')} AS answer FROM fx_responses"))(
    lambda spark, sf: fx_responses(spark, sf).select(
        "question_id", "lang", X.answer_tag(X.strip_reasoning("response"), F.col("lang")).alias("answer")))

# --- B17 map label (pass-through) -------------------------------------------------------
register("map_label", resp(f"SELECT question_id, {O.lookup(S.CQSA_BN_MAP, O.clean('response'))} AS mapped FROM fx_responses"))(
    lambda spark, sf: fx_responses(spark, sf).select(
        "question_id", X.map_label(X.strip_reasoning("response"), S.CQSA_BN_MAP).alias("mapped")))

# --- B27 digits both ways ---------------------------------------------------------------------
register("transliterate_digits", resp("""SELECT question_id,
  translate(ground_truth, '০১২৩৪৫৬৭৮৯', '0123456789') AS latin,
  translate(CAST(question_id AS VARCHAR), '0123456789', '০১২৩৪৫৬৭৮৯') AS bangla
FROM fx_responses"""))(
    lambda spark, sf: fx_responses(spark, sf).select(
        "question_id", X.transliterate_digits("ground_truth", "latin").alias("latin"),
        X.transliterate_digits("question_id", "bangla").alias("bangla")))

# --- B7 text after the last marker, B9 phrase replacements (whole texts) ----------------------------
_marked = "concat(text, ' #### ', CAST(doc_id % 97 AS VARCHAR), ' #### ', CAST(n_chars AS VARCHAR))"
register("answer_after_marker", f"SELECT doc_id, string_split({_marked}, '#### ')[-1] AS answer FROM documents")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", X.answer_after_marker(
        F.concat(F.col("text"), F.lit(" #### "), (F.col("doc_id") % 97).cast("string"),
                 F.lit(" #### "), F.col("n_chars").cast("string"))).alias("answer")))

PHRASES = [("Header", "হেডার"), ("Title", "টাইটেল"), ("Step", "স্টেপ"), ("the", "THE")]
_rep = "text"
for _a, _b in PHRASES:
    _rep = f"replace({_rep}, {q(_a)}, {q(_b)})"
register("phrase_replace", f"SELECT doc_id, md5({_rep}) AS text_md5, length({_rep}) AS n_chars FROM documents")(
    lambda spark, sf: table(spark, sf, "documents").select(
        "doc_id", F.md5(X.phrase_replace("text", PHRASES)).alias("text_md5"),
        F.length(X.phrase_replace("text", PHRASES)).cast("bigint").alias("n_chars")))

# --- B24, B25, B26 on translation messages --------------------------------------------------
_msg = "message"
_tag_pat = "(?s)<bangla_translation>(.*?)</bangla_translation>"
_tag_null = f"(CASE WHEN regexp_matches({_msg}, {q(_tag_pat)}) THEN {O.strip(f'regexp_extract({_msg}, {q(_tag_pat)}, 1)')} END)"
_tag_whole = f"(CASE WHEN regexp_matches({_msg}, {q(_tag_pat)}) THEN {O.strip(f'regexp_extract({_msg}, {q(_tag_pat)}, 1)')} ELSE {_msg} END)"
register("extract_tag", R(f"SELECT idx, {_tag_null} AS tag_or_null, {_tag_whole} AS tag_or_whole FROM fx_messages",
                          "fx_messages"))(
    lambda spark, sf: fx_messages(spark, sf).select(
        "idx", X.extract_tag("message", "bangla_translation", "null").alias("tag_or_null"),
        X.extract_tag("message", "bangla_translation", "whole").alias("tag_or_whole")))

_notes = O.strip(f"split_part({_tag_whole}, '<translator_notes>', 1)")
register("strip_notes", R(f"SELECT idx, {_notes} AS translation FROM fx_messages", "fx_messages"))(
    lambda spark, sf: fx_messages(spark, sf).select(
        "idx", X.strip_notes(X.extract_tag("message", "bangla_translation", "whole")).alias("translation")))


def _ws_sql(x, form):
    collapse = lambda y: O.strip(f"regexp_replace({y}, '{WS_CLASS}+', ' ', 'g')")
    if form == "a":
        return collapse(x)
    if form == "b":
        t = collapse(x)
        for pat, rep in [(r" *\{ *", "{"), (r" *\} *", "}"), (" *: *", ": "), (" *, *", ", ")]:
            t = f"regexp_replace({t}, {q(pat)}, {q(rep)}, 'g')"
        return t
    return collapse(f"regexp_replace({x}, '{WS_CLASS}*([{{}}\\[\\]:,]){WS_CLASS}*', '\\1', 'g')")


register("normalize_whitespace", R(f"""SELECT idx, {_ws_sql('message', 'a')} AS form_a, {_ws_sql('message', 'b')} AS form_b,
  {_ws_sql('message', 'c')} AS form_c FROM fx_messages""", "fx_messages"))(
    lambda spark, sf: fx_messages(spark, sf).select(
        "idx", X.normalize_whitespace("message", "a").alias("form_a"),
        X.normalize_whitespace("message", "b").alias("form_b"),
        X.normalize_whitespace("message", "c").alias("form_c")))

# whole documents through the same rule (long texts)
register("normalize_whitespace_docs", f"SELECT doc_id, md5({_ws_sql('text', 'a')}) AS text_md5 FROM documents")(
    lambda spark, sf: table(spark, sf, "documents").select(
        "doc_id", F.md5(X.normalize_whitespace("text", "a")).alias("text_md5")))

# --- B34 / C4 ASCII share and B35 language detection over whole texts ------------------------
_ratio = "(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(text) END)"
register("ascii_letter_ratio", f"""SELECT doc_id, round({_ratio}, 10) AS ascii_ratio,
  coalesce({_ratio} >= 0.3, false) AS flagged FROM documents""")(
    lambda spark, sf: table(spark, sf, "documents").select(
        "doc_id", F.round(X.ascii_letter_ratio("text"), 10).alias("ascii_ratio"),
        X.ascii_flag("text").alias("flagged")))


def _detect_sql(text):
    words = f"regexp_split_to_array(lower(coalesce({text}, '')), '[^\\p{{L}}]+')"
    cnt = {lg: f"len(list_filter({words}, lambda w: list_contains({[*sw]}, w)))" for lg, sw in X.STOPWORDS.items()}
    best = f"greatest({', '.join(cnt.values())})"
    whens = " ".join(f"WHEN {c} = {best} AND {best} > 0 THEN '{lg}'" for lg, c in cnt.items())
    bangla = f"length(regexp_replace(coalesce({text}, ''), '[^\\x{{0980}}-\\x{{09ff}}]', '', 'g'))"
    latin = f"length(regexp_replace(coalesce({text}, ''), '[^A-Za-z]', '', 'g'))"
    return f"(CASE WHEN {bangla} > 0 AND {bangla} >= {latin} THEN 'bn' {whens} ELSE 'und' END)"


# some documents in Bangla letters, so that the script share is checked as well
_ABC = "abcdefghijklmnopqrstuvwxyz"
_BN_ABC = "".join(chr(0x0995 + i) for i in range(26))
_LANG_DOCS_SQL = f"""SELECT doc_id, CASE WHEN doc_id % 9 = 4 THEN 'bn' ELSE lang END AS lang,
  CASE WHEN doc_id % 9 = 4 THEN translate(lower(text), '{_ABC}', '{_BN_ABC}') ELSE text END AS text FROM documents"""


def _lang_docs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    bn = F.col("doc_id") % 9 == 4
    return d.select("doc_id", F.when(bn, "bn").otherwise(F.col("lang")).alias("lang"),
                    F.when(bn, F.translate(F.lower("text"), _ABC, _BN_ABC)).otherwise(F.col("text")).alias("text"))


register("detect_language", f"SELECT doc_id, lang, {_detect_sql('text')} AS detected FROM ({_LANG_DOCS_SQL}) d")(
    lambda spark, sf: X.with_language(_lang_docs(spark, sf), "text").select("doc_id", "lang", "detected"))

register("filter_untranslated", f"""SELECT doc_id FROM ({_LANG_DOCS_SQL}) d
WHERE coalesce({_ratio} >= 0.3, false) AND {_detect_sql('text')} = 'en'""")(
    lambda spark, sf: X.with_language(_lang_docs(spark, sf).where(X.ascii_flag("text")), "text")
    .where(F.col("detected") == "en").select("doc_id"))

register("detect_language_accuracy", f"""SELECT lang, count(*) AS n,
  CAST(count(*) FILTER (WHERE d = lang) AS DOUBLE) / count(*) AS accuracy
FROM (SELECT lang, {_detect_sql('text')} AS d FROM ({_LANG_DOCS_SQL}) y) x GROUP BY lang""")(
    lambda spark, sf: X.with_language(_lang_docs(spark, sf), "text", "d")
    .groupBy("lang").agg(F.count(F.lit(1)).alias("n"),
                         (F.count_if(F.col("d") == F.col("lang")).cast("double") / F.count(F.lit(1))).alias("accuracy")))

# --- B36 detection text, B37 text measures on chat turns -------------------------------------------
register("detection_text", R("""SELECT conv_id, turn,
  md5(coalesce(system_prompt, '') || ' ' || coalesce(prompt, '') || ' ' || coalesce(response, '')) AS text_md5
FROM fx_chat""", "fx_chat"))(
    lambda spark, sf: fx_chat(spark, sf).select(
        "conv_id", "turn", F.md5(X.detection_text("system_prompt", "prompt", "response")).alias("text_md5")))

_pt = O.strip("coalesce(system_prompt, '') || ' ' || coalesce(prompt, '')")
register("text_measures", R(f"""SELECT conv_id, turn, strlen({_pt}) AS n_bytes,
  greatest(len(list_filter(regexp_split_to_array({_pt}, '{WS_CLASS}+'), lambda w: w <> '')), 1) AS n_words,
  length({_pt}) AS n_chars
FROM fx_chat""", "fx_chat"))(
    lambda spark, sf: fx_chat(spark, sf).select(
        "conv_id", "turn", X.utf8_bytes(X.prompt_text("system_prompt", "prompt")).cast("bigint").alias("n_bytes"),
        X.word_count(X.prompt_text("system_prompt", "prompt")).cast("bigint").alias("n_words"),
        F.length(X.prompt_text("system_prompt", "prompt")).cast("bigint").alias("n_chars")))

# --- B28 message content from a response record -----------------------------------------------------
_RESP_SCHEMA = "struct<choices:array<struct<message:struct<role:string,content:string>>>>"


@register("message_content", R("""SELECT conv_id, turn,
  CASE WHEN turn % 3 = 0 THEN '' ELSE coalesce(response, '') END AS content FROM fx_chat""", "fx_chat"))
def q_message_content(spark, sf):
    c = fx_chat(spark, sf)
    msg = F.struct(F.struct(F.lit("assistant").alias("role"), F.col("response").alias("content")).alias("message"))
    raw = F.to_json(F.struct(F.when(F.col("turn") % 3 == 0, F.array().cast(
        "array<struct<message:struct<role:string,content:string>>>")).otherwise(F.array(msg)).alias("choices")))
    return c.select("conv_id", "turn", X.message_content(F.from_json(raw, _RESP_SCHEMA)).alias("content"))


# --- B30 answer letter with a repeatable fallback ---------------------------------------------------
_LET = "ABCDEFGHIJ"
_ans_text = ("concat(coalesce(response, ''), CASE WHEN conv_id % 3 = 0 THEN ' The answer is (' || "
             "substr('ABCDEFGHIJ', CAST(turn % 10 AS INTEGER) + 1, 1) || ')' WHEN conv_id % 3 = 1 THEN ' answer is ' || "
             "substr('ABCDEFGHIJ', CAST(conv_id % 10 AS INTEGER) + 1, 1) ELSE '' END)")
_pat30 = r"answer is \(?([ABCDEFGHIJ])\)?"


@register("answer_letter", R(f"""SELECT conv_id, turn,
  CASE WHEN regexp_matches(t, {q(_pat30)}) THEN regexp_extract(t, {q(_pat30)}, 1)
       ELSE substr('{_LET}', CAST((conv_id * 1000003 + turn * 7919 + 42) % 10 AS INTEGER) + 1, 1) END AS letter
FROM (SELECT conv_id, turn, {_ans_text} AS t FROM fx_chat) x""", "fx_chat"))
def q_answer_letter(spark, sf):
    c = fx_chat(spark, sf)
    t = F.concat(F.coalesce("response", F.lit("")),
                 F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit(" The answer is ("), F.substring(
                     F.lit(_LET), (F.col("turn") % 10 + 1).cast("int"), 1), F.lit(")")))
                 .when(F.col("conv_id") % 3 == 1, F.concat(F.lit(" answer is "), F.substring(
                     F.lit(_LET), (F.col("conv_id") % 10 + 1).cast("int"), 1)))
                 .otherwise(F.lit("")))
    return c.select("conv_id", "turn", X.answer_letter(t, F.col("conv_id") * 1000003 + F.col("turn") * 7919,
                                                        seed=42).alias("letter"))


# --- B18 option prefixes, B19 options from text, B20 zip to map (on fx_items words) --------------
def _opts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    d = d.select("doc_id", word_choices(F.col("text")).alias("words"))
    opts = F.transform("words", lambda c, i: F.when(i % 2 == 0, F.concat(
        F.lit("("), F.substring(F.lit("ABCDEFGH"), (i + F.col("doc_id") % 4 + 1).cast("int"), 1), F.lit(") "), c))
        .otherwise(c))
    return d.select("doc_id", "words", opts.alias("options"))


_OPTS_SQL = f"""SELECT doc_id, words,
  list_transform(words, lambda c, i: CASE WHEN (i - 1) % 2 = 0
       THEN '(' || substr('ABCDEFGH', CAST(i - 1 + doc_id % 4 AS INTEGER) + 1, 1) || ') ' || c ELSE c END) AS options
FROM (SELECT doc_id, {word_choices_sql('text')} AS words
      FROM documents) d"""


def _map_prefix_sql(o):
    pat = f"^(\\({WORD_CHAR}\\))"
    lab = f"regexp_extract({o}, {q(pat)}, 1)"
    rest = f"regexp_replace(substr({o}, 4), '^{WS_CLASS}+', '')"
    return (f"CASE WHEN regexp_matches({o}, {q(pat)}) THEN "
            f"{O.lookup(X.OPTION_LABELS_BN, lab)} || ' ' || {rest} ELSE {o} END")


register("map_option_prefix", f"""SELECT doc_id, array_to_string(list_transform(options, lambda o: {_map_prefix_sql('o')}), '|') AS mapped
FROM ({_OPTS_SQL}) x""")(
    lambda spark, sf: _opts(spark, sf).select("doc_id", F.array_join(X.map_option_prefix("options"), "|").alias("mapped")))

_sol = "'Answer : ' || array_to_string(words, ' A ')"
_sol_sql = f"replace({_sol}, 'Answer :', 'উত্তর :')"
for _a, _b in X.LETTERS_BN.items():
    _sol_sql = f"replace({_sol_sql}, {q(' ' + _a)}, {q(' ' + _b)})"
register("map_solution_labels", f"SELECT doc_id, {_sol_sql} AS solution FROM ({_OPTS_SQL}) x")(
    lambda spark, sf: _opts(spark, sf).select("doc_id", X.map_solution_labels(
        F.concat(F.lit("Answer : "), F.array_join("words", " A "))).alias("solution")))

_opt_text_sql = ("concat(doc_id::VARCHAR, ' Options:', chr(10), array_to_string(list_transform(words, lambda c, i: '(' || "
                 "substr('ABCDEFGH', i, 1) || ') ' || c), chr(10)))")
_pat19 = f"\\(({WORD_CHAR})\\){WS_CLASS}+(.+)"


@register("options_from_text", f"""SELECT doc_id, array_to_string(list_transform(
    list_zip(regexp_extract_all(a, {q(_pat19)}, 1), regexp_extract_all(a, {q(_pat19)}, 2)),
    lambda e: {O.lookup(X.OPTION_LABELS_BN, "'(' || e[1] || ')'")} || ' ' || {O.strip('e[2]')}), '|') AS options
FROM (SELECT doc_id, substr(t, strpos(t, 'Options:') + 8) AS a
      FROM (SELECT doc_id, {_opt_text_sql} AS t FROM ({_OPTS_SQL}) x) y) z""")
def q_options_from_text(spark, sf):
    o = _opts(spark, sf)
    t = F.concat(F.col("doc_id").cast("string"), F.lit(" Options:\n"), F.array_join(F.transform(
        "words", lambda c, i: F.concat(F.lit("("), F.substring(F.lit("ABCDEFGH"), (i + 1).cast("int"), 1),
                                       F.lit(") "), c)), "\n"))
    return o.select("doc_id", F.array_join(X.options_from_text(t), "|").alias("options"))


@register("zip_to_map", f"""SELECT doc_id, k AS "key", arg_max(v, pos) AS "value" FROM (
  SELECT doc_id, substr(w, 1, 1) AS k, w AS v, pos
  FROM (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS pos FROM ({_OPTS_SQL}) x) y) z
GROUP BY doc_id, k""")
def q_zip_to_map(spark, sf):
    o = _opts(spark, sf)
    keys = F.transform("words", lambda w: F.substring(w, 1, 1))
    m = X.zip_to_map(keys, F.col("words"))
    return o.select("doc_id", F.explode(m).alias("key", "value"))


# --- B31, B33, B53, B54, C3 on parsed translation messages --------------------------------------------
_translation_sql = _notes  # tag (or whole message) with notes cut


@register("parse_json_strict", R(f"""SELECT idx,
  CASE WHEN json_valid(t) AND starts_with(t, '{{') THEN json_extract_string(t, '$.question') END AS question,
  CASE WHEN json_valid(t) AND starts_with(t, '{{') THEN json_extract_string(t, '$.answer') END AS answer
FROM (SELECT idx, {_translation_sql} AS t FROM fx_messages) x""", "fx_messages"))
def q_parse_json(spark, sf):
    m = fx_messages(spark, sf)
    t = X.strip_notes(X.extract_tag("message", "bangla_translation", "whole"))
    p = X.parse_json_strict(t, "struct<question:string,answer:string>")
    return m.select("idx", p["question"].alias("question"), p["answer"].alias("answer"))


@register("text_length_ratio", R(f"""SELECT idx, tl AS translated_len, ol AS original_len, tl > 3 * ol AS overlong
FROM (SELECT idx, length(coalesce(json_extract_string(t, '$.question'), '')) + length(coalesce(json_extract_string(t, '$.answer'), '')) AS tl,
             length(original) AS ol
      FROM (SELECT idx, original, {_translation_sql} AS t FROM fx_messages) x
      WHERE json_valid(t) AND starts_with(t, '{{')) y""", "fx_messages"))
def q_length_ratio(spark, sf):
    m = fx_messages(spark, sf)
    p = X.parse_json_strict(X.strip_notes(X.extract_tag("message", "bangla_translation", "whole")),
                            "struct<question:string,answer:string>")
    d = m.select("idx", "original", p.alias("p")).where(F.col("p").isNotNull())
    tl = X.text_length(F.col("p.question")) + X.text_length(F.col("p.answer"))
    return d.select("idx", tl.cast("bigint").alias("translated_len"), F.length("original").cast("bigint").alias("original_len"),
                    X.length_ratio_flag(tl, F.length("original")).alias("overlong"))


register("filter_overlong", R(f"""SELECT idx FROM (SELECT idx,
  length(coalesce(json_extract_string(t, '$.question'), '')) + length(coalesce(json_extract_string(t, '$.answer'), '')) AS tl,
  length(original) AS ol FROM (SELECT idx, original, {_translation_sql} AS t FROM fx_messages) x
  WHERE json_valid(t) AND starts_with(t, '{{')) y WHERE tl > 3 * ol""", "fx_messages"))(
    lambda spark, sf: q_length_ratio(spark, sf).where(F.col("overlong")).select("idx"))

_gap_json = ("'{\"label\": ' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE CAST(doc_id AS VARCHAR) END || "
             "', \"text\": \"  ' || lang || '  \"' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE ', \"endings\": [\"' || source || '\"]' END || '}'")


@register("patch_field_gaps", f"""SELECT doc_id, json_extract_string(p, '$.label') AS label,
  {O.strip("coalesce(json_extract_string(p, '$.text'), '')")} AS text,
  coalesce(array_to_string(CAST(json_extract(p, '$.endings') AS VARCHAR[]), '|'), '') AS endings
FROM (SELECT doc_id, regexp_replace({_gap_json}, '"label":{WS_CLASS}*,', '"label": null,', 'g') AS p FROM documents) x""")
def q_patch_gaps(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    raw = F.concat(F.lit('{"label": '), F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(
        F.col("doc_id").cast("string")), F.lit(', "text": "  '), F.col("lang"), F.lit('  "'),
        F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(
            F.concat(F.lit(', "endings": ["'), F.col("source"), F.lit('"]'))), F.lit("}"))
    p = X.patch_field_gaps(raw, "struct<label:string,text:string,endings:array<string>>",
                           text_fields=["text"], list_fields=["endings"])
    return d.select("doc_id", p["label"].alias("label"), p["text"].alias("text"),
                    F.array_join(p["endings"], "|").alias("endings"))


@register("project_pair", R(f"""SELECT idx, {O.strip("coalesce(json_extract_string(t, '$.question'), '')")} AS question,
  {O.strip("coalesce(json_extract_string(t, '$.answer'), '')")} AS answer
FROM (SELECT idx, {_translation_sql} AS t FROM fx_messages) x WHERE json_valid(t) AND starts_with(t, '{{')""", "fx_messages"))
def q_project_pair(spark, sf):
    m = fx_messages(spark, sf)
    p = X.parse_json_strict(X.strip_notes(X.extract_tag("message", "bangla_translation", "whole")),
                            "struct<question:string,answer:string>")
    return (m.select("idx", p.alias("p")).where(F.col("p").isNotNull())
            .select("idx", *[c.alias(n) for n, c in X.project_pair(F.col("p"), ["question", "answer"]).items()]))


# --- B39-B49, B55: result-file names and contents -------------------------------------------------------
register("parse_result_name", R(f"SELECT path, {N.parse_name_sql('path')} FROM ({N.result_files_sql()}) f "
                                f"WHERE regexp_matches(regexp_replace(path, '^.*/', ''), {q(N.NAME_PATTERN)})",
                                "fx_responses"))(
    lambda spark, sf: N.parse_result_name(N.fx_result_files(spark, sf)).select(
        "path", "dataset", "model", "metric"))

register("split_path_columns", R(f"SELECT path, {N.split_path_sql('path')} FROM ({N.result_files_sql()}) f",
                                 "fx_responses"))(
    lambda spark, sf: N.split_path_columns(N.fx_result_files(spark, sf)).select(
        "path", "lang", "dataset", "model", "metric", "model_family"))

register("normalize_model", R(f"SELECT path, {N.normalize_model_sql(N.raw_model_sql('path'))} AS model_norm "
                              f"FROM ({N.result_files_sql()}) f", "fx_responses"))(
    lambda spark, sf: N.fx_result_files(spark, sf).select(
        "path", N.normalize_model(N.raw_model(F.col("path"))).alias("model_norm")))

register("rename_lookup", R(f"""SELECT path, {N.rename_sql(N.normalize_model_sql(N.raw_model_sql('path')), N.MODEL_RENAMING)} AS model,
  {N.rename_sql(N.dataset_part_sql('path'), N.DATASET_RENAMING)} AS dataset
FROM ({N.result_files_sql()}) f""", "fx_responses"))(
    lambda spark, sf: N.fx_result_files(spark, sf).select(
        "path", N.rename(N.normalize_model(N.raw_model(F.col("path"))), N.MODEL_RENAMING).alias("model"),
        N.rename(N.dataset_part(F.col("path")), N.DATASET_RENAMING).alias("dataset")))

register("metric_type", R(f"SELECT path, {N.metric_type_sql(N.metric_part_sql('path'))} AS metric_type "
                          f"FROM ({N.result_files_sql()}) f", "fx_responses"))(
    lambda spark, sf: N.fx_result_files(spark, sf).select(
        "path", N.metric_type(N.metric_part(F.col("path"))).alias("metric_type")))

register("model_size", R(f"SELECT model, {N.model_size_sql('model')} AS model_size FROM "
                         f"(SELECT DISTINCT {N.raw_model_sql('path')} AS model FROM ({N.result_files_sql()}) f) m",
                         "fx_responses"))(
    lambda spark, sf: N.fx_result_files(spark, sf).select(N.raw_model(F.col("path")).alias("model")).distinct()
    .select("model", N.model_size(F.col("model")).alias("model_size")))

register("split_lang_suffix", R(f"""SELECT folder, regexp_extract(folder, '^(.*)-([^-]*)$', 1) AS name,
  regexp_extract(folder, '^(.*)-([^-]*)$', 2) AS lang
FROM (SELECT DISTINCT {N.folder_sql('path')} AS folder FROM ({N.result_files_sql()}) f) x""", "fx_responses"))(
    lambda spark, sf: N.fx_result_files(spark, sf).select(N.folder(F.col("path")).alias("folder")).distinct()
    .select("folder", *N.split_lang_suffix(F.col("folder"))))

register("lang_from_folder", R(f"SELECT path, {N.lang_from_folder_sql(N.folder_sql('path'))} AS lang "
                               f"FROM ({N.result_files_sql()}) f", "fx_responses"))(
    lambda spark, sf: N.fx_result_files(spark, sf).select(
        "path", N.lang_from_folder(N.folder(F.col("path"))).alias("lang")))

register("dataset_from_filename", R(f"SELECT path, {N.dataset_from_filename_sql('path')} AS dataset "
                                    f"FROM ({N.result_files_sql()}) f", "fx_responses"))(
    lambda spark, sf: N.fx_result_files(spark, sf).select(
        "path", N.dataset_from_filename(F.col("path")).alias("dataset")))

register("try_number", R(f"SELECT path, TRY_CAST(trim(content) AS DOUBLE) AS score FROM ({N.result_files_sql()}) f "
                         f"WHERE TRY_CAST(trim(content) AS DOUBLE) IS NOT NULL", "fx_responses"))(
    lambda spark, sf: N.try_number(N.fx_result_files(spark, sf), "content", "score").select("path", "score"))

register("file_safe_name", "SELECT page_id, replace(url, '/', '-') AS safe FROM pages")(
    lambda spark, sf: table(spark, sf, "pages").select("page_id", X.file_safe_name("url").alias("safe")))

# the importer end to end: names -> normalised keys -> known only -> last file wins
register("import_result_tree", R(f"SELECT * FROM ({N.import_sql()}) i", "fx_responses"))(
    lambda spark, sf: N.import_scores(N.fx_result_files(spark, sf)))
