"""Registered repair and log queries (B32, J6, C7, D3/D4 on repairs, I1-I5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyeval.functions import text as X
from polyeval.operators import joins as J
from polyeval.operators import repair as RP
from polyeval.plans import oracle as O
from polyeval.plans.catalog import register
from polyeval.plans.fixtures import fx_broken, fx_chat, fx_log, fx_messages, table, with_views
from polyeval.plans.oracle import q

SCHEMA = "struct<question:string,answer:string>"
KEYS = ["question", "answer"]
_tag_pat = "(?s)<bangla_translation>(.*?)</bangla_translation>"
_TRANSLATION_SQL = O.strip(
    f"split_part((CASE WHEN regexp_matches(message, {q(_tag_pat)}) THEN "
    f"{O.strip(f'regexp_extract(message, {q(_tag_pat)}, 1)')} ELSE message END), '<translator_notes>', 1)")


def _translations(spark, sf):
    m = fx_messages(spark, sf)
    return m.select("idx", "original", X.strip_notes(X.extract_tag("message", "bangla_translation", "whole"))
                    .alias("translation"))


# --- I1 index per log line --------------------------------------------------------------------
register("log_error_index", with_views(" UNION ALL ".join(
    f"SELECT line_no, '{k}' AS kind, CAST(regexp_extract(line, {q(p)}, 1) AS BIGINT) AS idx FROM fx_log "
    f"WHERE regexp_matches(line, {q(p)})" for k, p in RP.LOG_PATTERNS), "fx_log"))(
    lambda spark, sf: RP.log_error_index(fx_log(spark, sf), dedupe=False))

register("log_affected_indexes", with_views("SELECT idx, min(kind) AS kind FROM (" + " UNION ALL ".join(
    f"SELECT '{k}' AS kind, CAST(regexp_extract(line, {q(p)}, 1) AS BIGINT) AS idx FROM fx_log "
    f"WHERE regexp_matches(line, {q(p)})" for k, p in RP.LOG_PATTERNS) + ") x GROUP BY idx", "fx_log"))(
    lambda spark, sf: RP.log_error_index(fx_log(spark, sf), dedupe=True))

# --- I2 / I3 detection lines ------------------------------------------------------------------------
register("log_drop_kind", with_views(
    "SELECT line_no, line FROM fx_log WHERE NOT contains(line, 'Detected English entry')", "fx_log"))(
    lambda spark, sf: RP.log_drop_kind(fx_log(spark, sf)))

STAMP = "2024-01-02 00:00:00,000"
_ratio = "(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(text) END)"


def _detected_sql():
    from polyeval.plans.q_text import _detect_sql
    return f"SELECT doc_id FROM documents WHERE coalesce({_ratio} >= 0.3, false) AND {_detect_sql('text')} = 'en'"


register("log_append_detection", with_views(f"""SELECT line FROM fx_log WHERE NOT contains(line, 'Detected English entry')
UNION ALL SELECT '{STAMP}:ERROR:Detected English entry at index ' || CAST(doc_id AS VARCHAR) || '. Using original entry.'
FROM ({_detected_sql()}) d""", "fx_log"))(
    lambda spark, sf: RP.log_append_detection(
        fx_log(spark, sf),
        X.with_language(table(spark, sf, "documents").select("doc_id", "text").where(X.ascii_flag("text")), "text")
        .where(F.col("detected") == "en").select(F.col("doc_id").alias("idx")), STAMP))


# --- I5 bodies of batch output lines ------------------------------------------------------------------
def _batch_lines(spark, sf):
    c = fx_chat(spark, sf)
    msg = F.array(F.struct(F.struct(F.lit("assistant").alias("role"), F.col("response").alias("content"))
                           .alias("message")))
    body = F.when(F.col("turn") % 4 != 0, F.struct(msg.alias("choices")))
    line = F.to_json(F.struct(F.concat(F.lit("task-"), F.col("conv_id").cast("string"), F.lit("-"),
                                       F.col("turn").cast("string")).alias("custom_id"),
                              F.struct(F.lit(200).alias("status_code"), body.alias("body")).alias("response")))
    return c.select("conv_id", "turn", line.alias("line"))


register("extract_body", with_views(
    "SELECT conv_id, turn, response AS content FROM fx_chat WHERE turn % 4 <> 0", "fx_chat"))(
    lambda spark, sf: RP.extract_body(_batch_lines(spark, sf)).select("conv_id", "turn", "content"))

# --- C7 lines whose JSON does not parse -----------------------------------------------------------------
register("filter_broken_json", with_views(f"""SELECT idx FROM (SELECT idx, {_TRANSLATION_SQL} AS t FROM fx_messages) x
WHERE NOT (json_valid(t) AND starts_with(t, '{{') AND ends_with(t, '}}'))""", "fx_messages"))(
    lambda spark, sf: _translations(spark, sf).where(
        X.parse_json_strict(F.col("translation"), SCHEMA).isNull()).select("idx"))


# --- B32 / J6 attempt chain; I4 report; D3 fallback on failures -----------------------------------------------
# The oracle states, for each shape of fx_broken (fixtures.BROKEN_SHAPES), the
# status and the fields after the repair: worked out from the rules of each family.
# A value pattern that reaches past a missing comma swallows the next member, as the
# rules have it. # is the row's text as it comes out: unchanged where the record
# parses as it is (text); without blanks around structure characters after the loose
# fix (tight); with runs of blanks as one after a repair (blank); as its escaped form
# where the values were encoded anew (again), without escaped quotes after the maths
# rules (maths); line feeds as blanks where it stood raw (raw).
_MERGED = '#" "answer": "C'
_FAILED = ("failed", None, None)
_QUESTIONS = {
    0: ("parsed", "#", "A"), 1: ("loose", "#", "B"), 2: ("repaired", _MERGED, None), 3: ("repaired", "#", "D"),
    4: ("repaired", 'say "#" now', "E"), 5: ("repaired", '# x" "answer": "F', None), 6: ("repaired", '#" "answer": "3', None),
    7: ("repaired", "#", '["a","b"]'), 8: _FAILED, 9: _FAILED, 10: ("repaired", "\\q #", "H"),
    11: ("repaired", 'f("1 2") of "$x$" #', "I"), 12: _FAILED, 13: ("parsed", "#", None),
    14: ("repaired", '৩ #" "answer": "৭', None)}
_SENTENCES = {**_QUESTIONS, 6: ("repaired", "#", "3"), 7: _FAILED, 8: ("repaired", '# \\"', "G")}
_TASKS = {**_SENTENCES, 8: ("repaired", '# "', "G"), 14: ("repaired", '3 #" "answer": "7', None)}
_MATHS = {k: v if v[0] in ("parsed", "loose") else _FAILED for k, v in _TASKS.items()} | {
    3: ("repaired", "#", "D"), 6: ("repaired", "#", "3"), 7: ("repaired", "#", "[a, b]"), 14: ("repaired", "3 #", "7")}
_LABELS = {**_QUESTIONS, 12: ("repaired", "#", "J")}
_BLANKS = f"regexp_replace(e, '{X.WS_CLASS}+', ' ', 'g')"
_TIGHT = (f"regexp_replace(regexp_replace(e, '{X.WS_CLASS}*([{{}}\\[\\]:,]){X.WS_CLASS}*', '\\1', 'g'), "
          f"'{X.WS_CLASS}+', ' ', 'g')")


def _unescaped(value: str) -> str:
    return f"""json_extract_string('{{"v":"' || {value} || '"}}', '$.v')"""


_MATHS_E = f"""replace({_BLANKS}, '\\"', '')"""
_FORMS = {"text": "w", "tight": _unescaped(_TIGHT), "blank": _unescaped(_BLANKS), "again": _BLANKS,
          "maths": _MATHS_E, "maths blank": _unescaped(_MATHS_E), "raw": f"regexp_replace(raw, '{X.WS_CLASS}+', ' ', 'g')"}
# form of # by shape: the family's own, but for these
_SPECIAL = {0: "text", 13: "text", 1: "tight", 5: "raw"}
_QUESTION_FORMS = {**{k: "blank" for k in range(15)}, 10: "again", **_SPECIAL}
_FORM_OF = {"Q": _QUESTION_FORMS, "S": {**_QUESTION_FORMS, 6: "again", 8: "again"},
            "T": {**{k: "again" for k in range(15)}, 6: "blank", **_SPECIAL},
            "M": {**{k: "maths" for k in range(15)}, 6: "maths blank", 14: "maths blank", **_SPECIAL}}


def _case(expected, field, family):
    def text(k, v):
        return "NULL" if v is None else "replace(" + q(v) + f", '#', {_FORMS[_FORM_OF[family][k]]})"
    return "CASE shape " + " ".join(f"WHEN {k} THEN {q(v[0]) if field == 0 else text(k, v[field])}"
                                    for k, v in expected.items()) + " END"


def _expected_sql(expected, family):
    return with_views(f"SELECT idx, {_case(expected, 0, family)} AS status, {_case(expected, 1, family)} AS question, "
                      f"{_case(expected, 2, family)} AS answer FROM fx_broken", "fx_broken")


def _attempts(spark, sf, family, **extra):
    return RP.repair_attempts(fx_broken(spark, sf), "translation", SCHEMA, KEYS, family, **extra)


def _fields(attempts):
    return attempts.select("idx", "status", F.col("parsed.question").alias("question"), F.col("parsed.answer").alias("answer"))


register("repair_json", _expected_sql(_QUESTIONS, "Q"))(lambda spark, sf: _fields(_attempts(spark, sf, "Q")))
register("repair_json_sentences", _expected_sql(_SENTENCES, "S"))(lambda spark, sf: _fields(_attempts(spark, sf, "S", extra=[RP.r10])))
# the profile of a data set by name: keys, family and extra steps come from the table
register("repair_json_tasks", _expected_sql(_TASKS, "T"))(
    lambda spark, sf: _fields(RP.repair_dataset(fx_broken(spark, sf), "translation", SCHEMA, "gsm8k")))
register("repair_json_maths", _expected_sql(_MATHS, "M"))(lambda spark, sf: _fields(_attempts(spark, sf, "T", use_r9=True)))
register("repair_json_labels", _expected_sql(_LABELS, "Q"))(lambda spark, sf: _fields(_attempts(spark, sf, "Q", pre=[RP.r13, RP.r3])))
_STATUS = {k: ("incomplete", *v[1:]) if v[0] != "failed" and None in v else v for k, v in _QUESTIONS.items()}
register("repair_report", with_views(f"SELECT status, count(*) AS n FROM (SELECT {_case(_STATUS, 0, 'Q')} AS status FROM fx_broken) x "
                                     "GROUP BY status", "fx_broken"))(
    lambda spark, sf: RP.repair_report(_attempts(spark, sf, "Q"), KEYS))


@register("translations_table", with_views(f"""SELECT d.doc_id AS idx,
  CASE WHEN b.status NOT IN ('failed', 'incomplete') THEN b.question ELSE d.text END AS question,
  CASE WHEN b.status NOT IN ('failed', 'incomplete') THEN b.answer END AS answer,
  CASE WHEN b.status NOT IN ('failed', 'incomplete') THEN 'translated' ELSE 'original' END AS status
FROM documents d LEFT JOIN (SELECT idx, {_case(_STATUS, 0, 'Q')} AS status, {_case(_STATUS, 1, 'Q')} AS question,
    {_case(_STATUS, 2, 'Q')} AS answer FROM fx_broken) b ON b.idx = d.doc_id""", "fx_broken"))
def q_translations(spark, sf):
    """Final table: repaired translation where it has every key, the original
    record otherwise (D3), keyed by index over all documents."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), F.col("text").alias("question"),
                                                F.lit(None).cast("string").alias("answer"))
    # failed records have no field, so they fall back as well
    a = _attempts(spark, sf, "Q").select(
        "idx", F.lit(1).alias("attempt"), *[F.col(f"parsed.{k}").alias(k) for k in KEYS])
    return J.fallback_to_original(docs, a, "idx", KEYS, order="attempt")
