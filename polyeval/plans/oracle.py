"""DuckDB SQL fragments that restate the engine's column rules for the oracle.

Only used to build the check queries in ``__spark_entry__.oracle_sql``; the
engine itself never runs these strings.
"""

from __future__ import annotations

from polyeval.functions.text import OPTIONS_DELIMITER, WS_CLASS
from polyeval.operators import scoring as S


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g')"


def clean(r: str) -> str:
    t = f"coalesce({r}, '')"
    return strip(f"CASE WHEN contains({t}, '<think>') AND contains({t}, '</think>') "
                 f"THEN regexp_replace({t}, '(?s)<think>.*?</think>{WS_CLASS}*', '', 'g') ELSE {t} END")


def options(prompt: str, lang: str) -> str:
    p = f"coalesce({prompt}, '')"
    bn, en = OPTIONS_DELIMITER["bn"], OPTIONS_DELIMITER["en"]
    return strip(
        f"CASE WHEN {lang} = 'bn' THEN "
        f"(CASE WHEN strpos({p}, {q(bn)}) > 0 THEN substr({p}, strpos({p}, {q(bn)}) + length({q(bn)})) ELSE {p} END) "
        f"ELSE (CASE WHEN strpos({p}, {q(en)}) > 0 THEN substr({p}, strpos({p}, {q(en)}) + length({q(en)})) ELSE {p} END) END")


def tag(r: str, lang: str) -> str:
    def one(t):
        pat = f"<{t}>(.*?)</{t}>"
        return f"CASE WHEN regexp_matches({r}, {q(pat)}) THEN regexp_extract({r}, {q(pat)}, 1) END"
    return f"(CASE WHEN {lang} = 'bn' THEN {one('উত্তর')} ELSE {one('answer')} END)"


def lookup(mapping: dict, x: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"(CASE {x} {whens} ELSE {x} END)"


def inlist(items) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


def variant(ds: str, lang: str) -> str:
    return (f"(CASE WHEN {ds} = 'boolq' THEN 'boolq' WHEN {ds} = 'gsm8k' THEN 'gsm8k' "
            f"WHEN {ds} = 'cqsa' AND {lang} = 'bn' THEN 'cqsa_bn' "
            f"WHEN {ds} = 'winogrande' AND {lang} = 'bn' THEN 'winogrande_bn' "
            f"WHEN {ds} = 'winogrande' AND {lang} = 'en' THEN 'winogrande_en' "
            f"WHEN {ds} = 'hellaswag' AND {lang} = 'en' THEN 'hellaswag_en' "
            f"WHEN {ds} = 'hellaswag' AND {lang} = 'bn' THEN 'hellaswag_bn' ELSE 'generic' END)")


def right(r: str, ans: str, v: str, lang: str) -> str:
    a = f"coalesce({ans}, '')"
    t = tag(r, lang)
    return (f"coalesce(CASE WHEN {v} = 'boolq' THEN lower({lookup(S.BOOLQ_MAP, r)}) = lower({a}) "
            f"WHEN {v} = 'gsm8k' THEN coalesce({t} = {a}, false) "
            f"WHEN {v} = 'cqsa_bn' THEN {lookup(S.CQSA_BN_MAP, r)} = {a} "
            f"WHEN {v} = 'winogrande_bn' THEN {lookup(S.WINOGRANDE_BN_MAP, r)} = {a} "
            f"WHEN {v} = 'winogrande_en' THEN {lookup(S.WINOGRANDE_EN_MAP, r)} = {a} "
            f"WHEN {v} = 'hellaswag_en' THEN lower({lookup(S.HELLASWAG_EN_MAP, r)}) = lower({a}) "
            f"WHEN {v} = 'hellaswag_bn' THEN lower({lookup(S.HELLASWAG_BN_MAP, r)}) = lower({a}) "
            f"ELSE {r} = {a} END, false)")


def error(r: str, opts: str, v: str, lang: str) -> str:
    t = tag(r, lang)
    digits = f"replace(replace({t}, ',', ''), ' ', '')"
    num_ok = (f"(CASE WHEN {lang} = 'bn' THEN regexp_matches({digits}, '^[০-৯]+$') "
              f"ELSE regexp_matches({digits}, '^[0-9]+$') END)")
    m = lookup(S.CQSA_BN_MAP, r)
    cqsa_ok = " OR ".join(f"({m} = {q(lat)} AND contains({opts}, {q(bn)}))"
                          for bn, lat in S.CQSA_BN_MAP.items())
    generic_ok = f"(({r} = '' AND {opts} <> '') OR (length({r}) = 1 AND strpos({opts}, {r}) > 0))"
    return (f"coalesce(CASE WHEN {v} = 'boolq' THEN lower({lookup(S.BOOLQ_MAP, r)}) NOT IN {inlist(S.BOOLQ_OPTIONS)} "
            f"WHEN {v} = 'gsm8k' THEN (CASE WHEN {t} IS NULL THEN true ELSE NOT {num_ok} END) "
            f"WHEN {v} = 'cqsa_bn' THEN NOT ({cqsa_ok}) "
            f"WHEN {v} = 'winogrande_bn' THEN {r} NOT IN {inlist(S.WINOGRANDE_BN_OPTIONS)} "
            f"WHEN {v} = 'winogrande_en' THEN {r} NOT IN {inlist(S.WINOGRANDE_EN_OPTIONS)} "
            f"WHEN {v} = 'hellaswag_bn' THEN lower({r}) NOT IN {inlist(S.HELLASWAG_BN_OPTIONS)} "
            f"WHEN {v} = 'hellaswag_en' THEN lower({r}) NOT IN {inlist(S.HELLASWAG_EN_OPTIONS)} "
            f"ELSE NOT {generic_ok} END, true)")


def scored_rows_sql() -> str:
    """fx_responses with clean_response, options, right, error (as a subquery)."""
    return f"""
SELECT s.*, {right('s.clean_response', 's.ground_truth', 's.v', 's.lang')} AS "right",
       {error('s.clean_response', 's.options', 's.v', 's.lang')} AS error
FROM (SELECT f.*, {clean('f.response')} AS clean_response,
             {options('f.prompt', 'f.lang')} AS options,
             {variant('f.dataset', 'f.lang')} AS v
      FROM fx_responses f) s
"""


def score_table_sql(where: str = "", by=("dataset", "lang", "model")) -> str:
    keys = ", ".join(by)
    w = f"WHERE {where}" if where else ""
    return f"""
SELECT {keys}, CAST(sum(CAST("right" AS BIGINT)) AS BIGINT) AS "right", CAST(sum(CAST(error AS BIGINT)) AS BIGINT) AS errors,
       count(*) AS "rows",
       CAST(sum(CAST("right" AS BIGINT)) AS DOUBLE) / count(*) AS accuracy,
       CAST(sum(CAST(error AS BIGINT)) AS DOUBLE) / count(*) AS rer
FROM ({scored_rows_sql()}) x {w}
GROUP BY {keys}
"""
