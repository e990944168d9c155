"""Translation repair.

One ``translations`` table with a ``status`` column replaces the reference's
log-and-rewrite loop: every attempt is a filtered subset that is joined back
by index. The order of attempts is: plain parse, loose fix (r12), the
dataset's repair profile, a retry through the model runner (J4), and finally
the original record (D3).

Plain repair rules are Java regular expressions (``regexp_replace``; Java
supports the look-arounds the rules need). The two rules that rewrite each
JSON value through a callback (r6, r8) run in Arrow-batched pandas UDFs, and
only for the rows that still fail to parse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyeval.functions.text import (BANGLA_DIGITS, LATIN_DIGITS, WORD_CHAR, WS_JAVA, bind,
                                     normalize_whitespace, parse_json_strict)

# ---------------------------------------------------------------------------
# Log patterns of the translation scripts (kind, pattern)
# ---------------------------------------------------------------------------
LOG_PATTERNS = [
    ("json_decoding", r"ERROR:JSON decoding error at index (\d+)"),
    ("failed_translate", r"ERROR:Failed to translate entry index (\d+)"),
    ("english", r"ERROR:Detected English entry at index (\d+)"),
    ("exception", r"ERROR:Exception for entry index (\d+)"),
    ("error_processing", r"Error processing index (\d+)"),
    ("error_decoding", r"Error decoding JSON at index (\d+)"),
    ("failed_extract", r"Error: Failed to extract data at index (\d+)"),
]
ENGLISH_LINE = "ERROR:Detected English entry at index {idx}. Using original entry."
DETECTED_MARK = "Detected English entry"


# ---------------------------------------------------------------------------
# logs
# ---------------------------------------------------------------------------
def log_error_index(lines: DataFrame, line: str = "line", patterns=LOG_PATTERNS,
                    dedupe: bool = True) -> DataFrame:
    """(line_no..., kind, idx) for every pattern a line matches; a line
    may match several. ``dedupe`` keeps one row per index (processing an
    index twice gives the same result)."""
    hits = F.array(*[F.when(F.col(line).rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract(
        F.col(line), p, 1).cast("bigint").alias("idx"))) for k, p in patterns])
    keep = [c for c in lines.columns if c != line]
    out = lines.select(*keep, F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("_h")) \
        .select(*keep, "_h.kind", "_h.idx")
    if dedupe:
        out = out.groupBy("idx").agg(F.min("kind").alias("kind"))
    return out


def log_drop_kind(lines: DataFrame, mark: str = DETECTED_MARK, line: str = "line") -> DataFrame:
    """Remove earlier detection lines before a new scan."""
    return lines.where(~F.col(line).contains(mark))


def log_append_detection(lines: DataFrame, detected: DataFrame, stamp: str, idx: str = "idx",
                         line: str = "line") -> DataFrame:
    """The log without old detection lines, plus one line per new hit."""
    new = detected.select(F.concat(F.lit(stamp + ":"), F.lit("ERROR:Detected English entry at index "),
                                   F.col(idx).cast("string"), F.lit(". Using original entry.")).alias(line))
    return log_drop_kind(lines.select(line), line=line).unionByName(new)


def extract_body(lines: DataFrame, line: str = "line") -> DataFrame:
    """``response.body`` of each batch-output line (content of the first
    choice); lines without a body are dropped (they are reported by
    ``missing_body``)."""
    body = F.get_json_object(F.col(line), "$.response.body")
    content = F.get_json_object(F.col(line), "$.response.body.choices[0].message.content")
    return lines.where(body.isNotNull()).withColumn("content", content)


def missing_body(lines: DataFrame, line: str = "line") -> DataFrame:
    return lines.where(F.get_json_object(F.col(line), "$.response.body").isNull())


# ---------------------------------------------------------------------------
# Repair steps. The patterns and replacements of r1 to r14
# ---------------------------------------------------------------------------
def r1(t: Column) -> Column:
    """curly quotes to straight quotes"""
    return F.regexp_replace(t, "[“”]", '"')


def r2(t: Column) -> Column:
    """every single quote to a double quote"""
    return F.regexp_replace(t, "'", '"')


def r3(t: Column) -> Column:
    """remove single quotes next to double quotes"""
    t = F.regexp_replace(t, "(?<=\")'", "")
    t = F.regexp_replace(t, "'(?=\")", "")
    t = F.regexp_replace(t, r"(?<!\\)'" + WS_JAVA + r"*(?=\\\")", "")
    return F.regexp_replace(t, r"(?<=\\\")'", "")


def r4(t: Column) -> Column:
    """unquote arrays: ``"k": "[...]"`` -> ``"k": [...]``"""
    return F.regexp_replace(t, rf'("{WORD_CHAR}+":){WS_JAVA}*"(\[(?d:.)*?\])"', "$1 $2")


def r5(t: Column) -> Column:
    """quote bare values (numbers, booleans and null become text)"""
    return F.regexp_replace(t, rf'{WS_JAVA}*("{WORD_CHAR}+"):{WS_JAVA}*({WORD_CHAR}+)', ' $1: "$2"')


# What a `"key": "value"` member looks like to the question and
# sentence sets ("text") and to the task and maths sets ("task"). The key of the
# first is a string token (its loop is possessive, so that long texts need no stack).
MEMBER_PATTERNS = {
    "text": rf'(?s)("(?:[^"\\]|\\.)*+"){WS_JAVA}*:{WS_JAVA}*"(.*?)(?<!\\)"(?={WS_JAVA}*[,\n}}])',
    "task": rf'(?s)("[^"]+"){WS_JAVA}*:{WS_JAVA}*"(.*?)"(?={WS_JAVA}*[,\n}}])',
}


def bare_quotes(value: Column) -> Column:
    """Escape what JSON does not allow bare: line feeds, and quotes that have no backslash yet."""
    return F.regexp_replace(F.replace(value, F.lit("\n"), F.lit("\\n")), r'(?<!\\)"', r'\\"')


def json_text(value: Column) -> Column:
    """The whole value as a JSON encoder writes it (backslashes are doubled)."""
    # {"v":"..."}
    return bind(F.to_json(F.struct(value.alias("v"))), lambda record: F.substring(record, F.lit(7), F.length(record) - 8))


def encode_members(t: Column, kind: str, encode) -> Column:
    """The text with every member value passed through ``encode``; the rest, the
    pieces between the matches, stays as it is."""
    pattern = F.lit(MEMBER_PATTERNS[kind])

    def rebuilt(x):
        made = F.zip_with(F.regexp_extract_all(x, pattern, 1), F.regexp_extract_all(x, pattern, 2),
                          lambda key, value: F.concat(key, F.lit(': "'), encode(value), F.lit('"')))
        between = F.split(x, MEMBER_PATTERNS[kind], -1)
        return F.array_join(F.zip_with(between, F.concat(made, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return bind(t, rebuilt)


def r6(t: Column) -> Column:
    """escape bare quotes and newlines of each value"""
    return encode_members(t, "text", bare_quotes)


def r7(t: Column, keys: list[str]) -> Column:
    """insert a comma between consecutive known keys; collapse ``,,``"""
    for a, b in zip(keys, keys[1:]):
        t = F.regexp_replace(t, rf'(?d)("{a}":.*?)(?={WS_JAVA}*?"{b}":)(?!,)', "$1, ")
    return F.regexp_replace(t, rf",{WS_JAVA}*,", ",")


def r8(t: Column, kind: str = "text") -> Column:
    """encode each value anew; ``kind``: how members are found"""
    return encode_members(t, kind, json_text)


# Maths rules (r9), in the order they apply
R9_RULES = [
    (r"\$\\'", "\\$"),
    (r'"\?"', "?"),
    (r'"%"', "%"),
    (r'\\"', ""),
    (r'"(\\\((?d:.)*?\\\))"', "$1"),
    (r'\\?"(\d)"\\?', "$1"),
    (r'"(\{\\[^}]+\})"', "$1"),
    (r'"(\d+(\.\d+)?)"', "$1"),
    (r'"([A-Za-z])"', "$1"),
    (r'\(\\?"(\d[\d\s]*)\\?"\)', "($1)"),
    (r'"\$([^$]+)\$"', "\\$$1\\$"),
    (r'"(\$[^$]+\$)"', "$1"),
    (r"(\$[^$]+\$)'", "$1"),
]


def r9(t: Column, rules: list[int] | None = None) -> Column:
    for i, (p, rep) in enumerate(R9_RULES):
        if rules is None or i in rules:
            t = F.regexp_replace(t, p, rep)
    return t


def r10(t: Column) -> Column:
    """drop commas before a closing bracket"""
    return F.regexp_replace(t, rf",{WS_JAVA}*([}}\]])", "$1")


def r11(t: Column) -> Column:
    """Bangla digits to Latin before parsing"""
    return F.translate(t, BANGLA_DIGITS, LATIN_DIGITS)


def r12(t: Column) -> Column:
    """loose first-pass fix: single quotes to double, tight structure"""
    return normalize_whitespace(F.regexp_replace(t, "'", '"'), "c")


def r13(t: Column) -> Column:
    """blank label: ``"label": ,`` gets ``""``"""
    return F.regexp_replace(t, rf'"label":{WS_JAVA}*,', '"label": "",')


def r14(t: Column) -> Column:
    """stray ``}`` before ``, "response"``"""
    return F.regexp_replace(t, rf'\}}{WS_JAVA}*(,{WS_JAVA}*"response")', "$1")


# ---------------------------------------------------------------------------
# profiles: families of steps, and the data sets that use them
# ---------------------------------------------------------------------------
def _valid(t: Column, schema: str) -> Column:
    return parse_json_strict(t, schema).isNotNull()


def profile_q(t: Column, keys: list[str], schema: str, pre: list = ()) -> Column:
    """Q (question sets): one blank for all white space, ``pre``, r1 r2 r4 r5 r6; if
    still invalid, r7 on the text before r6, then r8."""
    t = normalize_whitespace(t, "a")
    for step in pre:
        t = step(t)
    return bind(r5(r4(r2(r1(t)))), lambda s0: bind(
        r6(s0), lambda s1: F.when(_valid(s1, schema), s1).otherwise(r8(r7(s0, keys)))))


def profile_s(t: Column, keys: list[str], schema: str, extra: list = ()) -> Column:
    """S (sentence sets): one blank for all white space, r1 r6; if still invalid, r7
    (after r6), ``extra``, then r8."""
    def finish(s1):
        s2 = r7(s1, keys)
        for step in extra:
            s2 = step(s2)
        return F.when(_valid(s1, schema), s1).otherwise(r8(s2))
    return bind(r6(r1(normalize_whitespace(t, "a"))), finish)


def profile_t(t: Column, keys: list[str], schema: str, maths: list[int] | None = None,
              use_r9: bool = False) -> Column:
    """T (tasks) and M (maths): one blank for all white space, r11 [r9] r1 r8 r7 r10, always."""
    s = r11(normalize_whitespace(t, "a"))
    if use_r9:
        s = r9(s, maths)
    return r10(r7(r8(r1(s), "task"), keys))


PROFILES = {
    "Q": profile_q,
    "S": profile_s,
    "T": profile_t,
}

_QUESTION_KEYS = ["id", "question_stem", "choices_text", "choices_label", "answerKey"]
_CONTINUATION_KEYS = ["activity_label", "ctx_a", "ctx_b", "ctx", "split", "split_type", "source_id"]

# Family, member keys in order and extra steps by data set
DATASET_PROFILES: dict[str, tuple[str, list[str], dict]] = {
    "arc": ("Q", ["id", "question", "choices", "answerKey"], {}),
    "openbookqa": ("Q", _QUESTION_KEYS, {}),
    "openbookqa-additional": ("Q", [*_QUESTION_KEYS, "fact1", "humanScore", "clarity", "turkIdAnonymized"], {}),
    "commonsenseqa": ("Q", ["id", "question", "question_concept", "choices", "answerKey"], {}),
    "hellaswag-dev": ("Q", _CONTINUATION_KEYS, {}),
    "hellaswag-test": ("Q", _CONTINUATION_KEYS, {"pre": [r13]}),
    "hellaswag-train": ("Q", _CONTINUATION_KEYS, {"pre": [r3]}),
    "winogrande": ("S", ["qID", "sentence", "option1", "option2", "answer"], {"extra": [r10]}),
    "siqa": ("S", ["context", "question", "answerA", "answerB", "answerC"], {}),
    "piqa": ("S", ["goal", "sol1", "sol2", "label"], {}),
    "mr-gsm8k-training": ("S", ["query", "response"], {"extra": [r10, r14]}),
    "boolq": ("T", ["question", "title", "answer", "passage"], {}),
    "bbh": ("T", ["input", "options", "target"], {}),
    "gsm8k": ("T", ["question", "answer"], {}),
    "mmlu": ("T", ["prompt", "A", "B", "C", "D", "answer"], {}),
    "mmlu-pro": ("T", ["question_id", "question", "options", "answer", "answer_index", "cot_content", "category", "src"], {}),
    "preference": ("T", ["chosen", "rejected"], {}),
    "math": ("T", ["problem", "level", "type", "solution"], {"use_r9": True}),
    "dolly": ("T", ["instruction", "context", "response", "category"], {"use_r9": True}),
}


def repair_attempts(df: DataFrame, text: str, schema: str, keys: list[str], family: str = "Q",
                    **kw) -> DataFrame:
    """The attempt chain on one text column. Adds ``parsed`` (struct) and
    ``status`` in {parsed, loose, repaired, failed}. Plain and loose parse run once
    for every row; the profile sees the text only of rows that both reject, null
    for the others."""
    t = F.col(text)
    plain = df.withColumn("_plain", parse_json_strict(t, schema))
    loose = plain.withColumn("_loose", F.when(F.col("_plain").isNull(), parse_json_strict(r12(t), schema)))
    todo = loose.withColumn("_todo", F.when(F.col("_plain").isNull() & F.col("_loose").isNull(), t))
    fixed = todo.withColumn("_fixed", parse_json_strict(PROFILES[family](F.col("_todo"), keys, schema, **kw), schema))
    return fixed.select(
        *df.columns, F.coalesce("_plain", "_loose", "_fixed").alias("parsed"),
        F.when(F.col("_plain").isNotNull(), "parsed").when(F.col("_loose").isNotNull(), "loose")
        .when(F.col("_fixed").isNotNull(), "repaired").otherwise("failed").alias("status"))


def repair_dataset(df: DataFrame, text: str, schema: str, dataset: str) -> DataFrame:
    """The attempt chain with the profile of a data set."""
    family, keys, extra = DATASET_PROFILES[dataset]
    return repair_attempts(df, text, schema, keys, family, **extra)


def incomplete(parsed: Column, keys: list[str]) -> Column:
    """True where a record was parsed but lacks a key (a repair that swallowed the next member)."""
    lacks = F.lit(False)
    for k in keys:
        lacks = lacks | parsed[k].isNull()
    return parsed.isNotNull() & lacks


def repair_report(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """I4: rows per status; parsed records that lack one of ``keys`` count as incomplete."""
    status = F.when(incomplete(F.col("parsed"), keys), "incomplete").otherwise(F.col("status"))
    return attempts.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
