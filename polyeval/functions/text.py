"""Column builders for text cleanup, extraction and measures.

Every function returns a ``Column`` built from ``pyspark.sql.functions`` so
that it stays inside whole-stage codegen. Regular expressions are written
for Java and avoid lookaround, so the same pattern text also runs in DuckDB
(RE2) for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour)
# ---------------------------------------------------------------------------
# Characters Python's str.strip()/str.isspace() treat as blank (code point ranges).
WS_RANGES = [(0x9, 0xD), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
             (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
WS_CLASS = "[" + "".join(rf"\x{{{a:X}}}" if a == b else rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in WS_RANGES) + "]"
# The same class as Java tests it fastest: single Latin-1 characters are one bit set, and one
# range check turns away almost all others. (The oracle's engine knows no class intersection.)
WS_JAVA = ("[" + "".join(rf"\x{c:02X}" for a, b in WS_RANGES if b < 0x100 for c in range(a, b + 1))
           + r"[\x{1680}-\x{3000}&&[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in WS_RANGES if b >= 0x100) + "]]]")
WS_CHARS = "".join(chr(c) for a, b in WS_RANGES for c in range(a, b + 1))
LATIN_DIGITS = "0123456789"
BANGLA_DIGITS = "০১২৩৪৫৬৭৮৯"
# Option-line starts recognised when lines of a prompt are listed as options.
OPTION_LINE_STARTS = ["A", "B", "C", "D", "E", " F", "G", "H", "I", "J", "K", "L", "M", "N",
                      "ক", "খ", "গ", "ঘ", "ঙ", "চ", "ছ", "জ", "ঝ", "ঞ", "ট", "ঠ", "ড", "ঢ",
                      "true", "false", "সত্য", "মিথ্যা"]
# Language-specific start of the options block in a rendered prompt.
OPTIONS_DELIMITER = {"bn": "বিকল্পসমূহ:", "en": "Options:"}
# Answer tags used by the maths datasets, per language.
ANSWER_TAG = {"bn": "উত্তর", "en": "answer"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x) -> Column:
    """Python ``str.strip()``: remove all Unicode blanks at both ends
    (``btrim`` with the blank set: looks at the ends only)."""
    return F.btrim(_c(x), F.lit(WS_CHARS))


def collapse_blanks(x) -> Column:
    """``re.sub(r'\\s+', ' ', x).strip()`` (B26 form a)."""
    return py_strip(F.regexp_replace(_c(x), rf"{WS_JAVA}+", " "))


def strip_reasoning(x) -> Column:
    """Drop ``<think>...</think>`` and the blanks after it, only when both
    tags are present; then strip. Null input counts as empty text."""
    t = F.coalesce(_c(x), F.lit(""))
    both = t.contains("<think>") & t.contains("</think>")
    removed = F.regexp_replace(t, rf"(?s)<think>.*?</think>{WS_JAVA}*", "")
    return py_strip(F.when(both, removed).otherwise(t))


def options_section(prompt, lang) -> Column:
    """Text after the first language delimiter, else the whole prompt;
    stripped. ``lang`` = 'bn' uses the Bangla header, anything else English."""
    p = F.coalesce(_c(prompt), F.lit(""))
    is_bn = F.coalesce(_c(lang) == "bn", F.lit(False))
    at = F.when(is_bn, F.locate(OPTIONS_DELIMITER["bn"], p)).otherwise(
        F.locate(OPTIONS_DELIMITER["en"], p))
    dlen = F.when(is_bn, F.lit(len(OPTIONS_DELIMITER["bn"]))).otherwise(
        F.lit(len(OPTIONS_DELIMITER["en"])))
    rest = F.when(at > 0, p.substr(at + dlen, F.length(p) + 1)).otherwise(p)
    return py_strip(rest)


def option_lines(prompt) -> Column:
    """Prompt lines that begin with a known option label, stripped."""
    p = F.coalesce(_c(prompt), F.lit(""))
    lines = F.split(p, "\n", -1)

    def is_opt(line):
        cond = F.lit(False)
        for s in OPTION_LINE_STARTS:
            cond = cond | line.startswith(s)
        return cond

    return F.transform(F.filter(lines, is_opt), lambda x: py_strip(x))


def extract_tag(x, tag: str, mode: str = "null") -> Column:
    """First ``<tag>(.*?)</tag>`` across lines, stripped.

    mode='null'  -> null when the tag is missing (repair scripts)
    mode='whole' -> the whole message when the tag is missing (translate)
    """
    t = _c(x)
    pat = rf"(?s)<{tag}>(.*?)</{tag}>"
    got = py_strip(F.regexp_extract(t, pat, 1))
    miss = F.lit(None).cast("string") if mode == "null" else t
    return F.when(t.rlike(pat), got).otherwise(miss)


def strip_notes(x) -> Column:
    """Drop left-over translation tags, cut everything from ``<translator_notes>`` on and strip."""
    bare = F.regexp_replace(_c(x), "</?bangla_translation>", "")
    return py_strip(F.substring_index(bare, "<translator_notes>", 1))


def normalize_whitespace(x, form: str = "a") -> Column:
    """(a) all blanks to one, stripped; (b) then tight braces and
    ``': '``/``', '``; (c) first tight around ``{}[]:,``, then (a)."""
    if form == "a":
        return collapse_blanks(x)
    if form == "b":
        t = collapse_blanks(x)
        t = F.regexp_replace(t, r" *\{ *", "{")
        t = F.regexp_replace(t, r" *\} *", "}")
        t = F.regexp_replace(t, r" *: *", ": ")
        return F.regexp_replace(t, r" *, *", ", ")
    if form == "c":
        return collapse_blanks(F.regexp_replace(_c(x), rf"{WS_JAVA}*+([{{}}\[\]:,]){WS_JAVA}*+", "$1"))
    raise ValueError(f"unknown whitespace form {form!r}")


def transliterate_digits(x, to: str = "latin") -> Column:
    """Bangla digits to Latin (to='latin') or back (to='bangla')."""
    t = _c(x).cast("string")
    if to == "latin":
        return F.translate(t, BANGLA_DIGITS, LATIN_DIGITS)
    return F.translate(t, LATIN_DIGITS, BANGLA_DIGITS)


def answer_tag(x, lang) -> Column:
    """Content of ``<answer>`` (or ``<উত্তর>`` for bn) on one line, else null."""
    t = F.coalesce(_c(x), F.lit(""))

    def one(tag):
        pat = rf"(?d)<{tag}>(.*?)</{tag}>"
        return F.when(t.rlike(pat), F.regexp_extract(t, pat, 1))

    return F.when(_c(lang) == "bn", one(ANSWER_TAG["bn"])).otherwise(one(ANSWER_TAG["en"]))


def answer_after_marker(x, marker: str = "#### ") -> Column:
    """Ground truth = text after the last marker."""
    return F.substring_index(_c(x), marker, -1)


def phrase_replace(x, pairs: list[tuple[str, str]]) -> Column:
    """Ordered literal replacements."""
    t = _c(x)
    for a, b in pairs:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def map_label(x, mapping: dict, strict: bool = False) -> Column:
    """Label to another script. Pass-through (``.get(x, x)``) or strict
    (raise on an unknown key, like ``mapping[x]``)."""
    t = _c(x)
    m = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    hit = F.try_element_at(m, t)
    if not strict:
        return F.coalesce(hit, t)
    return F.when(hit.isNotNull() | t.isNull(), hit).otherwise(
        F.raise_error(F.concat(F.lit("unknown label: "), t)))


def text_length(x) -> Column:
    return F.coalesce(F.length(_c(x)), F.lit(0))


def list_length(x) -> Column:
    """Sum of the element lengths of an array of strings."""
    return F.aggregate(F.coalesce(_c(x), F.array().cast("array<string>")), F.lit(0),
                       lambda acc, e: acc + F.coalesce(F.length(e), F.lit(0)))


def length_ratio_flag(translated_len, original_len, factor: float = 3.0) -> Column:
    """Flag when translated length > factor x original length."""
    return _c(translated_len) > F.lit(factor) * _c(original_len)


def ascii_letter_ratio(x) -> Column:
    """ASCII letters over all characters; null for empty text."""
    t = _c(x)
    n = F.length(t)
    letters = F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    return F.when(n > 0, letters / n)


def ascii_flag(x, threshold: float = 0.3) -> Column:
    """Flagged when ratio >= threshold; empty text is not flagged."""
    return F.coalesce(ascii_letter_ratio(x) >= F.lit(threshold), F.lit(False))


def word_count(x) -> Column:
    """Blank-separated words, at least 1."""
    t = F.coalesce(_c(x), F.lit(""))
    n = F.size(F.filter(F.split(t, rf"{WS_JAVA}+"), lambda w: w != ""))
    return F.greatest(n, F.lit(1))


def utf8_bytes(x) -> Column:
    return F.octet_length(F.coalesce(_c(x), F.lit("")))


def prompt_text(system, prompt) -> Column:
    """The text that is tokenised: strip(system + ' ' + prompt)."""
    return py_strip(F.concat(F.coalesce(_c(system), F.lit("")), F.lit(" "),
                             F.coalesce(_c(prompt), F.lit(""))))


def file_safe_name(x) -> Column:
    """``/`` in a model name becomes ``-``."""
    return F.replace(_c(x), F.lit("/"), F.lit("-"))


# Python's ``\w`` (letters, digits, underscore in any script) for Java and RE2
WORD_CHAR = r"[\p{L}\p{N}_]"

# ---------------------------------------------------------------------------
# Latin-to-Bangla option labels used by the translation scripts
# ---------------------------------------------------------------------------
OPTION_LABELS_BN = {f"({chr(65 + i)})": f"({chr(0x0995 + i)})" for i in range(18)}   # (A) to (R)
LETTERS_BN = {"A": "ক", "B": "খ", "C": "গ", "D": "ঘ", "E": "ঙ", "F": "চ"}


def map_option_prefix(options, mapping: dict = OPTION_LABELS_BN) -> Column:
    """A leading ``(X)`` of each option is replaced by its mapped label;
    the rest is left-stripped and joined with one blank. Others are kept."""
    pat = rf"^\({WORD_CHAR}\)"
    m = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])

    def one(o):
        lab = F.regexp_extract(o, rf"^(\({WORD_CHAR}\))", 1)
        rest = F.regexp_replace(F.substring(o, 4, 1 << 30), rf"^{WS_JAVA}+", "")
        return F.when(o.rlike(pat), F.concat(F.coalesce(F.try_element_at(m, lab), lab), F.lit(" "), rest)) \
            .otherwise(o)
    return F.transform(_c(options), one)


def map_solution_labels(solution, letters: dict = LETTERS_BN) -> Column:
    """``Answer :`` becomes ``উত্তর :`` and each `` X`` its Bangla letter."""
    t = F.replace(_c(solution), F.lit("Answer :"), F.lit("উত্তর :"))
    for a, b in letters.items():
        t = F.replace(t, F.lit(" " + a), F.lit(" " + b))
    return t


def options_from_text(text, mapping: dict = OPTION_LABELS_BN) -> Column:
    """After the first ``Options:``, every ``(X) text`` becomes
    ``mapped(X) text``; a text without ``Options:`` raises."""
    t = _c(text)
    # text after the first "Options:" only
    after = F.substring(t, F.locate("Options:", t) + len("Options:"), 1 << 30)
    pat = rf"(?d)\(({WORD_CHAR})\){WS_JAVA}+(.+)"
    labels = F.regexp_extract_all(after, F.lit(pat), 1)
    texts = F.regexp_extract_all(after, F.lit(pat), 2)
    m = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    z = F.arrays_zip(labels.alias("l"), texts.alias("t"))
    out = F.transform(z, lambda e: F.concat(
        F.coalesce(F.try_element_at(m, F.concat(F.lit("("), e["l"], F.lit(")"))),
                   F.concat(F.lit("("), e["l"], F.lit(")"))), F.lit(" "), py_strip(e["t"])))
    return F.when(F.locate("Options:", t) > 0, out).otherwise(
        F.raise_error(F.lit("text has no 'Options:' section")))


# ---------------------------------------------------------------------------
# B35 built-in language detector: stop-word counts per language as column
# expressions (a user detector can replace it; see operators.repair).
# ---------------------------------------------------------------------------
STOPWORDS = {
    "en": ["the", "and", "of", "to", "in", "is", "that", "it", "was", "for", "with", "as", "on", "are"],
    "fr": ["le", "la", "les", "des", "et", "un", "une", "du", "de", "est", "que", "qui", "dans", "pour"],
    "de": ["der", "die", "das", "und", "zu", "ist", "nicht", "ein", "eine", "von", "mit", "den", "sich", "auf"],
    "es": ["el", "los", "las", "y", "en", "un", "una", "es", "que", "por", "con", "para", "del", "se"],
}


def _count_parts(text):
    words = F.split(F.lower(F.coalesce(_c(text), F.lit(""))), r"[^\p{L}]+")
    lists = {lang: F.array(*[F.lit(w) for w in sw]) for lang, sw in STOPWORDS.items()}
    zero = F.struct(*[F.lit(0).alias(lang) for lang in STOPWORDS])

    def merge(acc, w):
        return F.struct(*[(acc[lang] + F.when(F.array_contains(lst, w), 1).otherwise(0)).alias(lang)
                          for lang, lst in lists.items()])
    return words, zero, merge


def stopword_counts(text) -> Column:
    """Stop words of every language counted in one pass over the words
    (one ``aggregate`` with a struct of counters)."""
    words, zero, merge = _count_parts(text)
    return F.aggregate(words, zero, merge)


def language_of_counts(counts) -> Column:
    """Language with the most stop words (first in list order on ties);
    'und' when none is found."""
    c = _c(counts)
    best = F.greatest(*[c[lang] for lang in STOPWORDS])
    res = F.lit("und")
    for lang in reversed(list(STOPWORDS)):
        res = F.when((c[lang] == best) & (best > 0), F.lit(lang)).otherwise(res)
    return res


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a one-element array is
    mapped, so the lambda variable stands for the value wherever it is used
    (also after the optimizer inlines the expression into a filter)."""
    return F.element_at(F.transform(F.array(value), body), 1)


BANGLA_SCRIPT = "\u0980-\u09ff"


def _stopword_pattern(words: list[str]) -> str:
    """Whole words only: no letter before or after."""
    return r"(?<!\p{L})(?:" + "|".join(words) + r")(?!\p{L})"


def mostly_bangla(text) -> Column:
    """Script share: at least as many Bangla letters and signs as ASCII letters, and some."""
    t = F.coalesce(_c(text), F.lit(""))
    bangla = F.length(F.regexp_replace(t, f"[^{BANGLA_SCRIPT}]+", ""))
    latin = F.length(F.regexp_replace(t, "[^A-Za-z]+", ""))
    return (bangla > 0) & (bangla >= latin)


def detect_language(text) -> Column:
    """B35 built-in detector: the script share tells Bangla; else the language
    with the most stop words, each counted by one pattern over the text (only the
    hits become values, the words are never split)."""
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    counts = F.struct(*[F.regexp_count(t, F.lit(_stopword_pattern(sw))).alias(lang) for lang, sw in STOPWORDS.items()])
    return F.when(mostly_bangla(text), F.lit("bn")).otherwise(bind(counts, language_of_counts))


def with_language(df, text: str, out: str = "detected"):
    """Add the detected language as a column."""
    return df.withColumn(out, detect_language(text))


def detection_text(*parts) -> Column:
    """Fields and list elements joined by blanks (missing = '')."""
    cols = []
    for p in parts:
        c = _c(p)
        cols.append(F.coalesce(c, F.lit("")))
    return F.concat_ws(" ", *cols)


# ---------------------------------------------------------------------------
# JSON: strict parsing, field defaults, response records
# ---------------------------------------------------------------------------
def parse_json_strict(x, schema: str) -> Column:
    """Parse a JSON object; null on failure.

    Spark's reader is more lenient than Python's ``json.loads``; the gaps of
    SURVEY 2.1 are closed here: single quotes are off, a broken record is
    detected through the corrupt-record column, and text after the closing
    brace is rejected by requiring the stripped text to start with ``{`` and
    end with ``}``.
    """
    full = schema[:-1] + ",_corrupt_record:string>" if schema.startswith("struct<") else schema
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record",
               "allowSingleQuotes": "false", "allowUnquotedControlChars": "false"}
    fields = [f.split(":", 1)[0] for f in _split_fields(schema[len("struct<"):-1])]

    def kept(p):
        return F.when(p.isNotNull() & p["_corrupt_record"].isNull(), F.struct(*[p[f].alias(f) for f in fields]))

    # text and record are computed once, however often they are named
    return bind(py_strip(_c(x)), lambda t: F.when(
        t.startswith("{") & t.endswith("}"), bind(F.from_json(t, full, options), kept)))


def _split_fields(body: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in body:
        if ch == "<":
            depth += 1
        elif ch == ">":
            depth -= 1
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    if cur:
        out.append(cur)
    return out


def patch_field_gaps(x, schema: str, text_fields: list[str], list_fields: list[str],
                     blank_key: str = "label") -> Column:
    """``"label": ,`` becomes ``"label": null,``; missing list fields
    become ``[]``, text fields are stripped (missing = '')."""
    fixed = F.regexp_replace(_c(x), rf'"{blank_key}":{WS_JAVA}*,', f'"{blank_key}": null,')
    p = parse_json_strict(fixed, schema)
    fields = [f.split(":", 1)[0] for f in _split_fields(schema[len("struct<"):-1])]
    cols = []
    for f in fields:
        c = p[f]
        if f in text_fields:
            c = py_strip(F.coalesce(c, F.lit("")))
        elif f in list_fields:
            c = F.coalesce(c, F.array().cast("array<string>"))
        cols.append(c.alias(f))
    return F.when(p.isNotNull(), F.struct(*cols))


def project_pair(parsed, keys: list[str]) -> dict[str, Column]:
    """Keep some fields of a parsed record, stripped, missing = ''."""
    return {k: py_strip(F.coalesce(_c(parsed)[k], F.lit(""))) for k in keys}


def message_content(record) -> Column:
    """``choices[0].message.content`` with a default at each level."""
    first = F.try_element_at(_c(record)["choices"], F.lit(1))
    return F.coalesce(first["message"]["content"], F.lit(""))


def answer_letter(text, key, seed: int = 0, letters: str = "ABCDEFGHIJ") -> Column:
    """``answer is (X)``; otherwise a letter drawn from (key + seed) so a
    rerun gives the same guess."""
    pat = r"answer is \(?([ABCDEFGHIJ])\)?"
    t = F.coalesce(_c(text), F.lit(""))
    guess = F.substring(F.lit(letters), (F.pmod(_c(key) + F.lit(seed), F.lit(len(letters))) + 1).cast("int"), 1)
    return F.when(t.rlike(pat), F.regexp_extract(t, pat, 1)).otherwise(guess)


def zip_to_map(keys, values) -> Column:
    """``dict(zip(keys, values))``: later duplicates win, key order is the
    first occurrence. Independent of ``spark.sql.mapKeyDedupPolicy``."""
    k, v = _c(keys), _c(values)
    n = F.least(F.size(k), F.size(v))
    k, v = F.slice(k, 1, n), F.slice(v, 1, n)
    uniq = F.array_distinct(k)
    last = F.transform(uniq, lambda u: F.element_at(v, (F.size(k) - F.array_position(F.reverse(k), u) + 1).cast("int")))
    return F.map_from_arrays(uniq, last)
