"""Prompt rendering as column expressions.

A renderer returns a ``Column`` holding the full user message: the input
template of the dataset (B10) followed by the rendered item. Choice lists
are rendered with higher-order functions (``transform``/``arrays_zip``),
so rendering stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NL = "\n"
LATIN_LETTERS = "".join(chr(65 + i) for i in range(26))
# Bangla option letters are consecutive code points from U+0995 (rule of the
# reference: chr(0x0995 + i)); Spark's chr() is modulo 256, so letters are
# taken from this string with substring().
BANGLA_LETTERS = "".join(chr(0x0995 + i) for i in range(40))
MOST_OPTIONS = 10   # lettered option lists

# ---------------------------------------------------------------------------
# Option headers and templates
# ---------------------------------------------------------------------------
OPTIONS_HEADER = {"en": "Options:", "bn": "বিকল্পসমূহ:"}
CONCEPT_HEADER = {"en": "Concept: ", "bn": "প্রশ্নের বিষয়: "}
PASSAGE_HEADER = {"en": "Passage:", "bn": "অনুচ্ছেদ:"}
CONTEXT_HEADER = {"en": "Given the context:", "bn": "প্রদত্ত প্রসঙ্গ:"}
CONTINUATION_QUESTION = {"en": "Which of the following is the most likely continuation?",
                         "bn": "নিচের কোনটি সবচেয়ে সম্ভাব্য পরবর্তী অংশ?"}
CONTEXT_REPLACEMENTS_BN = [("Header", "হেডার"), ("Title", "টাইটেল"), ("Step", "স্টেপ")]

SYSTEM_GENERAL = {
    "en": ("You are a highly intelligent English-language assistant designed to analyze questions and "
           "provide concise answers by selecting the most accurate label from a given list."),
    "bn": ("আপনি একজন অত্যন্ত বুদ্ধিমান  বাংলা ভাষার সহকারী, যিনি প্রশ্ন বিশ্লেষণ করে একটি প্রদত্ত তালিকা "
           "থেকে সবচেয়ে সঠিক লেবেল নির্বাচন করে সংক্ষিপ্ত উত্তর প্রদান করেন।"),
}
SYSTEM_GSM8K = {
    "en": ("You are a highly intelligent English-language assistant designed to solve mathematical questions "
           "and provide only english numeric answers based on accurate calculations without any explanation. "),
    "bn": ("আপনি একজন অত্যন্ত বুদ্ধিমান বাংলা-ভাষার সহকারী, যার কাজ হলো গণিত সম্পর্কিত প্রশ্ন সমাধান করা "
           "এবং নির্ভুল গণনার ভিত্তিতে শুধুমাত্র বাংলা সংখ্যায় উত্তর প্রদান করা, কোনো ব্যাখ্যা ছাড়া।"),
}
SYSTEM_BOOLQ = {
    "en": ("You are a highly intelligent assistant designed to analyze yes/no questions and "
           "provide concise answers by selecting the most accurate label (true or false) based on the given passage."),
    "bn": ("আপনি একটি অত্যন্ত বুদ্ধিমান সহকারী, যা সত্য/মিথ্যা প্রশ্ন বিশ্লেষণ করতে সক্ষম এবং "
           "প্রদত্ত অনুচ্ছেদের ভিত্তিতে সবচেয়ে নির্ভরযোগ্য লেবেল (সত্য বা মিথ্যা) নির্বাচন করে সংক্ষিপ্ত উত্তর প্রদান করে।"),
}
MCQ_EXAMPLES = {
    "en": {2: "A, B", 4: "A, B, C, D", 5: "A, B, C, D, E", 13: "A, B, C, D, E,F,G,H,I,J,K,L,M"},
    "bn": {2: "ক, খ", 4: "ক, খ, গ, ঘ", 5: "ক, খ, গ, ঘ, ঙ",
           13: "ক, খ, গ, ঘ, ঙ, চ, ছ, জ, ঝ, ঞ, ট, ঠ, ড"},
}
MCQ_TEMPLATE = {
    "en": ("Please select the most appropriate answer. "
           "Respond with the label (e.g., {examples}) without any explanation or additional text.\n"
           "Question: "),
    "bn": ("অনুগ্রহ করে সবচেয়ে উপযুক্ত উত্তরটি নির্বাচন করুন। "
           "কোনো ব্যাখ্যা বা অতিরিক্ত লেখা ছাড়া শুধুমাত্র লেবেল (যেমন, {examples}) দিয়ে উত্তর দিন।\n"
           "প্রশ্ন: "),
}
MULTI_TEMPLATE = {
    "en": ("Please select all the appropriate answers. "
           "Respond with all the correct labels as a list separated by comma(s) "
           "(e.g., [A,B,C,D,E,F,G,H,I,J,K,L,M,N]) without any explanation or additional text. \n"
           "Question: "),
    "bn": ("অনুগ্রহ করে সমস্ত উপযুক্ত উত্তর নির্বাচন করুন। "
           "সঠিক লেবেলগুলিকে কমা দ্বারা পৃথক করে একটি তালিকা হিসাবে উত্তর দিন "
           "(যেমন, [ক, খ, গ, ঘ, ঙ, চ, ছ, জ, ঝ, ঞ, ট, ঠ, ড, ঢ]) কোনো ব্যাখ্যা বা অতিরিক্ত লেখা ছাড়া।\n"
           "প্রশ্ন: "),
}
GSM8K_TEMPLATE = {
    "en": ("Please provide the most appropriate English numeric answer based on the question."
           "If the answer requires multi-step reasoning, execute them concisely, and encompass it within a <reason>  tag."
           "Irrespective of reasoning steps, you must explicitly state the answer at the end within an <answer> tag"
           "For example, if the answer is 300, respond with only: <answer>300</answer>\n"
           "Question: "),
    "bn": ("দয়া করে প্রশ্নের ভিত্তিতে সবচেয়ে উপযুক্ত বাংলা সংখ্যায় উত্তর প্রদান করুন। "
           "যদি উত্তর বের করতে একাধিক ধাপের গণনা প্রয়োজন হয়, তাহলে সংক্ষেপে সেই ধাপগুলো <কারণ> ট্যাগের মধ্যে রাখুন। "
           "গণনার ধাপ যাই হোক, আপনাকে অবশ্যই চূড়ান্ত উত্তর <উত্তর> ট্যাগের মধ্যে প্রকাশ করতে হবে। "
           "উদাহরণস্বরূপ, যদি বাংলা উত্তর হয় ৩০০, তাহলে শুধুমাত্র এইভাবে উত্তর দিন: <উত্তর>৩০০</উত্তর>\n"
           "প্রশ্ন: "),
}
BOOLQ_TEMPLATE = {
    "en": ("Please select the most appropriate answer. "
           "Respond with the label (e.g.,true/false) without any explanation or additional text.\n"
           "Question: "),
    "bn": ("সবচেয়ে উপযুক্ত উত্তর নির্বাচন করুন। "
           "লেবেল (যেমন, সত্য/মিথ্যা) দিয়ে উত্তর দিন, কোনও ব্যাখ্যা বা অতিরিক্ত পাঠ্য যোগ করবেন না।\n"
           "প্রশ্ন: "),
}
# option count of the multiple-choice template per dataset
OPTION_COUNT = {"openbookqa": 4, "arc-easy": 5, "arc-challenge": 5, "truthfulqa-mc": 13,
                "commonsenseqa": 5, "piqa": 2, "mmlu": 4, "winogrande": 2, "hellaswag": 4}
BBH_DATASETS = ["bbh-date", "bbh-disamb-qa", "bbh-geo-shapes", "bbh-hyperbaton", "bbh-logic-3",
                "bbh-logic-5", "bbh-logic-7", "bbh-movie", "bbh-penguins", "bbh-reasoning",
                "bbh-ruin-names", "bbh-salient", "bbh-snarks", "bbh-temporal", "bbh-track-3",
                "bbh-track-5", "bbh-track-7"]


def mcq_template(lang: str, n: int) -> str:
    return MCQ_TEMPLATE[lang].format(examples=MCQ_EXAMPLES[lang][n])


def template_rows() -> list[tuple[str, str, str, str]]:
    """(dataset, lang, system, input) for every known dataset."""
    rows = []
    for lang in ("en", "bn"):
        for ds in [*OPTION_COUNT, *BBH_DATASETS, "truthfulqa-ml", "gsm8k-main", "boolq"]:
            system = SYSTEM_GENERAL[lang]
            if ds == "gsm8k-main":
                system, inp = SYSTEM_GSM8K[lang], GSM8K_TEMPLATE[lang]
            elif ds == "boolq":
                system, inp = SYSTEM_BOOLQ[lang], BOOLQ_TEMPLATE[lang]
            elif ds == "truthfulqa-ml":
                inp = MULTI_TEMPLATE[lang]
            elif ds in BBH_DATASETS:
                inp = mcq_template("en", 4)  # English template in both languages
            else:
                inp = mcq_template(lang, OPTION_COUNT[ds])
            rows.append((ds, lang, system, inp))
    return rows


TEMPLATE_SCHEMA = T.StructType([T.StructField("dataset", T.StringType()),
                                T.StructField("lang", T.StringType()),
                                T.StructField("system_prompt", T.StringType()),
                                T.StructField("input_prompt", T.StringType())])


def template_table(spark, overrides: dict | None = None) -> DataFrame:
    """B10 as a small dimension table (fixed, about 60 rows: safe to broadcast)."""
    rows = template_rows()
    if overrides:
        rows = [(d, lg, *overrides.get((d, lg), (s, i))) for d, lg, s, i in rows]
    return spark.createDataFrame(rows, TEMPLATE_SCHEMA)


def with_templates(items: DataFrame, templates: DataFrame) -> DataFrame:
    """Attach system and input messages by (dataset, lang); unknown dataset
    gets nulls (a broadcast left join of the fixed dimension)."""
    return items.join(F.broadcast(templates), ["dataset", "lang"], "left")


# ---------------------------------------------------------------------------
# Renderers
# ---------------------------------------------------------------------------
def _zip_lines(labels: Column, texts: Column, sep: str) -> Column:
    """``label sep text\\n`` per pair, cut at the shorter list (like zip)."""
    n = F.least(F.size(labels), F.size(texts))
    z = F.arrays_zip(F.slice(labels, 1, n).alias("l"), F.slice(texts, 1, n).alias("t"))
    return F.array_join(F.transform(z, lambda e: F.concat(e["l"], F.lit(sep), e["t"], F.lit(NL))), "")


def render_choices(prefix: Column, stem: Column, labels: Column, texts: Column, lang: str = "en",
                   sep: str = ". ", concept: Column | None = None) -> Column:
    """B1: ``stem\\nOptions:\\n{label}{sep}{text}\\n...``; science sets use
    ``': '``; common-sense sets add a concept line when it is not empty."""
    parts = [prefix, stem, F.lit(NL)]
    if concept is not None:
        parts.append(F.when(F.coalesce(concept, F.lit("")) != "",
                            F.concat(F.lit(CONCEPT_HEADER[lang]), concept, F.lit(NL))).otherwise(F.lit("")))
    parts += [F.lit(OPTIONS_HEADER[lang] + NL), _zip_lines(labels, texts, sep)]
    return F.concat(*parts)


def render_choice_map(prefix: Column, stem: Column, choices: Column, lang: str = "bn",
                      sep: str = ": ", concept: Column | None = None) -> Column:
    """B2: same from a label-to-text map, in map order."""
    entries = F.map_entries(choices)
    lines = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(sep), e["value"], F.lit(NL))), "")
    parts = [prefix, stem, F.lit(NL)]
    if concept is not None:
        parts.append(F.when(F.coalesce(concept, F.lit("")) != "",
                            F.concat(F.lit(CONCEPT_HEADER[lang]), concept, F.lit(NL))).otherwise(F.lit("")))
    parts += [F.lit(OPTIONS_HEADER[lang] + NL), lines]
    return F.concat(*parts)


def parse_list_literal(s: Column) -> Column:
    """A Python list literal kept in a string, e.g. ``['a', 'b']``, parsed
    with the JSON reader in single-quote mode. Rows it cannot parse stay null
    and go to ``literal_eval_udf``."""
    return F.from_json(s, T.ArrayType(T.StringType()), {"allowSingleQuotes": "true"})


def literal_eval_udf():
    """Fallback for B3 rows the JSON reader rejects (Arrow-batched)."""
    from polyeval.functions.pyudfs import literal_list
    return literal_list


def render_fixed(prefix: Column, stem: Column, options: list[Column], labels: list[str],
                 lang: str = "en", sep: str = ": ") -> Column:
    """Options from fixed columns (two solutions, four answers, two options)."""
    parts = [prefix, stem, F.lit(NL + OPTIONS_HEADER[lang] + NL)]
    for lab, col in zip(labels, options):
        parts += [F.lit(lab + sep), col, F.lit(NL)]
    return F.concat(*parts)


# Code points of the first option letter
FIRST_LETTER = {"latin": 65, "bangla": 0x0995}


def letter(i: Column, script: str = "latin") -> Column:
    """Option letter number ``i`` (0-based): code points from the script's first letter on, without an end."""
    code = i.cast("int") + F.lit(FIRST_LETTER[script])
    # code points below 0x800 have two UTF-8 bytes, those above three
    two = F.concat(F.hex(F.lit(0xC0) + F.shiftright(code, 6)), F.hex(F.lit(0x80) + code.bitwiseAND(F.lit(63))))
    three = F.concat(F.hex(F.lit(0xE0) + F.shiftright(code, 12)), F.hex(F.lit(0x80) + F.shiftright(code, 6).bitwiseAND(F.lit(63))),
                     F.hex(F.lit(0x80) + code.bitwiseAND(F.lit(63))))
    return F.when(code < 0x80, F.chr(code)).otherwise(F.decode(F.unhex(F.when(code < 0x800, two).otherwise(three)), "UTF-8"))


def render_positional(prefix: Column, stem: Column, choices: Column, lang: str = "en",
                      script: str = "latin", sep: str = ": ") -> Column:
    """Letters from positions."""
    lines = F.array_join(F.transform(
        choices, lambda c, i: F.concat(letter(i, script), F.lit(sep), c, F.lit(NL))), "")
    return F.concat(prefix, stem, F.lit(NL + OPTIONS_HEADER[lang] + NL), lines)


def first_correct_letter(labels: Column, script: str = "latin") -> Column:
    """Letter of the first label equal to 1; null when there is none."""
    pos = F.array_position(labels, 1)
    return F.when(pos > 0, letter((pos - 1).cast("int"), script))


def all_correct_letters(labels: Column, script: str = "latin") -> Column:
    """B5 multi: letters of all labels equal to 1; null when there is none."""
    idx = F.filter(F.transform(labels, lambda x, i: F.when(x == 1, i)), lambda i: i.isNotNull())
    return F.when(F.size(idx) > 0, F.transform(idx, lambda i: letter(i, script)))


def render_passage(prefix: Column, question: Column, passage: Column, lang: str = "en") -> Column:
    """Question, passage header, passage."""
    return F.concat(prefix, question, F.lit(NL + PASSAGE_HEADER[lang] + NL), passage, F.lit(NL))


def render_option_list(prefix: Column, stem: Column, options: Column, lang: str = "en") -> Column:
    """Options already rendered, one per line."""
    return F.concat(prefix, stem, F.lit(NL + OPTIONS_HEADER[lang] + NL),
                    F.array_join(F.transform(options, lambda o: F.concat(o, F.lit(NL))), ""))


def render_context(prefix: Column, ctx: Column, endings: Column, lang: str = "en") -> Column:
    """Continuation items: context, question, lettered endings (``X. text``)."""
    if lang == "bn":
        for a, b in CONTEXT_REPLACEMENTS_BN:
            ctx = F.replace(ctx, F.lit(a), F.lit(b))
    script = "bangla" if lang == "bn" else "latin"
    lines = F.array_join(F.transform(endings, lambda e, i: F.concat(letter(i, script), F.lit(". "), e, F.lit(NL))), "")
    return F.concat(prefix, F.lit(CONTEXT_HEADER[lang] + NL), ctx, F.lit(NL + CONTINUATION_QUESTION[lang] + NL),
                    F.lit(OPTIONS_HEADER[lang] + NL), lines)


def chat_messages(system: Column, prompt: Column, model: str | Column, qid: Column,
                  truth: Column) -> Column:
    """``{model, messages:[system, user], metadata}`` request struct."""
    m = F.lit(model) if isinstance(model, str) else model
    msgs = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")),
                   F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    return F.struct(m.alias("model"), msgs.alias("messages"),
                    F.struct(truth.alias("ground_truth"), qid.alias("question_id")).alias("metadata"))


def translation_request(fields: dict[str, Column], guidelines: str, mode: str = "dumped") -> Column:
    """A JSON block inside ``<english_text>`` tags plus guidelines.

    mode='dumped': each field JSON-encoded (``to_json`` of a struct, nulls kept)
    mode='raw'   : fields pasted into a JSON-looking text unescaped (the lower
                   quality level, kept for parity).
    """
    if mode == "dumped":
        block = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})
    else:
        parts = [F.lit("{")]
        for i, (k, c) in enumerate(fields.items()):
            parts += [F.lit(("" if i == 0 else ", ") + f'"{k}": "'), F.coalesce(c.cast("string"), F.lit("None")),
                      F.lit('"')]
        parts.append(F.lit("}"))
        block = F.concat(*parts)
    return F.concat(F.lit("<english_text>\n"), block, F.lit("\n</english_text>\n\n" + guidelines))


def batch_task(idx: Column, model: str, system: Column, user: Column, temperature: float = 0.0,
               url: str = "/v1/chat/completions") -> Column:
    """``{custom_id: task-{idx}, method, url, body{model, temperature, messages}}`` as JSON."""
    body = F.struct(F.lit(model).alias("model"), F.lit(temperature).alias("temperature"),
                    F.array(F.struct(F.lit("system").alias("role"), system.alias("content")),
                            F.struct(F.lit("user").alias("role"), user.alias("content"))).alias("messages"))
    return F.to_json(F.struct(F.concat(F.lit("task-"), idx.cast("string")).alias("custom_id"),
                              F.lit("POST").alias("method"), F.lit(url).alias("url"), body.alias("body")))


# Default judge instructions and worked examples; any template with {examples},
# {prompt}, {ground_truth} and {answer} placeholders can be passed instead.
JUDGE_TEMPLATE = (
    "You are a strict grader. Decide whether the model answer matches the reference answer "
    "for the question. Reply as JSON {{\"reasoning\": ..., \"verdict\": \"Correct\" or \"Incorrect\"}}.\n"
    "An answer is Correct when it names the reference's label or value, in any script, digits or "
    "wording; it is Incorrect when it is empty, undecided, or names several.\n\n"
    "{examples}Question:\n{prompt}\n\nReference answer:\n{ground_truth}\n\nModel answer:\n{answer}\n")


JUDGE_EXAMPLES = [
    {"prompt": "Which is a colour?\nOptions:\nA: seven\nB: green\n", "ground_truth": "B", "answer": "B: green",
     "reasoning": "The answer names the reference's label.", "verdict": "Correct"},
    {"prompt": "How many legs have two birds?", "ground_truth": "4", "answer": "৪",
     "reasoning": "The same number in another script.", "verdict": "Correct"},
    {"prompt": "Is ice warm? (true/false)", "ground_truth": "False", "answer": "It depends.",
     "reasoning": "The answer does not decide.", "verdict": "Incorrect"},
]


def judge_example_block(examples: list[dict]) -> str:
    """The worked examples of a judge prompt, one after the other."""
    import json
    return "".join(
        f"Example {i}\nQuestion:\n{e['prompt']}\n\nReference answer:\n{e['ground_truth']}\n\nModel answer:\n{e['answer']}\n"
        f"{json.dumps({'reasoning': e['reasoning'], 'verdict': e['verdict']}, ensure_ascii=False)}\n\n"
        for i, e in enumerate(examples, 1))


def judge_prompt(prompt: Column, truth: Column, answer: Column, template: str = JUDGE_TEMPLATE,
                 examples: list[dict] = JUDGE_EXAMPLES) -> Column:
    """Fill the judge template (literal pieces + columns, no Python)."""
    import re
    head, mark, tail = template.partition("{examples}")
    if mark:
        shown = judge_example_block(examples).replace("{", "{{").replace("}", "}}")
        template = head + shown + tail
    pieces = re.split(r"(?<!\{)(\{prompt\}|\{ground_truth\}|\{answer\})", template)
    cols = {"{prompt}": prompt, "{ground_truth}": truth, "{answer}": answer}
    out = []
    for p in pieces:
        if p in cols:
            out.append(F.coalesce(cols[p].cast("string"), F.lit("")))
        elif p:
            out.append(F.lit(p.replace("{{", "{").replace("}}", "}")))
    return F.concat(*out)


def lettered_options(options: Column, most: int | None = MOST_OPTIONS, on_more: str = "raise") -> Column:
    """``Options are:\\n(A): x\\n...``. More than ``most`` options raise; with
    ``on_more="keep"`` all are lettered, with ``"cut"`` the first ``most`` (as the scripts do)."""
    if most is not None and on_more == "raise":
        options = F.when(F.size(options) <= most, options).otherwise(
            F.raise_error(F.lit(f"more than {most} options")).cast("array<string>"))
    elif most is not None and on_more == "cut":
        options = F.slice(options, 1, most)
    return F.concat(F.lit("Options are:\n"), F.array_join(F.transform(
        options, lambda o, i: F.concat(F.lit("("), letter(i), F.lit("): "), o, F.lit(NL))), ""))


def render_chat_text(system: Column, prompt: Column) -> Column:
    return F.concat_ws(" ", system, prompt)

