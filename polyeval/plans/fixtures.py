"""Fixture views: the driver tables turned into the tables the operators need.

Each view has two faces that must agree row for row:
- a DataFrame builder (what the engine runs; scans prune columns and push
  filters into parquet), and
- the same view as DuckDB SQL text, used as a common table expression by the
  oracle queries of ``__spark_entry__.oracle_sql``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyeval.functions.text import BANGLA_DIGITS, LATIN_DIGITS

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def word_choices(text: Column, n: int = 4) -> Column:
    """At most ``n`` choices made of all blank-separated words of a text: choice j
    joins the words at positions j, j + n, j + 2n, ..."""
    def deal(words):
        return F.transform(F.sequence(F.lit(0), F.least(F.size(words), F.lit(n)) - 1), lambda j: F.array_join(
            F.filter(words, lambda w, i: i % n == j), " "))
    words = F.filter(F.split(text, " "), lambda w: w != "")
    # bound once as a lambda variable, so that the split is not repeated for each choice
    return F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, deal(w)).otherwise(
        F.array().cast("array<string>"))), 1)


def word_choices_sql(text: str = "text", n: int = 4) -> str:
    words = f"list_filter(string_split({text}, ' '), lambda w: w <> '')"
    return (f"list_transform(range(least(len({words}), {n})), lambda j: "
            f"array_to_string(list_filter({words}, lambda x, i: (i - 1) % {n} = j), ' '))")


# ---------------------------------------------------------------------------
# fx_responses: answers to score (six datasets, two languages, four models)
# ---------------------------------------------------------------------------
def fx_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    a = d.join(lab, "doc_id", "left")
    doc_id = F.col("doc_id")
    q0 = F.coalesce(F.col("quality"), (doc_id % 2).cast("int"))
    ds = (F.when(doc_id % 6 == 0, "boolq").when(doc_id % 6 == 1, "gsm8k")
          .when(doc_id % 6 == 2, "cqsa").when(doc_id % 6 == 3, "winogrande")
          .when(doc_id % 6 == 4, "hellaswag").otherwise("openbookqa"))
    a = a.select(
        doc_id.alias("question_id"),
        ds.alias("dataset"),
        F.concat(F.lit("model-"), (F.floor(doc_id / F.lit(6)) % 4).cast("string")).alias("model"),
        F.when(F.col("lang") == "en", "en").otherwise("bn").alias("lang"),
        F.col("text").alias("stem"),
        q0.alias("q"),
        F.when(F.col("n_chars") % 3 == 0, 1 - q0).otherwise(q0).alias("g"),
        (F.col("n_chars") % 7).alias("k"),
    )
    bn = F.col("lang") == "bn"
    g1 = F.col("g") == 1
    q1 = F.col("q") == 1
    g_str = F.col("g").cast("string")
    q_str = F.col("q").cast("string")
    raw = (F.when(F.col("dataset") == "boolq",
                  F.when(bn, F.when(g1, "সত্য").otherwise("মিথ্যা"))
                  .otherwise(F.when(g1, "true").otherwise("False")))
           .when(F.col("dataset") == "gsm8k",
                 F.when(bn, F.concat(F.lit("<উত্তর>"), F.translate(g_str, LATIN_DIGITS, BANGLA_DIGITS),
                                     F.lit("</উত্তর>")))
                 .otherwise(F.concat(F.lit("<answer>"), g_str, F.lit("</answer>"))))
           .otherwise(F.when(bn, F.when(g1, "ক").otherwise("খ"))
                      .otherwise(F.when(g1, "A").otherwise("B"))))
    nl = F.lit("\n")
    prompt = F.when(bn, F.concat(F.col("stem"), nl, F.lit("বিকল্পসমূহ:"), nl, F.lit("ক: x"), nl,
                                 F.lit("খ: y"), nl, F.lit("গ: z"), nl, F.lit("ঘ: w"), nl)) \
        .otherwise(F.concat(F.col("stem"), nl, F.lit("Options:"), nl, F.lit("A: x"), nl,
                            F.lit("B: y"), nl, F.lit("C: z"), nl, F.lit("D: w"), nl))
    k = F.col("k")
    response = (F.when(k == 0, F.concat(F.lit("<think>a\nb</think> "), raw))
                .when(k == 1, F.lit("")).when(k == 2, F.lit("I am not sure"))
                .when(k == 3, F.concat(F.lit(" "), raw)).otherwise(raw))
    ds_c = F.col("dataset")
    truth = (F.when(ds_c == "boolq", F.when(q1, "True").otherwise("False"))
             .when(ds_c == "gsm8k", F.when(bn, F.translate(q_str, LATIN_DIGITS, BANGLA_DIGITS)).otherwise(q_str))
             .when(ds_c == "winogrande", F.when(q1, "1").otherwise("2"))
             .when(ds_c == "hellaswag", F.when(q1, "0").otherwise("1"))
             .when(ds_c == "cqsa", F.when(q1, "A").otherwise("B"))
             .otherwise(F.when(bn, F.when(q1, "ক").otherwise("খ")).otherwise(F.when(q1, "A").otherwise("B"))))
    return a.select(
        "question_id", "dataset", "model", "lang",
        F.when(bn, "সঠিক লেবেল দিন").otherwise("Give the label").alias("system_prompt"),
        prompt.alias("prompt"),
        response.alias("response"),
        truth.alias("ground_truth"),
        F.col("question_id").alias("idx"),
    )


FX_RESPONSES_SQL = """
SELECT b.question_id, b.dataset, b.model, b.lang,
       CASE WHEN b.lang = 'bn' THEN 'সঠিক লেবেল দিন' ELSE 'Give the label' END AS system_prompt,
       CASE WHEN b.lang = 'bn'
            THEN concat(b.stem, chr(10), 'বিকল্পসমূহ:', chr(10), 'ক: x', chr(10), 'খ: y', chr(10), 'গ: z', chr(10), 'ঘ: w', chr(10))
            ELSE concat(b.stem, chr(10), 'Options:', chr(10), 'A: x', chr(10), 'B: y', chr(10), 'C: z', chr(10), 'D: w', chr(10)) END AS prompt,
       CASE b.k WHEN 0 THEN concat('<think>a', chr(10), 'b</think> ', b.raw)
                WHEN 1 THEN '' WHEN 2 THEN 'I am not sure' WHEN 3 THEN concat(' ', b.raw) ELSE b.raw END AS response,
       CASE b.dataset WHEN 'boolq' THEN CASE WHEN b.q = 1 THEN 'True' ELSE 'False' END
                      WHEN 'gsm8k' THEN CASE WHEN b.lang = 'bn' THEN translate(CAST(b.q AS VARCHAR), '0123456789', '০১২৩৪৫৬৭৮৯') ELSE CAST(b.q AS VARCHAR) END
                      WHEN 'winogrande' THEN CASE WHEN b.q = 1 THEN '1' ELSE '2' END
                      WHEN 'hellaswag' THEN CASE WHEN b.q = 1 THEN '0' ELSE '1' END
                      WHEN 'cqsa' THEN CASE WHEN b.q = 1 THEN 'A' ELSE 'B' END
                      ELSE CASE WHEN b.lang = 'bn' THEN CASE WHEN b.q = 1 THEN 'ক' ELSE 'খ' END
                                ELSE CASE WHEN b.q = 1 THEN 'A' ELSE 'B' END END END AS ground_truth,
       b.question_id AS idx
FROM (SELECT a.*, CASE a.dataset
        WHEN 'boolq' THEN CASE WHEN a.lang = 'bn' THEN CASE WHEN a.g = 1 THEN 'সত্য' ELSE 'মিথ্যা' END ELSE CASE WHEN a.g = 1 THEN 'true' ELSE 'False' END END
        WHEN 'gsm8k' THEN CASE WHEN a.lang = 'bn' THEN concat('<উত্তর>', translate(CAST(a.g AS VARCHAR), '0123456789', '০১২৩৪৫৬৭৮৯'), '</উত্তর>') ELSE concat('<answer>', CAST(a.g AS VARCHAR), '</answer>') END
        ELSE CASE WHEN a.lang = 'bn' THEN CASE WHEN a.g = 1 THEN 'ক' ELSE 'খ' END ELSE CASE WHEN a.g = 1 THEN 'A' ELSE 'B' END END END AS raw
      FROM (SELECT d.doc_id AS question_id,
              CASE d.doc_id % 6 WHEN 0 THEN 'boolq' WHEN 1 THEN 'gsm8k' WHEN 2 THEN 'cqsa' WHEN 3 THEN 'winogrande' WHEN 4 THEN 'hellaswag' ELSE 'openbookqa' END AS dataset,
              concat('model-', CAST(CAST(floor(d.doc_id / 6.0) AS BIGINT) % 4 AS VARCHAR)) AS model,
              CASE WHEN d.lang = 'en' THEN 'en' ELSE 'bn' END AS lang,
              d.text AS stem,
              coalesce(l.quality, CAST(d.doc_id % 2 AS INT)) AS q,
              CASE WHEN d.n_chars % 3 = 0 THEN 1 - coalesce(l.quality, CAST(d.doc_id % 2 AS INT)) ELSE coalesce(l.quality, CAST(d.doc_id % 2 AS INT)) END AS g,
              d.n_chars % 7 AS k
            FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) a) b
"""


# ---------------------------------------------------------------------------
# fx_chat: user turn, following assistant turn, system text when present
# ---------------------------------------------------------------------------
def fx_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    s = c.where(F.col("role") == "system").select("conv_id", F.col("text").alias("system_prompt"))
    return (u.join(a, ["conv_id", "turn"], "inner")
            .join(s, "conv_id", "left")
            .select("conv_id", "turn", "system_prompt", "prompt", "response"))


FX_CHAT_SQL = """
SELECT u.conv_id, u.turn, s.text AS system_prompt, u.text AS prompt, a.text AS response
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
LEFT JOIN conversations s ON s.conv_id = u.conv_id AND s.role = 'system'
WHERE u.role = 'user'
"""


# ---------------------------------------------------------------------------
# whole document texts as JSON values: escaped, and raw (line feeds as they are, no quotes)
# ---------------------------------------------------------------------------
JSON_ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]


def json_escaped(text: str) -> Column:
    t = F.coalesce(F.col(text), F.lit(""))
    for raw, escaped in JSON_ESCAPES:
        t = F.replace(t, F.lit(raw), F.lit(escaped))
    return t


def json_escaped_sql(text: str) -> str:
    t = f"coalesce({text}, '')"
    for raw, escaped in JSON_ESCAPES:
        t = f"replace({t}, chr({ord(raw)}), '{escaped}')"
    return t


def raw_value(text: str) -> Column:
    return F.replace(F.coalesce(F.col(text), F.lit("")), F.lit('"'), F.lit(""))


# ---------------------------------------------------------------------------
# fx_messages: raw translation messages (every 11th index has none); the question is the
# whole text, on every fifth index four times over (longer than a translation may be)
# ---------------------------------------------------------------------------
def fx_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    t = json_escaped("text")
    m = F.col("doc_id") % 5
    msg = (F.when(m == 0, F.concat(F.lit('{"question": "'), t, F.lit('", "answer": "A"}')))
           .when(m == 1, F.concat(F.lit("ok <bangla_translation>\n{\"question\": \""), t,
                                  F.lit("\", \"answer\": \"ক\"}\n</bangla_translation>"
                                        "<translator_notes>n</translator_notes>")))
           .when(m == 2, F.concat(F.lit('<bangla_translation>{"question": "'), t,
                                  F.lit('" "answer": "খ"}</bangla_translation>')))
           .when(m == 3, F.concat(F.lit("<bangla_translation>{'question': '"), t,
                                  F.lit("', 'answer': '৩'}</bangla_translation>")))
           .otherwise(F.concat(F.lit('<bangla_translation>{"question": "'), F.repeat(t, 4),
                               F.lit('", "answer": "গ"} <translator_notes>x</translator_notes>'
                                     '</bangla_translation>'))))
    return (d.where(F.col("doc_id") % 11 != 10)
            .select(F.col("doc_id").alias("idx"), F.col("text").alias("original"),
                    msg.alias("message")))


FX_MESSAGES_SQL = f"""
SELECT d.doc_id AS idx, d.text AS original,
  CASE d.doc_id % 5
    WHEN 0 THEN concat('{{"question": "', d.t, '", "answer": "A"}}')
    WHEN 1 THEN concat('ok ', '<bangla_translation>', chr(10), '{{"question": "', d.t, '", "answer": "ক"}}', chr(10), '</bangla_translation>', '<translator_notes>n</translator_notes>')
    WHEN 2 THEN concat('<bangla_translation>{{"question": "', d.t, '" "answer": "খ"}}</bangla_translation>')
    WHEN 3 THEN concat('<bangla_translation>{{''question'': ''', d.t, ''', ''answer'': ''৩''}}</bangla_translation>')
    ELSE concat('<bangla_translation>{{"question": "', repeat(d.t, 4), '", "answer": "গ"}} <translator_notes>x</translator_notes></bangla_translation>') END AS message
FROM (SELECT doc_id, text, {json_escaped_sql('text')} AS t FROM documents) d
WHERE d.doc_id % 11 <> 10
"""


# ---------------------------------------------------------------------------
# fx_log: translation log lines
# ---------------------------------------------------------------------------
def fx_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    uid = F.col("user_id").cast("string")
    ts = "2024-01-01 00:00:00,000:"
    m = F.col("event_id") % 5
    line = (F.when(m == 0, F.concat(F.lit(ts + "ERROR:JSON decoding error at index "), uid, F.lit(": x")))
            .when(m == 1, F.concat(F.lit(ts + "ERROR:Failed to translate entry index "), uid,
                                   F.lit(". Using original entry.")))
            .when(m == 2, F.concat(F.lit(ts + "ERROR:Detected English entry at index "), uid,
                                   F.lit(". Using original entry.")))
            .when(m == 3, F.concat(F.lit(ts + "ERROR:Exception for entry index "), uid, F.lit(": x")))
            .otherwise(F.lit(ts + "INFO:ok")))
    return (e.where(F.col("event_type").isin("error", "view"))
            .select(F.col("event_id").alias("line_no"), line.alias("line")))


FX_LOG_SQL = """
SELECT event_id AS line_no,
  CASE event_id % 5 WHEN 0 THEN concat('2024-01-01 00:00:00,000:ERROR:JSON decoding error at index ', CAST(user_id AS VARCHAR), ': x')
                    WHEN 1 THEN concat('2024-01-01 00:00:00,000:ERROR:Failed to translate entry index ', CAST(user_id AS VARCHAR), '. Using original entry.')
                    WHEN 2 THEN concat('2024-01-01 00:00:00,000:ERROR:Detected English entry at index ', CAST(user_id AS VARCHAR), '. Using original entry.')
                    WHEN 3 THEN concat('2024-01-01 00:00:00,000:ERROR:Exception for entry index ', CAST(user_id AS VARCHAR), ': x')
                    ELSE '2024-01-01 00:00:00,000:INFO:ok' END AS line
FROM events WHERE event_type IN ('error', 'view')
"""


# ---------------------------------------------------------------------------
# fx_predictions: gold label and five predictions (one for each training size) in one string
# ---------------------------------------------------------------------------
def fx_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return lab.select(
        F.col("doc_id").cast("bigint").alias("idx"),
        (F.col("quality") + 1).cast("string").alias("gold"),
        F.concat((F.col("doc_id") % 2 + 1).cast("string"), F.lit(","),
                 (F.col("doc_id") % 3 % 2 + 1).cast("string"), F.lit(","),
                 (F.col("quality") + 1).cast("string"), F.lit(","),
                 (F.col("doc_id") % 5 % 2 + 1).cast("string"), F.lit(","),
                 F.when(F.col("doc_id") % 7 == 0, F.lit("1")).otherwise((F.col("quality") + 1).cast("string"))).alias("preds"))


FX_PREDICTIONS_SQL = """
SELECT CAST(doc_id AS BIGINT) AS idx, CAST(quality + 1 AS VARCHAR) AS gold,
  concat(CAST(doc_id % 2 + 1 AS VARCHAR), ',', CAST(doc_id % 3 % 2 + 1 AS VARCHAR), ',', CAST(quality + 1 AS VARCHAR), ',', CAST(doc_id % 5 % 2 + 1 AS VARCHAR), ',', CASE WHEN doc_id % 7 = 0 THEN '1' ELSE CAST(quality + 1 AS VARCHAR) END) AS preds
FROM labels
"""

# ---------------------------------------------------------------------------
# fx_broken: one broken JSON text per repair step, by doc_id
# ---------------------------------------------------------------------------
# each shape around a whole document text, escaped at # and raw at ~; the texts are data for the repair rules
BROKEN_SHAPES = [
    '{"question": "#", "answer": "A"}',                      # valid
    "{'question': '#', 'answer': 'B'}",                      # r12: single quotes
    '{"question": "#" "answer": "C"}',                       # r7: missing comma
    '{“question”: “#”, “answer”: “D”}',                      # r1: curly quotes
    '{"question": "say "#" now", "answer": "E"}',            # r6: bare quotes in a value
    '{"question": "~\nx" "answer": "F"}',                    # line feeds in a value and a missing comma
    '{"question": "#" "answer": 3}',                         # r5: bare value
    '{"question": "#", "answer": "["a", "b"]"}',             # r4: quoted array
    '{"question": "# “", "answer": "G",}',                   # r10: comma before the bracket
    'no record of #',                                        # nothing helps
    '{"question": "\\q #", "answer": "H"}',                  # r8: lone backslash
    '{"question": "f("1 2") of "$x$" #", "answer": "I"}',    # r9: maths quotes
    '{"label": , "question": "#", "answer": "J"}',           # r13: blank label
    '{"question": "#"}, "response": "K"}',                   # r14: stray bracket
    '{"question": "৩ #" "answer": "৭"}',                     # r11: Bangla digits
]


def fx_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    shapes = F.array(*[F.lit(s) for s in BROKEN_SHAPES])
    shape = F.element_at(shapes, (F.col("doc_id") % len(BROKEN_SHAPES) + 1).cast("int"))
    # a shape has one of the two marks; texts may hold either
    filled = F.when(F.contains(shape, F.lit("~")), F.replace(shape, F.lit("~"), raw_value("text"))).otherwise(
        F.replace(shape, F.lit("#"), json_escaped("text")))
    return d.select(F.col("doc_id").alias("idx"), filled.alias("translation"))


FX_BROKEN_SQL = f"""
SELECT doc_id AS idx, doc_id % {len(BROKEN_SHAPES)} AS shape, coalesce(text, '') AS w, {json_escaped_sql('text')} AS e,
  replace(coalesce(text, ''), '"', '') AS raw FROM documents
"""

VIEW_SQL = {
    "fx_broken": FX_BROKEN_SQL,
    "fx_responses": FX_RESPONSES_SQL,
    "fx_chat": FX_CHAT_SQL,
    "fx_messages": FX_MESSAGES_SQL,
    "fx_log": FX_LOG_SQL,
    "fx_predictions": FX_PREDICTIONS_SQL,
}


def with_views(sql: str, *views: str) -> str:
    """Prefix an oracle query with the fixture views it uses as CTEs."""
    if not views:
        return sql.strip()
    views = list(views)
    if "fx_scores" in views and "fx_responses" not in views:
        views.insert(0, "fx_responses")

    def body(v):
        return fx_scores_sql() if v == "fx_scores" else VIEW_SQL[v].strip()

    ctes = ",\n".join(f"{v} AS ({body(v)})" for v in views)
    sql = sql.strip()
    if sql[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{sql[5:]}"
    return f"WITH {ctes}\n{sql}"


# ---------------------------------------------------------------------------
# fx_scores: the long score table of the analysis layer, derived from
# fx_responses (accuracy, rar = 1 - rer, llm-judge) with display names.
# ---------------------------------------------------------------------------
# Fixture display names for the four fixture models, and the dataset renames
# that line the fixture names up with the category dictionary.
FIXTURE_MODEL_NAMES = {"model-0": "llama-3.1-8B", "model-1": "qwen2.5-72B",
                       "model-2": "mistral-7B", "model-3": "deepseek-llama-70B"}
FIXTURE_DATASET_NAMES = {"cqsa": "commonsenseqa", "gsm8k": "gsm8k-main"}


def score_sums(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """One pass over the responses: accuracy, RER and the rule judge's share by (dataset, lang,
    model), and the aggregates ``more``."""
    from polyeval.operators import scoring as S

    rows = S.score_rows(fx_responses(spark, sf_dir))
    c = F.col("clean_response")
    correct = (c != "") & (c == F.coalesce(F.col("ground_truth"), F.lit("")))
    return rows.groupBy("dataset", "lang", "model").agg(
        (F.sum(F.col("right").cast("long")).cast("double") / F.count(F.lit(1))).alias("accuracy"),
        (F.sum(F.col("error").cast("long")).cast("double") / F.count(F.lit(1))).alias("rer"),
        (F.count_if(correct).cast("double") / F.count(F.lit(1))).alias("judge_accuracy"), *more)


def fixture_dataset(name="dataset") -> Column:
    from polyeval.operators import analysis as A
    return F.coalesce(F.try_element_at(A.map_lit(FIXTURE_DATASET_NAMES), F.col(name)), F.col(name))


def fx_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores_of(score_sums(spark, sf_dir))


def scores_of(t: DataFrame) -> DataFrame:
    """The long score table of one ``score_sums`` frame."""
    from polyeval.operators import analysis as A

    keys = ("dataset", "lang", "model")
    long = t.select(*keys, F.expr("stack(3, 'accuracy', accuracy, 'rer', rer, 'llm-judge', judge_accuracy)"
                                  " AS (metric_type, score)"))
    long = A.adherence(long)
    ds = fixture_dataset()
    model = F.try_element_at(A.map_lit(FIXTURE_MODEL_NAMES), F.col("model"))
    long = long.withColumn("dataset", ds).withColumn("model", model)
    return long.select(
        "lang", "dataset",
        F.try_element_at(A.map_lit(A.CATEGORY_MAP), F.col("dataset")).alias("dataset_category"),
        "model", A.model_family("model").alias("model_family"), A.model_size("model").alias("model_size"),
        "metric_type", "score")


def _case_map(mapping: dict, x: str, default: str) -> str:
    def q(s):
        return "'" + s.replace("'", "''") + "'"
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"(CASE {x} {whens} ELSE {default} END)"


def fx_scores_sql() -> str:
    from polyeval.operators import analysis as A
    from polyeval.plans import oracle as O

    judge = f"""SELECT dataset, lang, model,
               coalesce(CAST(count(*) FILTER (WHERE verdict = 'Correct') AS DOUBLE) / count(*), 0.0) AS judge_accuracy
        FROM (SELECT dataset, lang, model,
                     CASE WHEN c = '' THEN '' WHEN c = coalesce(ground_truth, '') THEN 'Correct' ELSE 'Incorrect' END AS verdict
              FROM (SELECT f.*, {O.clean('f.response')} AS c FROM fx_responses f) x) y
        GROUP BY dataset, lang, model"""
    t = f"SELECT s.*, j.judge_accuracy FROM ({O.score_table_sql()}) s JOIN ({judge}) j USING (dataset, lang, model)"
    long = f"""SELECT dataset, lang, model, 'accuracy' AS metric_type, accuracy AS score FROM t0
               UNION ALL SELECT dataset, lang, model, 'rar', 1 - rer FROM t0
               UNION ALL SELECT dataset, lang, model, 'llm-judge', judge_accuracy FROM t0"""
    ds = _case_map(FIXTURE_DATASET_NAMES, "dataset", "dataset")
    model = _case_map(FIXTURE_MODEL_NAMES, "model", "NULL")
    named = f"SELECT lang, {ds} AS dataset, {model} AS model, metric_type, score FROM l0"
    up = "upper(model)"
    size = (f"CASE WHEN regexp_matches({up}, '(\\d+)(B|M)') THEN "
            f"CAST(regexp_extract({up}, '(\\d+)(B|M)', 1) AS BIGINT) * "
            f"(CASE WHEN regexp_extract({up}, '(\\d+)(B|M)', 2) = 'M' THEN 1000 ELSE 1000000 END) END")
    return f"""WITH t0 AS ({t}), l0 AS ({long}), n0 AS ({named})
SELECT lang, dataset, {_case_map(A.CATEGORY_MAP, 'dataset', 'NULL')} AS dataset_category, model,
       split_part(model, '-', 1) AS model_family, {size} AS model_size, metric_type, score
FROM n0"""


VIEW_SQL["fx_scores"] = "SELECT * FROM (" + "{fx_scores}" + ") z"
