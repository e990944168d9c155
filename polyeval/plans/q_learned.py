"""Registered queries of learned profiles, merge tables and stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyeval.operators import analysis as A
from polyeval.operators import bpe as BPE
from polyeval.operators import joins as J
from polyeval.operators import language as LG
from polyeval.operators import tokens as TK
from polyeval.plans.catalog import register
from polyeval.plans.fixtures import fx_responses, fx_scores, table, with_views
from polyeval.plans.oracle import q
from polyeval.plans.q_text import _LANG_DOCS_SQL, _lang_docs
from polyeval.plans.q_tokens import NAMES, _stats_sql
from polyeval.session import scratch_path
from polyeval.sources import files as FS
from polyeval.sources import sinks as SK
from polyeval.sources import upserts as UP

# --- B35 language profiles: learned on four fifths of the documents, scored over all --------------------
TRAIN = "doc_id % 5 <> 0"
_WORDS_SQL = "regexp_extract_all(lower(coalesce(text, '')), '\\p{L}[\\p{L}\\p{M}]*')"
_GRAMS_SQL = f"list_transform(range(1, length(word) + 3 - {LG.GRAM} + 1), lambda i: substr('_' || word || '_', i, {LG.GRAM}))"
_PROFILES_SQL = f"""l AS ({_LANG_DOCS_SQL}),
k AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest({_WORDS_SQL}) AS word FROM l WHERE {TRAIN}) x GROUP BY lang, word),
g AS (SELECT lang, gram, sum(n)::BIGINT AS n FROM (SELECT lang, n, unnest({_GRAMS_SQL}) AS gram FROM k) x GROUP BY lang, gram),
t AS (SELECT lang, sum(n)::BIGINT AS total FROM g GROUP BY lang),
p AS (SELECT lang, gram, floor(1000 * ln((n + 1)::DOUBLE / (total + 1)))::BIGINT AS weight,
        floor(1000 * ln(1::DOUBLE / (total + 1)))::BIGINT AS unseen
      FROM g JOIN t USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) <= {LG.TOP})"""
_DETECT_SQL = f"""{_PROFILES_SQL},
w AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({_WORDS_SQL}) AS word FROM l) x GROUP BY doc_id, word),
d AS (SELECT doc_id, gram, sum(n) AS n FROM (SELECT doc_id, n, unnest({_GRAMS_SQL}) AS gram FROM w) x
      WHERE gram IN (SELECT gram FROM p) GROUP BY doc_id, gram),
u AS (SELECT DISTINCT lang, unseen FROM p),
s AS (SELECT d.doc_id, u.lang, sum(d.n * coalesce(p.weight, u.unseen)) AS s
      FROM d CROSS JOIN u LEFT JOIN p ON p.gram = d.gram AND p.lang = u.lang GROUP BY d.doc_id, u.lang),
b AS (SELECT doc_id, first(lang ORDER BY s DESC, lang) AS detected FROM s GROUP BY doc_id),
o AS (SELECT l.doc_id, l.lang, coalesce(b.detected, 'und') AS detected FROM l LEFT JOIN b USING (doc_id))"""


def _profiles(spark, sf):
    d = _lang_docs(spark, sf)
    return LG.learn_profiles(d.where(F.col("doc_id") % 5 != 0), "text", "lang")


def _profiled(spark, sf):
    """Languages of all documents by a profile table that is written once and read by every task."""
    path = scratch_path(spark, "language-profiles")
    _profiles(spark, sf).write.parquet(path)
    d = _lang_docs(spark, sf)
    return d.select("doc_id", "lang").join(LG.detect(d, spark.read.parquet(path), "doc_id", "text"), "doc_id")


register("language_profiles", f"WITH {_PROFILES_SQL} SELECT lang, gram, weight, unseen FROM p")(_profiles)
register("detect_language_profile", f"WITH {_DETECT_SQL} SELECT doc_id, lang, detected FROM o")(_profiled)
register("detect_language_profile_accuracy", f"""WITH {_DETECT_SQL} SELECT lang, NOT ({TRAIN}) AS held_out, count(*) AS n,
  CAST(count(*) FILTER (WHERE detected = lang) AS DOUBLE) / count(*) AS accuracy FROM o GROUP BY ALL""")(
    lambda spark, sf: _profiled(spark, sf).groupBy("lang", (F.col("doc_id") % 5 == 0).alias("held_out")).agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if(F.col("detected") == F.col("lang")).cast("double") / F.count(F.lit(1))).alias("accuracy")))

# --- J5 byte-pair tokens by a merge table given as data -------------------------------------------------
# A merge table in rank order
MERGES = [("t", "h"), ("i", "n"), ("e", "r"), ("a", "n"), ("th", "e"), ("o", "n"), ("r", "e"), ("e", "n"), ("in", "g"),
          ("an", "d"), ("e", "s"), ("o", "u"), ("l", "l"), ("n", "t"), ("i", "on"), ("t", "ion"), ("m", "ent"), ("d", "e"),
          ("l", "a"), ("q", "u"), ("s", "t"), ("a", "a"), ("c", "h"), ("u", "n"), ("e", "u")]


def _merges(spark):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(MERGES)], "rank int, left string, right string")


def _merged_sql(word: str) -> str:
    """Every symbol between blanks of its own; the merges one after the other, in rank order. (``m ent`` never
    fires, since ``e n`` and ``n t`` come first: the table is data, not a check.)"""
    s = f"array_to_string(list_transform(string_split({word}, ''), lambda c: ' ' || c || ' '), '')"
    for a, b in MERGES:
        s = f"replace({s}, ' {a}  {b} ', ' {a}{b} ')"
    return f"len(string_split({s}, '  '))"


register("count_tokens_bpe", f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), {q(BPE.WORDS)})) AS word FROM documents),
k AS (SELECT word, {_merged_sql('word')} AS tokens FROM (SELECT DISTINCT word FROM w) x),
s AS (SELECT doc_id, sum(tokens)::BIGINT AS bpe FROM w JOIN k USING (word) GROUP BY doc_id)
SELECT doc_id, coalesce(bpe, 0) AS bpe FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN s USING (doc_id)""")(
    lambda spark, sf: BPE.count_tokens(table(spark, sf, "documents"), "text", _merges(spark), "doc_id"))

# --- D4 upsert into a stored table ----------------------------------------------------------------------
FILE_IDS = 25        # consecutive ids in one file of the fixture table


@register("upsert_stored", f"""WITH u AS (SELECT doc_id, quality FROM labels WHERE toxic = 1),
t AS (SELECT DISTINCT doc_id // {FILE_IDS} AS f FROM documents JOIN u USING (doc_id))
SELECT d.doc_id, CASE WHEN u.doc_id IS NOT NULL THEN u.quality ELSE CAST(d.n_chars % 2 AS INTEGER) END AS quality,
  d.doc_id // {FILE_IDS} IN (SELECT f FROM t) AS rewritten,
  (SELECT count(DISTINCT doc_id // {FILE_IDS}) FROM documents) AS files, (SELECT count(*) FROM t) AS files_rewritten
FROM documents d LEFT JOIN u USING (doc_id)""")
def q_upsert_stored(spark, sf):
    """Corrections (each given twice, the later one counts) go into the files that hold them; the rest stays."""
    path = scratch_path(spark, "stored")
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"))
    # rows without an id go into the first file
    UP.create(d, path, by=F.coalesce(F.floor(F.col("doc_id") / F.lit(FILE_IDS)), F.lit(0)))
    lab = table(spark, sf, "labels").where("toxic = 1").select("doc_id", "quality")
    twice = lab.withColumn("seq", F.lit(2)).unionByName(lab.select("doc_id", (1 - F.col("quality")).alias("quality"), F.lit(1).alias("seq")))
    done = UP.upsert(spark, path, twice, "doc_id", ["quality"], order="seq")
    return UP.read(spark, path).select("doc_id", "quality", (~F.col("_file").startswith("data/v=000000/")).alias("rewritten"),
                                       F.lit(done["files"]).cast("long").alias("files"),
                                       F.lit(done["rewritten"]).cast("long").alias("files_rewritten"))


# --- E17 token measures of the first response file of each dataset -----------------------------------------
FIRST_IDS = 100      # consecutive ids in one response file of the fixture tree


@register("first_file_tokens", with_views(f"""SELECT * FROM ({_stats_sql(
    "(SELECT dataset, system_prompt || ' ' || prompt AS text FROM fx_responses f WHERE idx // " + str(FIRST_IDS) +
    " = (SELECT min(g.idx // " + str(FIRST_IDS) + ") FROM fx_responses g WHERE g.dataset = f.dataset)) x", "trim(text)", ["dataset"])}) s""",
                                        "fx_responses"))
def q_first_file_tokens(spark, sf):
    path = scratch_path(spark, "response-tree")
    r = fx_responses(spark, sf).withColumn("part", F.lpad(F.floor(F.col("idx") / F.lit(FIRST_IDS)).cast("string"), 12, "0"))
    SK.write_response_tree(r, path, ["dataset", "part"], "idx")
    first = FS.read_first_files(spark, path, "dataset")
    text = F.trim(F.concat("system_prompt", F.lit(" "), "prompt"))
    return TK.token_stats(first, text, ["dataset"], NAMES)


# --- E19 the bootstrap interval beside the normal one ---------------------------------------------------------
REPLICATES = 200


def _weight_sql(u: str) -> str:
    return "(CASE " + " ".join(f"WHEN {u} < {s} THEN {k}" for k, s in enumerate(A.POISSON_STEPS)) + f" ELSE {len(A.POISSON_STEPS)} END)"


register("mean_bootstrap_by_size", with_views(f"""SELECT m.model_size, m.lang, m.metric_type, round(m.mean_score, 10) AS mean_score,
  round(b.lo, 10) AS boot_low, round(b.hi, 10) AS boot_high, m.n
FROM (SELECT model_size, lang, metric_type, avg(score) AS mean_score, count(score) AS n FROM fx_scores GROUP BY ALL) m
LEFT JOIN (SELECT model_size, lang, metric_type, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM (
    SELECT model_size, lang, metric_type, r, sum(w * score) / nullif(sum(w), 0) AS v FROM (
      SELECT model_size, lang, metric_type, score, r, {_weight_sql("u")} AS w FROM (
        SELECT *, ('0x' || substr(md5(concat_ws('|', lang, dataset, model, metric_type, CAST(r AS VARCHAR))), 1, 8))::BIGINT AS u
        FROM fx_scores CROSS JOIN (SELECT unnest(range(1, {REPLICATES + 1})) AS r) x WHERE score IS NOT NULL) y) z
    GROUP BY ALL) c GROUP BY ALL) b
  ON m.model_size IS NOT DISTINCT FROM b.model_size AND m.lang IS NOT DISTINCT FROM b.lang AND m.metric_type = b.metric_type""", "fx_scores"))(
    lambda spark, sf: A.mean_bootstrap(fx_scores(spark, sf), ["model_size", "lang", "metric_type"],
                                       ["lang", "dataset", "model", "metric_type"], replicates=REPLICATES))


# --- A15 resume over large outputs: stored filters before the exact anti join --------------------------------
@register("skip_finished", with_views("""SELECT question_id, dataset FROM fx_responses
WHERE NOT (model IN ('model-0', 'model-1') AND idx % 3 <> 0)""", "fx_responses"))
def q_skip_finished(spark, sf):
    """Questions whose result is in no output file; the filter of each (dataset, model) output is stored once."""
    r = fx_responses(spark, sf).select("question_id", "dataset", "model", "idx")
    done = r.where(F.col("model").isin("model-0", "model-1") & (F.col("idx") % 3 != 0))
    path = scratch_path(spark, "finished-filters")
    J.bloom_filter(done.withColumn("f", F.concat_ws("/", "dataset", "model")), ["question_id"], "f").write.parquet(path)
    return J.skip_finished(r, done, spark.read.parquet(path), ["question_id"]).select("question_id", "dataset")
