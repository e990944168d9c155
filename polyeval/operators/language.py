"""Statistical language identification (B35): character n-gram profiles.

``learn_profiles`` counts the character n-grams of labelled texts: distinct
words are counted first (partial aggregation), their n-grams once a word, so
the corpus is never exploded into n-grams. A profile is the ``top`` n-grams of
each language with integer log-probabilities; the table has at most ``top``
rows a language, whatever the corpus.

``detect`` explodes the n-grams of the words of each text, looks them up in the
profile table (bounded by ``top``, so it may be broadcast) and adds up the
weights, a column a language; the partial aggregation leaves one row a text
before the only shuffle. The language with the largest sum wins (ties: the smaller name);
a text without any known n-gram is ``und``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3
TOP = 1_000
WORDS = r"\p{L}[\p{L}\p{M}]*"


def words(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(WORDS), 0)


def grams(word, n: int = GRAM) -> Column:
    """Overlapping ``n``-grams of one word between boundary marks; one pass over the word."""
    marked = F.concat(F.lit("_"), F.col(word) if isinstance(word, str) else word, F.lit("_"))
    return F.regexp_extract_all(marked, F.lit(rf"(?=(.{{{n}}}))"), 1)


def learn_profiles(df: DataFrame, text: str, lang: str, n: int = GRAM, top: int = TOP) -> DataFrame:
    """(lang, gram, weight, unseen): ``weight`` = floor(1000 ln((count + 1) / (total + 1))) of the ``top``
    n-grams of every language (ties by n-gram), ``unseen`` the weight of all others. Rows without a
    language teach nothing."""
    d = df.where(F.col(lang).isNotNull())
    by_word = d.select(F.col(lang).alias("lang"), F.explode(words(text)).alias("word")).groupBy("lang", "word").agg(
        F.count(F.lit(1)).alias("n"))
    counts = (by_word.select("lang", "n", F.explode(grams("word", n)).alias("gram")).groupBy("lang", "gram")
              .agg(F.sum("n").alias("n")))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= top)

    def weight(c):
        return F.floor(F.lit(1000) * F.ln((c + 1).cast("double") / (F.col("total") + 1))).cast("long")
    return best.join(total, "lang").select("lang", "gram", weight(F.col("n")).alias("weight"), weight(F.lit(0)).alias("unseen"))


def detect(df: DataFrame, profiles: DataFrame, key: str, text: str, n: int = GRAM, out: str = "detected") -> DataFrame:
    """(key, ``out``) of every row; a key with several texts is judged by all of them together."""
    # one pair a language; a language that lacks a gram of another takes its unseen weight
    langs = sorted({(r["lang"], r["unseen"]) for r in profiles.select("lang", "unseen").distinct().collect()})
    ids = df.select(F.col(key).alias(key)).distinct()
    if not langs:
        return ids.withColumn(out, F.lit("und"))
    of_gram = profiles.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "weight"))).alias("weights"))
    rows = of_gram.select("gram", F.array(*[
        F.coalesce(F.try_element_at("weights", F.lit(name)), F.lit(unseen)) for name, unseen in langs]).alias("of"))
    seen = (df.select(F.col(key).alias(key), F.explode(words(text)).alias("_w"))
            .select(key, F.explode(grams("_w", n)).alias("gram")).join(F.broadcast(rows), "gram")
            .groupBy(key).agg(*[F.sum(F.col("of")[i]).alias(f"_s{i}") for i in range(len(langs))]))
    best = F.array_min(F.array(*[F.struct((-F.col(f"_s{i}")).alias("s"), F.lit(name).alias("lang"))
                                 for i, (name, _) in enumerate(langs)]))
    b = seen.select(F.col(key).alias("_k"), best["lang"].alias("_lang"))
    return ids.join(b, ids[key].eqNullSafe(b["_k"]), "left").select(key, F.coalesce("_lang", F.lit("und")).alias(out))
