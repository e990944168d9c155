"""Tokenizer efficiency.

All tokenizers are evaluated in one pass over the text. The built-in ones
are column expressions (JVM-side, no Python): blank-separated pieces,
word-plus-punctuation pieces, characters and UTF-8 bytes. A user tokenizer
(e.g. a pretrained byte-pair model) goes through ``count_tokens_udf``: one
Arrow-batched pandas UDF that returns a struct with one count per tokenizer,
so the text crosses to Python once, not once per tokenizer.

Statistics are aggregated wide (one ``groupBy`` with partial aggregation,
one average column per tokenizer and measure) and only the small result is
unpivoted to the long (tokenizer, dataset, lang, ...) table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyeval.functions.text import WORD_CHAR, WS_CLASS, word_count

R = 10


def blank_tokens(t: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(t, F.lit("")), rf"{WS_CLASS}+"), lambda w: w != ""))


def word_punct_tokens(t: Column) -> Column:
    """Runs of word characters, and every other non-blank character alone."""
    pat = rf"{WORD_CHAR}+|[^\p{{L}}\p{{N}}_\x{{9}}-\x{{D}}\x{{1C}}-\x{{20}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]"
    return F.size(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(pat), 0))


def char_tokens(t: Column) -> Column:
    return F.length(F.coalesce(t, F.lit("")))


def byte_tokens(t: Column) -> Column:
    return F.octet_length(F.coalesce(t, F.lit("")))


BUILTIN: dict[str, Callable[[Column], Column]] = {
    "blank": blank_tokens,
    "word_punct": word_punct_tokens,
    "char": char_tokens,
    "byte": byte_tokens,
}


def count_tokens(text: Column, names: list[str]) -> Column:
    """J5 (built-ins): struct of token counts, one field per tokenizer."""
    return F.struct(*[BUILTIN[n](text).cast("bigint").alias(n) for n in names])


def count_tokens_udf(tokenizers: dict[str, Callable[[str], int]]):
    """J5 (user tokenizers): one pandas UDF -> struct<name:int,...>.

    ``tokenizers`` maps a name to ``fn(text) -> number of tokens``; the
    functions are shipped to the executors once per task."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    schema = T.StructType([T.StructField(n, T.IntegerType()) for n in tokenizers])

    def run(s: pd.Series) -> pd.DataFrame:
        out = {n: [] for n in tokenizers}
        for txt in s.fillna(""):
            for n, fn in tokenizers.items():
                out[n].append(int(fn(txt)))
        return pd.DataFrame(out)

    run.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    return pandas_udf(run, schema)


def token_ratios(tokens: Column, n_bytes: Column, words: Column, baseline: Column) -> dict[str, Column]:
    """bytes/token (0 without tokens), tokens/word (words >= 1),
    tokens/baseline tokens (baseline >= 1)."""
    return {
        "bytes_per_token": F.when(tokens > 0, n_bytes / tokens).otherwise(F.lit(0.0)),
        "tokens_per_word": tokens / F.greatest(words, F.lit(1)),
        "nsl": tokens / F.greatest(baseline, F.lit(1)),
    }


def measure_sums(text: Column, names: list[str]) -> list[Column]:
    """Aggregates for any grouping of rows: the sums of E4-E6 and the row count; groups add up to
    larger ones, ``measures_of_sums`` gives the averages."""
    counts = {n: BUILTIN[n](text) for n in names}
    words = F.greatest(counts["blank"] if "blank" in names else word_count(text), F.lit(1))
    n_bytes = F.octet_length(F.coalesce(text, F.lit("")))
    out = [F.count(F.lit(1)).alias("_rows")]
    for n in names:
        r = token_ratios(counts[n], n_bytes, words, counts[names[0]])
        out += [F.sum(counts[n]).alias(f"{n}__tpr"), F.sum(r["tokens_per_word"]).alias(f"{n}__tpw"),
                F.sum(r["bytes_per_token"]).alias(f"{n}__bpt"), F.sum(r["nsl"]).alias(f"{n}__nsl")]
    return out


def token_stats(df: DataFrame, text: Column, keys: list[str], names: list[str],
                counts: Column | None = None) -> DataFrame:
    """E4-E6 for every tokenizer in one pass.

    ``names[0]`` is the baseline of the normalised sequence length. Output:
    keys, tokenizer, avg_tokens_per_row, avg_tokens_per_word,
    avg_bytes_per_token, avg_normalized_seq_len (rounded to 10 digits).
    """
    words = word_count(text)
    if counts is not None:
        c = counts
    else:
        cols = {n: BUILTIN[n](text) for n in names}
        if "blank" in names:
            # the same expression object twice: evaluated once per row
            words = F.greatest(cols["blank"], F.lit(1))
        c = F.struct(*[v.alias(n) for n, v in cols.items()])
    d = df.select(*keys, c.alias("_tok"), F.octet_length(F.coalesce(text, F.lit(""))).alias("_bytes"),
                  words.alias("_words"))
    base = F.col(f"_tok.{names[0]}")
    aggs = []
    for n in names:
        t = F.col(f"_tok.{n}")
        r = token_ratios(t, F.col("_bytes"), F.col("_words"), base)
        aggs += [F.avg(t).alias(f"{n}__tpr"), F.avg(r["tokens_per_word"]).alias(f"{n}__tpw"),
                 F.avg(r["bytes_per_token"]).alias(f"{n}__bpt"), F.avg(r["nsl"]).alias(f"{n}__nsl")]
    wide = d.groupBy(*keys).agg(*aggs)
    stack = ", ".join(f"'{n}', `{n}__tpr`, `{n}__tpw`, `{n}__bpt`, `{n}__nsl`" for n in names)
    long = wide.select(*keys, F.expr(
        f"stack({len(names)}, {stack}) AS (tokenizer, tpr, tpw, bpt, nsl)"))
    return long.select(*keys, "tokenizer",
                       F.round("tpr", R).alias("avg_tokens_per_row"),
                       F.round("tpw", R).alias("avg_tokens_per_word"),
                       F.round("bpt", R).alias("avg_bytes_per_token"),
                       F.round("nsl", R).alias("avg_normalized_seq_len"))

