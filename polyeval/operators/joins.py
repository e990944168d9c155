"""Joins and filters.

All joins are equi-joins on keys. No side is hinted for broadcast unless it
is a literal dimension of fixed size; data-derived sides are left to AQE,
which turns a sort-merge join into a broadcast join only after it has
measured the materialised side below
``spark.sql.adaptive.autoBroadcastJoinThreshold`` (a size-checked
broadcast). Skewed keys are split by AQE's skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyeval.functions.text import py_strip


def join_scores_tokens(scores: DataFrame, tokens: DataFrame,
                       keys=("model", "dataset", "lang")) -> DataFrame:
    """Scores left join the token table on (model, dataset, lang)."""
    return scores.join(tokens, list(keys), "left")


def filter_affected(df: DataFrame, indexes: DataFrame, key: str = "idx") -> DataFrame:
    """Keep only the rows whose index is named (left semi join; the
    index list may repeat an index, a semi join does not multiply rows)."""
    return df.join(indexes.select(key), key, "left_semi")


def filter_known(df: DataFrame, known: dict[str, list[str]]) -> DataFrame:
    """Drop rows with unknown values; ``known`` are literal lists."""
    cond = F.lit(True)
    for col, values in known.items():
        cond = cond & F.col(col).isin(values)
    return df.where(cond)


def filter_failed(df: DataFrame, response: str = "response") -> DataFrame:
    """Rows without a result."""
    return df.where(F.col(response).isNull())


def filter_blank_lines(df: DataFrame, value: str = "value") -> DataFrame:
    """Skip lines that are empty after stripping."""
    return df.where(py_strip(F.col(value)) != "")


def validate_lengths(a: DataFrame, b: DataFrame, what: str = "row counts") -> DataFrame:
    """One row (n_a, n_b); raises when the counts differ. Both sides are
    counted in one aggregate over their union (no cross join)."""
    u = a.select(F.lit(0).alias("_side")).unionByName(b.select(F.lit(1).alias("_side")))
    c = u.agg(F.count_if(F.col("_side") == 0).alias("n_a"), F.count_if(F.col("_side") == 1).alias("n_b"))
    return c.select("n_a", "n_b", F.when(F.col("n_a") == F.col("n_b"), F.lit(True)).otherwise(
        F.raise_error(F.lit(f"{what} differ"))).alias("equal"))


def join_original_response(originals: DataFrame, responses: DataFrame, key: str = "idx") -> DataFrame:
    """Each original line with its response file, missing stays null."""
    return originals.join(responses, key, "left")


def fallback_to_original(originals: DataFrame, translated: DataFrame, key: str,
                         fields: list[str], order: str) -> DataFrame:
    """D3: a translation that lacks any of ``fields`` is replaced by the whole
    original record; ``status`` says which one was kept. Of several
    translations of a key the last by ``order`` counts."""
    t = last_per_key(translated, key, fields, order).select(key, *[F.col(f).alias(f"_t_{f}") for f in fields],
                          F.lit(True).alias("_has"))
    j = originals.join(t, key, "left")
    ok = F.col("_has").isNotNull()
    for f in fields:
        ok = ok & F.col(f"_t_{f}").isNotNull()
    out = j.select(key, *[F.when(ok, F.col(f"_t_{f}")).otherwise(F.col(f)).alias(f) for f in fields],
                   F.when(ok, F.lit("translated")).otherwise(F.lit("original")).alias("status"))
    return out


def last_per_key(df: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """One row per key: the one with the largest ``order`` (ties: the largest values), by a
    partial aggregation."""
    values = F.struct(*fields)
    last = df.groupBy(key).agg(F.max_by(values, F.struct(F.col(order), values)).alias("_last"))
    return last.select(key, *[F.col(f"_last.{f}").alias(f) for f in fields])


def upsert_by_index(base: DataFrame, updates: DataFrame, key: str, fields: list[str],
                    order: str) -> tuple[DataFrame, DataFrame]:
    """Replace the rows of ``base`` named in ``updates`` (of several updates of
    an index the last by ``order``); updates whose index is not in ``base`` are
    returned separately (reported, not added)."""
    u = last_per_key(updates, key, fields, order).select(key, *[F.col(f).alias(f"_u_{f}") for f in fields], F.lit(True).alias("_hit"))
    merged = base.join(u, key, "left").select(
        key, *[F.when(F.col("_hit").isNotNull(), F.col(f"_u_{f}")).otherwise(F.col(f)).alias(f) for f in fields],
        F.col("_hit").isNotNull().alias("updated"))
    unmatched = updates.join(base.select(key), key, "left_anti")
    return merged, unmatched


def pair_corpora(a: DataFrame, b: DataFrame, key: str = "idx", id_col: str | None = None,
                 b_id_col: str | None = None) -> DataFrame:
    """Row i of one corpus with row i of the other, each side as JSON
    without its id; ``sample_id`` is the id of the first corpus, else the
    position."""
    drop_a, drop_b = {key, id_col}, {key, b_id_col}
    sid = F.coalesce(F.col(id_col).cast("string"), F.col(key).cast("string")) if id_col else F.col(key).cast("string")
    ja = a.select(key, sid.alias("sample_id"),
                  F.to_json(F.struct(*[c for c in a.columns if c not in drop_a])).alias("left_json"))
    jb = b.select(key, F.to_json(F.struct(*[c for c in b.columns if c not in drop_b])).alias("right_json"))
    return ja.join(jb, key, "inner")


def predictions_vs_gold(df: DataFrame, gold: str, preds: str, sizes: list[int]) -> DataFrame:
    """One prediction column per training size, unpivoted to
    (idx, train_size, gold, pred)."""
    parts = F.split(F.col(preds), ",")
    cols = [F.struct(F.lit(s).alias("train_size"), F.trim(F.try_element_at(parts, F.lit(i + 1))).alias("pred"))
            for i, s in enumerate(sizes)]
    return df.select("idx", F.trim(F.col(gold)).alias("gold"), F.explode(F.array(*cols)).alias("_p")) \
        .select("idx", "_p.train_size", "gold", "_p.pred")


def accuracy_by_size(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("train_size").agg(
        (F.count_if(F.col("pred") == F.col("gold")).cast("double") / F.count(F.lit(1))).alias("accuracy"))


def anti_ids(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Ids only in ``a`` and ids only in ``b`` (distinct)."""
    ka, kb = a.select(key).distinct(), b.select(key).distinct()
    return ka.join(kb, key, "left_anti"), kb.join(ka, key, "left_anti")


def union_models(tables: dict[str, DataFrame], model_col: str = "model") -> DataFrame:
    """H6: stack one table per tokenizer/model with the name as a column; an
    empty input is an error."""
    if not tables:
        raise ValueError("no tables to stack")
    out = None
    for name, t in tables.items():
        t = t.withColumn(model_col, F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def stack_models(wide: DataFrame, keys: list[str], columns: dict[str, str], value: str,
                 model_col: str = "model") -> DataFrame:
    """H6 from one pass: ``columns`` maps each tokenizer/model to its column of ``wide``;
    the columns become rows."""
    if not columns:
        raise ValueError("no tables to stack")
    rows = F.array(*[F.struct(F.lit(m).alias(model_col), F.col(c).alias(value)) for m, c in columns.items()])
    return wide.select(*keys, F.explode(rows).alias("_m")).select(*keys, f"_m.{value}", f"_m.{model_col}")


def join_fewshot(items: DataFrame, prefixes: DataFrame, key: str = "category") -> DataFrame:
    """The category prefix in front of each item of that category."""
    return items.join(prefixes, key, "inner")


def chunk_requests(df: DataFrame, idx: str = "idx", size: int = 50) -> DataFrame:
    """Fixed chunks of ``size`` consecutive indexes."""
    return df.withColumn("chunk", F.floor(F.col(idx) / F.lit(size)).cast("long"))


def merge_chunk_results(requests: DataFrame, results: DataFrame, idx: str, field: str,
                        original: str, order: str) -> DataFrame:
    """Results matched back by index; a missing result keeps the
    original (keyed, so a missing chunk cannot shift later rows; of several
    results of an index the last by ``order`` counts)."""
    r = last_per_key(results, idx, [field], order).select(idx, F.col(field).alias("_res"))
    return requests.join(r, idx, "left").withColumn(
        field, F.coalesce(F.col("_res"), F.col(original))).drop("_res")


def skip_existing(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Drop the runs whose output exists already (left anti join)."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


# ---------------------------------------------------------------------------
# A15 over large outputs: a stored Bloom filter of the finished ids
# ---------------------------------------------------------------------------
BLOOM_WORDS = 1 << 14          # 64-bit words of one filter: a million bits, 128 KB
BLOOM_HASHES = 4


def _bloom_bits(keys: list[str], words: int) -> list:
    """Bit numbers of a row's keys, one for each hash; null is a key value like any other."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys]
    return [F.pmod(F.xxhash64(F.lit(i), *parts), F.lit(words * 64)) for i in range(BLOOM_HASHES)]


def bloom_filter(done: DataFrame, keys: list[str], file: str | None = None, words: int = BLOOM_WORDS) -> DataFrame:
    """Filter over the finished ids as rows (file, word, bits), one filter for each output ``file`` (one
    in all where it is not given): an or of bits by partial aggregation, stored beside the outputs."""
    of = F.col(file).cast("string") if file else F.lit("")
    bits = F.explode(F.array(*_bloom_bits(keys, words))).alias("_bit")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_bit") % 64).cast("int"))
    return (done.select(of.alias("file"), bits)
            .groupBy("file", F.floor(F.col("_bit") / 64).cast("int").alias("word")).agg(F.bit_or(one).alias("bits")))


def maybe_done(todo: DataFrame, blooms: DataFrame, keys: list[str], words: int = BLOOM_WORDS) -> DataFrame:
    """``todo`` with ``_maybe``: false only where no filter holds the row's keys."""
    # ``words`` numbers, whatever the outputs hold
    merged = [0] * words
    for r in blooms.groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
        merged[r["word"]] = r["bits"]
    packed = b"".join((m & (2 ** 64 - 1)).to_bytes(8, "big") for m in merged)
    table = F.lit(bytearray(packed))
    maybe = F.lit(True)
    for bit in _bloom_bits(keys, words):
        byte = F.conv(F.hex(F.substring(table, (F.floor(bit / 64) * 8 + 8 - F.floor((bit % 64) / 8)).cast("int"), F.lit(1))), 16, 10)
        maybe = maybe & (F.call_function("shiftright", byte.cast("int"), (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return todo.withColumn("_maybe", maybe)


def skip_finished(todo: DataFrame, done: DataFrame, blooms: DataFrame, keys: list[str], words: int = BLOOM_WORDS) -> DataFrame:
    """A15 over large outputs: rows that the stored filters rule out go straight on; only the others
    meet the outputs in the exact anti join. Null keys match null keys."""
    marked = maybe_done(todo, blooms, keys, words)
    d = done.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rest = marked.where("_maybe").join(d, same, "left_anti")
    return marked.where("NOT _maybe").unionByName(rest).drop("_maybe")
