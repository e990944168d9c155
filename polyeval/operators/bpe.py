"""Token counts of a byte-pair tokenizer whose merges are data.

The merge table (rank, left, right) comes from the user's tokenizer. A word's
tokens depend on the word alone, so every distinct word of a part of an Arrow
batch is merged once and its count kept for the task's next parts; only one row a key
is shuffled, however many words the texts have.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyeval.functions.text import WORD_CHAR
from polyeval.session import ensure_checkpoint_dir, ship_package

WORDS = rf"{WORD_CHAR}+|[^\p{{L}}\p{{N}}_\s]"


def merge_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Symbols of a word: the pair of lowest rank merges first, of equal pairs the leftmost."""
    sym: list[str | None] = list(word)
    after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
    heap: list[tuple[int, int, str, str]] = []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b < len(sym):
            rank = ranks.get((sym[a], sym[b]))
            if rank is not None:
                heapq.heappush(heap, (rank, a, sym[a], sym[b]))
    for i in range(len(sym) - 1):
        offer(i, i + 1)
    while heap:
        _, a, left, right = heapq.heappop(heap)
        b = after[a]
        if sym[a] != left or b >= len(sym) or sym[b] != right:
            continue                                     # merged away since
        sym[a], sym[b] = left + right, None
        after[a] = after[b]
        if after[a] < len(sym):
            before[after[a]] = a
        offer(before[a], a)
        offer(a, after[a])
    return [s for s in sym if s is not None]


CACHE_WORDS, CACHE_CHARS = 200_000, 64    # words whose token counts a task keeps, and their length
PART_ROWS = 512                          # rows counted at a time


def _row_tokens(words: DataFrame, merges: DataFrame, out: str) -> DataFrame:
    """(key, ``out``) of a frame (key, words): tokens of every row's words. The merge table of a tokenizer
    (bounded by its vocabulary) goes to every task."""
    spark = words.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    ranks: dict[tuple[str, str], int] = {}
    for r in merges.select("rank", "left", "right").orderBy("rank").collect():
        ranks.setdefault((r["left"], r["right"]), r["rank"])
    shared = spark.sparkContext.broadcast(ranks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        known: dict[str, int] = {}
        for part in (b.slice(i, PART_ROWS) for b in batches for i in range(0, b.num_rows, PART_ROWS)):
            lists = part.column(1)
            coded = lists.flatten().dictionary_encode()
            tokens = np.empty(len(coded.dictionary), np.int64)
            for i, word in enumerate(coded.dictionary.to_pylist()):
                n = known.get(word)
                if n is None:
                    n = len(merge_word(word, table))
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    if len(word) <= CACHE_CHARS:
                        known[word] = n
                tokens[i] = n
            upto = np.concatenate([[0], np.cumsum(tokens[coded.indices.to_numpy()])])
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(upto[at[1:]] - upto[at[:-1]], pa.int64())],
                                             names=schema.names)

    schema = T.StructType([words.schema[0], T.StructField(out, T.LongType())])
    return words.mapInArrow(count, schema)


def _words(text) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORDS), 0)


def count_tokens(df: DataFrame, text: str, merges: DataFrame, key: str, out: str = "bpe") -> DataFrame:
    """(key, ``out``): tokens of every row's text; rows of one key are added up, a text without words has none."""
    rows = _row_tokens(df.select(F.col(key).alias(key), _words(text).alias("_words")), merges, out)
    # rows of one key are added up within their task before the only shuffle
    return rows.groupBy(key).agg(F.sum(out).alias(out))
