"""Counts over whole texts, one Arrow column function for many texts at once.

Words are the runs between ASCII white space. Counting works on the bytes of a
block of texts: one table look-up a byte for the character classes, and word
hashes for repeats; windows that share a hash are compared word by word, so
counts are exact.

A null text counts like an empty one: all zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from polyeval.llm.common import HashCache, blocks

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
          "n_digits", "n_punct", "n_bang", "n_wide", "n_distinct")
REPEAT = 5
#: Shares computed from the counts; inputs of the quality models.
FEATURES = ("log_words", "mean_word", "symbol_share", "upper_share", "digit_share", "punct_share", "bang_share",
            "wide_share", "dup_line_share", "repeat_share", "distinct_share", "words_per_line")

_OTHER, _SPACE, _LINE, _SYMBOL, _UPPER, _LOWER, _DIGIT, _BANG, _PUNCT, _LEAD, _TAIL = range(11)


def _classes() -> np.ndarray:
    c = np.full(256, _OTHER, np.uint8)
    for b in range(33, 127):
        ch = chr(b)
        c[b] = (_SYMBOL if ch in "#*$%&|<>" else _UPPER if ch.isupper() else _LOWER if ch.islower()
                else _DIGIT if ch.isdigit() else _BANG if ch == "!" else _PUNCT)
    c[[9, 11, 12, 13, 32]] = _SPACE
    c[10] = _LINE
    c[128:192] = _TAIL
    c[192:] = _LEAD
    return c


_CLASS = _classes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _repeat_words(codes: np.ndarray, doc: np.ndarray, n_docs: int, width: int = REPEAT) -> np.ndarray:
    """Words of each document inside windows of ``width`` words that occur twice or more in it."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(n_docs, np.int64)
    key = doc[:n].astype(np.uint64)
    for j in range(width):
        key = _mix(key * np.uint64(0xD6E8FEB86659FD93) + codes[j:n + j])
    start = np.flatnonzero(doc[:n] == doc[width - 1:])
    order = start[np.argsort(key[start], kind="stable")]
    same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    for j in range(width):
        same &= codes[order + j][1:] == codes[order + j][:-1]
    hit = np.zeros(len(codes) + 1, np.int32)
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = order[twice]
    np.add.at(hit, at, 1)
    np.add.at(hit, at + width, -1)
    return np.bincount(doc[np.cumsum(hit[:-1]) > 0], minlength=n_docs)


def count_block(texts: list[str | None], cache: HashCache) -> np.ndarray:
    """[text, COUNTS] of one block."""
    n = len(texts)
    data = [t.encode("utf-8", "replace") if t else b"" for t in texts]
    size = np.array([len(d) for d in data], np.int64)
    doc = np.repeat(np.arange(n), size)
    joined = np.frombuffer(b"".join(data), np.uint8)
    by = np.bincount(doc * 16 + _CLASS[joined], minlength=n * 16).reshape(n, 16)
    out = np.zeros((n, len(COUNTS)), np.int64)
    words = [d.split() for d in data]
    out[:, 0] = [len(w) for w in words]
    out[:, 1] = size - by[:, _SPACE] - by[:, _LINE] - by[:, _TAIL]
    out[:, 2] = by[:, _SYMBOL]
    for i, d in enumerate(data):
        lines = [x for x in d.split(b"\n") if x and not x.isspace()]
        out[i, 3] = len(lines) - len(set(lines))
        out[i, 5] = len(lines)
    codes = np.fromiter((cache[w] for ws in words for w in ws), np.uint64, int(out[:, 0].sum()))
    word_doc = np.repeat(np.arange(n), out[:, 0])
    out[:, 4] = _repeat_words(codes, word_doc, n)
    out[:, 6] = by[:, _UPPER]
    out[:, 7] = by[:, _UPPER] + by[:, _LOWER] + by[:, _LEAD]
    out[:, 8], out[:, 9], out[:, 10], out[:, 11] = by[:, _DIGIT], by[:, _PUNCT], by[:, _BANG], by[:, _LEAD]
    out[:, 12] = [len(set(w)) for w in words]
    return out


def features(c: np.ndarray) -> np.ndarray:
    """[text, FEATURES] from counts; shares of nothing are zero."""
    words, chars, lines = (np.maximum(c[:, i], 1).astype(float) for i in (0, 1, 5))
    letters = np.maximum(c[:, 7], 1).astype(float)
    return np.stack([np.log1p(c[:, 0]), c[:, 1] / words, c[:, 2] / chars, c[:, 6] / letters, c[:, 8] / chars,
                     c[:, 9] / chars, c[:, 10] / chars, c[:, 11] / chars, c[:, 3] / lines, c[:, 4] / words,
                     c[:, 12] / words, c[:, 0] / lines], axis=1)


def measure_column(extra=None) -> Column:
    """text -> struct of COUNTS (long) and FEATURES (double), and, where ``extra`` is
    given as (name, function of the feature matrix), one more double."""
    names = [(c, pa.int64()) for c in COUNTS] + [(f, pa.float64()) for f in FEATURES]
    names += [(extra[0], pa.float64())] if extra else []

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = HashCache(lambda w: xxhash.xxh64_intdigest(w, 3))
        more = extra[1]() if extra else None
        for texts in parts:
            texts = texts.to_pylist()
            made = [count_block(texts[s:e], cache) for s, e in blocks(texts, 2 << 20)]
            c = np.concatenate(made) if made else np.zeros((0, len(COUNTS)), np.int64)
            f = features(c)
            cols = [pa.array(c[:, i]) for i in range(c.shape[1])] + [pa.array(f[:, i]) for i in range(f.shape[1])]
            if more:
                cols.append(pa.array(more(f)))
            yield pa.StructArray.from_arrays(cols, [n for n, _ in names])
    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    kinds = ", ".join(f"{n} {'long' if t == pa.int64() else 'double'}" for n, t in names)
    return F.arrow_udf(run, kinds)(F.col("text"))


def sample_features(docs, labels, column: str, max_per_class: int):
    """(x, y, weight) of the bounded labelled sample, ordered by doc_id; weights restore
    the class shares of the whole training fold."""
    from polyeval.llm import common
    sample, counts = common.sample_labels(labels, column, max_per_class)
    # at most 2 * max_per_class rows, a few numbers each
    got = (common.sampled_texts(docs, sample).select("doc_id", "y", measure_column().alias("m"))
           .select("doc_id", "y", *[F.col(f"m.{f}").alias(f) for f in FEATURES]).collect())
    rows = sorted(tuple(r) for r in got)
    x = np.array([r[2:] for r in rows], float).reshape(len(rows), len(FEATURES))
    y = np.array([r[1] for r in rows], float)
    n = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.where(y == 1, counts.get(1, 0) / n[1], counts.get(0, 0) / n[0])
    return x, y, weight / weight.mean() if len(weight) and weight.mean() else weight
