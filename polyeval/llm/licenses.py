"""Licence scans by a generalised suffix automaton.

The automaton holds every word run of the licence templates and phrases. A text
streams through it word by word; the state and length at each word are the
matching statistics (longest run ending here that some template holds). Phrases
ending at a word follow from the state's suffix links. Runs of ``MIN_MATCH`` and
more words that cannot be prolonged are chained per template (in template order,
at most ``MAX_GAP`` foreign words between) to covered spans; a chain that covers
``MIN_COVER`` of a template adds the template's label.

Edge cases: null and empty texts have no words; words are counted whole at any
length; repeated texts scan alike; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyeval.llm import common

MIN_MATCH = 4
MAX_GAP = 12
MIN_COVER = 0.5

# fixed values: base phrases and their labels
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# fixed values: wording of well-known licence grants and notices
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "Released under the MIT License"),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0"),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version",
        "This work is licensed under the GNU General Public License, version 3"),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "Creative Commons Attribution NonCommercial 4.0 International License"),
    "cc-by": ("Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
}

_KEEP = bytes(b if (48 <= b <= 57 or 97 <= b <= 122 or b >= 128) else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().translate(_KEEP).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, templates=None, phrases=None):
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[dict[int, int]] = [{}]       # state -> {template: end word of one occurrence}
        self.templates: list[tuple[str, int]] = []     # (label, words)
        for label, texts in (TEMPLATES if templates is None else templates).items():
            for text in texts:
                words = words_of(text)
                self.templates.append((label, len(words)))
                self._add(words, len(self.templates) - 1)
        self.phrases = [(words_of(p), label) for p, label in (PHRASES if phrases is None else phrases).items()]
        for words, _ in self.phrases:
            self._add(words, None)
        self._spread()

    def _ids(self, words):
        return [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]

    def _new(self, length, nxt, link) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.places.append({})
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:                              # the run is known already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _add(self, words, template):
        last = 0
        for i, c in enumerate(self._ids(words)):
            last = self._extend(last, c)
            if template is not None:
                self.places[last][template] = i + 1

    def _spread(self):
        """Places and phrases of a state hold for the states its suffix links lead to and from."""
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            for t, e in self.places[s].items():
                self.places[self.link[s]].setdefault(t, e)
        at = {}
        for k, (words, _) in enumerate(self.phrases):
            s = 0
            for c in self._ids(words):
                s = self.next[s][c]
            at.setdefault(s, []).append(k)
        self.ends: list[tuple[tuple[int, int], ...]] = []   # state -> (words, phrase) of phrases that are suffixes
        for s in range(len(self.next)):
            found, v = [], s
            while v > 0:
                found += [(len(self.phrases[k][0]), k) for k in at.get(v, ())]
                v = self.link[v]
            self.ends.append(tuple(found))

    def scan(self, words: list[bytes]):
        """(phrase hits as (start, phrase), maximal runs as (start, stop, state)) of one text."""
        ids = np.fromiter((self.vocabulary.get(w, -1) for w in words), np.int64, len(words))
        hits, runs = [], []
        known = np.flatnonzero((ids >= 0) & (np.r_[ids[1:], -1] >= 0) | (ids >= 0) & (np.r_[-1, ids[:-1]] >= 0))
        state, length, before = 0, 0, -2
        nxt, link, size, ends = self.next, self.link, self.length, self.ends
        for i, c in zip(known.tolist(), ids[known].tolist()):
            if i != before + 1:
                if length >= MIN_MATCH:
                    runs.append((before + 1 - length, before + 1, state))
                state = length = 0
            elif c not in nxt[state] and length >= MIN_MATCH:
                runs.append((before + 1 - length, before + 1, state))
            while state and c not in nxt[state]:
                state = link[state]
                length = size[state]
            to = nxt[state].get(c)
            if to is not None:
                state, length = to, length + 1
                for n, k in ends[state]:
                    if n <= length:
                        hits.append((i + 1 - n, k))
            before = i
        if length >= MIN_MATCH:
            runs.append((before + 1 - length, before + 1, state))
        return hits, runs

    def chains(self, runs):
        """Covered spans (label, start, stop, covered, share) of the runs, one pass per template."""
        open_chain: dict[int, list] = {}
        done = []
        for start, stop, state in runs:
            for t, end in self.places[state].items():
                begin = end - (stop - start)
                now = open_chain.get(t)
                if now and begin >= now[2] and 0 <= start - now[1] <= MAX_GAP:
                    now[1], now[2], now[3] = stop, end, now[3] + stop - start
                else:
                    if now:
                        done.append((t, *now))
                    open_chain[t] = [start, stop, end, stop - start]
        done += [(t, *now) for t, now in open_chain.items()]
        return [(self.templates[t][0], a, b, covered, covered / self.templates[t][1])
                for t, a, b, _, covered in done if covered >= MIN_COVER * self.templates[t][1]]


RESULT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "spans array<struct<label:string,start:long,stop:long,covered:long,share:double>>")


def scan_text(automaton: Automaton, text: str | None) -> dict:
    words = words_of(text)
    hits, runs = automaton.scan(words)
    spans = sorted(automaton.chains(runs), key=lambda s: (s[1], s[2], s[0]))
    base = {automaton.phrases[k][1] for _, k in hits}
    starts = [s for s, _ in hits]
    best = max([s[4] for s in spans], default=0.0)
    return {"n_words": len(words), "n_base": len(hits), "first_word": min(starts, default=None),
            "last_word": max(starts, default=None), "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {s[0] for s in spans})),
            "score": 1 - (1 - min(best, 1.0)) * (0.5 if hits else 1.0),
            "spans": [dict(zip(("label", "start", "stop", "covered", "share"), s)) for s in spans]}


def scan_column():
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("covered", pa.int64()),
                      ("share", pa.float64())])
    types = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
             ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))]

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = Automaton()
        for texts in parts:
            rows = [scan_text(automaton, t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([r[n] for r in rows], t) for n, t in types], [n for n, _ in types])
    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, RESULT)(F.col("text"))


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id and the fields of RESULT for every row; ``spans`` are word ranges of template wording."""
    common.prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).select(
        "doc_id", scan_column().alias("r")).select("doc_id", "r.*")
