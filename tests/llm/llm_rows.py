"""Rows shared by the tests of this folder."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          # names that the operators use inside
          "fp long, prefix long, node int, score double, words string, m string, slots string, key long, shard int, y int")

_SYLLABLES = "ka lo mi ra tu ven sor pel din gra sho bri".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text),
            1, 2, 3, 0.5, "w", "m", "s", 4, 5, 1)


def edge_documents():
    """Nulls, empty and very long texts, ties, repeated rows, copies and near copies."""
    passage = prose(1, 60)
    near = prose(2, 200).split()
    rows = [row(1, None), row(2, ""), row(3, "   \n\t "), row(4, "one"), row(5, "one"),
            row(6, prose(3, 12000)), row(7, "a " * 4000), row(8, "x" * 50_000),
            row(10, prose(4, 80) + " " + passage + "\n" + prose(5, 40)), row(11, passage), row(12, prose(6, 30) + " " + passage),
            row(13, passage + " " + prose(4, 80)), row(13, passage + " " + prose(4, 80)),
            row(20, " ".join(near)), row(21, " ".join(near[:100] + ["other"] + near[101:])), row(22, " ".join(near)),
            row(None, " ".join(near)), row(None, None), row(30, prose(7, 49)), row(31, prose(7, 49)),
            row(32, prose(8, 50)), row(33, prose(8, 50), None, None),
            row(40, "Tab\tline\u000bfeed\u000cform\r\nUPPER lower ÀÉ ñandú 漢字 😀 a b ▁x")]
    return rows
