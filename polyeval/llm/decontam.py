"""Benchmark decontamination by template windows, DataFrame functions only.

A text becomes a list of tokens: words, and numbers with the currency sign or
unit beside them. Numbers, quantities (numbers with sign or unit) and names
(words with a capital first letter) are slots: the template keeps their type,
the slot list their value. Windows of ``width`` template tokens, with at least
``min_literal`` plain words, are hashed on both sides and joined by the hash; a
bit map of the items' hashes, of fixed size, holds most other windows back
before the join.

Windows of one document and item at one offset are an alignment. It is
consistent when its names map one to one (``Tom`` is ``Ann`` everywhere, and
nothing else is), which is what a question with new numbers and names keeps and
an accidental template does not. Numbers and quantities are free: new numbers
may collide, and one number of the item may have several parts to play. An item
is reported for a document when at least ``min_coverage`` of its windows occur
in consistent alignments, or occur with unchanged names.

Each window is hashed by its wording too, the tokens themselves in one letter
case, so that a copy in other letter case, where other words are names, counts
as found with unchanged slots. An item without a window of ``min_literal`` plain
words (fewer than ``width`` tokens, mostly numbers or names) is found by its
wording alone: windows of ``width`` tokens, or of all its tokens where it has
fewer; documents are hashed at each width that occurs. In scripts written
without spaces each character is a token.

The item windows are broadcast when a count shows at most ``BROADCAST_WINDOWS``
of them; beyond it the join shuffles by hash, where skewed hashes are split by
adaptive execution.

Edge cases: null and empty texts and items have no window; neither have items
without a letter or digit; punctuation is not compared; rows without doc_id or item_id are not
reported; repeated rows count once; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyeval.llm import common
from polyeval.llm.common import written

WIDTH = 8
MIN_LITERAL = 4
MIN_COVERAGE = 0.5
BROADCAST_WINDOWS = 200_000
BROADCAST_HITS = 2_000_000    # ids of documents that go, broadcast at most
SIEVE_BITS = 1 << 18           # smallest bit map of item window hashes
SIEVE_MAX = 1 << 24            # largest: beyond a million item windows more document windows pass to the join
SIEVE_LOAD = 16                # bits of the map for each item window
NUMBER, QUANTITY, NAME = -1, -2, -3

# fixed values: unit words that may follow a number
UNITS = ("kg", "g", "mg", "lb", "lbs", "oz", "ton", "tons", "km", "m", "cm", "mm", "mi", "mile", "miles", "meter",
         "meters", "metre", "metres", "feet", "foot", "ft", "inch", "inches", "yard", "yards", "l", "ml", "liter",
         "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute", "minutes",
         "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars",
         "euro", "euros", "cent", "cents", "percent", "degree", "degrees", "mph", "kmh")
# scripts without spaces between words: Thai to Tibetan, Myanmar, Khmer, kana, Han
UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
# a word; a character of an unspaced script; a number with its currency sign or unit
TOKEN = (rf"[^\P{{L}}{UNSPACED}]+|[{UNSPACED}]|(?:[$€£] ?)?[0-9]+(?:[.,][0-9]+)*(?: ?[%°]| ?(?i:"
         + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + r")(?!\p{L}))?")
_SEP = "\u001f"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def _codes(words: Column) -> Column:
    """Template of a token list as numbers: the word's hash, or NUMBER, QUANTITY or NAME.

    Compared as bytes: digits and signs come before ``:``, capital letters before
    ``[``, small ASCII letters before U+0080."""
    def code(word):
        last = F.right(word, F.lit(1))
        amount = F.when((last >= "0") & (last < ":") & (word >= "0") & (word < ":"), F.lit(NUMBER)).otherwise(F.lit(QUANTITY))
        return (F.when(word < ":", amount)
                .when(word < "[", F.lit(NAME))
                .when(word < "\u0080", F.xxhash64(word))
                .when(word.startswith("€") | word.startswith("£"), F.lit(QUANTITY))
                .when(F.substring(word, 1, 1) != F.lower(F.substring(word, 1, 1)), F.lit(NAME))
                .otherwise(F.xxhash64(word)))
    return F.transform(words, code)


def _is_slot(code: Column) -> Column:
    return (code >= NAME) & (code <= NUMBER)


def _is_amount(value: Column) -> Column:
    """True for the value of a number or quantity slot."""
    return value.rlike("^[$€£0-9]")


def _coded(rows: DataFrame, key: str) -> DataFrame:
    cut = rows.where(F.col(key).isNotNull()).select(F.col(key).alias(key), tokens(F.col("text")).alias("words"))
    return cut.select(key, "words", _codes(F.col("words")).alias("codes"),
                      F.transform("words", lambda w: F.xxhash64(F.upper(w))).alias("values"))


def _starts(width: int) -> Column:
    n = F.size("codes")
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


def _at(pos: Column, width: int, column: str = "codes") -> list[Column]:
    """The window's elements one by one: ``slice`` would copy the whole list for every window."""
    return [F.get(F.col(column), pos + j) for j in range(width)]


def _template(pos: Column, width: int) -> Column:
    return F.xxhash64(*_at(pos, width))


def _slots(pos: Column, width: int) -> Column:
    """The slot values of a window, in order and in one letter case."""
    return F.upper(F.concat_ws(_SEP, *[F.when(_is_slot(c), w) for c, w in zip(_at(pos, width), _at(pos, width, "words"))]))


def _wording(pos: Column, width: int) -> Column:
    """Hash of a window's tokens in one letter case; the width keeps it apart from the templates'."""
    return F.xxhash64(F.lit(width), *_at(pos, width, "values"))


def item_windows(benchmark: DataFrame, width: int = WIDTH, min_literal: int = MIN_LITERAL) -> DataFrame:
    """(item_id, item_pos, hash, item_slots, width) of the windows with enough plain words, by
    template and by wording (no slots); of items without such a window, by wording."""
    def template(pos):
        plain = sum((F.when(_is_slot(c), 0).otherwise(1) for c in _at(pos, width)), F.lit(0))
        return F.struct(pos.alias("pos"), _template(pos, width).alias("hash"), _slots(pos, width).alias("slots"),
                        F.lit(width).alias("width"), plain.alias("plain"))

    def wording(pos, size):
        return F.struct(pos.alias("pos"), _wording(pos, size).alias("hash"), F.lit(None).cast("string").alias("slots"),
                        F.lit(size).alias("width"), F.lit(0).alias("plain"))
    eligible = _coded(benchmark, "item_id").withColumn(
        "eligible", F.filter(F.transform(_starts(width), template), lambda w: w["plain"] >= min_literal))
    n = F.size("codes")
    worded = F.transform(_starts(width), lambda pos: wording(pos, width))
    for size in range(1, width):
        worded = F.when(n == size, F.array(wording(F.lit(0), size))).otherwise(worded)
    both = F.concat("eligible", F.transform("eligible", lambda w: wording(w["pos"], width)))
    found = eligible.select("item_id", F.explode(F.when(F.size("eligible") > 0, both).otherwise(worded)).alias("w"))
    return found.select("item_id", F.col("w.pos").alias("item_pos"), F.col("w.hash").alias("hash"),
                        F.col("w.slots").alias("item_slots"), F.col("w.width").alias("width")).distinct()


def sieve_bits(n_windows: int) -> int:
    """Size of the bit map for so many item windows: a power of two of ``SIEVE_LOAD`` bits a window, from
    ``SIEVE_BITS`` (32 KB) to ``SIEVE_MAX`` (2 MB), so that few other document windows pass."""
    want = max(1, SIEVE_LOAD * n_windows)
    return min(SIEVE_MAX, max(SIEVE_BITS, 1 << (want - 1).bit_length()))


def _sieve(items: DataFrame) -> tuple[Column, int]:
    """A bit map with the hashes' low bits, as an array constant, and its size. Words of the map are made in
    the tasks; at most ``SIEVE_MAX`` / 64 of them reach the driver."""
    size = sieve_bits(items.count())
    low = F.col("hash").bitwiseAND(F.lit(size - 1))
    words = [0] * (size // 64)
    bit = F.expr("shiftleft(1L, cast(low & 63 as int))")
    for r in (items.select(low.alias("low")).groupBy(F.shiftright("low", 6).cast("int").alias("word"))
              .agg(F.bit_or(bit).alias("bits")).collect()):
        words[r["word"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>"), size


def document_windows(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, pos, hash, slots) of the windows whose hash passes the items' sieve;
    wordings have no slots.

    Equal templates have equal slots by kind, so the number of plain words is
    checked on the items alone. ``explode_outer`` keeps the planner from
    computing the windows a second time for a size filter.
    """
    # at most ``width`` numbers; documents are hashed once for each
    worded = items.where(F.col("item_slots").isNull())
    widths = sorted(r["width"] for r in worded.select("width").distinct().collect())
    by_template, by_wording = _sieve(items.where(F.col("item_slots").isNotNull())), _sieve(worded) if widths else None

    def near(hashes, size, sieve, slots):
        bits, n_bits = sieve

        def passes(i):
            h = F.get(hashes, i)
            word = F.get(bits, F.shiftright(h.bitwiseAND(F.lit(n_bits - 1)), 6).cast("int"))
            return F.bit_get(word, h.bitwiseAND(F.lit(63)).cast("int")) == 1

        def window(i):
            return F.struct(i.alias("pos"), F.get(hashes, i).alias("hash"), slots(i).alias("slots"))
        return F.transform(F.filter(_starts(size), passes), window)
    def wordings(size):
        return F.transform(_starts(size), lambda i: _wording(i, size)).alias(f"wordings{size}")
    hashed = _coded(docs, "doc_id").select(
        "doc_id", "words", "codes", F.transform(_starts(width), lambda i: _template(i, width)).alias("hashes"),
        *[wordings(w) for w in widths])
    windows = F.concat(near("hashes", width, by_template, lambda i: _slots(i, width)),
                       *[near(f"wordings{w}", w, by_wording, lambda i: F.lit(None).cast("string")) for w in widths])
    return (hashed.select("doc_id", F.explode_outer(windows).alias("w"))
            .select("doc_id", "w.pos", "w.hash", "w.slots").where(F.col("hash").isNotNull()))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, min_literal: int = MIN_LITERAL,
                 min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, n_windows
    (of the item, found), n_item_windows, coverage, n_slots, n_changed (slot
    values that differ) and kind (copy, reparameterised, or short: an item below ``width``
    tokens, whose words stand in the document)."""
    common.prepare(docs.sparkSession)
    items = written(item_windows(benchmark, width, min_literal), "items")
    totals = items.groupBy("item_id").agg(F.countDistinct("item_pos").alias("n_item_windows"), F.max("width").alias("item_width"))
    side = F.broadcast(items) if items.count() <= BROADCAST_WINDOWS else items
    met = document_windows(docs, items, width).join(side, "hash")
    pair = F.when(F.col("slots") != "", F.arrays_zip(
        F.split("item_slots", _SEP).alias("item"), F.split("slots", _SEP).alias("doc")))
    same = F.coalesce(F.forall(pair, lambda p: _is_amount(p["item"]) | (p["item"] == p["doc"])), F.lit(True))
    lines = (met.groupBy("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("offset"))
             .agg(F.collect_set(F.when(F.col("slots").isNotNull(), F.col("item_pos"))).alias("places"),
                  F.collect_set(F.when(same, F.col("item_pos"))).alias("same"),
                  F.array_distinct(F.flatten(F.collect_set(pair))).alias("pairs"),
                  F.array_distinct(F.flatten(F.collect_set(F.when(same, pair)))).alias("same_pairs")))
    names = F.filter("pairs", lambda p: ~_is_amount(p["item"]))
    n = F.size(names)
    fits = ((F.size(F.array_distinct(F.transform(names, lambda p: p["item"]))) == n)
            & (F.size(F.array_distinct(F.transform(names, lambda p: p["doc"]))) == n))
    kept = F.when(fits, F.col("pairs")).otherwise(F.col("same_pairs"))
    # sets over the windows of one item: bounded by the item's length
    found = (lines.select("doc_id", "item_id", F.array_sort(F.when(fits, F.array_union("places", "same")).otherwise(F.col("same"))).alias("places"),
                          F.size(kept).alias("n"), F.size(F.filter(kept, lambda p: p["item"] != p["doc"])).alias("changed"))
             .groupBy("doc_id", "item_id")
             .agg(F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("n_windows"),
                  F.max("n").cast("long").alias("n_slots"), F.max("changed").cast("long").alias("n_changed")))
    return (found.join(totals, "item_id")
            .withColumn("coverage", F.col("n_windows") / F.col("n_item_windows"))
            .where(F.col("coverage") >= min_coverage)
            .select("doc_id", "item_id", "n_windows", "n_item_windows", "coverage", "n_slots", "n_changed",
                    F.when(F.col("item_width") < width, "short").when(F.col("n_changed") > 0, "reparameterised")
                    .otherwise("copy").alias("kind")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no item is found, columns unchanged. A short item ("Paris", "What is
    it?") stands in clean documents too: it is reported, but drops none."""
    hit = written(contaminated(docs, benchmark, **options).where("kind <> 'short'").select(F.col("doc_id").alias("hit_id")).distinct(),
                  "hits")
    # few ids are counted and broadcast, so that the texts stay where they are
    hit = F.broadcast(hit) if hit.count() <= BROADCAST_HITS else hit
    return docs.join(hit, docs["doc_id"] == hit["hit_id"], "left_anti")
