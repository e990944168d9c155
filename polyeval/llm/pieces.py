"""SentencePiece encoding with byte offsets, and decoding.

The model file is read once on the driver. Its compiled character map (a
double-array trie) drives a longest-prefix normalisation that notes, for every
byte of the normalised text, the source byte it came from; merges then run on
the normalised text, and every piece is projected to its byte span in the
source. Ids equal the library's for BPE models; spans tile the source.

No piece of such a model has the space mark after another character, so merges
never leave a run "space marks, then other characters": each such run is encoded
once a task and remembered (a bounded cache), and documents are put together
from the runs with array operations.

Edge cases: a null text encodes like the empty one (no ids, decodes to ""); any
length is encoded whole; repeated rows encode alike; models with user-defined,
unused or suffix-space pieces or of another type are refused.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyeval.llm import common
from polyeval.llm.common import CACHE_WORDS, blocks

MARK = "▁"
SHORT_RUN = 64                 # characters; shorter runs are merged many at once, longer ones with a heap
RUNS_AT_ONCE = 20_000
_RUN = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


class CharMap:
    """Longest-prefix replacement through a compiled character map (empty: each character is itself)."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.trie = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self.strings = blob[4 + size:]
        self.known: dict[bytes, tuple[bytes, int]] = {}

    def replace(self, data: bytes, at: int) -> tuple[bytes, int]:
        """(replacement, number of source bytes) of the longest entry at ``at``."""
        width = _width(data[at])
        if self.trie:
            node, length, value = 0, 0, -1
            unit = self.trie[0]
            node ^= _offset(unit)
            for i in range(at, len(data)):
                node ^= data[i]
                unit = self.trie[node]
                if unit & 0x800000FF != data[i]:
                    break
                node ^= _offset(unit)
                if unit >> 8 & 1:
                    length, value = i + 1 - at, self.trie[node] & 0x7FFFFFFF
            if length:
                return self.strings[value:self.strings.index(b"\0", value)], length
        return data[at:at + width], width


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 512) >> 6)


def _width(lead: int) -> int:
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Merges:
    """All two-part splits of the pieces in a hash table, so that the pairs of many runs are looked up at once."""

    def __init__(self, ids: dict[str, int], scores: list[float]):
        symbols = dict.fromkeys(ids)
        symbols.update(dict.fromkeys(c for p in ids for c in p))
        number = {s: i for i, s in enumerate(symbols)}
        self.id = np.array([ids.get(s, -1) for s in number], np.int64)
        self.bytes = np.array([len(s.encode()) for s in number], np.int64)
        # characters that no piece holds stand behind the symbols
        self.of_char = np.arange(len(number), len(number) + 0x110000, dtype=np.int32)
        self.char = np.full(len(number), -1, np.int64)
        for s, i in number.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
                self.char[i] = ord(s)
        keys, made, cost = [], [], []
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                a, b = number.get(piece[:k]), number.get(piece[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(number[piece])
                    cost.append(-scores[i])
        bits = max(4, (8 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, -1, np.int64)
        self.made = np.full(1 << bits, -1, np.int32)
        self.cost = np.full(1 << bits, np.inf)
        key, todo = np.array(keys, np.int64), np.arange(len(keys))
        at = self._slot(key)
        while len(todo):                       # linear probing, all keys at once
            slot = at[todo]
            free = self.key[slot] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            where = todo[put]
            self.key[at[where]] = key[where]
            self.made[at[where]] = np.array(made, np.int32)[where]
            self.cost[at[where]] = np.array(cost)[where]
            todo = todo[~put]
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Table slots of the pairs; one without an entry gets a free slot (cost infinite)."""
        key = a.astype(np.int64) << 32 | b
        at = self._slot(key)
        there = self.key[at]
        off = np.flatnonzero((there != key) & (there >= 0))
        while len(off):
            at[off] = (at[off] + 1) & self.mask
            there = self.key[at[off]]
            off = off[(there != key[off]) & (there >= 0)]
        return at

    def pieces_of(self, symbol: np.ndarray, byte_ids: np.ndarray):
        """(ids, bytes, pieces a symbol): a symbol that is no piece is one character, and gives one piece a byte."""
        known = symbol < len(self.id)
        ids = self.id[np.where(known, symbol, 0)]
        odd = ~known | (ids < 0)
        if not odd.any():
            return ids, self.bytes[symbol], np.ones(len(symbol), np.int64)
        char = np.where(known, self.char[np.where(known, symbol, 0)], symbol - len(self.id))[odd]
        width = 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)
        count = np.ones(len(symbol), np.int64)
        count[odd] = width
        some = np.repeat(odd, count)
        out, size = np.repeat(ids, count), np.repeat(self.bytes[np.where(known, symbol, 0)], count)
        out[some] = byte_ids[np.frombuffer("".join(map(chr, char.tolist())).encode(), np.uint8)]
        size[some] = 1
        return out, size, count

    def join(self, sym: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Symbol numbers [run, place] of runs of ``size`` symbols (the last column is free) after all merges:
        in every run the pair of best score, then leftmost, one a round. Places merged away hold -1."""
        n, width = sym.shape[0], sym.shape[1] - 1
        place = np.arange(width)
        cost = np.full((n, width), np.inf)
        made = np.full((n, width), -1, np.int32)
        row, col = np.nonzero(place < size[:, None] - 1)
        slot = self.find(sym[row, col], sym[row, col + 1])
        cost[row, col], made[row, col] = self.cost[slot], self.made[slot]
        after = np.broadcast_to(place + 1, (n, width)).copy()
        after[np.arange(n), size - 1] = width
        before = np.broadcast_to(np.where(place, place - 1, width), (n, width)).copy()
        before = np.concatenate([before, np.full((n, 1), width)], axis=1)
        rows = np.arange(n)
        while len(rows):
            at = cost[rows].argmin(axis=1)
            on = cost[rows, at] < np.inf
            rows, at = rows[on], at[on]
            gone = after[rows, at]
            sym[rows, at] = made[rows, at]
            sym[rows, gone] = -1
            cost[rows, gone] = np.inf
            right, left = after[rows, gone], before[rows, at]
            after[rows, at] = right
            before[rows, right] = at
            for a, b in ((at, right), (left, at)):
                has = (a < width) & (b < width)
                slot = self.find(sym[rows[has], a[has]], sym[rows[has], b[has]])
                cost[rows[has], a[has]], made[rows[has], a[has]] = self.cost[slot], self.made[slot]
            last = right == width
            cost[rows[last], at[last]] = np.inf
        return sym[:, :width]


@dataclass
class Model:
    """What encoding needs of a model file; picklable."""
    ids: dict[str, int]
    scores: list[float]
    pieces: list[str]
    kinds: list[int]
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool               # remove leading, trailing and repeated spaces
    escape: bool
    byte_ids: list[int] = field(default_factory=list)
    unknown: int = 0
    unknown_text: str = " ⁇ "
    merges: Merges | None = None

    @classmethod
    def load(cls, path: str) -> "Model":
        from sentencepiece import sentencepiece_model_pb2 as pb
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = [p.type for p in proto.pieces]
        if proto.trainer_spec.model_type != 2 or set(kinds) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE} \
                or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models of normal, byte, control and unknown pieces")
        pieces = [p.piece for p in proto.pieces]
        if any(MARK in p.lstrip(MARK) for p, k in zip(pieces, kinds) if k == _NORMAL):
            raise ValueError("a piece has a space mark inside")
        spec = proto.normalizer_spec
        made = cls({p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == _NORMAL},
                   [p.score for p in proto.pieces], pieces, kinds, spec.precompiled_charsmap,
                   spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces,
                   unknown=kinds.index(_UNKNOWN), unknown_text=proto.trainer_spec.unk_surface)
        if _BYTE in kinds:
            by_name = {p: i for i, p in enumerate(pieces)}
            made.byte_ids = [by_name[f"<0x{b:02X}>"] for b in range(256)]
        made.merges = Merges(made.ids, made.scores)
        return made


def _view(numbers: array) -> np.ndarray:
    """The numbers without a copy; only for reading at once, the array cannot grow while a view lives."""
    return np.frombuffer(numbers, np.int64)


class Encoder:
    def __init__(self, model: Model):
        self.m, self.map = model, CharMap(model.charsmap)
        self.byte_ids = np.array(model.byte_ids, np.int64)
        self.plain = not model.charsmap and not model.squeeze and model.escape and model.dummy_prefix
        self._reset()

    def _reset(self):
        self.code: dict[str, int] = {}
        # per run: first piece, pieces, bytes; per piece: id, end in the normalised and in the source run
        self.start, self.length, self.norm_bytes, self.source_bytes = (array("q") for _ in range(4))
        self.flat_id, self.flat_end, self.flat_source = (array("q") for _ in range(3))

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the source byte offset."""
        data, m = text.encode("utf-8", "replace"), self.m
        out, origin, at = bytearray(), array("q"), 0
        mark = MARK.encode() if m.escape else b" "
        if m.squeeze:
            while at < len(data):
                sp, n = self.map.replace(data, at)
                if sp != b" ":
                    break
                at += n
        if at >= len(data):
            return "", np.array([at])
        if m.dummy_prefix:
            out += mark
            origin.extend([at] * len(mark))
        after_space = m.squeeze
        while at < len(data):
            sp, n = self.map.replace(data, at)
            while after_space and sp.startswith(b" "):
                sp = sp[1:]
            if sp:
                new = sp.replace(b" ", mark)
                out += new
                origin.extend([at] * len(new))
                after_space = m.squeeze and sp.endswith(b" ")
            at += n
        end = at
        if m.squeeze:
            while out.endswith(mark):
                end = origin[len(out) - len(mark)]
                del out[-len(mark):]
        return out.decode("utf-8", "replace"), np.append(np.array(origin[:len(out)], np.int64), end)

    def _join_long(self, run: str) -> list[str]:
        """Symbols of a run of any length after all merges, with a heap: best score first, then leftmost."""
        ids, scores = self.m.ids, self.m.scores
        sym: list[str | None] = list(run)
        nxt, prv = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap: list = []

        def offer(a: int, b: int):
            if a >= 0 and b < len(sym):
                i = ids.get(sym[a] + sym[b])
                if i is not None:
                    heapq.heappush(heap, (-scores[i], a, b, len(sym[a]) + len(sym[b])))
        for a in range(len(sym) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, n = heapq.heappop(heap)
            if sym[a] is None or sym[b] is None or len(sym[a]) + len(sym[b]) != n:
                continue
            sym[a] += sym[b]
            sym[b] = None
            nxt[a] = nxt[b]
            if nxt[a] < len(sym):
                prv[nxt[a]] = a
            offer(prv[a], a)
            offer(a, nxt[a])
        return [s for s in sym if s is not None]

    def merge(self, run: str) -> list[tuple[int, int]]:
        """(id, end byte) of the pieces of one run."""
        ids = self.m.ids
        out, end = [], 0
        for s in self._join_long(run):
            data = s.encode()
            i = ids.get(s)
            if i is not None:
                out.append((i, end + len(data)))
            elif self.m.byte_ids:
                out += [(self.m.byte_ids[b], end + k + 1) for k, b in enumerate(data)]
            elif out and out[-1][0] == self.m.unknown:
                out[-1] = (self.m.unknown, end + len(data))
            else:
                out.append((self.m.unknown, end + len(data)))
            end += len(data)
        return out

    def _learn_one(self, run: str) -> None:
        self.code[run] = len(self.start)
        done = self.merge(run)
        data = run.encode()
        self.start.append(len(self.flat_id))
        self.length.append(len(done))
        self.norm_bytes.append(len(data))
        self.source_bytes.append(len(data) - 2 * run.count(MARK))
        lead = len(run) - len(run.lstrip(MARK))
        for i, e in done:
            self.flat_id.append(i)
            self.flat_end.append(e)
            self.flat_source.append(e - 2 * min(lead, e // 3))

    def _learn(self, runs: list[str]) -> None:
        """Merge new runs and remember them, runs of a like length together; long runs (and all runs of
        a model without byte pieces) one by one."""
        by_width: dict[int, list[str]] = {}
        for run in runs:
            if len(run) > SHORT_RUN or not len(self.byte_ids):
                self._learn_one(run)
            else:
                by_width.setdefault(max(4, 1 << (len(run) - 1).bit_length()), []).append(run)
        merges = self.m.merges
        for width, some in by_width.items():
            for s in range(0, len(some), RUNS_AT_ONCE):
                part = some[s:s + RUNS_AT_ONCE]
                size = np.array([len(r) for r in part], np.int64)
                char = merges.of_char[np.frombuffer("".join(part).encode("utf-32-le"), "<u4")]
                row = np.repeat(np.arange(len(part)), size)
                sym = np.full((len(part), width + 1), -1, np.int32)
                sym[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = char
                sym = merges.join(sym, size)
                row, col = np.nonzero(sym >= 0)
                ids, n_bytes, expanded = merges.pieces_of(sym[row, col], self.byte_ids)
                row, names = np.repeat(row, expanded), part
                count = np.bincount(row, minlength=len(names))
                stop = np.cumsum(count)
                end = np.cumsum(n_bytes)
                total = end[stop - 1]
                norm = np.diff(np.r_[0, total])
                end = end - np.repeat(total - norm, count)
                marks = np.array([r.count(MARK) for r in names], np.int64)     # all in front
                source = end - 2 * np.minimum(np.repeat(marks, count), end // 3)
                self.code.update(zip(names, range(len(self.start), len(self.start) + len(names))))
                first = len(self.flat_id)
                for kept, new in ((self.start, first + stop - count), (self.length, count), (self.norm_bytes, norm),
                                  (self.source_bytes, norm - 2 * marks), (self.flat_id, ids), (self.flat_end, end),
                                  (self.flat_source, source)):
                    kept.frombytes(new.astype(np.int64).tobytes())

    def encode_block(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, ends, offsets): pieces of all texts end to end; text i has offsets[i]:offsets[i+1]."""
        if len(self.code) > CACHE_WORDS:
            self._reset()
        split, origins = [], []
        for text in texts:
            origin = None
            if not text:
                parts = []
            elif self.plain and MARK not in text:
                parts = _RUN.findall(MARK + text.replace(" ", MARK))
            else:
                norm, origin = self.normalise(text)
                parts = _RUN.findall(norm)
            split.append(parts)
            origins.append(origin)
        known = self.code
        self._learn([p for p in set().union(*split) if p not in known])
        runs = [len(parts) for parts in split]
        code = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, sum(runs))
        length = _view(self.length)[code]
        total = int(length.sum())
        stop = np.cumsum(length)
        at = np.arange(total) + np.repeat(_view(self.start)[code] - (stop - length), length)
        ids = _view(self.flat_id)[at].astype(np.int32)
        edge = np.r_[0, np.cumsum(runs)]
        offsets = np.r_[0, stop][edge]
        source = _view(self.source_bytes)[code]
        before = np.cumsum(source) - source
        first = np.repeat(np.r_[before, 0][edge[:-1]], runs) if len(code) else before
        # the mark in front of a text stands for no source byte
        ends = _view(self.flat_source)[at] + np.repeat(before - first, length) - 1
        for i, origin in enumerate(origins):
            if origin is not None:
                part = slice(edge[i], edge[i + 1])
                norm = _view(self.norm_bytes)[code[part]]
                where = np.repeat(np.cumsum(norm) - norm, length[part])
                piece = slice(offsets[i], offsets[i + 1])
                ends[piece] = origin[_view(self.flat_end)[at[piece]] + where]
        begins = np.r_[0, ends][:total]
        starts = offsets[:-1][np.diff(offsets) > 0]
        begins[starts] = 0
        for i, origin in enumerate(origins):
            if origin is not None and offsets[i] < offsets[i + 1]:
                begins[offsets[i]] = origin[0]
        return ids, begins.astype(np.int32), ends.astype(np.int32), offsets


class Decoder:
    def __init__(self, model: Model):
        self.m = model
        self.text = [chr(0xDC00 + int(p[3:5], 16)) if k == _BYTE and int(p[3:5], 16) >= 128
                     else chr(int(p[3:5], 16)) if k == _BYTE
                     else "" if k == _CONTROL else model.unknown_text if k == _UNKNOWN else p.replace(MARK, " ")
                     for p, k in zip(model.pieces, model.kinds)]
        # bytes above 127 stand in as lone surrogates until the whole text is joined
        self.strip = model.dummy_prefix or model.squeeze
        self.space = np.array([k == _NORMAL and p.startswith(MARK) for p, k in zip(model.pieces, model.kinds)])
        self.silent = np.array([k == _CONTROL for k in model.kinds])

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        text = "".join(map(self.text.__getitem__, ids.tolist()))
        if self.strip and len(ids) and self.space[ids[0]]:
            cut = 1
            if self.m.squeeze:
                cut = len(text) - len(text.lstrip(" "))
            text = text[cut:]
        if text.isascii():
            return text
        try:
            return text.encode("utf-8", "surrogateescape").decode("utf-8")
        except UnicodeDecodeError:
            return _lenient(text)


def _lenient(text: str) -> str:
    """Bytes that make no character become U+FFFD one by one."""
    def fix(run):
        data, out, i = run.group().encode("utf-8", "surrogateescape"), [], 0
        while i < len(data):
            n = _width(data[i])
            try:
                out.append(data[i:i + n].decode())
                i += n
            except UnicodeDecodeError:
                out.append("�")
                i += 1
        return "".join(out)
    return re.sub("[\udc80-\udcff]+", fix, text)


def _lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))


def shipped(spark: SparkSession, path: str):
    """The model as a broadcast value (a vocabulary of fixed size)."""
    common.prepare(spark)
    return spark.sparkContext.broadcast(Model.load(path))


def _encode(model, decode: bool, rows_at_once: int = 256):
    """Batches (doc_id, text) -> batches of bounded size with pieces and spans."""
    def run(batches):
        encoder, decoder = Encoder(model.value), Decoder(model.value)
        names = ["doc_id", "ids", "begins", "ends", *["decoded"] * decode]
        for batch in batches:
            for start in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(start, rows_at_once)
                texts = part.column(1).to_pylist()
                for s, e in blocks(texts, 1 << 20):
                    ids, begins, ends, offsets = encoder.encode_block(texts[s:e])
                    columns = [part.column(0).slice(s, e - s), *(_lists(x, offsets) for x in (ids, begins, ends))]
                    if decode:
                        columns.append(pa.array([decoder.decode(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:])],
                                                pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names)
    return run


def encode_documents(docs: DataFrame, path: str, decode: bool = False) -> DataFrame:
    """doc_id, ids, begins, ends of every row: pieces of the whole text with their
    source bytes; ``decode`` adds the text that the ids decode to."""
    model = shipped(docs.sparkSession, path)
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    kinds = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, begins array<int>, ends array<int>"
    return rows.mapInArrow(_encode(model, decode), kinds + ", decoded string" * decode)


def decode_rows(encoded: DataFrame, path: str, name: str = "decoded") -> DataFrame:
    """Any frame with a column ``ids``, and the text that they decode to."""
    model = shipped(encoded.sparkSession, path)

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(model.value)
        for ids in parts:
            yield pa.array([None if x is None else decoder.decode(x) for x in ids.to_pylist()], pa.string())
    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return encoded.withColumn(name, F.arrow_udf(run, "string")(F.col("ids")))


def token_report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 (begins, a slash, ends of the pieces
    in source bytes), source_bytes (end of the last piece) and ids."""
    rows = encode_documents(docs, path, decode=True)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"),
                       F.sha2(F.concat_ws("/", F.array_join(F.col("begins").cast("array<string>"), ","),
                                          F.array_join(F.col("ends").cast("array<string>"), ",")), 256).alias("spans_sha256"),
                       F.coalesce(F.array_max("ends"), F.lit(0)).cast("long").alias("source_bytes"), "ids")
