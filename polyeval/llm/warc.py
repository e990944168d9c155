"""Deterministic sharded WARC archives.

Writing: records are cut into key ranges of about ``shard_bytes`` of payload
(ranges follow from the data alone, not from samples or partitions; a key above
that is cut by digest), sorted by key inside a range, and written as one gzip member each; a file is closed when
its compressed size reaches ``file_bytes``. Headers and digests are made anew,
the record id derives from key and payload, and the date is a parameter, so the
same table gives the same bytes at any layout. Every writing attempt uses names
of its own ending in ``.tmp``; the manifest of the attempts that Spark committed
is written as Parquet, then its files get their final names and other ``.tmp``
files of the shard go. A lost executor leaves at most ``.tmp`` files behind.

Of records with equal payloads of at least ``revisit_bytes`` the smallest key
holds the payload, the others are revisit records that point to it.

Reading streams the files that the manifest names and checks the block digests.

Edge cases: a null payload is empty; a null key sorts first, is never referred
to and is read back as null; rows sharing key and payload are all responses when
their key is the smallest; a null address is written as an empty one; an empty
table gives an empty manifest; other columns may have any name. Rows equal in key
and payload share a shard, however many they are.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyeval.llm import common
from polyeval.sources.stores import open_store

SHARD_BYTES = 32 << 20
FILE_BYTES = 4 << 20
REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
CELLS = 8192                   # key cells counted at once while ranges are sought
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = ("shard int, part int, temporary string, name string, first_key long, last_key long, "
            "n_records long, n_bytes long, sha256 string")
RECORDS = ("page_id long, url string, record_type string, payload binary, payload_bytes long, "
           "payload_digest string, refers_to long")


def _sums(sizes: DataFrame, lo: np.ndarray, hi: np.ndarray, step: np.ndarray) -> list[tuple[int, int, int]]:
    """(first key, last key, bytes) of the cells of ``step`` keys in the disjoint ranges lo..hi, by one job."""
    shipped = sizes.sparkSession.sparkContext.broadcast((lo, hi, step))    # three numbers a range

    @F.pandas_udf("long")
    def cell(keys: pd.Series) -> pd.Series:
        lo, hi, step = shipped.value
        k = keys.to_numpy(np.int64)
        i = np.maximum(np.searchsorted(lo, k, side="right") - 1, 0)
        inside = (k >= lo[i]) & (k <= hi[i])
        # differences as unsigned numbers: keys may lie further apart than a long holds
        start = lo[i] + ((k - lo[i]).view(np.uint64) // step[i] * step[i]).view(np.int64)
        return pd.Series(pd.arrays.IntegerArray(start, ~inside))
    rows = (sizes.groupBy(cell("key").alias("c")).agg(F.sum("n").alias("n")).where("c is not null").collect())
    out = []
    for c, n in sorted(map(tuple, rows)):
        i = int(np.searchsorted(lo, c, side="right")) - 1
        out.append((c, min(int(hi[i]), c + int(step[i]) - 1), n))
    return out


def key_bounds(sizes: DataFrame, shard_bytes: int) -> list[int]:
    """Lower bounds of the key ranges after the first, each of about ``shard_bytes``.

    ``sizes``: (key, n). Keys are counted in ``CELLS`` equal cells; all cells above the target are
    counted again in smaller ones, together, until they fit or hold one key. So there is one job a
    level, however many cells are too large, and at most 16 finer cells for each shard's worth of
    bytes reach the driver.
    """
    edge = sizes.agg(F.min("key").alias("a"), F.max("key").alias("b")).first()
    if edge["a"] is None:
        return []
    done, todo = [], [(edge["a"], edge["b"], CELLS)]
    while todo:
        lo, hi = (np.array([t[i] for t in todo], np.int64) for i in (0, 1))
        step = np.array([(b - a) // parts + 1 for a, b, parts in todo], np.uint64)
        todo = []
        for a, b, n in _sums(sizes, lo, hi, step):
            if n > shard_bytes and b > a:
                todo.append((a, b, 16 * -(-n // shard_bytes)))
            else:
                done.append((a, n))
    bounds, filled = [], 0
    for a, n in sorted(done):
        if filled and filled + n > shard_bytes:
            bounds.append(a)
            filled = 0
        filled += n
    return bounds


def hot_keys(sizes: DataFrame, shard_bytes: int) -> dict[int | None, int]:
    """Keys (the null key too) that hold more than ``shard_bytes`` and so stand for several shards;
    there are fewer of them than shards."""
    rows = sizes.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > shard_bytes).collect()
    return {r["key"]: -(-r["n"] // shard_bytes) for r in rows}


def shard_numbers(bounds: list[int], hot: dict[int | None, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, first shard, shards) of the key ranges: range 0 is that of null keys, range i that of
    keys from bounds[i - 1] on. A hot key is a range of its own, cut by digest."""
    edges = sorted({*bounds, *(k for k in hot if k is not None), *(k + 1 for k in hot if k is not None and k < (1 << 63) - 1)})
    edges = [-(1 << 63), *(e for e in edges if e > -(1 << 63))]
    shards = np.array([hot.get(None, 1), *(hot.get(e, 1) for e in edges)], np.int64)
    return np.array(edges, np.int64), np.cumsum(shards) - shards, shards


def _record_id(key, digest: str, nth: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}:{digest}:{nth}')}>"


def _clean(url: str | None) -> str:
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def _record(key, url, payload: bytes, digest: str, refers, nth: int, date: str) -> bytes:
    head = [("WARC-Type", "revisit" if refers else "response"),
            ("WARC-Record-ID", _record_id(key, digest, nth)), ("WARC-Date", date),
            ("WARC-Target-URI", _clean(url))]
    block = b""
    if refers:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(refers[0], digest)),
                 ("WARC-Refers-To-Target-URI", _clean(refers[1])), ("X-Refers-To-Page", refers[0])]
    else:
        block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
                 .encode() + payload)
    head += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"),
             ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("X-Payload-Length", len(payload)),
             ("Content-Length", len(block))]
    if key is not None:
        head.append(("X-Page-Id", key))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return text.encode("utf-8", "replace") + block + b"\r\n\r\n"


class _File:
    """One archive file under a name of this attempt."""

    def __init__(self, store, folder: str, shard: int, part: int):
        self.shard, self.part = shard, part
        self.name = f"{shard:06d}/{shard:06d}-{part:05d}.warc.gz"
        self.temporary = f"{self.name}.{uuid.uuid4().hex}.tmp"
        store.create_dir(f"{folder}/{shard:06d}", recursive=True)
        self.out = store.open_output_stream(f"{folder}/{self.temporary}", compression=None)
        self.sha, self.bytes, self.records = hashlib.sha256(), 0, 0
        self.first = self.last = None

    def add(self, key, record: bytes):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = z.compress(record) + z.flush()
        self.out.write(data)
        self.sha.update(data)
        self.bytes += len(data)
        self.records += 1
        self.first = key if self.records == 1 else self.first
        self.last = key

    def close(self) -> tuple:
        self.out.close()
        return (self.shard, self.part, self.temporary, self.name, self.first, self.last, self.records, self.bytes,
                self.sha.hexdigest())


def _writer(root: str, file_bytes: int, date: str):
    """Sorted rows (shard, key, digest, mark, url, payload, refers) -> manifest rows. A row with
    ``mark`` 0 says that the records of its key and digest revisit ``refers``."""
    def run(batches):
        store, folder = open_store(root)
        file, last, refers, nth = None, None, None, 0
        done = []
        for batch in batches:
            for row in batch.to_pylist():
                shard, key, digest = row["shard"], row["key"], row["digest"]
                if row["mark"] == 0:
                    last, refers, nth = (shard, key, digest), (row["refers"], row["refers_url"]), 0
                    continue
                if (shard, key, digest) != last:
                    last, refers, nth = (shard, key, digest), None, 0
                if file and (file.shard != shard or file.bytes >= file_bytes):
                    part = file.part + 1 if file.shard == shard else 0
                    done.append(file.close())
                    file = _File(store, folder, shard, part)
                file = file or _File(store, folder, shard, 0)
                payload = row["payload"].encode("utf-8", "replace") if row["payload"] is not None else b""
                file.add(key, _record(key, row["url"], payload, digest, refers, nth, date))
                nth += 1
        if file:
            done.append(file.close())
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
        types = [kinds[c.split()[1]] for c in MANIFEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names=names)
    return run


def _committer(root: str):
    """Committed manifest rows of whole shards: final names, then other .tmp files of the shard go."""
    def run(batches):
        store, folder = open_store(root)
        for batch in batches:
            shards = set()
            for row in batch.to_pylist():
                final, temporary = f"{folder}/{row['name']}", f"{folder}/{row['temporary']}"
                if store.get_file_info(temporary).type == pafs.FileType.File:
                    store.move(temporary, final)
                info = store.get_file_info(final)      # moved before by a lost attempt of this task
                if info.type != pafs.FileType.File or info.size != row["n_bytes"]:
                    raise OSError(f"archive file {row['name']} is missing or incomplete")
                shards.add(row["shard"])
            for shard in shards:
                for info in store.get_file_info(pafs.FileSelector(f"{folder}/{shard:06d}")):
                    if info.path.endswith(".tmp"):
                        store.delete_file(info.path)
            yield pa.RecordBatch.from_arrays([pa.array([len(shards)], pa.int64())], names=["n"])
    return run


def write_archives(pages: DataFrame, root: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES,
                   revisit_bytes: int = REVISIT_BYTES, date: str = DATE, key: str = "page_id", url: str = "url",
                   payload: str = "html") -> DataFrame:
    """Write one record per row below ``root``; the manifest, also kept as ``root``/manifest."""
    spark = pages.sparkSession
    common.prepare(spark)
    text = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.sha2(text, 256).alias("digest"),
                        F.octet_length(text).cast("long").alias("n"), F.col(url).alias("url"), text.alias("payload"))
    light = common.written(rows.select("key", "digest", "n", "url"), "digests")
    sizes = light.select("key", (F.col("n") + 400).alias("n"))
    ranges = shard_numbers(key_bounds(sizes.where("key is not null"), shard_bytes), hot_keys(sizes, shard_bytes))
    n_shards = int(ranges[2].sum())
    known = spark.sparkContext.broadcast(ranges)       # three numbers for each shard at most

    @F.pandas_udf("int")
    def shard_of(keys: pd.Series, digests: pd.Series) -> pd.Series:
        edges, first, shards = known.value
        empty = keys.isna().to_numpy()
        at = np.searchsorted(edges, pd.Series(pd.array(keys, "Int64")).fillna(0).to_numpy(np.int64), side="right")
        at[empty] = 0
        # digests are even over their first 32 bits
        part = digests.map(lambda d: int(d[:8], 16)).to_numpy(np.int64) * shards[at] >> 32
        return pd.Series((first[at] + part).astype(np.int32))

    # of rows with one key and payload the first in address order is the first record (null addresses are empty)
    first = (light.where(F.col("n") >= revisit_bytes).groupBy("digest")
             .agg(F.min("key").alias("refers"),
                  F.min(F.when(F.col("key").isNotNull(), F.struct("key", "url")))["url"].alias("refers_url"),
                  F.count(F.lit(1)).alias("copies")).where("copies > 1 and refers is not null").drop("copies"))
    marks = (light.select("key", "digest").where("key is not null").join(first, "digest").where("key > refers")
             .select("key", "digest", F.lit(0).alias("mark"), F.lit(None).cast("string").alias("url"),
                     F.lit(None).cast("string").alias("payload"), "refers", "refers_url").distinct())
    whole = rows.select("key", "digest", F.lit(1).alias("mark"), "url", "payload",
                        F.lit(None).cast("long").alias("refers"), F.lit(None).cast("string").alias("refers_url"))
    dealt = (whole.unionByName(marks).withColumn("shard", shard_of("key", "digest"))
             .repartitionById(n_shards, F.col("shard"))
             .sortWithinPartitions("shard", F.col("key").asc_nulls_first(), "digest", "mark", "url"))
    made = dealt.mapInArrow(_writer(root, file_bytes, date), MANIFEST)
    made.write.parquet(f"{root.rstrip('/')}/manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{root.rstrip('/')}/manifest")
    manifest.repartition("shard").mapInArrow(_committer(root), "n long").agg(F.sum("n")).collect()
    return manifest


def _parse(data: bytes) -> dict:
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    head = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = data[end + 4:end + 4 + int(head["content-length"])]
    if hashlib.sha256(block).hexdigest() != head["warc-block-digest"].partition(":")[2]:
        raise ValueError(f"damaged record {head['warc-record-id']}")
    kind = head["warc-type"]
    number = lambda k: int(head[k]) if k in head else None
    payload = block[block.index(b"\r\n\r\n") + 4:] if kind == "response" else None
    return {"page_id": number("x-page-id"), "url": head["warc-target-uri"], "record_type": kind, "payload": payload,
            "payload_bytes": number("x-payload-length") if payload is None else len(payload),
            "payload_digest": head["warc-payload-digest"].partition(":")[2] if payload is None
            else hashlib.sha256(payload).hexdigest(),
            "refers_to": number("x-refers-to-page")}


def _members(stream, chunk: int = 1 << 20):
    z, parts = zlib.decompressobj(31), []
    while data := stream.read(chunk):
        while data:
            parts.append(z.decompress(data))
            data = z.unused_data
            if z.eof:
                yield b"".join(parts)
                z, parts = zlib.decompressobj(31), []


def _reader(root: str):
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [(c.split()[0], kinds[c.split()[1]]) for c in RECORDS.split(", ")]

    def run(batches):
        store, folder = open_store(root)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in fields],
                                              names=[n for n, _ in fields])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for member in _members(stream):
                        rows.append(_parse(member))
                        size += len(member)
                        if size > 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)
    return run


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """The records of the files in the manifest. A revisit has no payload; its
    length and digest are those its header gives."""
    common.prepare(spark)
    manifest = spark.read.schema(MANIFEST).parquet(f"{root.rstrip('/')}/manifest")
    # a task for each file: with the number given, small inputs are not gathered into one task
    return manifest.select("name").repartition(max(1, manifest.count()), "name").mapInArrow(_reader(root), RECORDS)
