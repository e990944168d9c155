import hashlib
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_rows import SCHEMA, edge_documents, prose, row  # noqa: E402

from polyeval.llm import common, kdshards, warc  # noqa: E402
from polyeval.llm.queries import op2_warc_archives, op5_kd_shards  # noqa: E402

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, shard int, mark int, refers long, payload string"


def page(i, url, html):
    return (i, url, html, 1, 2, 3, "p")


def expected_records(rows):
    first = {}
    for k, h in rows:
        data = (h or "").encode()
        if k is not None and len(data) >= 100:
            first[data] = min(k, first.get(data, k))
    out = []
    for k, h in rows:
        data = (h or "").encode()
        f = first.get(data)
        other = k is not None and f is not None and f < k
        out.append((k, len(data), hashlib.sha256(data).hexdigest(), "revisit" if other else "response", f if other else None))
    return sorted(map(str, out))


def test_archives_round_trip_and_are_deterministic(spark):
    big = "<p>" + prose(1, 60_000) + "</p>"
    rows = [page(1, "http://a/1", "x" * 100), page(2, None, "x" * 100), page(3, "http://a/\n3 é", "x" * 99), page(4, "u", None),
            page(5, "u", ""), page(6, "u", big), page(-7, "u", "ü" * 70), page(8, "u", "ü" * 70), page(None, "u", "x" * 100),
            page(9, "u", "x" * 99), page(9, "u", "x" * 99), page(1 << 60, "u", big), page(1, "http://a/1", "x" * 100),
            page(10, "u", "\r\n\r\nWARC/1.1\r\n" + prose(2, 40))]
    df = spark.createDataFrame(rows, PAGES)
    sums = []
    for frame, parts in ((df, 1), (df.repartition(5), 5)):
        root = common.shared_path(spark, "test-archives")
        manifest = warc.write_archives(frame, root, shard_bytes=2000, file_bytes=600)
        names = sorted((r.name, r.sha256, r.n_bytes) for r in manifest.collect())
        store, folder = warc.open_store(root)
        for name, sha, size in names:
            with store.open_input_stream(f"{folder}/{name}", compression=None) as f:
                data = f.read()
            assert len(data) == size and hashlib.sha256(data).hexdigest() == sha
        import pyarrow.fs as fs
        files = store.get_file_info(fs.FileSelector(folder, recursive=True))
        assert not [f.path for f in files if f.path.endswith(".tmp")]
        sums.append(names)
        got = warc.read_archives(spark, root).collect()
        assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == \
            expected_records([(r[0], r[2]) for r in rows])
        for r in got:
            assert (r.payload is None) == (r.record_type == "revisit")
    assert sums[0] == sums[1] and len(sums[0]) > 3


def test_archives_of_an_empty_table(spark):
    root = common.shared_path(spark, "test-archives")
    assert warc.write_archives(spark.createDataFrame([], PAGES), root).collect() == []
    assert warc.read_archives(spark, root).collect() == []


def test_archive_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()]
    got = [str(tuple(r)) for r in op2_warc_archives(spark, SF).collect()]
    assert sorted(got) == expected_records(rows)


def test_key_ranges_split_clustered_keys(spark):
    keys = [(k, 10) for k in range(500)] + [((1 << 50) + k, 10) for k in range(500)]
    bounds = warc.key_bounds(spark.createDataFrame(keys, "key long, n long"), 500)
    edges = [-1 << 62, *bounds, 1 << 62]
    held = [sum(n for k, n in keys if a <= k < b) for a, b in zip(edges, edges[1:])]
    assert sum(held) == 10_000 and max(held) <= 1000


def check_shards(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards_of_edge_rows(spark):
    rows = edge_documents()
    got = kdshards.shard_documents(spark.createDataFrame(rows, SCHEMA), shards=5, block_rows=4).collect()
    import zlib
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in got) == \
        sorted(str((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode()))) for r in rows)
    check_shards(got, 5)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    assert kdshards.shard_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shards_have_near_equal_bytes_with_a_hot_group(spark):
    rows = [row(i, prose(i, 20 + i % 30), "en" if i % 4 else "de", f"s{i % 7}") for i in range(3000)]
    rows += [row(5000 + i, prose(1, 40), "en", "s0") for i in range(1500)]
    got = kdshards.shard_documents(spark.createDataFrame(rows, SCHEMA), shards=10, block_rows=100).collect()
    check_shards(got, 10)
    held = {}
    for r in got:
        held[r.shard] = held.get(r.shard, 0) + r.size
    mean = sum(held.values()) / 10
    assert len(held) == 10 and max(held.values()) < 1.06 * mean and min(held.values()) > 0.94 * mean


def test_equal_texts_stay_together_where_bytes_allow(spark):
    rows = [row(i, prose(i // 2, 30), "en" if i % 2 else "de", f"s{i % 5}") for i in range(4000)]
    got = kdshards.shard_documents(spark.createDataFrame(rows, SCHEMA), shards=6).collect()
    where = {}
    for r in got:
        where.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_shard_query(spark):
    got = op5_kd_shards(spark, SF).collect()
    check_shards(got, 40)
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_key_ranges_cost_one_job_a_level(spark):
    """Many cells above the target are counted again together, clusters at both ends of the longs too."""
    low = -(1 << 63)
    keys = [(low + k, 10) for k in range(300)] + [((1 << 63) - 1 - k, 10) for k in range(300)]
    keys += [(c * (1 << 40) + k, 10) for c in range(40) for k in range(100)]
    df = spark.createDataFrame(keys, "key long, n long").cache()
    calls, plain = [], warc._sums
    warc._sums = lambda *a: calls.append(len(a[1])) or plain(*a)
    try:
        bounds = warc.key_bounds(df, 500)
    finally:
        warc._sums = plain
    edges = [low, *bounds, 1 << 63]
    held = [sum(n for k, n in keys if a <= k < b) for a, b in zip(edges, edges[1:])]
    assert sum(held) == 46_000 and max(held) <= 500 and bounds == sorted(set(bounds))
    assert len(calls) <= 12 and max(calls) >= 40


def test_a_hot_key_is_written_by_several_shards(spark):
    rows = [page(i, "u", prose(i, 30)) for i in range(60)]
    rows += [page(7, "http://a/%d" % (i % 3), prose(1000 + i, 30)) for i in range(40)]
    rows += [page(None, "u", prose(2000 + i, 30)) for i in range(40)]
    rows += [page(70 + i, "u", prose(1000 + i, 30)) for i in range(40)]
    sums = []
    for frame in (spark.createDataFrame(rows, PAGES), spark.createDataFrame(rows[::-1], PAGES).repartition(4)):
        root = common.shared_path(spark, "test-archives")
        manifest = warc.write_archives(frame, root, shard_bytes=4000, file_bytes=2000).collect()
        assert len({r.shard for r in manifest if r.first_key == 7 and r.last_key == 7}) >= 3
        assert len({r.shard for r in manifest if r.last_key is None}) >= 3
        got = warc.read_archives(spark, root).collect()
        assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == \
            expected_records([(r[0], r[2]) for r in rows])
        sums.append(sorted((r.name, r.sha256) for r in manifest))
    assert sums[0] == sums[1]


def test_the_first_record_of_tied_keys_does_not_hang_on_the_layout(spark):
    """Two addresses share the smallest key and the payload: revisits name the first in order."""
    rows = [page(1, u, "y" * 200) for u in ("http://b", "http://a", None, "http://c")] + [page(2, "u", "y" * 200)]
    sums = set()
    for k in range(4):
        root = common.shared_path(spark, "test-archives")
        frame = spark.createDataFrame(rows[k:] + rows[:k], PAGES).repartition(k + 1)
        sums.add(tuple(sorted((r.name, r.sha256) for r in warc.write_archives(frame, root).collect())))
    assert len(sums) == 1


def test_shards_are_cut_by_size_and_hot_ids_are_numbered_in_blocks(spark):
    rows = [row(i, prose(i, 5 + i % 200), "en", "s") for i in range(2000)] + [row(None, prose(9000 + i, 20), "en", "s") for i in range(1000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = kdshards.shard_documents(frame, shards=8, block_rows=50).collect()
    check_shards(got, 8)
    spans = sorted((min(r.size for r in got if r.shard == s), max(r.size for r in got if r.shard == s)) for s in range(8))
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    plan = kdshards.with_slots(kdshards.light_rows(frame).withColumn("shard", kdshards.F.lit(0)), block_rows=50)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("text_key") >= 1
    assert sorted(r.slot for r in plan.collect()) == list(range(3000))
