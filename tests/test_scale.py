"""Steps whose cost must not grow faster than their input."""

from polyeval.operators import bpe as BPE
from polyeval.operators import language as LG
from polyeval.operators import runner as RN


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_calls_take_bounded_parts_of_a_batch():
    import pyarrow as pa
    batch = pa.record_batch({"k": pa.array(range(3000)), "t": pa.array(["x" * (RN.PART_BYTES // 100)] * 3000)})
    parts = list(RN._parts(batch, ["t"]))
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(3000))
    assert max(p.column("t").nbytes for p in parts) <= RN.PART_BYTES
    small = pa.record_batch({"t": pa.array(["x"] * 3000)})
    assert max(p.num_rows for p in RN._parts(small, ["t"])) <= RN.PART_ROWS
    assert [p.num_rows for p in RN._parts(batch.slice(0, 1), ["t"])] == [1]


def test_columns_beside_the_inputs_stay_in_arrow(spark):
    rows = [(1, "a", [1, None], None), (None, None, None, bytearray(b"\x00")), (1, "a", [], None)]
    df = spark.createDataFrame(rows, "k long, t string, l array<int>, b binary").coalesce(1)
    out = RN.batch_infer(df, lambda t: t.upper(), ["t"], "k", max_tries=1)
    assert "MapInArrow" in _plan(out)
    assert [tuple(r) for r in out.select("k", "t", "l", "b", "response", "attempts", "ok").collect()] == [
        (1, "a", [1, None], None, "A", 1, True), (None, None, None, bytearray(b"\x00"), None, 1, False),
        (1, "a", [], None, "A", 1, True)]


def test_detection_has_one_sum_a_text(spark):
    """No row a gram and language: the text's grams are added up by columns."""
    profiles = spark.createDataFrame([("a", "_x_", -1, -9), ("b", "_y_", -2, -9), ("c", "_x_", -1, -9)],
                                     "lang string, gram string, weight long, unseen long")
    df = spark.createDataFrame([(1, "x x"), (1, "y"), (2, "y"), (3, None), (4, "zz"), (None, "y y"), (None, "x")], "id int, t string")
    got = LG.detect(df, profiles, "id", "t")
    assert _plan(got).count("Generate explode") == 2
    # 1: a -11, b -20, c -11 (a tie: the smaller name); null ids are one text
    assert {tuple(r) for r in got.collect()} == {(1, "a"), (2, "b"), (3, "und"), (4, "und"), (None, "b")}


def test_token_counts_shuffle_no_words(spark):
    merges = spark.createDataFrame([(0, "t", "h"), (1, "th", "e")], "rank int, left string, right string")
    df = spark.createDataFrame([(1, "the the, he"), (1, "the"), (2, ""), (3, None), (None, "he")], "id int, t string")
    got = BPE.count_tokens(df.coalesce(1), "t", merges, "id")
    plan = _plan(got)
    assert plan.count("Aggregate") == 1 and "Join" not in plan and "Generate" not in plan
    assert {tuple(r) for r in got.collect()} == {(1, 6), (2, 0), (3, 0), (None, 2)}
    assert got.schema.simpleString() == "struct<id:int,bpe:bigint>"


def test_blanks_of_the_fast_class_are_the_blanks_of_the_rules(spark):
    import re

    from pyspark.sql import functions as F

    from polyeval.functions import text as X
    codes = spark.range(1, 0x11000).where("id NOT BETWEEN 55296 AND 57343").withColumn(
        "c", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32"))
    blank = {r["id"] for r in codes.where(F.col("c").rlike(X.WS_JAVA)).collect()}
    assert blank == {ord(c) for c in X.WS_CHARS}
    df = spark.createDataFrame([("\u2003{ a \x85:\t b\u3000\u3000,\x1cc } \u200b d ",)], "t string")
    assert df.select(X.normalize_whitespace("t", "c")).first()[0] == "{a:b,c}\u200b d"
    # no range test a character for the blanks below 0x100
    assert not re.search(r"\\x\{?[0-9A-F]{1,2}\}?-", X.WS_JAVA)


def _tasks(spark, group, run):
    """Result of ``run`` and the number of tasks of all its stages."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    t = sc.statusTracker()
    stages = {s for j in t.getJobIdsForGroup(group) for s in t.getJobInfo(j).stageIds}
    return out, sum(t.getStageInfo(s).numTasks for s in stages if t.getStageInfo(s))


def test_stored_upsert_takes_far_fewer_tasks_than_files(spark, tmp_path):
    """one task writes and reads many of the small files."""
    from polyeval.plans.q_learned import FILE_IDS, q_upsert_stored
    ids = [i for i in range(400 * FILE_IDS) if i // FILE_IDS % 7 != 3] + [5, 5, None]      # gaps, repeated and null keys
    docs = [(i, None if i == 8 else (i or 3) % 5) for i in ids]
    lab = {i: (i // 3 % 2, int(i % 40 == 0)) for i in range(0, 500 * FILE_IDS, 2)}
    spark.createDataFrame(docs, "doc_id long, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, *x) for i, x in lab.items()], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    got, tasks = _tasks(spark, "stored", lambda: q_upsert_stored(spark, str(tmp_path)).collect())
    new = {i: x[0] for i, x in lab.items() if x[1]}
    part = {i: (i or 0) // FILE_IDS for i in ids}
    hit, files = {part[i] for i in ids if i in new}, len(set(part.values()))
    want = [(i, new[i] if i in new else None if n is None else n % 2, part[i] in hit, files, len(hit)) for i, n in docs]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert 0 < len(hit) < files and tasks < files


def test_stored_table_streams_its_files(spark, tmp_path):
    """one file a value, in parts; types, nulls and runs over several batches come back as they were."""
    from pyspark.sql import functions as F
    from polyeval.sources import upserts as UP
    path = str(tmp_path / "table")
    i = F.col("id")
    df = spark.range(30_000).select(
        i, F.when(i % 3 > 0, i % 3).alias("g"), F.timestamp_seconds(i).alias("ts"), i.cast("decimal(20,3)").alias("dec"),
        F.when(i % 2 == 0, F.array(i.cast("string"), F.lit(None))).alias("l"), F.struct(i.cast("short").alias("s")).alias("st"),
        F.encode(i.cast("string"), "utf-8").alias("b"), F.create_map(F.lit("k"), i.cast("double")).alias("m"))
    UP.create(df, path, by=F.col("g"))
    assert len(UP.files(spark, path)) == 3
    got = UP.read(spark, path)
    assert got.groupBy("_file").agg(F.countDistinct(F.coalesce("g", F.lit(0))).alias("n")).where("n <> 1").count() == 0
    assert got.dtypes[:-1] == df.dtypes
    key = F.to_json(F.struct(*df.columns))
    assert got.select(key).exceptAll(df.select(key)).count() == 0 and got.count() == 30_000


def test_stored_table_without_rows(spark, tmp_path):
    from polyeval.sources import upserts as UP
    path = str(tmp_path / "table")
    empty = spark.createDataFrame([], "k long, t string")
    UP.create(empty, path, by=empty["k"])
    up = spark.createDataFrame([(1, "x", 1)], "k long, t string, seq int")
    assert UP.upsert(spark, path, up, "k", ["t"], "seq") == {"files": 0, "rewritten": 0}
    assert UP.read(spark, path).collect() == [] and UP.read(spark, path).columns == ["k", "t", "_file"]


def test_small_files_are_read_as_bytes(spark, tmp_path):
    """no set-up of the text reader for each file; the same texts as by that reader."""
    import gzip

    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    from polyeval.sources import files as FS
    body = {1: b"", 2: b'{"k": 2}', 3: "﻿{\"k\": 3}\r\n".encode(), 4: "{\"k\":\r\n 4, \"t\": \"ক   é\"}\n\n".encode(),
            5: b"{not json", 6: b"\xff\x00{}", 70: b" "}
    for i, b in body.items():
        (tmp_path / f"response_{i}.json").write_bytes(b)
    (tmp_path / "other_9.json").write_bytes(b'{"k": 9}')
    (tmp_path / "response_8.txt").write_bytes(b'{"k": 8}')
    (tmp_path / "packed_7.json.gz").write_bytes(gzip.compress(b'{"k": 7}'))
    got = FS.scan_response_files(spark, str(tmp_path), "struct<k:long>")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FileScan binaryFile" in plan and "FileScan text" not in plan
    raw = {r["idx"]: bytes(r["raw"]) for r in got.select("idx", F.col("raw").cast("binary").alias("raw")).collect()}
    assert raw == {i: b for i, b in body.items() if b}           # Spark lists no empty file
    text = spark.read.option("pathGlobFilter", "response_*.json").text(str(tmp_path), wholetext=True)
    assert got.select("raw").exceptAll(text).count() == 0 == text.exceptAll(got.select("raw")).count()
    k = {r["idx"]: r["k"] for r in got.select("idx", "record.k").collect()}
    assert (k[2], k[4], k[5]) == (2, 4, None)
    # names that may be packed are unpacked as before
    good, bad = FS.combine_numbered_files(spark, str(tmp_path), T.StructType([T.StructField("k", T.LongType())]), "*_7.json.gz")
    assert [tuple(r) for r in good.collect()] == [("packed_7.json.gz", 7, 7, 0)] and bad.count() == 0
    tree = FS.scan_result_tree(spark, str(tmp_path))
    assert [tuple(r) for r in tree.collect()] == [("response_8.txt", '{"k": 8}')]
