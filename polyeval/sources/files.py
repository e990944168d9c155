"""Readers (A1-A9).

Every reader takes an explicit schema (never inferred), keeps the path of
each record through ``_metadata.file_path`` where the reference took
information from file names, and never collects anything to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyeval.functions.text import py_strip
from polyeval.operators.ids import with_index

RESPONSE_CSV_COLUMNS = ["Question ID", "Dataset Name", "Model Name", "System Prompt", "Prompt",
                        "Model Response", "Ground Truth"]
RESPONSE_COLUMNS = ["question_id", "dataset", "model", "system_prompt", "prompt", "response", "ground_truth"]


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A1: one JSON object per line into a typed table."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def line_index(spark: SparkSession, path: str, name: str = "line_no", **text_opts) -> DataFrame:
    """A3: lines of text files with their zero-based position.

    Every file split is read in order by one task, so a line's position is
    (lines in all earlier splits, in file-then-offset order) + (its place in
    its split). The scan keeps (file, split start, monotonically increasing
    id); one small aggregate gives each split's line count and first id, a
    prefix sum over the splits (one row per split, not per line) gives the
    offsets, and an equi-join on the split adds them - no sort of the lines.
    A split's rows and its place among the splits follow from the files alone,
    so a repeated task numbers alike and no line is checkpointed. Files follow
    each other by the number in their name, then by name.
    """
    r = spark.read
    for k, v in text_opts.items():
        r = r.option(k, v)
    d = r.text(path).select("value", F.col("_metadata.file_path").alias("_file"),
                            F.col("_metadata.file_block_start").alias("_block"),
                            F.monotonically_increasing_id().alias("_mid"))
    splits = d.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    number = F.regexp_extract("_file", r"(\d+)[^/]*$", 1).try_cast("decimal(38,0)")
    before = Window.orderBy(number.asc_nulls_last(), "_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offs = splits.select("_file", "_block", "_m0", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = d.join(offs, ["_file", "_block"])
    return out.withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("bigint")) \
        .drop("_file", "_block", "_mid", "_m0", "_off")


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType,
                        skip_blank: bool = False) -> tuple[DataFrame, DataFrame]:
    """A2: good rows and bad lines (line number + text). Line numbers count
    every line, also the blank ones that ``skip_blank`` drops."""
    lines = line_index(spark, path)
    if skip_blank:
        lines = lines.where(py_strip(F.col("value")) != "")
    full = T.StructType(list(schema.fields) + [T.StructField("_corrupt_record", T.StringType())])
    parsed = lines.withColumn("_r", F.from_json("value", full, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "allowSingleQuotes": "false"}))
    t = py_strip(F.col("value"))
    ok = F.col("_r").isNotNull() & F.col("_r._corrupt_record").isNull() & t.startswith("{") & t.endswith("}")
    good = parsed.where(ok).select("line_no", *[F.col(f"_r.{f.name}").alias(f.name) for f in schema.fields])
    bad = parsed.where(~ok).select("line_no", F.col("value").alias("text"))
    return good, bad


def read_response_csv(spark: SparkSession, path: str | list[str], with_file: bool = False) -> DataFrame:
    """A4: the seven-column response CSV (header, quoted new lines, cells of
    any size) with engine column names; ``with_file`` adds the file name as ``f``."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in RESPONSE_CSV_COLUMNS])
    d = (spark.read.schema(schema).option("header", True).option("multiLine", True)
         .option("escape", '"').option("maxCharsPerColumn", -1)
         .option("nullValue", "\\N").option("emptyValue", "")
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    file = [F.col("_metadata.file_name").alias("f")] if with_file else []
    return d.select(*[F.col(f"`{a}`").alias(b) for a, b in zip(RESPONSE_CSV_COLUMNS, RESPONSE_COLUMNS)], *file)


def read_first_files(spark: SparkSession, base: str, group: str) -> DataFrame:
    """The response CSVs of the smallest path of every ``group`` folder (``group=value``), and no
    other file: the choice is made on the listing, before anything is opened."""
    lister = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(base)
    first: dict[str, str] = {}
    for name in sorted(lister.inputFiles()):
        folder = next((f for f in name.split("/") if f.startswith(f"{group}=")), None)
        if folder is not None:
            first.setdefault(folder, name)
    if not first:
        return read_response_csv(spark, base).limit(0)
    return read_response_csv(spark, list(first.values()))


def _rel_path(col: str, base: str):
    p = F.regexp_replace(F.col(col), "^file:/+", "/")
    b = base.rstrip("/")
    b = "/" + b[len("file:"):].lstrip("/") if b.startswith("file:") else b
    return F.when(p.startswith(b + "/"), p.substr(len(b) + 2, 1 << 30)).otherwise(p)


def _whole_files(spark: SparkSession, folder: str, glob: str, recursive: bool = False) -> DataFrame:
    """Every file whose name matches ``glob`` as one row: ``_path`` and the whole text ``value``.
    The text reader sets up its compression codecs anew for each file, most of the time of a
    small one; names that end in .json or .txt have none and are read as bytes."""
    r = spark.read.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", True)
    if glob.endswith((".json", ".txt")):
        d = r.format("binaryFile").load(folder).withColumn("value", F.col("content").cast("string"))
    else:
        d = r.text(folder, wholetext=True)
    return d.select(F.col("_metadata.file_path").alias("_path"), "value")


def scan_result_tree(spark: SparkSession, base: str, avoid: list[str] = (), glob: str = "*.txt") -> DataFrame:
    """A5: every file below ``base`` (whole text) with its path relative to
    ``base``; files under a folder whose name contains an avoid string are
    dropped by a filter on the file path, before any content is parsed."""
    d = (_whole_files(spark, base, glob, recursive=True)
         .select(_rel_path("_path", base).alias("path"), F.col("value").alias("content")))
    folders = F.split(F.regexp_replace(F.col("path"), "/[^/]*$", ""), "/")
    for a in avoid:
        d = d.where(~F.exists(folders, lambda f: f.contains(a)))
    return d


def scan_response_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One JSON file per request named ``response_{idx}.json``; a file
    that does not parse gives a null record."""
    d = _whole_files(spark, folder, "response_*.json").select(
        F.regexp_extract("_path", r"response_(\d+)\.json$", 1).cast("bigint").alias("idx"), "value")
    return d.select("idx", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("record"),
                    F.col("value").alias("raw"))


def explode_json_document(spark: SparkSession, path: str, schema: T.StructType,
                          field: str = "examples", keep: list[str] = (), multi_line: bool = True) -> DataFrame:
    """JSON documents holding an array; one row per element with its
    position in the document. A document is one record of the JSON reader
    (many documents and files are read in parallel; one document is not
    split). ``keep`` names top-level fields carried along (read as bigint).
    ``multi_line``: one (pretty-printed) document per file; otherwise one
    document per line."""
    doc = T.StructType([T.StructField(k, T.LongType()) for k in keep]
                       + [T.StructField(field, T.ArrayType(schema))])
    d = spark.read.schema(doc).option("multiLine", multi_line).json(path)
    return d.select(*keep, F.posexplode(field).alias("pos", "_e")).select(*keep, F.col("pos").cast("bigint"), "_e.*")


def parquet_to_jsonl(spark: SparkSession, src: str, dst: str) -> None:
    """Parquet to JSON lines, nulls kept as ``null``."""
    spark.read.parquet(src).write.mode("overwrite").option("ignoreNullFields", "false").json(dst)


def combine_numbered_files(spark: SparkSession, folder: str, schema: T.StructType,
                           glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """Many one-object JSON files into one table ordered by the first
    number in the file name (no number sorts last); files that do not parse
    are returned separately (reported and skipped)."""
    full = T.StructType(list(schema.fields) + [T.StructField("_corrupt_record", T.StringType())])
    d = _whole_files(spark, folder, glob).select(F.regexp_replace("_path", "^.*/", "").alias("file"), "value")
    num = F.regexp_extract("file", r"(\d+)", 1)
    d = d.withColumn("file_number", F.when(num != "", num.cast("long"))) \
        .withColumn("_r", F.from_json("value", full, {"mode": "PERMISSIVE",
                                                      "columnNameOfCorruptRecord": "_corrupt_record"}))
    t = py_strip(F.col("value"))
    ok = F.col("_r").isNotNull() & F.col("_r._corrupt_record").isNull() & t.startswith("{") & t.endswith("}")
    good = d.where(ok).select("file", "file_number", *[F.col(f"_r.{f.name}").alias(f.name) for f in schema.fields])
    good = with_index(good, "position", order_by=[F.col("file_number").asc_nulls_last(), F.col("file")],
                      key=["file"], by=("file_number",))
    bad = d.where(~ok).select("file")
    return good, bad


def scan_response_tree(spark: SparkSession, base: str, avoid: list[str] = (),
                       suffix: str = "_responses.csv") -> DataFrame:
    """Response CSVs anywhere below ``base`` (one language folder per first
    level), with ``lang_folder`` (first folder below ``base``) and ``file``
    (the rest of the path). Only files ending in ``suffix`` are read (judge
    CSVs and metric files next to them are not responses). Folders whose
    name contains an avoid string are dropped by a filter on the path."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in RESPONSE_CSV_COLUMNS])
    d = (spark.read.schema(schema).option("recursiveFileLookup", True).option("header", True)
         .option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1)
         .option("nullValue", "\\N").option("emptyValue", "")
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(base))
    d = d.select(*[F.col(f"`{a}`").alias(b) for a, b in zip(RESPONSE_CSV_COLUMNS, RESPONSE_COLUMNS)],
                 _rel_path("_metadata.file_path", base).alias("_rel"))
    d = d.withColumn("lang_folder", F.substring_index("_rel", "/", 1)) \
         .withColumn("file", F.expr("substring(_rel, length(lang_folder) + 2)"))
    folders = F.split(F.regexp_replace(F.col("_rel"), "/[^/]*$", ""), "/")
    for a in avoid:
        d = d.where(~F.exists(folders, lambda f: f.contains(a)))
    # the file itself, or the folder of a table written under that name (``stem=x_responses.csv``)
    named = F.col("_rel").endswith(suffix) | F.exists(folders, lambda f: f.endswith(suffix))
    return d.where(named).drop("_rel")
