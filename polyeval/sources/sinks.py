"""Sinks (A10-A14, A17).

Order-preserving sinks sort with a range-partitioned ``orderBy`` (no single
task); part files then follow key order. ``single_file`` coalesces to one
file only when asked, because it routes the whole output through one task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyeval.sources.files import RESPONSE_COLUMNS, RESPONSE_CSV_COLUMNS

BOM = "﻿"
NULL_TOKEN = "\\N"  # written for null cells, so an empty string stays empty


def write_jsonl(df: DataFrame, path: str, order: str | None = "idx", single_file: bool = False) -> None:
    """A10: JSON lines, non-ASCII kept as is, in ``order`` order."""
    d = df.orderBy(order) if order else df
    if single_file:
        d = d.coalesce(1)
    d.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


# Cell texts that a pandas CSV round trip reads as missing
# (its default NA strings); ``compat_na`` reproduces that rewrite.
PANDAS_NA_STRINGS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                     "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def write_response_csv(df: DataFrame, path: str, order: str = "idx", compat_na: bool = False) -> None:
    """Header + rows in question order, every cell quoted, written to a
    new path (never rewritten in place). ``compat_na``: cells whose whole
    text is one of the pandas NA strings become empty, as after the
    reference's read-and-rewrite step."""
    _csv_writer(df.orderBy(order).select(*_cells(compat_na))).csv(path)


def write_response_tree(df: DataFrame, path: str, by: list[str], order: str = "idx") -> None:
    """A11 as a tree: one folder for each value of ``by``, with one response CSV in question order."""
    d = df.repartition(*by).sortWithinPartitions(*by, order).select(*_cells(False), *by)
    _csv_writer(d).partitionBy(*by).csv(path)


def _cells(compat_na: bool) -> list:
    def cell(c):
        v = F.col(c).cast("string")
        return F.when(v.isin(PANDAS_NA_STRINGS), F.lit("")).otherwise(v) if compat_na else v
    return [cell(a).alias(b) for a, b in zip(RESPONSE_COLUMNS, RESPONSE_CSV_COLUMNS)]


def _csv_writer(d: DataFrame):
    return (d.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"')
            .option("nullValue", NULL_TOKEN).option("emptyValue", "")
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def write_per_group(df: DataFrame, path: str, by: list[str], fmt: str = "parquet") -> None:
    """One table per group value in its own folder (``key=value``)."""
    df.write.mode("overwrite").partitionBy(*by).format(fmt).save(path)


def write_review_csv(df: DataFrame, path: str) -> None:
    """CSV for spreadsheets: a UTF-8 byte-order mark before the first
    header cell."""
    first = df.columns[0]
    d = df.withColumnRenamed(first, BOM + first)
    (d.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_files(df: DataFrame, base: str, path_col: str, content_col: str) -> None:
    """Write each row's content to ``base/<path>`` (the formats A5, A6 and A9 are
    one file per record), from the executors, through the file system that
    ``base`` names (local and mounted folders, HDFS, object stores). A file
    appears under its name only when it is complete."""
    base = base.rstrip("/")

    def put(rows):
        from polyeval.sources.stores import open_store
        store, folder = open_store(base)
        made = set()
        for r in rows:
            path = f"{folder}/{r[path_col]}"
            parent = path.rpartition("/")[0]
            if parent not in made:
                store.create_dir(parent, recursive=True)
                made.add(parent)
            part = f"{parent}/.{uuid.uuid4().hex}"
            with store.open_output_stream(part, compression=None) as f:
                f.write((r[content_col] or "").encode("utf-8"))
            store.move(part, path)

    df.select(path_col, content_col).foreachPartition(put)


def write_leaderboard(board: DataFrame, path: str, by=("lang", "metric_type"), order: str = "model_ordinal") -> None:
    """H4 sink: one CSV per (lang, metric) in its own folder, rows in the
    fixed model order, a missing cell written as an empty string (only
    here, at the sink). Each table holds one row per model, so one task per
    table is bounded by the model axis."""
    value_cols = [c for c in board.columns if c not in (*by, order, "model")]
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in value_cols]
    d = board.select(*by, order, F.col("model").alias("Model"), *cells)
    (d.repartition(*by).sortWithinPartitions(*by, order).drop(order)
       .write.mode("overwrite").partitionBy(*by).option("header", True).option("escape", '"')
       .option("emptyValue", "").csv(path))
