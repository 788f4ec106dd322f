"""Partitioned sinks for converted texts and packages.

A file name is a column and never becomes part of a path. Partitions are few and coarse
(the finish date by default, which lets retention drop whole partitions); the rebalance
hint splits a partition that holds most rows and merges small ones, so one day or batch
with a third of all outputs is still written by many tasks. By default the partitions at hand
are replaced, so that a job that is tried again leaves each row once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmark.functions.names import output_name

MAX_ROWS_PER_FILE = 1_000_000


def _write(df: DataFrame, path: str, partition_col: str | None, mode: str) -> None:
    out = df.hint("rebalance", partition_col) if partition_col else df.hint("rebalance")
    writer = out.write.mode(mode).option("maxRecordsPerFile", MAX_ROWS_PER_FILE)
    if partition_col:
        # with overwrite, only the partitions present in the frame are replaced
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition_col)
    writer.parquet(path)


def standalone_files(df: DataFrame) -> DataFrame:
    """Add ``file_name`` (``{stem}.md``) and UTF-8 ``data`` to ``filename, markdown`` rows."""
    return (
        df.withColumn("file_name", output_name(F.col("filename"), F.lit("standalone")))
        .withColumn("data", F.encode("markdown", "UTF-8"))
        .drop("markdown"))


def write_standalone(df: DataFrame, path: str, partition_col: str | None = None,
                     mode: str = "overwrite") -> None:
    """One Markdown text per task as rows ``..., file_name, data``."""
    _write(standalone_files(df), path, partition_col, mode)


def write_package(manifest: DataFrame, path: str, partition_col: str | None = None,
                  mode: str = "overwrite") -> None:
    """Manifest rows: the document and its images, per package."""
    _write(manifest, path, partition_col, mode)
