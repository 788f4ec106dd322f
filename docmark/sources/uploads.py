"""Upload relations from file trees, tables and streams.

An upload has ``filename STRING, content BINARY, length BIGINT``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from docmark import dims
from docmark.functions.names import DEFAULT_FILENAME
from docmark.limits import DEFAULT

FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])


def _filename(path: Column) -> Column:
    base = F.substring_index(path, "/", -1)
    return F.coalesce(F.nullif(base, F.lit("")), F.lit(DEFAULT_FILENAME))


def read_uploads(spark: SparkSession, path: str,
                 max_bytes: int = DEFAULT.max_upload_bytes) -> tuple[DataFrame, DataFrame]:
    """``(uploads, rejects)`` of a file tree; oversize files are listed but never read.

    The length predicate reaches the source, and the rejects do not select the content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return _by_size(files, max_bytes)


def _by_size(files: DataFrame, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    named = files.withColumn("filename", _filename(F.col("path")))
    uploads = named.filter(F.col("length") <= max_bytes).select(
        "path", "filename", "content", "length")
    rejects = named.filter(F.col("length") > max_bytes).select(
        "path", "filename", "length", F.lit(dims.TOO_LARGE).alias("error"))
    return uploads, rejects


def uploads_from_table(df: DataFrame, id_col: str, content_col: Column | str,
                       ext: Column | str, prefix: str = "") -> DataFrame:
    """The same relation from a table; names are ``{prefix}{id}{ext}``."""
    content = F.col(content_col) if isinstance(content_col, str) else content_col
    suffix = F.lit(ext) if isinstance(ext, str) else ext
    raw = content.cast("binary")
    return df.select(
        id_col,
        F.concat(F.lit(prefix), F.col(id_col).cast("string"), suffix).alias("filename"),
        raw.alias("content"),
        F.octet_length(raw).cast("long").alias("length"))


def stream_uploads(spark: SparkSession, path: str,
                   max_bytes: int = DEFAULT.max_upload_bytes,
                   max_files_per_trigger: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """``(uploads, rejects)`` of files as they arrive, each an independent unit."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(path))
    return _by_size(files, max_bytes)


def write_uploads(spark: SparkSession, path: str, out: str, max_bytes: int = DEFAULT.max_upload_bytes,
                  max_files_per_trigger: int = 1_000) -> tuple[DataStreamWriter, DataStreamWriter]:
    """Writers of arriving files: uploads into ``{out}/uploads``, rejects into ``{out}/rejects``.

    Each sink is a query of its own, so that its length test reaches the listing: the rejects
    never open a file, and the uploads never open one over the limit.
    """
    uploads, rejects = stream_uploads(spark, path, max_bytes, max_files_per_trigger)
    sink = lambda rows, name: rows.writeStream.format("parquet").option(
        "checkpointLocation", f"{out}/{name}-checkpoint").option("path", f"{out}/{name}")
    return sink(uploads, "uploads"), sink(rejects, "rejects")
