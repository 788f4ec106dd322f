"""Intake checks. A rejection is a row with an error class, never an exception.

Uploads have ``filename STRING, content BINARY, length BIGINT`` and pass-through columns.
All per-file checks are one CASE expression, cheapest test first, so a file costs one
pass over its head and no shuffle. Batch rules work on the narrow columns only; contents
never cross a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmark import dims
from docmark.functions import binary, names, text
from docmark.limits import DEFAULT, Limits


def too_large(length: Column, max_bytes: int) -> Column:
    """Strictly over the limit; a file of exactly the limit passes."""
    return length > max_bytes


def size_guard(df: DataFrame, max_bytes: int = DEFAULT.max_upload_bytes) -> DataFrame:
    """Add ``error``: the size rejection, or NULL."""
    return df.withColumn("error", F.when(too_large(F.col("length"), max_bytes), dims.TOO_LARGE))


def supported_type(df: DataFrame) -> DataFrame:
    """Add ``error``: the unknown-extension rejection, or NULL."""
    known = names.file_ext(F.col("filename")).isin(*dims.EXTENSION_MIME)
    return df.withColumn("error", F.when(~known, dims.UNSUPPORTED))


def declared_mime(df: DataFrame) -> DataFrame:
    """Add ``mime``: the type the extension claims, NULL when unknown."""
    ext = names.file_ext(F.col("filename"))
    return df.withColumn("mime", dims.lookup(ext, dims.EXTENSION_MIME))


def content_error(ext: Column, content: Column, limits: Limits = DEFAULT,
                  tolerate_cut: bool = False) -> Column:
    """Mismatch between the bytes and the type the extension claims, or NULL."""
    bad_text = ~binary.utf8_prefix_ok(content, limits.text_probe_bytes, tolerate_cut)
    spoofed = binary.binary_spoof(content)
    claimed = dims.lookup(ext, dims.EXTENSION_MIME)
    signed = F.coalesce(binary.match_signature(content) == claimed, F.lit(False))
    ok = (
        F.when(ext.isin(*dims.TEXT_EXTENSIONS), ~(bad_text | spoofed))
        .when(ext.isin(*dims.ZIP_EXTENSIONS), binary.zip_container(content))
        .otherwise(signed)
    )
    # NULL contents answer no test, so they are refused
    return F.when(~F.coalesce(ok, F.lit(False)), dims.MISMATCH)


def upload_error(filename: Column, content: Column, length: Column,
                 limits: Limits = DEFAULT, tolerate_cut: bool = False) -> Column:
    """First failing check in order: size, extension, bytes. NULL when the file is good."""
    ext = names.file_ext(filename)
    return (
        F.when(too_large(length, limits.max_upload_bytes), dims.TOO_LARGE)
        .when(~ext.isin(*dims.EXTENSION_MIME), dims.UNSUPPORTED)
        .otherwise(content_error(ext, content, limits, tolerate_cut))
    )


def checked_uploads(df: DataFrame, limits: Limits = DEFAULT,
                    tolerate_cut: bool = False) -> DataFrame:
    """Uploads with ``mime`` and ``error``; works on batch and on streaming frames."""
    error = upload_error(
        F.col("filename"), F.col("content"), F.col("length"), limits, tolerate_cut)
    return declared_mime(df).withColumn("error", error)


def validate_uploads(df: DataFrame, limits: Limits = DEFAULT,
                     tolerate_cut: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(accepted, quarantine)``; the quarantine carries the error class and no content."""
    checked = checked_uploads(df, limits, tolerate_cut)
    accepted = checked.filter(F.col("error").isNull()).drop("error")
    quarantine = checked.filter(F.col("error").isNotNull()).drop("content")
    return accepted, quarantine


def xml_entity_guard(df: DataFrame, strict: bool = True) -> DataFrame:
    """Add ``error`` and ``xml`` to rows with ``content``.

    Strict rejects every declaration of entities. Otherwise the declaration is
    stripped and references stay in the text unexpanded.
    """
    raw = F.col("content").cast("string")
    attack = text.xml_has_entities(raw)
    if strict:
        return (
            df.withColumn("error", F.when(attack, dims.XML_ATTACK))
            .withColumn("xml", F.when(~attack, raw)))
    return (
        df.withColumn("error", F.lit(None).cast("string"))
        .withColumn("xml", text.xml_strip_declarations(raw)))


# --- batch rules -------------------------------------------------------------


def batch_size_gate(df: DataFrame, limit: int = DEFAULT.max_batch_files) -> DataFrame:
    """Add ``error`` to every file of a batch with more than ``limit`` files.

    Counts are combined before the shuffle and only the oversize batches are joined
    back, so a batch with a large share of all files costs one counter per task. The
    join leaves its strategy and the splitting of a skewed batch to adaptive execution.
    """
    oversize = (
        df.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > limit)
        .select("batch_id", F.lit(dims.BATCH_LIMIT).alias("error")))
    return df.join(oversize, "batch_id", "left")


def batch_cap(df: DataFrame, limit: int = DEFAULT.max_batch_files) -> DataFrame:
    """First ``limit`` files of a batch in ``pos`` order, with ``truncated``.

    One row more than the limit tells whether the batch was cut. The rank filter is
    applied before the shuffle as well, so at most ``limit + 1`` rows of a batch leave
    each task.
    """
    by_pos = W.partitionBy("batch_id").orderBy("pos")
    head = df.withColumn("_rn", F.row_number().over(by_pos)).filter(F.col("_rn") <= limit + 1)
    cut = F.max("_rn").over(W.partitionBy("batch_id")) > limit
    return head.withColumn("truncated", cut).filter(F.col("_rn") <= limit).drop("_rn")


def batch_first_reject(df: DataFrame) -> DataFrame:
    """Add ``outcome``: queued before a batch's first bad file, rejected at it, else skipped.

    Also ``recorded``: whether a batch record is written, that is, no file was bad.
    ``df`` has ``batch_id, pos, error``.
    """
    first = df.filter(F.col("error").isNotNull()).groupBy("batch_id").agg(
        F.min("pos").alias("_first"))
    outcome = (
        F.when(F.col("_first").isNull() | (F.col("pos") < F.col("_first")), "queued")
        .when(F.col("pos") == F.col("_first"), "rejected")
        .otherwise("skipped"))
    return (
        df.join(first, "batch_id", "left")
        .withColumn("outcome", outcome)
        .withColumn("recorded", F.col("_first").isNull())
        .drop("_first"))
