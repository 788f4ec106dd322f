"""Image assets and package manifests.

Assets have ``doc_id, page_index, image_index, name, data, extension``; documents have
``doc_id, markdown``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmark.functions.binary import data_uri
from docmark.functions.names import asset_ext, asset_name
from docmark.operators.assembly import CHUNK_BYTES, text_chunks, whole_text

IMAGE_DIR = "images/"
DOCUMENT = "document.md"


def number_assets(docs: DataFrame) -> DataFrame:
    """Assets of ``doc_id, pages ARRAY<ARRAY<STRUCT<name, data>>>``, numbered from 0."""
    pages = docs.select("doc_id", F.posexplode("pages").alias("page_index", "_images"))
    images = pages.select(
        "doc_id", "page_index", F.posexplode("_images").alias("image_index", "_image"))
    name = asset_name(F.col("_image.name"), F.col("page_index"), F.col("image_index"))
    named = images.withColumn("name", name)
    return named.select(
        "doc_id", "page_index", "image_index", "name", F.col("_image.data").alias("data"),
        asset_ext(F.col("name")).alias("extension"))


def asset_chunks(docs: DataFrame, assets: DataFrame, inline: bool, chunk_bytes: int = CHUNK_BYTES,
                 split: bool | None = None, ranges: int | None = None) -> DataFrame:
    """Chunks of each document's text with its assets appended, embedded or linked.

    Documents and assets meet in one aggregation, so documents without assets stay and
    no join is needed.
    """
    target = data_uri(F.col("data"), F.col("extension")) if inline else F.concat(F.lit(IMAGE_DIR), F.col("name"))
    head = docs.select(
        "doc_id", F.lit(-1).cast("long").alias("page_index"),
        F.lit(-1).cast("long").alias("image_index"),
        F.col("markdown").alias("_piece"))
    piece = F.concat(F.lit("\n\n!["), F.col("name"), F.lit("]("), target, F.lit(")"))
    tail = assets.select(
        "doc_id", F.col("page_index").cast("long").alias("page_index"),
        F.col("image_index").cast("long").alias("image_index"), piece.alias("_piece"))
    return text_chunks(head.unionByName(tail), ["doc_id"], ["page_index", "image_index"], F.col("_piece"), "",
                       chunk_bytes, split, ranges)


def inline_assets(docs: DataFrame, assets: DataFrame, split: bool | None = None) -> DataFrame:
    """``doc_id, markdown`` with each asset appended as an embedded image."""
    return whole_text(asset_chunks(docs, assets, True, split=split), ["doc_id"])


def link_assets(docs: DataFrame, assets: DataFrame, split: bool | None = None) -> DataFrame:
    """``doc_id, markdown`` with each asset appended as a relative link."""
    return whole_text(asset_chunks(docs, assets, False, split=split), ["doc_id"])


def package_manifest(docs: DataFrame, assets: DataFrame) -> DataFrame:
    """Entries of each package: ``doc_id, page_index, image_index, path, data``.

    The document comes first (-1, -1). Of assets with the same path the last one's bytes
    are kept, at the first one's place.
    """
    head = docs.select(
        "doc_id", F.lit(-1).cast("long").alias("page_index"),
        F.lit(-1).cast("long").alias("image_index"),
        F.lit(DOCUMENT).alias("path"), F.encode("markdown", "UTF-8").alias("data"))
    place = F.struct("page_index", "image_index")
    files = (
        assets.withColumn("path", F.concat(F.lit(IMAGE_DIR), F.col("name")))
        .groupBy("doc_id", "path")
        .agg(F.min(place).alias("_place"), F.max_by("data", place).alias("data"))
        .select("doc_id", F.col("_place.page_index").cast("long").alias("page_index"),
                F.col("_place.image_index").cast("long").alias("image_index"), "path", "data"))
    return head.unionByName(files)


def batch_archive_name(batch_id: Column) -> Column:
    return F.concat(F.lit("Batch_Conversion_"), F.substring(batch_id, 1, 8), F.lit(".zip"))


def batch_manifest(outputs: DataFrame) -> DataFrame:
    """Entries of each batch archive: ``batch_id, archive_name, entry_no, entry_name, task_id``.

    ``outputs`` has ``batch_id, pos, task_id, file_name`` of the successful members. Of
    outputs with the same entry name the last one is kept, at the first one's place
    (``entry_no`` is that member's position). Contents are not carried: the entry names
    the task whose output it is.
    """
    entry = F.concat(F.substring("task_id", 1, 8), F.lit("_"), F.col("file_name"))
    return (
        outputs.withColumn("entry_name", entry)
        .groupBy("batch_id", "entry_name")
        .agg(F.min("pos").alias("entry_no"), F.max_by("task_id", "pos").alias("task_id"))
        .select("batch_id", batch_archive_name(F.col("batch_id")).alias("archive_name"),
                "entry_no", "entry_name", "task_id"))
