"""File, asset and output names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_FILENAME = "upload.bin"


def file_ext(filename: Column) -> Column:
    """Lower-cased text after the last dot, with the dot; empty if there is no dot."""
    return F.when(
        F.contains(filename, F.lit(".")),
        F.lower(F.concat(F.lit("."), F.substring_index(filename, ".", -1))),
    ).otherwise("")


def path_suffix(filename: Column) -> Column:
    """Suffix as a path sees it: a name that only starts or ends with its dot has none."""
    return F.lower(F.regexp_extract(filename, r"(?s)^.+(\.[^.]+)$", 1))


def stem(filename: Column) -> Column:
    """Name without its last suffix; a leading-dot name keeps everything."""
    return F.regexp_replace(filename, r"(?s)^(.+)\.[^.]+$", "$1")


def output_name(filename: Column, mode: Column) -> Column:
    """``{stem}.md`` for standalone output, ``{stem}.zip`` for anything else."""
    suffix = F.when(mode == "standalone", ".md").otherwise(".zip")
    return F.concat(stem(filename), suffix)


def asset_name(name: Column, page_index: Column, image_index: Column) -> Column:
    """The asset's own name, or ``img_{page}_{image}`` when it has none."""
    made = F.concat(
        F.lit("img_"), page_index.cast("string"), F.lit("_"), image_index.cast("string"))
    return F.coalesce(F.nullif(name, F.lit("")), made)


def asset_ext(name: Column) -> Column:
    """Lower-cased text after the last dot, without the dot; ``png`` if there is no dot."""
    return F.when(
        F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))
    ).otherwise("png")


def size_mb(length: Column) -> Column:
    """Size in MiB, one decimal."""
    return F.round(length / F.lit(1048576.0), 1)
