"""Page layouts to Markdown: tables and the text between them.

Inputs are the relations a layout decoder gives:

* ``pages(doc_id, page_no, height)``
* ``tables(doc_id, page_no, table_id, bbox ARRAY<DOUBLE>, grid ARRAY<ARRAY<STRING>>)`` with
  ``bbox = (x0, top, x1, bottom)``, top <= bottom
* ``lines(doc_id, page_no, line_no, top, bottom, text)``

The single steps run on :class:`Timeline` with the height on the page as the order, so a page
with a large share of all rows is spread as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmark import dims
from docmark.functions.tables import grid_to_markdown
from docmark.functions.text import strip
from docmark.operators.assembly import BROADCAST_ROWS, assemble_document, assemble_page
from docmark.operators.carry import BUCKET, LARGE_KEY_ROWS, Timeline, ranges_needed

PAGE = ["doc_id", "page_no"]


def boxed(tables: DataFrame) -> DataFrame:
    """Tables with a box of four numbers; adds ``top`` and ``bottom``."""
    return tables.filter(F.size("bbox") == 4).select(
        *tables.columns, F.get("bbox", F.lit(1)).alias("top"),
        F.get("bbox", F.lit(3)).alias("bottom"))


def order_tables(tables: DataFrame, ranges: int | None = None, split: bool | None = None) -> DataFrame:
    """Tables with a usable box from top to bottom; adds ``top, bottom, table_no`` (from 0)."""
    valid = boxed(tables)
    line = Timeline(PAGE, ["top", "table_id"], split)
    df = line.spread(valid, ranges)
    df = line.window(df, table_no=line.running_sum(F.lit(1), inclusive=False))
    return df.drop(BUCKET)


def text_regions(ordered: DataFrame, pages: DataFrame, ranges: int | None = None,
                 split: bool | None = None) -> DataFrame:
    """Regions of text around a page's tables: ``doc_id, page_no, ord, top, bottom``.

    Each region above a table starts at the bottom of the table before it (the page's
    top for the first), and exists only if it has a height; so does the region below the
    last table. A page without tables is one region. ``ord`` is even and interleaves with
    the tables' odd numbers. The page's end is laid behind its tables as one more mark,
    so that all regions come from one window and no join.
    """
    marks = ordered.select(
        *PAGE, F.lit(0).alias("_end"), F.col("top").cast("double").alias("_y"), "table_id",
        F.col("bottom").cast("double").alias("_bottom"))
    ends = pages.select(
        *PAGE, F.lit(1).alias("_end"), F.col("height").cast("double").alias("_y"),
        F.lit(None).cast(ordered.schema["table_id"].dataType).alias("table_id"),
        F.lit(None).cast("double").alias("_bottom"))
    line = Timeline(PAGE, ["_end", "_y", "table_id"], split)
    df = line.spread(marks.unionByName(ends), ranges)
    df = line.window(
        df, _above=line.lag("_bottom"),
        _no=line.running_sum(F.lit(1), inclusive=False))
    start = F.coalesce(F.col("_above"), F.lit(0.0))
    whole = (F.col("_end") == 1) & (F.col("_no") == 0)
    return df.filter(whole | (F.col("_y") > start)).select(
        *PAGE, (F.col("_no") * 2).alias("ord"), start.alias("top"), F.col("_y").alias("bottom"))


def assign_lines_to_regions(lines: DataFrame, regions: DataFrame,
                            ranges: int | None = None, split: bool | None = None) -> DataFrame:
    """Lines with the ``ord`` of the region ``[top, bottom)`` their top falls in.

    Regions of a page do not overlap, so this is an as-of lookup: regions and lines are
    laid on one axis and each line takes the last region that starts at or above it. No
    pairs of lines and regions are formed.
    """
    starts = regions.select(
        *PAGE, F.col("top").cast("double").alias("_y"), F.lit(0).alias("_kind"),
        F.col("ord").cast("long").alias("_seq"),
        F.struct(F.col("ord").cast("long").alias("ord"),
                 F.col("bottom").cast("double").alias("end")).alias("_region"),
        *[F.lit(None).cast(lines.schema[c].dataType).alias(c)
          for c in lines.columns if c not in PAGE])
    marks = lines.select(
        *PAGE, F.col("top").cast("double").alias("_y"), F.lit(1).alias("_kind"),
        F.col("line_no").cast("long").alias("_seq"),
        F.lit(None).cast("struct<ord:bigint,end:double>").alias("_region"),
        *[c for c in lines.columns if c not in PAGE])
    axis = Timeline(PAGE, ["_y", "_kind", "_seq"], split)
    df = axis.spread(starts.unionByName(marks), ranges)
    df = axis.window(df, _in=axis.running_last(F.col("_region")))
    return df.filter((F.col("_kind") == 1) & (F.col("_y") < F.col("_in.end"))).select(
        *lines.columns, F.col("_in.ord").alias("ord"))


def _verdicts(pages: DataFrame) -> DataFrame:
    """``doc_id, error`` of the documents that cannot be assembled."""
    broken = pages.groupBy("doc_id").agg(F.bool_or(F.col("height").isNull()).alias("_broken"))
    return broken.filter("_broken").select("doc_id", F.lit(dims.MARKDOWN_FAILED).alias("error"))


def _elements(tables: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Tables, lines and pages on one axis; ``_kind`` 0, 1 and 2."""
    def row(kind: int, y: Column, bottom: Column, order: Column, text: Column) -> list[Column]:
        return [F.lit(kind).alias("_kind"), y.cast("double").alias("_y"),
                bottom.cast("double").alias("_bottom"), order.cast("string").alias("_order"),
                text.alias("text")]

    none = F.lit(None)
    grid = strip(grid_to_markdown(F.col("grid")))
    return (
        boxed(tables).select(
            *PAGE, *row(0, F.col("top"), F.col("bottom"), F.col("table_id"), grid),
            none.cast("long").alias("line_no"))
        .unionByName(lines.select(
            *PAGE, *row(1, F.col("top"), none, none, F.col("text")),
            F.col("line_no").cast("long").alias("line_no")))
        .unionByName(pages.select(
            *PAGE, *row(2, F.lit(float("-inf")), F.col("height"), none, none.cast("string")),
            none.cast("long").alias("line_no"))))


def assemble_layout(tables: DataFrame, lines: DataFrame, pages: DataFrame,
                    large_pages: int = LARGE_KEY_ROWS) -> DataFrame:
    """``doc_id, markdown, error`` of every document in ``pages``.

    A region or table that cannot be read (NULL text or grid) is left out; a document
    with a page that cannot be read (NULL height) fails whole. The upload limit is one of
    files, not of the text in them, so a document of any length is assembled.

    The rows of a page meet in one shuffle: a line's place is the number of tables that start
    above it, and it belongs to the text there unless the last of them still covers it. Pages are
    spread over all tasks, whatever document they belong to; their texts are then joined by
    document, which a document of more than ``large_pages`` pages does in chunks.
    """
    bad = _verdicts(pages)
    found = bad.limit(BROADCAST_ROWS + 1).count()
    good = (tables, lines, pages)
    if found:
        held = F.broadcast(bad) if found <= BROADCAST_ROWS else bad
        good = tuple(df.join(held, "doc_id", "left_anti") for df in good)
    axis = _elements(*good).repartition(*PAGE)
    # numeric table ids keep their order as numbers
    if not isinstance(tables.schema["table_id"].dataType, T.StringType):
        axis = axis.withColumn("_order", F.col("_order").cast(tables.schema["table_id"].dataType))
    page = W.partitionBy(*PAGE)
    above = page.orderBy("_y", "_kind", "_order").rowsBetween(W.unboundedPreceding, 0)
    is_table = F.col("_kind") == 0
    placed = axis.select(
        "*",
        F.max(F.when(F.col("_kind") == 2, F.col("_bottom"))).over(page).alias("_height"),
        F.count(F.when(is_table, 1)).over(above).alias("_tables"),
        F.last(F.when(is_table, F.col("_bottom")), ignorenulls=True).over(above).alias("_covered"))
    free = (F.col("_y") >= F.coalesce("_covered", F.lit(0.0))) & (F.col("_y") < F.col("_height"))
    kept = placed.filter(is_table | ((F.col("_kind") == 1) & free))
    # the n-th table is part 2n - 1, the text after it part 2n
    ord_ = F.col("_tables") * 2 - F.when(is_table, 1).otherwise(0)
    item = F.struct("_y", "line_no", "text")
    parts = kept.filter(F.col("text").isNotNull()).groupBy(*PAGE, ord_.alias("ord")).agg(
        F.array_sort(F.collect_list(item))["text"].alias("_lines"))
    parts = parts.select(*PAGE, "ord", F.array_join("_lines", "\n").alias("text"))
    ranges = ranges_needed(pages, ["doc_id"], large_pages)
    docs = good[2].select("doc_id").distinct()
    made = assemble_document(
        assemble_page(parts, split=False), docs, split=ranges is not None, ranges=ranges,
    ).withColumn("error", F.lit(None).cast("string"))
    if not found:
        return made
    failed = bad.select("doc_id", F.lit(None).cast("string").alias("markdown"), "error")
    return made.unionByName(failed)
