"""Ordered text: rows to tables, parts to pages, pages to documents.

A text is made in chunks: every piece's place in it is a running sum of bytes over the pieces
before, so pieces that fall into the same stretch of bytes can be joined without the others. Chunks
(``keys, chunk_no, at, text``) hold about ``chunk_bytes`` each, or one longer piece, and ``at`` is
their first byte; their texts in order, with nothing between, are the whole text. A key with very
many pieces is cut into ranges for the running sum (:class:`Timeline`), so neither step puts a
giant text into one task. Joining the chunks to one value (:func:`whole_text`) is the last step,
for callers that want a value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmark.functions.tables import fit_row, row_line, separator_line
from docmark.functions.text import clean_cell, is_blank, strip
from docmark.operators.carry import LARGE_KEY_ROWS, Timeline

CHUNK_BYTES = 8_000_000
BROADCAST_ROWS = 1_000_000

PART_GAP = "\n\n"
PAGE_GAP = "\n\n---\n\n"


def text_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: Column, sep: str = "",
                chunk_bytes: int = CHUNK_BYTES, split: bool | None = None, ranges: int | None = None,
                large_rows: int = LARGE_KEY_ROWS) -> DataFrame:
    """``keys, chunk_no, at, text``: the texts of each key joined in order, in chunks.

    NULL counts as an empty text. ``split`` and ``ranges`` are those of :class:`Timeline`. Keys must
    not be NULL.
    """
    pieces = df.select(*keys, *[c for c in order if c not in keys], F.coalesce(text, F.lit("")).alias("_text"))
    gap = len(sep.encode())
    line = Timeline(keys, order, split, large_rows)
    size = F.octet_length("_text").cast("long") + gap
    placed = line.window(line.spread(pieces, ranges), _end=line.running_sum(size))
    first = F.col("_end") - size == 0
    piece = F.concat(F.when(first, F.lit("")).otherwise(F.lit(sep)), F.col("_text"))
    # a piece begins with its separator
    at = F.col("_end") - size - F.when(first, 0).otherwise(gap)
    placed = placed.select(*keys, *[c for c in order if c not in keys], at.alias("_at"), piece.alias("_piece"))
    return placed.groupBy(*keys, F.expr(f"_at div {chunk_bytes}").alias("chunk_no")).agg(
        F.min("_at").alias("at"),
        F.array_join(F.array_sort(F.collect_list(F.struct("_at", *order, "_piece")))["_piece"], "").alias("text"))


def whole_text(chunks: DataFrame, keys: Sequence[str], out: str = "markdown") -> DataFrame:
    """``keys, out``: chunks joined to one value per key."""
    texts = F.array_sort(F.collect_list(F.struct("chunk_no", "text")))["text"]
    return chunks.groupBy(*keys).agg(F.array_join(texts, "").alias(out))


def page_chunks(parts: DataFrame, chunk_bytes: int = CHUNK_BYTES, split: bool | None = None,
                ranges: int | None = None) -> DataFrame:
    """Chunks of pages: parts in ``ord`` order, stripped, blank ones dropped."""
    kept = parts.filter(~is_blank(F.col("text")))
    return text_chunks(kept, ["doc_id", "page_no"], ["ord"], strip(F.col("text")), PART_GAP, chunk_bytes, split, ranges)


def assemble_page(parts: DataFrame, split: bool | None = None) -> DataFrame:
    """``doc_id, page_no, text``: the text of each page that has one."""
    return whole_text(page_chunks(parts, split=split), ["doc_id", "page_no"], "text")


def document_chunks(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, split: bool | None = None,
                    ranges: int | None = None) -> DataFrame:
    """Chunks of documents: non-empty pages in order with a rule between them."""
    kept = pages.filter(F.coalesce(F.col("text"), F.lit("")) != "")
    return text_chunks(kept, ["doc_id"], ["page_no"], F.col("text"), PAGE_GAP, chunk_bytes, split, ranges)


def assemble_document(pages: DataFrame, documents: DataFrame | None = None, split: bool | None = None,
                      ranges: int | None = None) -> DataFrame:
    """``doc_id, markdown`` of each document.

    ``documents`` (``doc_id``), when given, adds the documents without any page as ''.
    """
    made = whole_text(document_chunks(pages, split=split, ranges=ranges), ["doc_id"])
    if documents is None:
        return made
    return documents.select("doc_id").join(made, "doc_id", "left").select(
        "doc_id", F.coalesce("markdown", F.lit("")).alias("markdown"))


def cell_chunks(cells: DataFrame, keys: Sequence[str] = ("table_id",), chunk_bytes: int = CHUNK_BYTES,
                split: bool | None = None, ranges: int | None = None) -> DataFrame:
    """Long-form cells (``keys, row, col, cell``) to one table per key, in chunks.

    The first row is the header; rows are padded or cut to its width.
    """
    keys = list(keys)
    cell = F.struct("col", clean_cell(F.col("cell")).alias("_cell"))
    rows = cells.groupBy(*keys, "row").agg(
        F.array_sort(F.collect_list(cell))["_cell"].alias("_cells"))
    # the header's width from counts alone, without its texts
    width = (
        cells.groupBy(*keys, "row").agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*keys).agg(F.min("row").alias("_head"), F.min_by("_n", "row").alias("_width")))
    fitted = rows.join(width, keys).withColumn("_width", F.col("_width").cast("int"))
    line = row_line(fit_row(F.col("_cells"), F.col("_width")))
    text = F.when(
        F.col("row") == F.col("_head"), F.concat(line, separator_line(F.col("_width")))
    ).otherwise(line)
    return text_chunks(fitted, keys, ["row"], text, "", chunk_bytes, split, ranges)


def cells_to_markdown(cells: DataFrame, keys: Sequence[str] = ("table_id",)) -> DataFrame:
    """``keys, markdown``: the table of each key, however far apart its row numbers are."""
    return whole_text(cell_chunks(cells, keys), keys)


def frame_chunks(df: DataFrame, group_cols: Sequence[str], order_col: str, columns: Sequence[str],
                 chunk_bytes: int = CHUNK_BYTES, split: bool | None = None, ranges: int | None = None) -> DataFrame:
    """A relation to one table per group, header from the column names, in chunks.

    ``order_col`` is unique in its group. Lines are made before the only shuffle of the text.
    """
    header = F.array(*[clean_cell(F.lit(c)) for c in columns])
    head = F.concat(row_line(header), separator_line(F.lit(len(columns))))
    line = row_line(F.array(*[clean_cell(F.col(c).cast("string")) for c in columns]))
    body = text_chunks(df, list(group_cols), [order_col], line, "", chunk_bytes, split, ranges)
    first = F.col("at") == 0
    return body.withColumn("text", F.when(first, F.concat(head, F.col("text"))).otherwise(F.col("text"))).withColumn(
        "at", F.when(first, 0).otherwise(F.col("at") + F.octet_length(head)).cast("long"))


def frame_to_markdown(df: DataFrame, group_cols: Sequence[str], order_col: str,
                      columns: Sequence[str]) -> DataFrame:
    """``group_cols, markdown``: the table of each group."""
    return whole_text(frame_chunks(df, group_cols, order_col, columns), list(group_cols))
