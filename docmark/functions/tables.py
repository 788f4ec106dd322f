"""Cell grids and delimited text as GitHub-flavoured Markdown tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmark.functions.text import clean_cell


def row_line(cells: Column) -> Column:
    """``| a | b |`` and a line end, from an array of clean cells."""
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |\n"))


def separator_line(width: Column) -> Column:
    """The line under the header."""
    return row_line(F.array_repeat(F.lit("---"), width))


def fit_row(cells: Column, width: Column) -> Column:
    """Pad a row with empty cells, or cut it, to the header's width."""
    pad = F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0)))
    return F.slice(F.concat(cells, pad), F.lit(1), width)


def grid_to_markdown(grid: Column) -> Column:
    """Array of rows to a table, row 0 being the header; empty grid or header gives ''."""
    rows = F.transform(grid, lambda row: F.transform(row, clean_cell))

    def render(clean: Column) -> Column:
        head = F.get(clean, F.lit(0))
        width = F.size(head)
        body = F.transform(
            F.slice(clean, F.lit(2), F.greatest(F.size(clean) - 1, F.lit(0))),
            lambda row: row_line(fit_row(row, width)))
        return F.concat(row_line(head), separator_line(width), F.array_join(body, ""))

    # the one-element array binds the cleaned grid, so that it is computed once
    table = F.get(F.transform(F.array(rows), render), F.lit(0))
    empty = grid.isNull() | (F.size(grid) == 0) | (
        F.coalesce(F.size(F.get(grid, F.lit(0))), F.lit(0)) <= 0)
    return F.when(empty, "").otherwise(table)


# One field and the delimiter that ends it. A field that starts with a quote may hold
# delimiters and doubled quotes; possessive, so that no input can exhaust the stack.
_FIELD = r'("(?:[^"]++|"")*+"[^,\r\n]*+|[^,\r\n]*+)(,|\r\n|\n|\r)'
_MARK, _END = "\x1e", "\x1f"


def csv_grid(text: Column) -> Column:
    """Delimited text to an array of rows of unquoted cells; blank lines are dropped."""
    plain = F.translate(text.cast("string"), _MARK + _END, "  ")
    marked = F.regexp_replace(F.concat(plain, F.lit("\n")), _FIELD, f"$1{_MARK}$2{_END}")
    lines = F.filter(
        F.split(marked, f"{_MARK}(?:\r\n|\n|\r){_END}"), lambda line: line != "")

    def unquote(cell: Column) -> Column:
        inner = F.regexp_extract(cell, r'(?s)^"(.*)"$', 1)
        quoted = F.rlike(cell, F.lit(r'(?s)^".*"$'))
        return F.when(quoted, F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(cell)

    return F.transform(
        lines, lambda line: F.transform(F.split(line, f"{_MARK},{_END}"), unquote))


def csv_to_markdown(text: Column) -> Column:
    """Delimited text to a table, its first line being the header."""
    return grid_to_markdown(csv_grid(text))
