"""HTML to Markdown as a chain of Catalyst expressions.

Every pattern is free of look-around and back-references, so it means the same in
Java's and in RE2's syntax.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmark.functions.tables import grid_to_markdown
from docmark.functions.text import strip

# dropped with their contents, in this order
REMOVED = (
    r"(?s)<!--.*?-->",
    r"(?is)<script[^>]*>.*?</script>",
    r"(?is)<style[^>]*>.*?</style>",
    r"(?is)<head(?:\s[^>]*)?>.*?</head>",
)
LINK = r"""(?is)<a\s[^>]*?href=["']([^"']*)["'][^>]*>(.*?)</a>"""
STRONG = r"(?i)<(?:b|strong)(?:\s[^>]*)?>([^<]*)</(?:b|strong)>"
EMPHASIS = r"(?i)<(?:i|em)(?:\s[^>]*)?>([^<]*)</(?:i|em)>"
IMAGE_ALT_FIRST = r"""(?i)<img\s[^>]*?alt=["']([^"']*)["'][^>]*?src=["']([^"']*)["'][^>]*>"""
IMAGE_SRC_FIRST = r"""(?i)<img\s[^>]*?src=["']([^"']*)["'][^>]*?alt=["']([^"']*)["'][^>]*>"""
IMAGE_NO_ALT = r"""(?i)<img\s[^>]*?src=["']([^"']*)["'][^>]*>"""
BREAK = r"(?i)<br\s*/?>"
ITEM = r"(?i)<li(?:\s[^>]*)?>"
BLOCK = r"(?i)</?(?:p|div|ul|ol|section|article|nav|footer|tr)(?:\s[^>]*)?>"
TAG = r"<[^>]*>"
MANY_BREAKS = r"\n{3,}"
# entity -> text; the ampersand is decoded last, so that nothing is decoded twice
ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
)

_TABLE = r"(?is)<table[^>]*>(.*?)</table>"
_ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
_CELL = r"(?is)<t[hd](?:\s[^>]*)?>(.*?)</t[hd]>"


def _where_found(text: Column, pattern: str, change) -> Column:
    """Apply ``change`` to texts with a match of ``pattern``; others pass untouched.

    The one-element array binds the text, so that it is computed once.
    """
    bound = F.transform(
        F.array(text), lambda t: F.when(F.rlike(t, F.lit(pattern)), change(t)).otherwise(t))
    return F.get(bound, F.lit(0))


def _tables(html: Column) -> Column:
    """Each table by its Markdown, keeping the text between tables."""
    between = F.split(html, _TABLE)
    blocks = F.transform(
        F.regexp_extract_all(html, F.lit(_TABLE), F.lit(1)),
        lambda table: F.concat(F.lit("\n\n"), grid_to_markdown(_grid(table)), F.lit("\n\n")))
    merged = F.zip_with(
        between, blocks, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    return F.array_join(merged, "")


def _grid(table: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(table, F.lit(_ROW), F.lit(1)),
        lambda row: F.transform(
            F.regexp_extract_all(row, F.lit(_CELL), F.lit(1)),
            lambda cell: F.regexp_replace(cell, TAG, "")))


def _heading(text: Column, level: int) -> Column:
    pattern = rf"(?is)<h{level}(?:\s[^>]*)?>(.*?)</h{level}>"
    return F.regexp_replace(text, pattern, "\n\n" + "#" * level + " $1\n\n")


def _lower_headings(text: Column) -> Column:
    for level in range(2, 7):
        text = _heading(text, level)
    return text


def _images(text: Column) -> Column:
    text = F.regexp_replace(text, IMAGE_ALT_FIRST, "![$1]($2)")
    text = F.regexp_replace(text, IMAGE_SRC_FIRST, "![$2]($1)")
    return F.regexp_replace(text, IMAGE_NO_ALT, "![]($1)")


def html_to_markdown(html: Column) -> Column:
    """Markdown text of an HTML page."""
    out = html
    for pattern in REMOVED:
        out = F.regexp_replace(out, pattern, "")
    out = _where_found(out, "(?i)<table", _tables)
    out = _heading(out, 1)
    out = _where_found(out, "(?i)<h[2-6]", _lower_headings)
    out = F.regexp_replace(out, LINK, "[$2]($1)")
    out = F.regexp_replace(out, STRONG, "**$1**")
    out = F.regexp_replace(out, EMPHASIS, "*$1*")
    out = _where_found(out, "(?i)<img", _images)
    out = F.regexp_replace(out, BREAK, "\n")
    out = F.regexp_replace(out, ITEM, "\n- ")
    out = F.regexp_replace(out, BLOCK, "\n\n")
    out = F.regexp_replace(out, TAG, "")
    out = _where_found(out, "&", _entities)
    # line by line: a pattern for blanks around line ends is quadratic in a run of blanks
    lines = F.transform(F.split(out, "\n"), lambda line: F.btrim(line, F.lit(" \t")))
    out = F.array_join(lines, "\n")
    out = F.regexp_replace(out, MANY_BREAKS, "\n\n")
    return strip(out)


def _entities(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text
