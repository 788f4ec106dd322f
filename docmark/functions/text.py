"""Plain-text, JSON and XML contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITE = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# An inline document type or an entity declaration.
XML_DECLARATION = r"(?i)<!(DOCTYPE[^>]*\[|ENTITY)"


def strip(text: Column) -> Column:
    """Remove white space, Unicode white space included, at both ends."""
    return F.btrim(text, F.lit(WHITE))


def is_blank(text: Column) -> Column:
    """Whether nothing is left after :func:`strip`; true for NULL."""
    return F.coalesce(strip(text) == "", F.lit(True))


def clean_cell(cell: Column) -> Column:
    """One table cell: NULL to empty, line ends to blanks, pipes escaped, stripped."""
    flat = F.translate(F.coalesce(cell, F.lit("")), "\r\n", "  ")
    return strip(F.replace(flat, F.lit("|"), F.lit("\\|")))


def text_to_markdown(text: Column) -> Column:
    """Plain text is its own Markdown."""
    return text.cast("string")


def json_to_markdown(text: Column) -> Column:
    """JSON text is kept as it is; validity is not checked."""
    return text.cast("string")


def json_is_valid(text: Column) -> Column:
    """Optional check beside :func:`json_to_markdown`: one value and nothing after it.

    Parsers stop after the first value, so the text is read as the only element of an
    array and as the only field of an object; what closes one breaks the other.
    """
    raw = text.cast("string")
    alone = F.json_array_length(F.concat(F.lit("["), raw, F.lit("]"))) == 1
    field = F.try_parse_json(F.concat(F.lit('{"v":'), raw, F.lit("}"))).isNotNull()
    return F.coalesce(alone & field, F.lit(False))


def xml_has_entities(text: Column) -> Column:
    """Whether a document declares entities or an internal subset."""
    return F.rlike(text.cast("string"), F.lit(XML_DECLARATION))


def xml_strip_declarations(text: Column) -> Column:
    """Drop entity and document-type declarations; references stay unexpanded."""
    no_subset = F.regexp_replace(
        text.cast("string"), r"(?is)<!DOCTYPE[^>\[]*\[.*?\]\s*>", "")
    no_entity = F.regexp_replace(no_subset, r"(?i)<!ENTITY[^>]*>", "")
    return F.regexp_replace(no_entity, r"(?i)<!DOCTYPE[^>]*>", "")


def xml_to_markdown(text: Column) -> Column:
    """XML text is kept as it is, without declarations; entities are never expanded."""
    return xml_strip_declarations(text)
