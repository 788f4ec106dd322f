"""Expressions on raw bytes: signatures, text checks, data URIs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmark import dims


def _bytes(raw: bytes) -> Column:
    return F.lit(bytearray(raw))


def utf8_prefix_ok(content: Column, n: int = 512, tolerate_cut: bool = False) -> Column:
    """Whether the first ``n`` bytes are strict UTF-8.

    A character cut by the probe's end makes the text invalid, as in the service;
    ``tolerate_cut`` lets the probe grow by the up to three bytes that end it.
    """
    def valid(k: int) -> Column:
        return F.is_valid_utf8(F.substring(content, 1, k).cast("string"))

    if not tolerate_cut:
        return valid(n)
    return reduce(lambda a, b: a | b, [valid(n + k) for k in range(4)])


def binary_spoof(content: Column) -> Column:
    """Whether bytes offered as text start like an archive or a PDF (case-sensitive)."""
    return F.startswith(content, _bytes(dims.ZIP_MAGIC)) | F.startswith(
        content, _bytes(dims.PDF_MAGIC))


def zip_container(content: Column) -> Column:
    """Whether the bytes start like an archive."""
    return F.startswith(content, _bytes(dims.ZIP_MAGIC))


def match_signature(
    content: Column, signatures: Sequence[tuple[int, bytes, str]] = dims.SIGNATURES
) -> Column:
    """MIME type of the first signature the bytes carry, ignoring ASCII case; else NULL.

    The list is a program argument of fixed size, so it becomes one CASE over the
    head of the content: no theta join, no shuffle.
    """
    def head(offset: int, size: int) -> Column:
        # one Latin-1 character per byte, so lower() folds ASCII letters as bytes do
        part = F.substring(content, offset + 1, size)
        return F.lower(F.decode(part, "ISO-8859-1"))

    found = F.lit(None).cast("string")
    for offset, magic, mime in reversed(signatures):
        hit = head(offset, len(magic)) == magic.decode("latin-1").lower()
        found = F.when(hit, mime).otherwise(found)
    return found


def contains_any(content: Column, patterns: Sequence[bytes]) -> Column:
    """Whether the bytes hold one of the patterns (a literal list, like ``isin``)."""
    if not patterns:
        return F.lit(False)
    return reduce(
        lambda a, b: a | b, [F.contains(content, _bytes(p)) for p in patterns])


def data_uri(data: Column, ext: Column) -> Column:
    """``data:{mime};base64,{text}`` on one line, MIME type from the image extension."""
    mime = dims.lookup(F.lower(ext), dims.IMAGE_MIME, dims.DEFAULT_IMAGE_MIME)
    one_line = F.translate(F.base64(data), "\r\n", "")
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), one_line)
