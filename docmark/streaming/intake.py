"""Intake checks on a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmark.limits import DEFAULT, Limits
from docmark.operators.validation import checked_uploads


def stream_validate(stream: DataFrame, limits: Limits = DEFAULT,
                    tolerate_cut: bool = False) -> DataFrame:
    """Each arriving upload with ``mime`` and ``error``; no state is kept.

    It is the batch operator's projection, so a stream and a batch over the same files
    give the same rows.
    """
    return checked_uploads(stream, limits, tolerate_cut)


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("error").isNull()).drop("error")


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("error").isNotNull()).drop("content")
