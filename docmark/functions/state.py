"""Task state as JSON text and as a struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE_FIELDS = (
    "task_id", "batch_id", "original_name", "output_mode", "stage", "status", "error_reason")
STATE_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in STATE_FIELDS])


def state_json() -> Column:
    """The seven state columns of the row as JSON; NULLs are written out."""
    return F.to_json(F.struct(*STATE_FIELDS), {"ignoreNullFields": "false"})


def parse_state(raw: Column) -> Column:
    """JSON text back to the state struct; NULL text reads as missing."""
    return F.from_json(raw, STATE_SCHEMA)
