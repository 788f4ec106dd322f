"""What a user may see of a failure, and the stage it is reported at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmark import dims


def attach_error_info(rejects: DataFrame) -> DataFrame:
    """Add ``context, http_status, user_message`` and drop the error class.

    An unknown class reads as an internal error with the generic message.
    """
    error = F.col("error")
    context = {k: v[0] for k, v in dims.ERRORS.items()}
    status = {k: v[1] for k, v in dims.ERRORS.items()}
    message = {k: v[2] for k, v in dims.ERRORS.items()}
    return (
        rejects.withColumn("context", dims.lookup(error, context))
        .withColumn("http_status", dims.lookup(error, status, dims.GENERIC_STATUS))
        .withColumn("user_message", dims.lookup(error, message, dims.GENERIC_MESSAGE))
        .drop("error"))


def failure_stage(errors: DataFrame) -> DataFrame:
    """Add ``stage`` and ``error_reason``: where and with what message a task fails.

    Only scan and conversion failures keep their own stage and message; everything
    else is reported at the last stage with the generic one.
    """
    error = F.col("error")
    own = {k: dims.ERRORS[k][2] for k in dims.FAILURE_STAGE}
    return (
        errors.withColumn("stage", dims.lookup(error, dims.FAILURE_STAGE, "PACKAGING"))
        .withColumn("error_reason", dims.lookup(error, own, dims.PIPELINE_MESSAGE)))
