"""Status, progress and download requests against states and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmark import dims
from docmark.operators.assets import batch_archive_name

ZIP_TYPE = "application/zip"
MARKDOWN_TYPE = "text/markdown"


def resolve_status(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Status lookups: ``request_id, task_id`` with ``http_status, stage, status, error_reason``.

    A task without a state is not found.
    """
    known = state.select("task_id", "stage", "status", "error_reason")
    missing = F.col("status").isNull()
    code = F.when(missing, dims.ERRORS[dims.NOT_FOUND][1]).otherwise(200)
    return requests.join(known, "task_id", "left").select(
        *requests.columns, code.alias("http_status"), "stage", "status", "error_reason")


def resolve_progress(requests: DataFrame, batches: DataFrame, members: DataFrame,
                     states: DataFrame) -> DataFrame:
    """What opening a progress stream gives at once: ``request_id, error``.

    ``requests`` has ``request_id`` and either ``task_id`` or ``batch_id``. ``error`` is
    NULL where there is a state to follow; else it tells what is missing.
    """
    live = states.select("task_id").distinct().withColumn("_live", F.lit(True))
    followed = members.join(live, "task_id", "left_semi").select("batch_id").distinct()
    known = batches.select("batch_id").distinct().withColumn("_known", F.lit(True))
    # requests without a key of one kind are kept out of its join, where they would meet in one task
    of_task = requests.filter(F.col("task_id").isNotNull()).join(live, "task_id", "left").select(
        "request_id", F.when(F.col("_live").isNull(), dims.TASK_NOT_FOUND).alias("error"))
    others = requests.filter(F.col("task_id").isNull())
    of_batch = others.filter(F.col("batch_id").isNotNull()).join(known, "batch_id", "left").join(
        followed.withColumn("_followed", F.lit(True)), "batch_id", "left").select(
            "request_id", F.when(F.col("_known").isNull(), "batch_not_found").when(
                F.col("_followed").isNull(), dims.NO_TASKS_FOUND).alias("error"))
    of_none = others.filter(F.col("batch_id").isNull()).select("request_id", F.lit("batch_not_found").alias("error"))
    return of_task.unionByName(of_batch).unionByName(of_none)


def resolve_deliveries(requests: DataFrame, state: DataFrame, outputs: DataFrame) -> DataFrame:
    """Add ``http_status, media_type, file_name, error`` to ``request_id, task_id``.

    No state: gone. Not successful: not found. No output: gone. Else the output, in this
    order. States and outputs have one row per task, so each join keeps the requests'
    row count; requests for one popular task are left to skew-join splitting.
    """
    known = state.select("task_id", F.col("status").alias("_status"))
    made = outputs.select("task_id", F.col("file_name").alias("_file"))
    error = (
        F.when(F.col("_status").isNull(), dims.PURGED)
        .when(F.col("_status") != "SUCCESS", dims.NOT_FOUND)
        .when(F.col("_file").isNull(), dims.PURGED))
    status = F.coalesce(
        dims.lookup(error, {k: v[1] for k, v in dims.ERRORS.items()}), F.lit(200))
    media = F.when(F.endswith(F.col("_file"), F.lit(".zip")), ZIP_TYPE).otherwise(MARKDOWN_TYPE)
    return (
        requests.join(known, "task_id", "left").join(made, "task_id", "left")
        .select(
            *requests.columns,
            status.alias("http_status"),
            F.when(error.isNull(), media).alias("media_type"),
            F.when(error.isNull(), F.col("_file")).alias("file_name"),
            error.alias("error")))


def resolve_batch_deliveries(requests: DataFrame, batches: DataFrame) -> DataFrame:
    """Add ``http_status, media_type, file_name`` to ``request_id, batch_id``.

    ``batches`` has the batches whose archive exists; a missing one is always not found.
    """
    present = batches.select("batch_id").distinct().withColumn("_there", F.lit(True))
    there = F.col("_there").isNotNull()
    return requests.join(present, "batch_id", "left").select(
        *requests.columns,
        F.when(there, 200).otherwise(dims.ERRORS[dims.NOT_FOUND][1]).alias("http_status"),
        F.when(there, ZIP_TYPE).alias("media_type"),
        F.when(there, batch_archive_name(F.col("batch_id"))).alias("file_name"))
