"""Tables that retention purges: rows with ``finished_at``, in partitions by their day.

Every kind of row has a clock of its own, its ``finished_at``: that of a task's output and state is the
task's end, that of a batch archive the time the batch was closed. A purge touches only the
partitions up to the day of its cutoff: earlier days are dropped without being read, and of the cutoff's
day the survivors are written back over it. Purging again changes nothing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmark.limits import DEFAULT
from docmark.scratch import exists, remove

DAY = "ended_on"


def write_by_end(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows by the day of their ``finished_at``; rows that have not ended form a part of their own."""
    dated = rows.withColumn(DAY, F.to_date("finished_at"))
    dated.hint("rebalance", DAY).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)


def _cutoff(spark: SparkSession, now: dt.datetime, keep_s: int) -> tuple[Column, dt.date]:
    """The last moment that is purged and its day, both by the session's clock."""
    us = F.unix_micros(F.lit(now).cast("timestamp")) - keep_s * 1_000_000
    row = spark.range(1).select(us.alias("us"), F.to_date(F.timestamp_micros(us)).alias("day")).first()
    return F.timestamp_micros(F.lit(row.us).cast("long")), row.day


def expired(table: DataFrame, now: dt.datetime, keep_s: int = DEFAULT.retention_s) -> DataFrame:
    """Rows of a table by day that a purge at this time deletes; later days are not read."""
    cutoff, day = _cutoff(table.sparkSession, now, keep_s)
    return table.where((F.col(DAY) <= F.lit(day)) & (F.col("finished_at") <= cutoff)).drop(DAY)


def purge(spark: SparkSession, path: str, now: dt.datetime, keep_s: int = DEFAULT.retention_s) -> None:
    """Delete what ended ``keep_s`` seconds or longer before ``now``; a missing table is no error."""
    if not exists(spark, path):
        return
    cutoff, day = _cutoff(spark, now, keep_s)
    table = spark.read.parquet(path)
    whole = table.select(DAY).where(F.col(DAY) < F.lit(day)).distinct().collect()
    last = table.where(F.col(DAY) == F.lit(day))
    cut = not last.where(F.col("finished_at") <= cutoff).isEmpty()
    survivors = last.where(F.col("finished_at") > cutoff)
    if cut and not survivors.isEmpty():
        survivors.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
    elif cut:
        remove(spark, f"{path}/{DAY}={day}")
    for gone in whole:
        remove(spark, f"{path}/{DAY}={gone[0]}")
