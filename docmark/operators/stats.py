"""Service counters as aggregates over event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmark.scratch import exists


def count_conversions(events: DataFrame) -> DataFrame:
    """``conversions``: one per successful conversion of any type."""
    return events.agg(F.count_if(F.col("status") == "SUCCESS").alias("conversions"))


def count_visitors(visits: DataFrame, approximate: bool = False) -> DataFrame:
    """``visitors``: each ``user_id`` once."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return visits.agg(count("user_id").alias("visitors"))


def current_stats(visitors: DataFrame, conversions: DataFrame) -> DataFrame:
    """One row ``visitors, conversions``; a counter that was never written reads 0.

    The inputs are one-row counters (or empty).
    """
    rows = visitors.select(
        F.col("visitors"), F.lit(None).cast("long").alias("conversions")
    ).unionByName(conversions.select(
        F.lit(None).cast("long").alias("visitors"), F.col("conversions")))
    return rows.agg(
        F.coalesce(F.sum("visitors"), F.lit(0)).alias("visitors"),
        F.coalesce(F.sum("conversions"), F.lit(0)).alias("conversions"))


# --- counters kept as increments ---------------------------------------------


def counter_increment(events: DataFrame) -> DataFrame:
    """One row ``conversions, visitors``: what a batch of events adds; ``visitors`` is a sketch.

    Increments of any split of the events give the same totals when they are united, in any order,
    so nothing is counted again.
    """
    return events.agg(
        F.count_if(F.col("status") == "SUCCESS").alias("conversions"),
        F.hll_sketch_agg(F.col("user_id").cast("string")).alias("visitors"))


def united(increments: DataFrame) -> DataFrame:
    """One increment out of many."""
    return increments.agg(
        F.coalesce(F.sum("conversions"), F.lit(0)).alias("conversions"),
        F.hll_union_agg("visitors").alias("visitors"))


def totals(increments: DataFrame) -> DataFrame:
    """``visitors, conversions`` of increments; the number of visitors is an estimate."""
    return united(increments).select(
        F.coalesce(F.hll_sketch_estimate("visitors"), F.lit(0)).alias("visitors"), "conversions")


def count_new_visitors(events: DataFrame, seen: DataFrame) -> DataFrame:
    """``user_id`` of visitors that were not ``seen`` before: an exact increment.

    Added to ``seen``, they leave the next batch only those that come after them.
    """
    return events.select("user_id").where(F.col("user_id").isNotNull()).distinct().join(
        seen.select("user_id").distinct(), "user_id", "left_anti")


class Counters:
    """Counters below a folder, kept by adding batches; a batch that is added again changes nothing."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _read(self, table: str, schema: str) -> DataFrame:
        if not exists(self.spark, f"{self.path}/{table}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{table}")

    def add(self, events: DataFrame, batch: int) -> None:
        """Count a batch of ``user_id, status`` events under its number."""
        seen = self._read("users", "user_id string")
        if "batch" in seen.columns:
            seen = seen.where(F.col("batch") != batch)
        events = events.withColumn("user_id", F.col("user_id").cast("string"))
        count_new_visitors(events, seen).write.mode("overwrite").parquet(f"{self.path}/users/batch={batch}")
        counter_increment(events).write.mode("overwrite").parquet(f"{self.path}/increments/batch={batch}")

    def current(self, exact: bool = True) -> DataFrame:
        """One row ``visitors, conversions``; exact from the users' table, or estimated by sketches."""
        found = totals(self._read("increments", "conversions long, visitors binary"))
        if not exact:
            return found
        users = self._read("users", "user_id string").agg(F.count_distinct("user_id").alias("visitors"))
        return current_stats(users, found.select("conversions"))
