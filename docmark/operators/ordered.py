"""Places of rows in an order, over keys of any size.

A row number over a window puts a whole key into one task. Here the rows are parted by ranges
of ``(key, order)``, which Spark cuts from a sample of the rows themselves, so that a large key,
or a burst of equal times, is spread over many partitions. A row's place is its place inside its
partition plus the rows of its key in the partitions before; one row for each key and partition
is all that crosses partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmark.scratch import scratch_path

PART, AT = "_part", "_at"


def in_ranges(df: DataFrame, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """The rows in order, written once, with the number of their range (``_part``, growing with
    the order) and their place inside it (``_at``).

    NULLs come first. Written, because the ranges are cut from a sample: whoever reads the
    numbers later must find the rows in the same ranges.
    """
    spark = df.sparkSession
    ranged = (df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order))
    made = ranged.sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    path = scratch_path(spark, "ordered")
    made.select(
        *df.columns, F.shiftright("_mid", 33).alias(PART),
        F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)).alias(AT)).write.parquet(path)
    return spark.read.parquet(path)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], place: str = "pos",
             total: str | None = None, partitions: int | None = None) -> DataFrame:
    """Add each row's place (from 0) among its key's rows, and how many those are.

    Equal rows in the order take neighbouring places in no particular sequence. NULL is a key
    like any other; without keys all rows are numbered.
    """
    rows = in_ranges(df, [*keys, *order], partitions)
    counts = rows.groupBy(*keys, PART).agg(F.min(AT).alias("_first"), F.count(F.lit(1)).alias("_n"))
    line = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    before = line.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys], F.col(PART).alias("_in"), "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(line).alias("_total"))
    here = [rows[k].eqNullSafe(starts[f"_of_{k}"]) for k in keys] + [rows[PART] == starts["_in"]]
    return rows.join(starts, reduce(lambda a, b: a & b, here)).select(
        *df.columns, (F.col(AT) - F.col("_first") + F.col("_before")).alias(place),
        *([F.col("_total").alias(total)] if total else []))
