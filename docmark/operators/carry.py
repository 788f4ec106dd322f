"""Windows over keys of any size.

A window partitioned by a key puts all rows of that key into one task. That is the right
plan while keys are small: one shuffle, no join. Where a key is too large for a task, the
rows are parted by ranges of ``(key, order)`` with about the same number of rows in each
(:mod:`docmark.operators.ordered`), so that bursts, equal times and a sparse key beside a
dense one are cut alike. Windows run inside ``(key, range)``, and what a range needs from its
neighbours comes from one summary row per key and range. The summary is the only thing a key's
whole history is ordered over. Both plans give the same rows.

Which plan is taken follows from the largest key, counted beforehand on the key columns alone
(``split=None``), or from what the caller knows (``split=True`` or ``False``). The count also
gives the number of ranges. Ranges are written once, and so is the result of each window over
them, so that several windows read what the ones before have found and not their inputs again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmark.operators.ordered import AT, PART, in_ranges
from docmark.scratch import scratch_path

BUCKET = PART
LARGE_KEY_ROWS = 1_000_000
# ranges aim at this part of a large key
RANGE_SHARE = 0.5


def has_large_key(df: DataFrame, keys: Sequence[str], rows: int = LARGE_KEY_ROWS) -> bool:
    """Whether some key has more than ``rows`` rows; counts are combined before the shuffle."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return not counts.filter(F.col("_n") > rows).isEmpty()


def ranges_needed(df: DataFrame, keys: Sequence[str], rows: int) -> int | None:
    """Ranges that cut every key with more than ``rows`` rows; None without any.

    One row per key is counted before the shuffle and one row comes back.
    """
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.max("_n").alias("largest"), F.sum("_n").alias("total")).first()
    if found.largest is None or found.largest <= rows:
        return None
    return max(2, -(-found.total // max(1, int(rows * RANGE_SHARE))))


@dataclass(frozen=True)
class Measure:
    """One window value, in the parts that a cut timeline needs."""

    summary: Column  # of one bucket
    carried: Callable[[str], Column]  # from the other buckets' summaries
    inside: Column  # of the row, within its bucket (or its whole key)
    merge: Callable[[Column, Column], Column]
    finish: Callable[[Column], Column] = lambda value: value


class Timeline:
    """Windows over ``keys`` in ``order``.

    >>> line = Timeline(["task_id"], ["ts", "event_id"])
    >>> df = line.spread(events)
    >>> df = line.window(df, prev=line.lag("stage"), seen=line.running_sum(F.lit(1)))

    :meth:`spread` comes first: it decides the plan. Keys must not be NULL.
    """

    def __init__(self, keys: Sequence[str], order: Sequence[str],
                 split: bool | None = None, large_rows: int = LARGE_KEY_ROWS) -> None:
        self.keys = list(keys)
        self.order = list(order)
        self.split = split
        self.large_rows = large_rows

    def spread(self, df: DataFrame, ranges: int | None = None) -> DataFrame:
        """For large keys, write the rows in ranges and partition by them."""
        if self.split is None:
            counted = ranges_needed(df, self.keys, self.large_rows)
            self.split = counted is not None
            ranges = ranges or counted
        if not self.split:
            return df
        return in_ranges(df, [*self.keys, *self.order], ranges).drop(AT)

    @property
    def _by(self) -> list[str]:
        return [*self.keys, BUCKET] if self.split else self.keys

    def _rows(self):
        return W.partitionBy(*self._by).orderBy(*self.order)

    def _until(self, inclusive: bool):
        return self._rows().rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)

    def _buckets(self):
        return W.partitionBy(*self.keys).orderBy(BUCKET)

    def _before(self):
        return self._buckets().rowsBetween(W.unboundedPreceding, -1)

    def lag(self, value: Column | str) -> Measure:
        """Value of the row before; NULL on a key's first row."""
        # a struct tells a NULL value from a missing row
        box = F.struct((F.col(value) if isinstance(value, str) else value).alias("v"))
        return Measure(
            F.max_by(box, F.struct(*self.order)),
            lambda agg: F.lag(agg).over(self._buckets()),
            F.lag(box).over(self._rows()), F.coalesce, lambda boxed: boxed["v"])

    def lead(self, value: Column | str) -> Measure:
        """Value of the row after; NULL on a key's last row."""
        box = F.struct((F.col(value) if isinstance(value, str) else value).alias("v"))
        return Measure(
            F.min_by(box, F.struct(*self.order)),
            lambda agg: F.lead(agg).over(self._buckets()),
            F.lead(box).over(self._rows()), F.coalesce, lambda boxed: boxed["v"])

    def running_sum(self, value: Column, inclusive: bool = True) -> Measure:
        """Sum over a key's rows up to this one (or up to the one before)."""
        zero = F.lit(0).cast("long")
        return Measure(
            F.sum(value),
            lambda agg: F.coalesce(F.sum(agg).over(self._before()), zero),
            F.coalesce(F.sum(value).over(self._until(inclusive)), zero),
            lambda own, carry: own + carry)

    def running_max(self, value: Column, inclusive: bool = True) -> Measure:
        """Maximum over a key's rows up to this one (or up to the one before)."""
        return Measure(
            F.max(value), lambda agg: F.max(agg).over(self._before()),
            F.max(value).over(self._until(inclusive)), F.greatest)

    def running_min(self, value: Column, inclusive: bool = True) -> Measure:
        """Minimum over a key's rows up to this one (or up to the one before)."""
        return Measure(
            F.min(value), lambda agg: F.min(agg).over(self._before()),
            F.min(value).over(self._until(inclusive)), F.least)

    def running_last(self, value: Column, inclusive: bool = True) -> Measure:
        """Last value up to this row (or up to the one before) that is not NULL."""
        return Measure(
            F.max_by(value, F.when(value.isNotNull(), F.struct(*self.order))),
            lambda agg: F.last(agg, ignorenulls=True).over(self._before()),
            F.last(value, ignorenulls=True).over(self._until(inclusive)), F.coalesce)

    def window(self, df: DataFrame, **measures: Measure) -> DataFrame:
        """Add the measures to a frame that was :meth:`spread`."""
        if not self.split:
            return df.select(
                *df.columns, *[m.finish(m.inside).alias(n) for n, m in measures.items()])
        rows = df.repartition(*self._by)
        summary = rows.groupBy(*self._by).agg(
            *[m.summary.alias(f"_agg_{n}") for n, m in measures.items()])
        carried = summary.select(
            *self._by, *[m.carried(f"_agg_{n}").alias(f"_in_{n}") for n, m in measures.items()])
        found = rows.join(carried, self._by).select(
            *df.columns,
            *[m.finish(m.merge(m.inside, F.col(f"_in_{n}"))).alias(n)
              for n, m in measures.items()])
        path = scratch_path(df.sparkSession, "window")
        found.write.parquet(path)
        return df.sparkSession.read.parquet(path)
