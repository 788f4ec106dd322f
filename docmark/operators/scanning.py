"""Threat screening, verdicts and retries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmark import dims
from docmark.functions.binary import contains_any
from docmark.limits import DEFAULT
from docmark.operators.carry import Timeline
from docmark.operators.patterns import pattern_hits


def signature_scan(df: DataFrame, hashes: DataFrame, patterns: Sequence[bytes] | DataFrame = (),
                   key: str = "task_id") -> DataFrame:
    """``key, error`` of the files whose bytes are a known threat.

    ``hashes`` has ``sha256`` (hex) and may be of any size: the join is on digests and
    keys only, contents stay where they are read, and Spark picks the strategy from the
    list's own size. ``patterns`` is a short literal list, tested in the same pass, or a table
    (``pattern``) of any size, see :mod:`docmark.operators.patterns`.
    """
    literal = () if isinstance(patterns, DataFrame) else patterns
    digests = df.select(
        key,
        F.sha2(F.col("content"), 256).alias("sha256"),
        contains_any(F.col("content"), literal).alias("_pattern"))
    known = hashes.select("sha256").distinct().withColumn("_listed", F.lit(True))
    hit = F.col("_pattern") | F.coalesce(F.col("_listed"), F.lit(False))
    found = digests.join(known, "sha256", "left").filter(hit).select(key)
    if isinstance(patterns, DataFrame):
        found = found.unionByName(pattern_hits(df, patterns, key)).distinct()
    return found.select(key, F.lit(dims.VIRUS).alias("error"))


def split_by_scan(df: DataFrame, hits: DataFrame, key: str = "task_id"
                  ) -> tuple[DataFrame, DataFrame]:
    """``(clean, infected)`` rows of a frame by the hits of a scan."""
    return df.join(hits, key, "left_anti"), df.join(hits, key, "left_semi")


def scan_verdict(files: DataFrame, results: DataFrame) -> DataFrame:
    """``file_id, verdict`` from the rows a scan returned for each file.

    ``files`` has ``file_id, answered``; ``results`` has ``file_id, ord, status``. No
    answer means unavailable; the first row that is not OK decides; all rows OK, or an
    answer without rows, means clean.
    """
    bad = results.filter(F.col("status") != "OK").groupBy("file_id").agg(
        F.min_by("status", "ord").alias("_bad"))
    verdict = (
        F.when(~F.col("answered"), "unavailable")
        .when(F.col("_bad") == "FOUND", "infected")
        .when(F.col("_bad").isNotNull(), "unavailable")
        .otherwise("clean"))
    return files.join(bad, "file_id", "left").select("file_id", verdict.alias("verdict"))


def resolve_attempts(attempts: DataFrame, max_retries: int = DEFAULT.scan_retries,
                     base_s: int = DEFAULT.scan_backoff_s) -> DataFrame:
    """``file_id, verdict, attempts_used, wait_s`` under the retry rule.

    ``attempts`` has ``file_id``, the order columns ``ts, event_id`` and ``outcome``, one
    of success, transient, permanent. Only the first ``max_retries + 1`` attempts count;
    the rank filter runs before the shuffle too, so a file tried a million times costs
    each task three rows.
    """
    tries = max_retries + 1
    nth = F.row_number().over(W.partitionBy("file_id").orderBy("ts", "event_id"))
    head = attempts.withColumn("_n", nth).filter(F.col("_n") <= tries)
    decided = F.min(F.when(F.col("outcome") != "transient", F.struct("_n", "outcome")))
    used = F.coalesce(F.col("_end._n"), F.col("_tried"))
    # after the i-th transient failure (from 0) the wait is base * 2^i, none after the last
    waits = F.least(
        F.when(F.col("_end").isNotNull(), F.col("_end._n") - 1).otherwise(F.col("_tried")),
        F.lit(max_retries))
    return head.groupBy("file_id").agg(
        decided.alias("_end"), F.max("_n").alias("_tried")
    ).select(
        "file_id",
        F.when(F.col("_end.outcome") == "success", "success")
        .when(F.col("_end").isNotNull() | (F.col("_tried") == tries), "unavailable")
        .otherwise("pending").alias("verdict"),
        used.cast("long").alias("attempts_used"),
        (F.lit(base_s) * (F.pow(F.lit(2), waits) - 1)).cast("long").alias("wait_s"))


def reconnect_delays(attempts: DataFrame, cap_s: int = DEFAULT.reconnect_cap_s,
                     ranges: int | None = None, split: bool | None = None) -> DataFrame:
    """Delay after each failed connection: ``2^n`` seconds up to the cap.

    ``attempts`` has ``client_id, ts, event_id, ok``; ``n`` counts the failures since the
    last success. It is the failures so far less those before the last success, both
    running values, so that a client's timeline can be cut anywhere.
    """
    line = Timeline(["client_id"], ["ts", "event_id"], split)
    df = line.spread(attempts, ranges)
    failed = (~F.col("ok")).cast("long")
    df = line.window(df, _fails=line.running_sum(failed, inclusive=False))
    at_success: Column = F.when(F.col("ok"), F.col("_fails"))
    df = line.window(df, _before=line.running_max(at_success))
    n = F.col("_fails") - F.coalesce(F.col("_before"), F.lit(0))
    delay = F.least(F.pow(F.lit(2), F.least(n, F.lit(30))).cast("long"), F.lit(cap_s))
    return df.filter(~F.col("ok")).select(
        "client_id", "event_id", n.alias("retry_no"), delay.cast("long").alias("delay_s"))
