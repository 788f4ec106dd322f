"""Byte patterns in contents, for pattern tables of any size.

Every pattern has an anchor: of its runs of eight bytes (fewer for a shorter pattern) the one that
fewest patterns share. Anchors and patterns go to all tasks, whose bytes are counted first; a table
over the bound goes out in blocks, of which each gives narrow hits. A task looks up every run of bytes
of a content in a table of bits, and compares patterns byte by byte where an anchor may stand. The plan
is the same for two patterns and for millions.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 8
#: Bytes of patterns, with 64 for each, that go to all tasks at once.
MAX_BROADCAST = 64_000_000
_CHUNK = 1 << 20
_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)


def anchored(patterns: DataFrame) -> DataFrame:
    """``pattern, at, run`` of the distinct patterns; NULL and empty ones are none."""
    own = patterns.select(F.col("pattern").cast("binary").alias("pattern")).where(F.length("pattern") > 0).distinct()
    width = F.least(F.length("pattern"), F.lit(RUN))
    runs = own.withColumn("at", F.explode(F.sequence(F.lit(0), F.length("pattern") - width)))
    runs = runs.withColumn("run", F.expr(f"substring(pattern, at + 1, least(length(pattern), {RUN}))"))
    shared = runs.select("pattern", "run").distinct().groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    return runs.join(shared, "run").groupBy("pattern").agg(
        F.min_by(F.struct("at", "run"), F.struct("n", "at")).alias("a")).select("pattern", "a.at", "a.run")


class _Index:
    """Anchors by their width: a table of bits, and the patterns of each run of bytes."""

    def __init__(self, rows: list[tuple[bytes, int, bytes]]):
        self.by_width: dict[int, tuple[np.ndarray, dict[int, list]]] = {}
        found: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for pattern, at, run in rows:
            found[len(run)][int.from_bytes(run, "big")].append((at, pattern))
        for width, runs in found.items():
            bits = np.zeros(1 << _BITS, bool)
            bits[self._slot(np.fromiter(runs, np.uint64, len(runs)))] = True
            self.by_width[width] = bits, dict(runs)

    @staticmethod
    def _slot(runs: np.ndarray) -> np.ndarray:
        return (runs * _MIX) >> np.uint64(64 - _BITS)

    def found_in(self, content: bytes) -> bool:
        data = np.frombuffer(content + bytes(RUN), np.uint8)
        for width, (bits, runs) in self.by_width.items():
            for start in range(0, max(0, len(content) - width + 1), _CHUNK):
                stop = min(start + _CHUNK, len(content) - width + 1)
                view = np.ndarray((stop - start,), ">u8", data.data, start, (1,)).astype(np.uint64)
                view >>= np.uint64(8 * (RUN - width))
                for i in np.flatnonzero(bits[self._slot(view)]).tolist():
                    for at, pattern in runs.get(int(view[i]), ()):
                        head = start + i - at
                        if head >= 0 and content[head : head + len(pattern)] == pattern:
                            return True
        return False


def pattern_hits(df: DataFrame, patterns: DataFrame, key: str = "task_id", content: str = "content",
                 max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Distinct ``key`` of the rows whose content holds one of the patterns (``pattern``).

    NULL contents hold none. A content is searched whole, whatever its length.
    """
    spark = df.sparkSession
    table = anchored(patterns).persist()
    size = table.agg(F.sum(F.length("pattern") + 64)).first()[0] or 0
    blocks = max(1, -(-size // max_broadcast))
    schema = df.select(key).schema
    hits = df.select(key).limit(0)
    for number in range(blocks):
        part = table.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == number)
        known = spark.sparkContext.broadcast([(bytes(r.pattern), r["at"], bytes(r.run)) for r in part.collect()])

        def search(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            index = _Index(known.value)
            for batch in batches:
                held = [c is not None and index.found_in(c) for c in batch.column(1).to_pylist()]
                yield batch.select([0]).filter(pa.array(held, pa.bool_()))

        hits = hits.unionByName(df.select(key, content).mapInArrow(search, schema))
    table.unpersist()
    return hits.distinct()
