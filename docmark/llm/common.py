"""Helpers that the operators of this folder share.

Words are cut and hashed over the bytes of a whole Arrow column at once: positions of word
starts and ends come from a table of byte classes, hashes of words and of runs of words from
prefix sums of a polynomial modulo 2**64. Hashes only propose; where two texts must be equal,
the operators compare the words themselves or combine two independent hashes.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one round of array work takes; a longer text is a round of its own.
SLICE_BYTES = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def space_class() -> np.ndarray:
    """Bytes that belong to words parted by ASCII white space."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def alnum_class() -> np.ndarray:
    """Bytes that belong to words of lower-case ASCII letters, digits and all else beyond ASCII."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


LOWER = _lower()
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_pair(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least n of each."""
    got = _powers.get(int(base))
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base), np.full(size, np.uint64(pow(int(base), -1, 1 << 64)))
        up[0] = down[0] = 1
        got = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 2 * SLICE_BYTES:
            _powers[int(base)] = got
    return got


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _BASE2
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Words of several texts, one after the other."""

    data: np.ndarray  # bytes of all texts
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word
    bounds: np.ndarray  # the words of text i are bounds[i] to bounds[i + 1]

    def hashes(self) -> np.ndarray:
        up, down = _power_pair(_BASE, len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words with one space after each, and where each begins (one entry more)."""
        lengths = self.ends - self.starts + 1
        at = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=at[1:])
        out = np.full(int(at[-1]), 0x20, np.uint8)
        body = lengths - 1
        total = int(body.sum())
        step = np.arange(total) - np.repeat(np.cumsum(body) - body, body)
        out[np.repeat(at[:-1], body) + step] = self.data[np.repeat(self.starts, body) + step]
        return out.tobytes(), at


def cut_words(texts: pa.Array, word_bytes: np.ndarray, lower: bool) -> Words:
    """The words of each text; null has none."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[first:last] if body is not None and last > first else np.zeros(0, np.uint8)
    offsets = offsets - first
    if lower:
        data = LOWER[data]
    inside = word_bytes[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = inside[heads]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    stops[tails] = inside[tails]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k word hashes; item i is of the run that starts at i."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return span_hashes(h, np.arange(n), np.full(n, k))


def span_hashes(h: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of the words first to first + length of each span."""
    up, down = _power_pair(_BASE2, len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[first + length] - sums[first]) * down[first] + length.astype(np.uint64))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each have at most limit bytes, or are one text."""
    for batch in batches:
        sizes = np.asarray(batch.column(column).cast(pa.large_binary()).fill_null(b"").to_pandas().map(len), np.int64)
        start = 0
        while start < batch.num_rows:
            fits = int(np.searchsorted(np.cumsum(sizes[start:]), limit, "right"))
            n = max(1, fits)
            yield batch.slice(start, n)
            start += n
    release()


def release() -> None:
    """Gives freed memory back to the machine, as a worker stays for other tasks."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def row_key(*cols: str) -> list[Column]:
    """Two hashes that tell rows of different contents apart, repeated rows not."""
    return [F.xxhash64(F.lit(s), *cols).alias(f"__k{s}") for s in (1, 2)]


KEY = ["__k1", "__k2"]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share; only a local session may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="docmark-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in shared storage: computed once, read again if an executor is lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: str) -> Column:
    """True for the fifth of documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % 5 == 0


def batch_of(schema: str | pa.Schema, columns: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))
