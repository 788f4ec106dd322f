"""Sum-of-squares online packing of documents into token windows.

A document's ids are cut into whole windows and a rest. A rest goes, as it comes, to the fill level
for which the sum of the squared numbers of open windows per level grows least; a level array
holds those numbers. When a partition ends, or too many windows are open, the open windows are
closed: pieces of the emptiest are cut and moved into the gaps of the fullest, and what then is
left is cut into windows whose lengths are powers of two, which need no padding.

Every input partition packs its own documents without a shuffle; what it holds is bounded by
``max_open`` windows. Window ids are the partition's number and a counter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmark.llm.common import slices
from docmark.llm.tokens import END, encoder

LENGTH = 2048
MAX_OPEN = 2048

Piece = tuple[int, int, np.ndarray]  # document, start, ids


class SumOfSquares:
    """Open windows by fill level; closed ones are lists of pieces in ``done``."""

    def __init__(self, length: int, max_open: int):
        self.length, self.max_open = length, max_open
        self.counts = np.zeros(length + 1, np.int64)
        self.levels: list[list[list[Piece]]] = [[] for _ in range(length + 1)]
        self.open = 0
        self.done: list[list[Piece]] = []

    def add(self, doc: int, ids: np.ndarray) -> None:
        whole = len(ids) // self.length * self.length
        for at in range(0, whole, self.length):
            self.done.append([(doc, at, ids[at : at + self.length])])
        if whole < len(ids):
            self._place((doc, whole, ids[whole:]))
        if self.open > self.max_open:
            self.close()

    def _place(self, piece: Piece) -> None:
        size, n = len(piece[2]), self.counts
        last = self.length - size
        # growth of the sum: leaving level h, reaching h + size; a full window leaves the array
        growth = 2 * (n[size : self.length + 1] - n[: last + 1]) + 2
        growth[last] = 1 - 2 * n[last]
        growth[n[: last + 1] == 0] = np.iinfo(np.int64).max
        growth[0] = 2 * n[size] + 1  # a new window
        level = int(growth.argmin())
        window = self.levels[level].pop() if level else []
        if level:
            n[level] -= 1
            self.open -= 1
        window.append(piece)
        if level + size == self.length:
            self.done.append(window)
        else:
            self.levels[level + size].append(window)
            n[level + size] += 1
            self.open += 1

    def close(self) -> None:
        """Fills the fullest open windows with pieces of the emptiest; no padding is left."""
        windows = [(h, w) for h in range(self.length, 0, -1) for w in self.levels[h]]
        self.levels = [[] for _ in range(self.length + 1)]
        self.counts[:] = 0
        self.open = 0
        left, right = 0, len(windows) - 1
        loose: list[Piece] = list(windows[right][1]) if windows else []
        while left < right:
            fill, window = windows[left]
            while fill < self.length:
                if not loose:
                    right -= 1
                    if right <= left:
                        break
                    loose = list(windows[right][1])
                doc, start, ids = loose.pop()
                take = min(len(ids), self.length - fill)
                window.append((doc, start, ids[:take]))
                if take < len(ids):
                    loose.append((doc, start + take, ids[take:]))
                fill += take
            if fill == self.length:
                self.done.append(window)
            else:
                loose = window
            left += 1
        rest, size = loose, sum(len(p[2]) for p in loose)
        while size:
            room = min(1 << (size.bit_length() - 1), self.length)
            window, size = [], size - room
            while room:
                doc, start, ids = rest.pop()
                window.append((doc, start, ids[:room]))
                if room < len(ids):
                    rest.append((doc, start + room, ids[room:]))
                room -= min(room, len(ids))
            self.done.append(window)

    def take(self) -> list[list[Piece]]:
        out, self.done = self.done, []
        return out


PIECES = "sequence_id bigint, offset bigint, start bigint, length bigint, doc_tokens bigint, ids array<int>"


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
         max_open: int = MAX_OPEN, vocabulary: str | None = None) -> DataFrame:
    """One row for each piece: the id column and sequence_id, offset, start, length, doc_tokens, ids.

    A document is its text's ids and then id 1; each id is in exactly one piece, and a sequence's
    pieces follow one another from offset 0. Sequences hold ``length`` ids, or a power of two of fewer.

    A null or empty text is the end id alone. Null and repeated ids are kept as they are: every row is
    a document of its own. Other columns are not looked at. An empty table gives no rows.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    kind = dict(docs.dtypes)[doc_id]
    slim = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, part = SumOfSquares(length, max_open), TaskContext.get().partitionId() << 33
        encode, count = encoder(vocabulary).encode, 0
        held: dict[int, tuple[object, int]] = {}  # documents with ids not yet given out: id, ids to go and in all
        number = 0

        def result() -> pa.RecordBatch:
            nonlocal count
            rows = []
            for window in packer.take():
                at = 0
                for doc, start, ids in window:
                    name, left, total = held[doc]
                    rows.append((name, part + count, at, start, len(ids), total, ids.view(np.int32)))
                    at += len(ids)
                    if left == len(ids):
                        del held[doc]
                    else:
                        held[doc] = (name, left - len(ids), total)
                count += 1
            kinds = [docs_type, *[pa.int64()] * 5, pa.list_(pa.int32())]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                ["doc", "sequence_id", "offset", "start", "length", "doc_tokens", "ids"])

        docs_type = pa.null()
        for batch in slices(batches, "text"):
            docs_type = batch.schema.field("doc").type
            for name, ids in zip(batch.column("doc").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                held[number] = (name, len(ids), len(ids))
                packer.add(number, ids)
                number += 1
            if packer.done:
                yield result()
        packer.close()
        if packer.done:
            yield result()

    packed = slim.mapInArrow(run, f"doc {kind}, {PIECES}")
    return packed.withColumnRenamed("doc", doc_id)


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        offsets = lists.offsets.to_numpy()
        crc = [zlib.crc32(values[a:z].tobytes()) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(crc, pa.int64())], [*names, "ids_crc32"])


def digest(packed: DataFrame) -> DataFrame:
    """The columns that the query returns."""
    rows = packed.mapInArrow(_crc, "doc_id bigint, start bigint, length bigint, doc_tokens bigint, "
                                   "sequence_id bigint, offset bigint, ids_crc32 bigint")
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


__all__ = ["END", "pack", "digest", "SumOfSquares"]
