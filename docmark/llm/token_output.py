"""Packed token-id matrices by best-fit-decreasing packing.

Each task takes its documents in runs of bounded size. Texts longer than a row are split into whole
rows and a rest, without loss. The rests are placed in decreasing order of length into the row with
the least room that fits; a segment tree over the amounts of room finds it. A row comes out as a
binary of fixed length (little-endian unsigned 16-bit ids, padded with ``pad``), with the cumulative
lengths of its segments and position numbers that begin anew at each segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmark.llm.common import slices
from docmark.llm.tokens import encoder

LENGTH = 2048
PAD = 50256
#: Ids after which a task packs what it has gathered.
RUN_IDS = 8_000_000


class Rooms:
    """A segment tree over amounts of room: which amount, at least as large as asked, is the least in use."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.used = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _change(self, room: int, by: int) -> None:
        at = self.size + room
        while at:
            self.used[at] += by
            at >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, row) of the tightest fit, taken out; None if nothing has so much room."""
        at = self.size + size
        if not self.used[at]:
            while at > 1 and (at & 1 or not self.used[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.used[2 * at] else 2 * at + 1
        room = at - self.size
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Numbers of the items in each row; every size is between 1 and length."""
    rooms, rows = Rooms(length), []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = rooms.take(sizes[item])
        if found is None:
            room, row = length, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(item)
        if room > sizes[item]:
            rooms.put(room - sizes[item], row)
    return rows


ROWS = ("row_id bigint, n_ids bigint, ids binary, cu_seqlens array<int>, position_ids binary, "
        "starts array<bigint>, doc_tokens array<bigint>")


def pack_matrix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, pad: int = PAD,
                run_ids: int = RUN_IDS, vocabulary: str | None = None) -> DataFrame:
    """One row of the matrix a line: its segments' ids of documents, starts, ids and positions.

    ``doc_ids``, ``starts`` and ``doc_tokens`` have an entry for each segment; ``cu_seqlens`` begins
    with 0 and ends with n_ids; ``ids`` and ``position_ids`` are ``length`` unsigned 16-bit numbers, of which
    those after n_ids are padding. A text is its ids and then id 1; concatenating its segments by
    start gives them back. The vocabulary must have fewer than 65,536 ids.

    A null or empty text is the end id alone. Null and repeated ids are kept: every row is a
    document of its own. Other columns are not looked at. An empty table gives no rows.
    """
    kind = dict(docs.dtypes)[doc_id]
    slim = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, count = encoder(vocabulary).encode, TaskContext.get().partitionId() << 33, 0
        docs_type = pa.null()

        def result(segments: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal count
            rows = best_fit_decreasing([len(s[2]) for s in segments], length)
            for at in range(0, len(rows), 2000):
                some = rows[at : at + 2000]
                matrix = np.full((len(some), length), pad, np.uint16)
                places = np.zeros((len(some), length), np.uint16)
                ends = []
                for r, row in enumerate(some):
                    cut = [0]
                    for i in row:
                        ids = segments[i][2]
                        matrix[r, cut[-1] : cut[-1] + len(ids)] = ids
                        places[r, cut[-1] : cut[-1] + len(ids)] = np.arange(len(ids))
                        cut.append(cut[-1] + len(ids))
                    ends.append(cut)
                raw, pos = matrix.astype("<u2"), places.astype("<u2")
                pick = lambda k, kind: pa.array([[segments[i][k] for i in row] for row in some], pa.list_(kind))
                yield pa.RecordBatch.from_arrays(
                    [pick(0, docs_type), pa.array(range(part + count, part + count + len(some)), pa.int64()),
                     pa.array([c[-1] for c in ends], pa.int64()), pa.array([x.tobytes() for x in raw], pa.binary()),
                     pa.array(ends, pa.list_(pa.int32())), pa.array([x.tobytes() for x in pos], pa.binary()),
                     pick(1, pa.int64()), pick(3, pa.int64())],
                    ["doc_ids", "row_id", "n_ids", "ids", "cu_seqlens", "position_ids", "starts", "doc_tokens"])
                count += len(some)

        segments, held = [], 0
        for batch in slices(batches, "text"):
            docs_type = batch.schema.field("doc").type
            for name, ids in zip(batch.column("doc").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                if held >= run_ids:
                    yield from result(segments)
                    segments, held = [], 0
                if len(ids) and int(ids.max()) > 0xFFFF:
                    raise ValueError("the vocabulary has ids above 65,535")
                small = ids.astype(np.uint16)
                segments += [(name, a, small[a : a + length], len(ids)) for a in range(0, len(ids), length)]
                held += len(ids)
        if segments:
            yield from result(segments)

    return slim.mapInArrow(run, f"doc_ids array<{kind}>, {ROWS}")


def write_matrix(packed: DataFrame, path: str) -> None:
    """Writes the rows as Parquet files with a fixed binary of ids a row; a retried job replaces them."""
    packed.write.mode("overwrite").parquet(path)
