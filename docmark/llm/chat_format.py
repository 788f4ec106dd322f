"""Chat formatting by columnar byte assembly.

A turn becomes ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. In texts and roles every ``<``, backslashes,
``|`` gets one backslash more, so that the marks cannot be written by a text; in roles backslashes and
line feeds are escaped as well. Both are undone by ``read_back``.

All turns of a batch are assembled at once: lengths of the six segments of each turn, cumulative
offsets and scatter indices are computed in numpy, and headers and contents are copied into one
buffer that becomes the Arrow column. This needs no shuffle. Turns are then put in order by ranges of
(conversation, turn), so that a conversation of any length spreads over tasks; each task joins
neighbouring turns of a conversation into parts of bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmark.llm.common import slices

START, END, LINE = b"<|im_start|>", b"<|im_end|>\n", b"\n"
LOSS_ROLE = "assistant"
#: Bytes after which a conversation goes on in another part.
PART_BYTES = 4_000_000

_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"<\\(\\*)\|")


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings, and where each begins (one entry more)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The formatted turns, and the first byte and length of each text in them."""
    roles = pc.replace_substring(pc.fill_null(roles, ""), "\\", "\\\\")
    roles = pc.replace_substring(roles, "\n", "\\n")
    marks = [pc.replace_substring_regex(c, r"<(\\*)\|", r"<\\\1|") for c in (roles, pc.fill_null(texts, ""))]
    (role_data, role_at), (text_data, text_at) = map(_bytes_of, marks)
    n = len(roles)
    lengths = np.empty((n, 5), np.int64)
    lengths[:] = len(START), 0, len(LINE), 0, len(END)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    begins = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, mark in ((0, START), (2, LINE), (4, END)):
        out[begins[:, k, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    for k, data, at in ((1, role_data, role_at), (3, text_data, text_at)):
        out[np.repeat(begins[:, k] - at[:-1], lengths[:, k]) + np.arange(len(data))] = data
    edges = np.append(begins[:, 0], len(out))
    buffers = [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(out)]
    formatted = pa.Array.from_buffers(pa.large_string(), n, buffers)
    return formatted, begins[:, 3] - begins[:, 0], lengths[:, 3]


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        formatted, first, length = assemble(batch.column("role"), batch.column("text"))
        learn = pc.fill_null(pc.equal(batch.column("role"), LOSS_ROLE), False)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("turn"), learn, formatted.cast(pa.string()), pa.array(first), pa.array(length)],
            ["conv", "turn", "learn", "formatted", "first", "length"])


_SPAN = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))


def _parts(part_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # formatted turns of one conversation
        key, opened, spans, size, number = None, None, [], 0, 0

        def result(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([key], batch.schema.field("conv").type), pa.array([opened[0]], batch.schema.field("turn").type),
                 pa.array([opened[1]], pa.int64()), pa.array([number], pa.int64()), pa.array([len(held)], pa.int64()), pa.array(["".join(held)], pa.string()),
                 pa.array([spans], _SPAN)], ["conv", "turn", "tie", "number", "n_turns", "formatted", "loss_spans"])

        for batch in batches:
            for conv, turn, learn, text, first, length, tie in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (conv != key or size >= part_bytes):
                    yield result(batch)
                    held, spans, size, number = [], [], 0, number + 1
                if not held:
                    key, opened = conv, (turn, tie)
                held.append(text)
                if learn:
                    spans.append({"from": size + first, "to": size + first + length})
                size += len(text.encode())
        if held:
            yield result(batch)

    return run


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 part_bytes: int = PART_BYTES) -> DataFrame:
    """Formatted conversations: the conversation's column, part, n_turns, formatted, loss_spans.

    Turns go by turn, nulls first, and a hash of role and text; repeated rows are repeated turns. Parts of a conversation,
    in the order of part, are its whole text; nearly all have one. loss_spans are byte ranges of the
    part's UTF-8: the escaped texts of assistant turns.

    Null texts and roles are empty; rows whose conversation is null form one conversation. Other
    columns are not looked at. An empty table gives no rows.
    """
    kinds = dict(turns.dtypes)
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    kind = f"conv {kinds[conv]}, turn {kinds[turn]}"
    made = rows.mapInArrow(_turns, f"{kind}, learn boolean, formatted string, first bigint, length bigint")
    made = made.withColumn("tie", F.xxhash64("formatted"))
    # equal keys meet in one task, so a task's own numbers put parts in order that begin alike
    ordered = made.repartitionByRange("conv", "turn", "tie").sortWithinPartitions("conv", "turn", "tie")
    parts = ordered.mapInArrow(_parts(part_bytes), f"{kind}, tie bigint, number bigint, n_turns bigint, formatted string, "
                               "loss_spans array<struct<`from`: bigint, `to`: bigint>>")
    return parts.select(F.col("conv").alias(conv), F.struct("turn", "tie", "number").alias("part"), "n_turns", "formatted", "loss_spans")


def _plain(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a formatted text."""
    unescaped = [(_plain(r), _plain(t)) for r, t in _TURN.findall(formatted)]
    return [(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], r), t) for r, t in unescaped]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, open_ = None, False
    turns, loss = hashlib.sha256(), hashlib.sha256()
    n = learnt = chars = 0

    def result() -> pa.RecordBatch:
        row = (key, n, turns.hexdigest(), learnt, loss.hexdigest(), chars)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([v], k) for v, k in zip(row, kinds, strict=True)],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")), strict=True):
            if not open_ or conv != key:
                if open_:
                    yield result()
                key, open_ = conv, True
                turns, loss = hashlib.sha256(), hashlib.sha256()
                n = learnt = chars = 0
            for role, content in read_back(text):
                turns.update(f"{role}\n{content}\n".encode())
                n += 1
            raw = text.encode()
            for s in spans:
                content = _plain(raw[s["from"] : s["to"]].decode())
                learnt += len(content)
                loss.update(content.encode())
            chars += len(text)
    if open_:
        yield result()


def digest(formatted: DataFrame) -> DataFrame:
    """The columns that the query returns, read back from the output.

    A digest runs over a whole conversation in order, so its parts stream through one task; one part
    is held at a time.
    """
    parts = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return parts.mapInArrow(_digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                     "loss_sha256 string, formatted_chars bigint")
