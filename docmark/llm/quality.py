"""A byte-level convolutional network for text quality, in numpy.

A text's UTF-8 bytes are cut into overlapping chunks of 256 bytes, 192 apart, which cover all of it.
Learned filters of five bytes slide over every position and are max-pooled in each chunk; a small layer
gives each chunk a value, and the mean and the least value of all chunks make one probability. As a filter
is a sum of one table entry for each byte, a position costs five look-ups.

Training takes a bounded sample of labelled texts (``TRAINING`` for each label, whole texts); scoring reads
every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmark.llm.common import held_out, slices
from docmark.llm.samples import balanced_ids, sampled_texts

WIDTH, FILTERS, HIDDEN = 5, 24, 16
CELL, CHUNK, STRIDE = 64, 4, 3  # a chunk is 4 cells of 64 bytes, the next begins 3 cells later
TRAINING = 700
EPOCHS = 12
THRESHOLD = 0.3
_BLOCK = 96  # cells whose positions are held at once


@dataclass
class Network:
    tables: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    hidden: np.ndarray  # FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray  # HIDDEN
    ends: np.ndarray  # constant, weight of the mean, weight of the least value
    shift: float = 0.0


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each padded with zeros to whole cells, and the first cell of each."""
    cells = np.array([(len(t) + WIDTH - 1) // CELL + 1 for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(cells)])
    data = np.zeros(int(first[-1]) * CELL + WIDTH, np.uint8)
    for t, c in zip(texts, first[:-1].tolist(), strict=True):
        data[c * CELL : c * CELL + len(t)] = np.frombuffer(t, np.uint8)
    return data, first


def chunks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of each chunk (repeated at the end of a text), and the first chunk of each text."""
    cells = np.diff(first)
    n = np.maximum(1, -(-(cells - CHUNK) // STRIDE) + 1)
    start = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(cells)), n)
    at = (np.arange(start[-1]) - start[text]) * STRIDE
    return first[text][:, None] + np.minimum(at[:, None] + np.arange(CHUNK), cells[text][:, None] - 1), start


def convolve(net: Network, data: np.ndarray, cells: int, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The largest answer of each filter in each cell, and at which byte.

    A text's last WIDTH bytes are padding, so that no filter that counts looks into the next text.
    """
    best = np.empty((cells, FILTERS), np.float32)
    place = np.empty((cells, FILTERS), np.int64) if where else None
    room, more = (np.empty((_BLOCK * CELL, FILTERS), np.float32) for _ in range(2))
    for a in range(0, cells, _BLOCK):
        z = min(a + _BLOCK, cells)
        part = data[a * CELL : z * CELL + WIDTH].astype(np.intp)
        n = (z - a) * CELL
        answer = np.take(net.tables[0], part[:n], axis=0, out=room[:n], mode="clip")
        for k in range(1, WIDTH):
            np.add(answer, np.take(net.tables[k], part[k : k + n], axis=0, out=more[:n], mode="clip"), out=answer)
        answer = answer.reshape(z - a, CELL, FILTERS)
        if where:
            at = answer.argmax(axis=1)
            place[a:z] = at + np.arange(a, z)[:, None] * CELL
            best[a:z] = np.take_along_axis(answer, at[:, None], 1)[:, 0]
            continue
        half = CELL
        while half > 1:  # halving is faster than a maximum along the middle axis
            half //= 2
            answer = np.maximum(answer[:, :half], answer[:, half : 2 * half])
        best[a:z] = answer[:, 0]
    return best, place


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _values(net: Network, pooled: np.ndarray):
    seen = np.maximum(pooled + net.bias, 0)
    inner = np.maximum(seen @ net.hidden + net.hidden_bias, 0)
    return seen, inner, inner @ net.out


def _combined(net: Network, values: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean = np.add.reduceat(values, start[:-1]) / np.diff(start)
    least = np.minimum.reduceat(values, start[:-1])
    return net.ends[0] + net.ends[1] * mean + net.ends[2] * least, mean, least


def score_texts(net: Network, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    data, first = layout(texts)
    best, _ = convolve(net, data, int(first[-1]))
    cells, start = chunks(first)
    values = _values(net, best[cells].max(axis=1))[2]
    return _sigmoid(_combined(net, values, start)[0] + net.shift)


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Network:
    """Adam over mini-batches of whole texts; labels are 0 or 1."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
                  rng.normal(0, 0.4, (FILTERS, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32),
                  rng.normal(0, 0.4, HIDDEN).astype(np.float32), np.array([0, 0.7, 0.7], np.float32))
    weights = [net.tables, net.bias, net.hidden, net.hidden_bias, net.out, net.ends]
    slow, fast, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), 24):
            some = order[at : at + 24]
            data, first = layout([texts[i] for i in some])
            best, place = convolve(net, data, int(first[-1]), True)
            cells, start = chunks(first)
            inside = best[cells]
            winner = inside.argmax(axis=1)
            pooled = np.take_along_axis(inside, winner[:, None], 1)[:, 0]
            seen, inner, values = _values(net, pooled)
            total, mean, least = _combined(net, values, start)
            error = ((_sigmoid(total) - labels[some]) / len(some)).astype(np.float32)
            text = np.repeat(np.arange(len(some)), np.diff(start))
            d_value = error[text] * (net.ends[1] / np.diff(start)[text] + net.ends[2] * (values == least[text]))
            d_inner = d_value[:, None] * net.out * (inner > 0)
            d_pooled = d_inner @ net.hidden.T * (seen > 0)
            position = place[np.take_along_axis(cells, winner, 1), np.arange(FILTERS)]
            d_tables = np.zeros_like(net.tables)
            for k in range(WIDTH):
                slot = data[position + k].astype(np.int64) * FILTERS + np.arange(FILTERS)
                d_tables[k] = np.bincount(slot.ravel(), d_pooled.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            grads = [d_tables, d_pooled.sum(0), seen.T @ d_inner, d_inner.sum(0), inner.T @ d_value,
                     np.array([error.sum(), error @ mean, error @ least])]
            step += 1
            for w, g, m, v in zip(weights, grads, slow, fast, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        per_label: int = TRAINING) -> Network | None:
    """A network from labelled texts outside the held-out fifth; None if a label is missing."""
    rows = labels.where(~held_out(doc_id)).where(F.col(label).isin(0, 1))
    shares = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    if len(shares) < 2:
        return None
    sample = sampled_texts(docs, balanced_ids(rows, doc_id, label, per_label), doc_id, text)
    marks = np.array([v for _, v in sample], np.float32)
    if len(set(marks.tolist())) < 2:
        return None
    net = train([t.encode() for t, _ in sample], marks)
    # the sample is balanced, the corpus is not
    net.shift = float(np.log(shares[1] / shares[0]) - np.log(marks.sum() / (len(marks) - marks.sum())))
    return net


def score(docs: DataFrame, net: Network | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from threshold on) to every row of docs.

    Null and empty texts get the score of an empty text. Without a network every score is 0.5.
    All rows and columns stay, repeated rows too; input columns named like the new ones are replaced.
    An empty table gives no rows.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            if shared.value is None:
                values = np.full(batch.num_rows, 0.5)
            else:
                values = score_texts(shared.value, pc.fill_null(batch.column(text).cast(pa.large_binary()), b"").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values.astype(np.float64)), pa.array((values >= threshold).astype(np.int32))],
                [*batch.schema.names, "score", "predicted"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{kinds}, score double, predicted int")


def digest(scored: DataFrame) -> DataFrame:
    """The columns that the query returns."""
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
