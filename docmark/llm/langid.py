"""Language identification by a linear-chain conditional random field over words.

Each word (a run of letters, A-Z lower-cased) gives features: its two- and three-byte n-grams, its first and
last bytes, itself, and whether a lexicon learned per language holds it. A hashed table gives each feature a
weight for each language, a learned matrix joins neighbouring words, and forward-backward labels every word,
so that texts which switch language are labelled in parts. A text's language has the largest mean
probability over all its words.

Training takes a bounded sample of labelled texts (``TRAINING`` for each language) and mixes runs of
words of several languages into sequences, from which switching is learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmark.llm.common import Words, cut_words, held_out, mix, slices
from docmark.llm.samples import balanced_ids, sampled_texts

TRAINING = 300
STEPS = 250
SEQUENCE, BATCH = 64, 128
SEGMENT = 64
BITS = 18
UNKNOWN = "und"


def letters_class() -> np.ndarray:
    table = np.zeros(256, bool)
    table[0x61:0x7B] = table[0x80:] = True
    return table


LETTERS = letters_class()


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray  # features x languages
    moves: np.ndarray  # log weight of language after language
    lexicon: np.ndarray  # sorted hashes of words
    holders: np.ndarray  # bits of the languages whose lexicon holds each


def _slot(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix(h * np.uint64(64) + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int64)


def features(words: Words, hashes: np.ndarray, lexicon: np.ndarray, holders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots of n-grams in word order, first n-gram of each word, slots of the other features by word)."""
    joined, at = words.joined()
    data = np.concatenate([[0x20, 0x20], np.frombuffer(joined, np.uint8)]).astype(np.uint64)
    two = data[2:] | data[1:-1] << np.uint64(8)
    three = two | data[:-2] << np.uint64(16)
    grams = np.stack([_slot(two, 1), _slot(three, 2)], axis=1).ravel()
    length = at[1:] - at[:-1] - 1
    other = [_slot(hashes, 3)]
    for k in (1, 2, 3, 4):  # affixes, the whole word where it is shorter
        head = np.zeros(len(length), np.uint64)
        tail = np.zeros(len(length), np.uint64)
        for j in range(k):
            inside = j < length
            head = head * np.uint64(257) + np.where(inside, data[2 + at[:-1] + np.minimum(j, length)], 0).astype(np.uint64)
            tail = tail * np.uint64(257) + np.where(inside, data[2 + np.maximum(at[1:] - 2 - j, at[:-1])], 0).astype(np.uint64)
        other += [_slot(head, 10 + k), _slot(tail, 20 + k)]
    mask = np.zeros(len(hashes), np.uint64)
    if len(lexicon):
        place = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
        mask = np.where(lexicon[place] == hashes, holders[place], np.uint64(0))
    other.append(_slot(mask, 4))
    return grams, 2 * at[:-1], np.stack(other, axis=1)


def _emissions(weights: np.ndarray, grams: np.ndarray, first: np.ndarray, other: np.ndarray) -> np.ndarray:
    if not len(first):
        return np.zeros((0, weights.shape[1]))
    out = np.add.reduceat(weights[grams], first)
    for k in range(other.shape[1]):
        out += weights[other[:, k]]
    return out


def marginals(emission: np.ndarray, bounds: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probabilities of the labels of each word of several texts, by forward-backward.

    Texts are cut into segments. Products of the step matrices of all segments are formed together,
    messages pass from segment to segment, and then run inside all segments together: the result is
    that of one pass over each whole text.
    """
    labels = len(moves)
    lengths = np.diff(bounds)
    n_seg = -(-lengths // SEGMENT)
    seg_first = np.concatenate([[0], np.cumsum(n_seg)])
    total = int(seg_first[-1])
    if not total:
        return np.zeros((0, labels))
    text = np.repeat(np.arange(len(lengths)), n_seg)
    number = np.arange(total) - seg_first[text]
    start = bounds[text] + number * SEGMENT
    size = np.minimum(SEGMENT, bounds[text + 1] - start)
    word = np.minimum(start[:, None] + np.arange(SEGMENT), len(emission) - 1)
    x = np.exp(emission - emission.max(axis=1, keepdims=True))[word]
    a = np.exp(moves - moves.max())
    opens = number == 0
    product = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
    for s in range(SEGMENT):
        new = (product if s == 0 else product @ a)
        if s == 0:
            new = np.where(opens[:, None, None], product, product @ a)
        new = new * x[:, s, None, :]
        new /= new.sum(axis=(1, 2), keepdims=True)
        product = np.where((s < size)[:, None, None], new, product)
    enter, leave = np.full((total, labels), 1.0), np.full((total, labels), 1.0)
    for k in range(int(n_seg.max()) - 1):  # messages between segments, all texts at once
        here = seg_first[:-1][n_seg > k + 1] + k
        passed = (enter[here, None, :] @ product[here])[:, 0]
        enter[here + 1] = passed / passed.sum(axis=1, keepdims=True)
        back = seg_first[1:][n_seg > k + 1] - 1 - k
        passed = (product[back] @ leave[back, :, None])[:, :, 0]
        leave[back - 1] = passed / passed.sum(axis=1, keepdims=True)
    forward = np.empty((total, SEGMENT, labels))
    message = enter
    for s in range(SEGMENT):
        moved = np.where(opens[:, None], message, message @ a) if s == 0 else message @ a
        moved = moved * x[:, s]
        message = moved / moved.sum(axis=1, keepdims=True)
        forward[:, s] = message
    message = leave
    for s in range(SEGMENT - 1, -1, -1):
        inside = (s < size)[:, None]
        both = forward[:, s] * message
        forward[:, s] = both / both.sum(axis=1, keepdims=True)
        moved = (x[:, s] * message) @ a.T
        message = np.where(inside, moved / moved.sum(axis=1, keepdims=True), message)
    return forward[np.arange(SEGMENT) < size[:, None]]


def train(texts: list[str], labels: list[str], steps: int = STEPS, seed: int = 5) -> Field:
    """Stochastic gradient steps (Adagrad) on mixed sequences of the texts' words."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    target = np.array([languages.index(v) for v in labels])
    words = cut_words(pa.array(texts, pa.large_string()), LETTERS, True)
    hashes = words.hashes()
    of_word = np.repeat(target, np.diff(words.bounds))
    distinct, back = np.unique(hashes, return_inverse=True)
    seen = np.zeros((len(distinct), len(languages)), np.int64)
    np.add.at(seen, (back, of_word), 1)
    holders = ((seen >= 2) * (1 << np.arange(len(languages))).astype(np.uint64)).sum(axis=1).astype(np.uint64)
    lexicon, holders = distinct[holders > 0], holders[holders > 0]
    grams, first, other = features(words, hashes, lexicon, holders)
    gram_end = np.append(first[1:], len(grams))
    field = Field(languages, np.zeros((1 << BITS, len(languages)), np.float32), np.zeros((len(languages),) * 2), lexicon, holders)
    squares, move_squares = np.full(field.weights.shape, 1e-6, np.float32), np.full(field.moves.shape, 1e-6)
    own = [np.flatnonzero(of_word == k) for k in range(len(languages))]
    bounds = np.arange(BATCH + 1) * SEQUENCE
    for _ in range(steps):
        picked = []
        for _ in range(BATCH):  # runs of neighbouring words, of another language each
            row: list[int] = []
            while len(row) < SEQUENCE:
                pool = own[rng.integers(len(languages))]
                at = rng.integers(len(pool))
                row += pool[at : at + int(rng.integers(4, 2 * SEQUENCE))].tolist()
            picked += row[:SEQUENCE]
        chosen = np.array(picked)
        # words left out of the lexicon at times, so that other features are learned too
        slots = other[chosen].copy()
        hide = rng.random(len(chosen)) < 0.5
        slots[hide, 0] = 0
        slots[hide, -1] = _slot(np.zeros(1, np.uint64), 4)[0]
        count = (gram_end - first)[chosen]
        starts = np.concatenate([[0], np.cumsum(count)])
        flat = grams[np.repeat(first[chosen] - starts[:-1], count) + np.arange(starts[-1])]
        emission = _emissions(field.weights, flat, starts[:-1], slots)
        error = marginals(emission, bounds, field.moves)
        y = of_word[chosen]
        pair = error.reshape(BATCH, SEQUENCE, -1)
        # expected moves, with neighbours taken as independent given their marginals
        expected = np.einsum("bsi,bsj->ij", pair[:, :-1], pair[:, 1:])
        actual = np.zeros_like(field.moves)
        np.add.at(actual, (y.reshape(BATCH, -1)[:, :-1].ravel(), y.reshape(BATCH, -1)[:, 1:].ravel()), 1)
        error[np.arange(len(y)), y] -= 1
        grad = np.zeros_like(field.weights)
        owner = np.repeat(np.arange(len(chosen)), count)
        for k in range(len(languages)):
            grad[:, k] = np.bincount(flat, error[owner, k], 1 << BITS) + np.bincount(
                slots.ravel(), np.repeat(error[:, k], slots.shape[1]), 1 << BITS)
        grad /= len(chosen)
        squares += grad * grad
        field.weights -= 0.1 * grad / np.sqrt(squares)
        moved = (expected - actual) / len(chosen)
        move_squares += moved * moved
        field.moves -= 0.05 * moved / np.sqrt(move_squares)
    return field


def label_texts(field: Field, texts: pa.Array) -> tuple[list[str], np.ndarray, Words, np.ndarray]:
    """Language and score of each text, and its words with their probabilities."""
    words = cut_words(texts, LETTERS, True)
    hashes = words.hashes()
    _, one, back = np.unique(hashes, return_index=True, return_inverse=True)
    each = Words(words.data, words.starts[one], words.ends[one], np.array([0, len(one)]))
    emission = _emissions(field.weights, *features(each, hashes[one], field.lexicon, field.holders))[back]
    probability = marginals(emission, words.bounds, field.moves)
    sums = np.concatenate([np.zeros((1, len(field.languages))), np.cumsum(probability, axis=0)])
    mean = (sums[words.bounds[1:]] - sums[words.bounds[:-1]]) / np.maximum(1, np.diff(words.bounds))[:, None]
    best = mean.argmax(axis=1)
    names = [field.languages[k] for k in best]
    score = mean[np.arange(len(best)), best]
    ascii_letters = np.concatenate([[0], np.cumsum(words.data[words.starts] < 0x80)]) if len(words.starts) else np.zeros(1, np.int64)
    for i in np.flatnonzero(ascii_letters[words.bounds[1:]] == ascii_letters[words.bounds[:-1]]).tolist():
        if not any(c.isalpha() for c in texts[i].as_py() or ""):
            names[i], score[i] = UNKNOWN, 0.0
    return names, np.clip(score, 0, 1), words, probability


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", per_label: int = TRAINING) -> Field | None:
    """A field from labelled texts outside the held-out fifth; None if there are none."""
    rows = docs.where(~held_out(doc_id)).where(F.col(text).isNotNull())
    sample = sampled_texts(rows, balanced_ids(rows, doc_id, label, per_label), doc_id, text)
    sample = [(t, v) for t, v in sample if any(c.isalpha() for c in t)]
    return train([t for t, _ in sample], [v for _, v in sample]) if sample else None


def identify(docs: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (0 to 1) to every row of docs.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text if there is no field.
    All rows and columns stay, repeated rows too; input columns named like the new ones are replaced.
    An empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            if shared.value is None:
                names, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                names, score, _, _ = label_texts(shared.value, batch.column(text))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())],
                [*batch.schema.names, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def digest(found: DataFrame) -> DataFrame:
    """The columns that the query returns."""
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
