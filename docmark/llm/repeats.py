"""Removal of repeated passages with sharded phrase automata.

Every window of ``window`` words has an anchor: the leftmost of its ``phrase``-word phrases with
the smallest hash. Equal windows have equal anchors, so only windows whose anchor recurs can recur.

1. Anchors. Each document is cut into segments, one for each anchor: the words of all windows
   that share it. Anchors are counted with partial sums; those seen once drop out.
2. Confirmation. Equal segments of an anchor become one row with a count. The words of one
   example of each are fetched, and windows are compared word by word within the anchor.
3. Automata. Segments are dealt to shards by anchor. A shard compiles its confirmed passages into
   Aho-Corasick automata (every word is one symbol) and streams its segments through them.
4. What the automata locate goes back to all occurrences, and covered words are removed.

An anchor with very many different segments is not gathered: its windows are counted by Spark,
and its segments are dealt over all shards with their confirmed windows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmark.llm.common import KEY, cut_words, row_key, run_hashes, slices, space_class, span_hashes, written

WINDOW = 35
PHRASE = 8
#: Different segments of one anchor that a shard compares itself.
MAX_GROUP = 8_000
#: Segments after which a shard compiles an automaton, once the anchor is complete.
SHARD_SEGMENTS = 4_000
SPACES = space_class()


def _segments(got, window: int, phrase: int):
    """For each anchor of each text: text, anchor hash, segment hash, first word, number of windows."""
    h = got.hashes()
    runs = run_hashes(h, phrase)
    reach = window - phrase + 1
    n = len(h) - window + 1
    if n <= 0:
        return None
    # smallest hash first, then leftmost: positions are the low bits
    low = np.uint64(len(runs).bit_length())
    order = ((runs >> low) << low) | np.arange(len(runs), dtype=np.uint64)
    size = 1
    while 2 * size <= reach:
        order = np.minimum(order[:-size], order[size:])
        size *= 2
    order = np.minimum(order[: n], order[reach - size : reach - size + n])
    doc = np.searchsorted(got.bounds, np.arange(n), "right") - 1
    inside = np.flatnonzero(np.arange(n) + window <= got.bounds[doc + 1])
    if not len(inside):
        return None
    anchor = (order[inside] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[inside][1:] != doc[inside][:-1])]))
    first = inside[new]
    count = np.diff(np.append(new, len(inside)))
    doc, anchor = doc[first], anchor[new]
    return doc, runs[anchor], span_hashes(h, first, count + window - 1), first - got.bounds[doc], count


def _anchors(docs: DataFrame, text: str, window: int, phrase: int) -> DataFrame:
    """A row for each segment; place is its first word times 64 plus its number of windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = _segments(cut_words(batch.column(text), SPACES, False), window, phrase)
            if found is None:
                continue
            doc, anchor, segment, first, count = found
            k1, k2 = (batch.column(k).to_numpy()[doc] for k in KEY)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1), pa.array(k2), pa.array(anchor.view(np.int64)), pa.array(segment.view(np.int64)),
                 pa.array(first.astype(np.int64) * 64 + count)], [*KEY, "anchor", "segment", "place"])

    return docs.mapInArrow(cut, "__k1 bigint, __k2 bigint, anchor bigint, segment bigint, place bigint")


def _texts(docs: DataFrame, examples: DataFrame, text: str, window: int) -> DataFrame:
    """The words of each example segment, cut from the documents that hold them."""
    wanted = examples.groupBy(*KEY).agg(F.collect_list(F.struct(
        "anchor", "segment", "n", "place", "mixed")).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            rows = batch.column("wanted").to_pylist()
            if not any(rows):
                continue
            got = cut_words(batch.column(text), SPACES, False)
            joined, at = got.joined()
            out = [(r["anchor"], r["segment"], r["n"], r["mixed"],
                    joined[at[b + r["place"] // 64] : at[b + r["place"] // 64 + r["place"] % 64 + window - 1] - 1].decode("utf-8", "replace"))
                   for b, found in zip(got.bounds[:-1].tolist(), rows, strict=True) for r in found or ()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["anchor", "segment", "n", "mixed", "words"])

    # a repeated row gives the same example again; located rows are made distinct later
    # all columns pass through, so that this and the last step share one exchange of the documents
    return docs.join(wanted, KEY).mapInArrow(
        fetch, "anchor bigint, segment bigint, n bigint, mixed boolean, words string")


def _shard(window: int, shard_segments: int):
    """Compiles the confirmed passages of a run of segments and streams the segments through them.

    Takes (anchor, segment, n, mask, words) sorted by anchor. mask has a bit for each confirmed
    window of the segment; null: compare the windows of the anchor here.
    Gives for each segment a bit for each covered word.
    """

    def located(rows: list[tuple]) -> list[tuple[int, int, int]]:
        symbols: dict[str, str] = {}
        lines = []
        for _, _, _, _, words in rows:
            for w in words.split(" "):
                if w not in symbols:
                    symbols[w] = chr(len(symbols) + 1)
            lines.append("".join([symbols[w] for w in words.split(" ")]))
        seen: Counter = Counter()
        for (anchor, _, n, mask, _), line in zip(rows, lines, strict=True):
            if mask is None:
                for i in range(len(line) - window + 1):
                    seen[(anchor, line[i : i + window])] += n
        automaton = ahocorasick.Automaton()
        for (anchor, _, _, mask, _), line in zip(rows, lines, strict=True):
            start = -1
            for i in range(len(line) - window + 2):  # a passage is a run of confirmed windows
                sure = i <= len(line) - window and (
                    seen[(anchor, line[i : i + window])] > 1 if mask is None else mask >> i & 1)
                if sure and start < 0:
                    start = i
                elif not sure and start >= 0:
                    passage = line[start : i + window - 1]
                    automaton.add_word(passage, len(passage))
                    start = -1
        if not len(automaton):
            return []
        automaton.make_automaton()
        out = []
        for (anchor, segment, _, _, _), line in zip(rows, lines, strict=True):
            cover = 0
            for end, length in automaton.iter(line):
                cover |= ((1 << length) - 1) << (end + 1 - length)
            if cover:
                out.append((anchor, segment, cover))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "segment", "n", "mask", "words"]

        def result(rows: list[tuple]) -> pa.RecordBatch:
            found = located(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["anchor", "segment", "cover"])

        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if len(rows) >= shard_segments and (row[0] != rows[-1][0] or row[3] is not None):
                    yield result(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield result(rows)

    return run


def find_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, phrase: int = PHRASE,
                 max_group: int = MAX_GROUP, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """Adds to each row of docs its repeated words: n_words, n_removed, kept (words joined by one space).

    A word is repeated if it lies in a window of ``window`` words whose sequence also starts
    anywhere else, in the same text or another. ``window`` is at most 35, so that a segment's words
    fit the bits of a long.

    Null or empty texts have no words and kept ''. Texts shorter than a window repeat nothing.
    Repeated rows are copies of each other and lose their windows like any other copy. Ids and other
    columns may be null; input columns named like the new ones are replaced. An empty table gives no rows.
    """
    if not phrase < window <= 35 or 2 * window - phrase > 63:
        raise ValueError("phrase < window <= 35 and 2 * window - phrase <= 63")
    docs = docs.drop("n_words", "n_removed", "kept", "found", "wanted", *KEY)
    keyed = docs.select("*", *row_key(*(c for c, t in docs.dtypes if "map<" not in t)))
    slim = keyed.select(*KEY, text)
    found = _anchors(slim, text, window, phrase)
    recurring = found.groupBy("anchor").count().where("count > 1").select("anchor")
    places = written(found.join(recurring, "anchor"), "repeats-places")
    # first() of one row each: any occurrence will do as the example
    groups = places.groupBy("anchor", "segment").agg(
        F.count("*").alias("n"), *(F.first(c).alias(c) for c in (*KEY, "place")))
    sizes = groups.groupBy("anchor").agg(F.count("*").alias("size"))
    examples = written(groups.join(sizes, "anchor").select(
        "anchor", "segment", "n", *KEY, "place", (F.col("size") > max_group).alias("mixed")), "repeats-examples")
    located = _texts(keyed, examples.where(~F.col("mixed")), text, window).withColumn("mask", F.lit(None).cast("long"))
    if not examples.where("mixed").isEmpty():
        many = _texts(keyed, examples.where("mixed"), text, window)
        located = located.unionByName(many.join(_masks(many, window), ["anchor", "segment"], "left").withColumn(
            "mask", F.coalesce("mask", F.lit(0))))
    located = located.select("anchor", "segment", "n", "mask", "words").repartition(
        "anchor", F.when(F.col("mask").isNotNull(), F.col("segment")).otherwise(0))
    located = located.sortWithinPartitions(F.col("mask").isNotNull(), "anchor").mapInArrow(
        _shard(window, shard_segments), "anchor bigint, segment bigint, cover bigint")
    located = located.dropDuplicates(["anchor", "segment"])
    hits = places.join(located, ["anchor", "segment"]).groupBy(*KEY).agg(
        F.collect_set(F.struct("place", "cover")).alias("found"))
    return _cut(keyed.join(hits, KEY, "left").drop(*KEY), text)


def _masks(segments: DataFrame, window: int) -> DataFrame:
    """For segments of anchors too large for a task: a bit for each window that recurs."""
    words = F.split("words", " ")
    each = segments.select("anchor", "segment", "n", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.size(words) - window),
        lambda i: F.array_join(F.slice(words, i + 1, window), " "))).alias("at", "window"))
    each = each.withColumns({"w1": F.xxhash64(F.lit(1), "window"), "w2": F.xxhash64(F.lit(2), "window")}).drop("window")
    sure = each.groupBy("anchor", "w1", "w2").agg(F.sum("n").alias("times")).where("times > 1").drop("times")
    return each.join(sure, ["anchor", "w1", "w2"]).groupBy("anchor", "segment").agg(
        F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"))


def _cut(joined: DataFrame, text: str) -> DataFrame:
    carried = [c for c in joined.columns if c != "found"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            got = cut_words(batch.column(text), SPACES, False)
            joined, at = got.joined()
            gone = np.zeros(len(got.starts), bool)
            for b, found in zip(got.bounds[:-1].tolist(), batch.column("found").to_pylist(), strict=True):
                for r in found or ():
                    bits = np.flatnonzero(np.unpackbits(np.frombuffer(np.int64(r["cover"]).tobytes(), np.uint8), bitorder="little"))
                    gone[b + r["place"] // 64 + bits] = True
            removed, kept = [], []
            for b, e in zip(got.bounds[:-1].tolist(), got.bounds[1:].tolist(), strict=True):
                lost = gone[b:e]
                removed.append(int(lost.sum()))
                if not removed[-1]:
                    kept.append(joined[at[b] : max(at[b], at[e] - 1)])
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[0], (~lost).astype(np.int8), [0]])))
                kept.append(b" ".join([joined[at[b + i] : at[b + j] - 1] for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), pa.array(np.diff(got.bounds)), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], [*carried, "n_words", "n_removed", "kept"])

    kinds = dict(joined.dtypes)
    return joined.mapInArrow(cut, ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), "n_words bigint, n_removed bigint, kept string"]))


def digest(found: DataFrame) -> DataFrame:
    """The columns that the query returns."""
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


