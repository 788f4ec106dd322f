"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Benchmark texts become windows of ten words. A table of their hashes goes to every task, which
scans the word windows of whole training texts, compares the words of each hash hit, and marks
the words inside an occurrence. Marked spans or whole documents are then removed.

The windows are counted first. Up to ``max_broadcast`` go out as one set; more go out in blocks
of that size, one pass over the documents for each, and the hits of all passes are united, so
that no task ever holds more than one block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmark.llm.common import Words, alnum_class, cut_words, run_hashes, slices, written

WINDOW = 10
MAX_BROADCAST = 2_000_000
ALNUM = alnum_class()
_BITS = 22


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", words: int = WINDOW) -> DataFrame:
    """Distinct (item, window, n_words); an item of fewer words is one window, null or empty none."""
    lowered = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    cut = benchmark.select(F.col(item).cast("string").alias("item"), parts.alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.size("w") - words)
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("w", i + 1, words), " "))
    return (cut.select("item", F.explode(runs).alias("window"), F.least(F.size("w"), F.lit(words)).alias("n_words"))
            .distinct())


class _Set:
    """Windows by length: a bit table to pass over most words, sorted hashes, and the words themselves."""

    def __init__(self, rows: list[tuple[str | None, str, int]]):
        items: dict[str, list] = defaultdict(list)
        for item, window, _ in rows:
            items[window].append(item)
        self.items = {w.encode(): tuple(v) for w, v in items.items()}
        by_length: dict[int, list[bytes]] = defaultdict(list)
        for window in self.items:
            by_length[window.count(b" ") + 1].append(window)
        self.by_length = {}
        for n, found in by_length.items():
            got = cut_words(pa.array(found, pa.binary()), ALNUM, False)
            h = run_hashes(got.hashes(), n)[got.bounds[:-1]]
            bits = np.zeros(1 << _BITS, bool)
            bits[h >> np.uint64(64 - _BITS)] = True
            self.by_length[n] = (bits, np.unique(h))

    def hits(self, got: Words) -> tuple[np.ndarray, dict[int, set]]:
        """Marked words, and the items found in each text."""
        marked = np.zeros(len(got.starts) + 1, np.int32)
        found: dict[int, set] = defaultdict(set)
        h = got.hashes()
        for n, (bits, sorted_hashes) in self.by_length.items():
            runs = run_hashes(h, n)
            at = np.flatnonzero(bits[runs >> np.uint64(64 - _BITS)])
            place = np.minimum(np.searchsorted(sorted_hashes, runs[at]), len(sorted_hashes) - 1)
            at = at[sorted_hashes[place] == runs[at]]
            doc = np.searchsorted(got.bounds, at, "right") - 1
            inside = at + n <= got.bounds[doc + 1]
            for i, d in zip(at[inside].tolist(), doc[inside].tolist(), strict=True):
                window = b" ".join(got.data[got.starts[j] : got.ends[j]].tobytes() for j in range(i, i + n))
                if window in self.items:
                    marked[i] += 1
                    marked[i + n] -= 1
                    found[d].update(self.items[window])
        return np.cumsum(marked)[:-1] > 0, found


def _spans(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                       item_text: str = "text", words: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Adds to every row of docs what of the benchmark occurs in its text.

    New columns: n_words, n_hit (words inside an occurrence), items (sorted distinct item ids as
    strings), hit_spans (byte from and to in the UTF-8 text). All rows and columns of docs stay, but
    input columns named like the new ones are replaced.

    Null or empty texts have no words and no hits. Null item texts are no windows; an item whose id
    is null marks words and counts as item ''. Repeated rows are judged alike; empty tables give
    no rows, or no hits.
    """
    docs = docs.drop(*NEW)
    sets = windows(benchmark, item, item_text, words).withColumn("item", F.coalesce("item", F.lit("")))
    blocks = max(1, -(-sets.count() // max_broadcast))
    if blocks == 1:
        return _scan(docs, sets.collect(), text)
    for b in range(blocks):
        block = sets.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b).collect()
        docs = written(_scan(docs, block, text), "decontamination")
    return docs


NEW = ["n_words", "n_hit", "items", "hit_spans"]
_SPAN_TYPE = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
_SCHEMA = "n_words bigint, n_hit bigint, items array<string>, hit_spans array<struct<`from`: bigint, `to`: bigint>>"


def _scan(docs: DataFrame, rows: list, text: str) -> DataFrame:
    """One pass with one block of windows; adds to what an earlier pass has found."""
    known = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])
    later, carried = "hit_spans" in docs.columns, [c for c in docs.columns if c not in NEW]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _Set(known.value)
        for batch in slices(batches, text):
            got = cut_words(batch.column(text), ALNUM, True)
            sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(sizes)])
            mask, found = wanted.hits(got)
            earlier = batch.select(["items", "hit_spans"]).to_pylist() if later else []
            for d, row in enumerate(earlier):
                lo, hi = got.bounds[d], got.bounds[d + 1]
                for s in row["hit_spans"]:
                    mask[lo:hi] |= ((got.starts[lo:hi] >= first[d] + s["from"]) & (got.ends[lo:hi] <= first[d] + s["to"]))
                    found[d].update(row["items"])
            n_hit, items, spans = [0] * batch.num_rows, [[]] * batch.num_rows, [[]] * batch.num_rows
            for d in found:
                lo, hi = int(got.bounds[d]), int(got.bounds[d + 1])
                n_hit[d], items[d] = int(mask[lo:hi].sum()), sorted(found[d])
                spans[d] = [{"from": int(got.starts[lo + i] - first[d]), "to": int(got.ends[lo + j - 1] - first[d])}
                            for i, j in _spans(mask[lo:hi])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), pa.array(np.diff(got.bounds)), pa.array(n_hit, pa.int64()),
                 pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPAN_TYPE)], [*carried, *NEW])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(scan, ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), _SCHEMA]))


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", drop_share: float = 1.0) -> DataFrame:
    """docs without the benchmark's passages; same columns.

    Hit spans are cut out. A document goes as a whole if at least ``drop_share`` of its words are
    hit (1.0: only if nothing but hits is left). Documents without a hit stay as they are, byte by byte.
    """
    names, place = docs.columns, docs.columns.index(text)
    docs = docs.toDF(*(f"c{i}" for i in range(len(names))))  # no name can clash with a new one
    text = f"c{place}"
    found = find_contamination(docs, benchmark, text)
    kept = found.where((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words") * F.lit(drop_share)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text)
            out = []
            for t, spans in zip(batch.column(text).to_pylist(), batch.column("hit_spans").to_pylist(), strict=True):
                if spans:
                    raw, at, parts = t.encode(), 0, []
                    for s in spans:
                        parts.append(raw[at : s["from"]])
                        at = s["to"]
                    t = b"".join([*parts, raw[at:]]).decode()
                out.append(t)
            columns = list(batch.columns)
            columns[place] = pa.array(out, pa.string())
            keep = [i for i, c in enumerate(batch.schema.names) if c != "hit_spans"]
            yield pa.RecordBatch.from_arrays([columns[i] for i in keep], [batch.schema.names[i] for i in keep])

    slim = kept.select(*docs.columns, "hit_spans")
    return slim.mapInArrow(cut, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)).toDF(*names)


def digest(found: DataFrame) -> DataFrame:
    """The columns that the query returns."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))

