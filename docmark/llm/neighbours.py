"""Approximate nearest neighbours by collision counting on sorted projections.

Vectors are dealt into blocks of bounded size. In a block, every one of ``projections`` random lines has
its own array of the vectors in the order of their projections. A query opens a window around its own
projection on each line and widens all windows step by step (virtual rehashing: a wider window is a
coarser hash table, without building one). A vector inside the windows of ``threshold`` lines is
verified: its inner product is computed on the original vectors in double precision. A query stops
widening once its k-th best is nearer than the windows' reach.

Only the k best of all blocks count, so a query first goes to one block alone and widens there until it
has k neighbours. All other blocks then know its k-th best: they open the windows that a better vector
must collide in, no wider, and give only what is as good. Queries go to the blocks in groups, so no task
holds more than a block and a batch of queries. Windows
are scaled by the lengths of query and candidate, so vectors of any length can be searched: the lines
are drawn through vectors of unit length with one more component that makes the inner product a distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmark.llm.common import written

K = 20
PROJECTIONS = 64
#: Half widths of the windows, in units of the longest vector of the block.
WIDTHS = (0.25, 0.5, 1.0, 1.125, 1.25, 1.5, 2.0)
#: A query may stop when its windows reach this share of the k-th best's distance.
REACH = 0.87
#: Width of the windows where the k-th best is known, as a share of its distance.
KNOWN_REACH = 0.83
#: Lines of 64 on which a vector must collide.
THRESHOLD = 34
BLOCK = 8192
SEED = 7


class Block:
    """Sorted projections of at most a few thousand vectors of one dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order])
        self.norms = np.sqrt((self.vectors**2).sum(axis=1))
        self.longest = float(self.norms.max())
        rng = np.random.default_rng(SEED)
        self.lines = rng.standard_normal((projections, vectors.shape[1] + 1))
        scaled = self.vectors / self.longest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(axis=1)))
        places = self.lines[:, :-1] @ scaled.T + self.lines[:, -1:] * rest
        self.order = np.argsort(places, axis=1)
        self.places = np.take_along_axis(places, self.order, axis=1)

    def nearest(self, own: int, query: np.ndarray, k: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k that collide, without the query's own id."""
        n, length = len(self.ids), float(np.sqrt((query**2).sum()))
        centre = self.lines[:, :-1] @ (query / length)
        counts = np.zeros(n, np.int32)
        tested = self.ids == own
        want = min(k, n - int(tested.sum()))
        lo = hi = np.array([np.searchsorted(p, c) for p, c in zip(self.places, centre, strict=True)])
        best_at, best = np.zeros(0, np.int64), np.zeros(0)
        for step, width in enumerate(WIDTHS):
            new_lo = np.array([np.searchsorted(p, c - width) for p, c in zip(self.places, centre, strict=True)])
            new_hi = np.array([np.searchsorted(p, c + width, "right") for p, c in zip(self.places, centre, strict=True)])
            ring = [o[a:b] for o, a, b in zip(self.order, new_lo, lo, strict=True) if a < b]
            ring += [o[a:b] for o, a, b in zip(self.order, hi, new_hi, strict=True) if a < b]
            lo, hi = new_lo, new_hi
            if ring:
                counts += np.bincount(np.concatenate(ring), minlength=n).astype(np.int32)
            found = np.flatnonzero((counts >= threshold) & ~tested)
            if len(found):
                tested[found] = True
                best_at = np.concatenate([best_at, found])
                best = np.concatenate([best, (self.vectors[found] * query).sum(axis=1)])
                keep = np.lexsort((self.ids[best_at], -best))[:k]
                best_at, best = best_at[keep], best[keep]
            if len(best) >= want:
                # squared distance of the k-th best on the unit sphere that the lines are drawn through
                far = 2 - 2 * best[want - 1] / (length * self.longest) if want else 0.0
                if width >= REACH * np.sqrt(max(far, 0.0)):
                    break
            if step == len(WIDTHS) - 2:  # last: windows over whole lines, so that every vector is verified
                threshold = 0
        return self.ids[best_at], best


    def as_good(self, own: np.ndarray, queries: np.ndarray, bounds: np.ndarray, threshold: int) -> Iterator[tuple]:
        """Of each query the ids and scores that collide and reach its bound, and how many were verified."""
        lengths = np.sqrt((queries**2).sum(axis=1))
        far = np.sqrt(np.clip(2 - 2 * bounds / (lengths * self.longest), 0.0, 4.0))
        centres, widths = self.lines[:, :-1] @ (queries / lengths[:, None]).T, KNOWN_REACH * far
        lo = np.array([np.searchsorted(p, c - widths) for p, c in zip(self.places, centres, strict=True)])
        hi = np.array([np.searchsorted(p, c + widths, "right") for p, c in zip(self.places, centres, strict=True)])
        n, most = len(self.ids), len(self.lines)
        for q in range(len(own)):
            spans = list(zip(self.order, lo[:, q].tolist(), hi[:, q].tolist(), strict=True))
            if 2 * int((hi[:, q] - lo[:, q]).sum()) <= n * most:
                counts = np.bincount(np.concatenate([o[a:b] for o, a, b in spans]), minlength=n)
            else:  # fewer lie outside the windows
                outside = np.concatenate([x for o, a, b in spans for x in (o[:a], o[b:])])
                counts = most - np.bincount(outside, minlength=n)
            hit = np.flatnonzero(counts >= threshold)
            hit = hit[self.ids[hit] != own[q]]
            scores = (self.vectors[hit] * queries[q]).sum(axis=1)
            good = scores >= bounds[q]
            yield self.ids[hit[good]], scores[good], len(hit)


_PAIRS = "query_id bigint, vec_id bigint, score double"


def _search(k: int, projections: int, threshold: int):
    """Answers queries (``asks``) by the vectors of their block, which come before them."""

    def answer(block: Block, rows: list[tuple]) -> Iterator[tuple]:
        first = [(i, v) for i, v, bound in rows if bound is None]
        for i, v in first:
            yield i, *block.nearest(i, v, k, threshold)
        known = [r for r in rows if r[2] is not None]
        if known:
            own, bounds = np.array([r[0] for r in known]), np.array([r[2] for r in known])
            for i, (found, scores, _) in zip(own, block.as_good(own, np.array([r[1] for r in known]), bounds, threshold), strict=True):
                best = np.lexsort((found, -scores))[:k]
                yield i, found[best], scores[best]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, block = None, [], [], None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("dim", "block", "share", "asks", "id", "bound")]
            out, waiting = [], []
            for dim, number, share, asks, vec_id, bound, vector in zip(*columns, batch.column("vector"), strict=True):
                if (dim, number, share) != key:
                    out += answer(block, waiting) if block is not None else []
                    key, ids, vectors, block, waiting = (dim, number, share), [], [], None, []
                values = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not asks:
                    ids.append(vec_id)
                    vectors.append(values)
                    continue
                if block is None and ids:
                    block = Block(np.array(ids), np.array(vectors), projections)
                waiting.append((vec_id, values, bound))
            out += answer(block, waiting) if block is not None else []
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([np.full(len(f), i) for i, f, _ in out]).astype(np.int64)),
                     pa.array(np.concatenate([f for _, f, _ in out]).astype(np.int64)),
                     pa.array(np.concatenate([x for _, _, x in out]).astype(np.float64))], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K,
           projections: int = PROJECTIONS, threshold: int = THRESHOLD, block_rows: int = BLOCK,
           query_share: int = 1024) -> DataFrame:
    """For each query its nearest vectors by inner product: query_id, rank, vec_id, score.

    Both frames have an integer id and an array of numbers. Vectors that are null, empty, zero, or hold
    null or non-finite components take no part; vectors of different dimensions do not meet. A query
    never finds its own id. Ties go to the smaller id; fewer than k candidates are all given.

    Rows that repeat an id count once, with the smallest of its vectors; rows without an id take no part. Other
    columns are not looked at. An empty table gives no rows.
    """
    def clean(df: DataFrame) -> DataFrame:
        v = F.col("vector")
        rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0))
        return rows.groupBy("id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))

    data, asked = clean(vectors), clean(queries)
    blocks = max(1, -(-vectors.count() // block_rows))
    total = queries.count()
    number = lambda i: F.explode(F.sequence(F.lit(0), F.lit(i - 1)))
    spread = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).cast("int")
    data = data.withColumns({
        "block": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), "asks": F.lit(False), "bound": F.lit(None).cast("double")})
    asked = asked.withColumn("asks", F.lit(True))

    def answers(asking: DataFrame, shares: int) -> DataFrame:
        both = data.withColumn("share", number(shares)).unionByName(asking.withColumn("share", spread(1, shares)))
        dealt = both.repartition(blocks * shares, "dim", "block", "share").sortWithinPartitions("dim", "block", "share", "asks")
        columns = dealt.select("dim", "block", "share", "asks", "id", "bound", "vector")
        return columns.mapInArrow(_search(k, projections, threshold), _PAIRS)

    none = F.lit(None).cast("double")
    found = answers(asked.withColumns({"block": spread(2, blocks), "bound": none}), max(1, -(-total // (blocks * query_share))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if blocks > 1:
        found = written(found, "neighbours")
        # the k-th best so far; a query with fewer takes whatever there is
        bounds = found.groupBy(F.col("query_id").alias("id")).agg(
            F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(-1e300)).alias("bound"))
        later = asked.join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(-1e300)))
        later = later.withColumn("home", spread(2, blocks)).withColumn("block", number(blocks)).where("block <> home").drop("home")
        found = found.unionByName(answers(later, max(1, -(-total // query_share))))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
