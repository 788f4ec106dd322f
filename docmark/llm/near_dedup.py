"""Near-duplicate groups by a chosen-path set similarity join.

Texts become sets of word shingles; equal sets become one class. Every class has a signature of
minwise tokens. In each of several independent trees a class starts in the node named by a few of
its tokens; a node with more than ``node_limit`` classes branches by further tokens, chosen by a
hash of the node's path, sometimes by two so that similar pairs survive deep trees. Small nodes
are compared exhaustively: signatures propose pairs, nodes that propose the same pairs are one, and the
full shingle sets confirm them. A pair that the node's confirmed links already connect needs no
comparison, so a node gives fewer links than it has members, whatever its number of pairs.

With the defaults, a pair at the threshold that meets no large node misses all trees with a chance below 1e-6
(0.85) or 2e-5 (0.8). Branching alone does not hold that chance, as a pair is lost on the way down. So the links
that the trees did not find between classes of large nodes are found by rare shingles: these have one order, rare
ones first, and of two sets of the wanted similarity the larger has one of its first shingles (:func:`prefix_lengths`)
among the still fewer first ones of the smaller. Nodes of such a shingle matter only while they hold classes that no
links connect yet and one set that has the shingle among the fewer, so that large groups of copies, which the trees
connect, and pages that agree in their template only need no comparison. If a node that matters is too large, shingles that
occur together are one group, in which shingles are counted and ordered anew. What is too large even then is
compared in blocks: the rows that every such pair has one of at least, with all.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmark.llm.common import KEY, cut_words, mix, release, row_key, run_hashes, slices, space_class, span_hashes, written

TOKENS = 96
TREES = 16
ROOT_TOKENS = 3
NODE_LIMIT = 1024
MAX_DEPTH = 8
#: Levels of nodes that are named and counted at once.
LEVELS = 4
#: Bits that tell whether a text is wanted, before texts are sent to their nodes.
BITS = 1 << 25
#: Cells in which shingles are counted to order them; equal counts are ordered by the shingle.
CELLS = 1 << 20
#: Rows of a scratch table that are worth a file of their own.
FILE_ROWS = 1 << 16
#: Members of a node that are compared with one at once.
AT_ONCE = 64
SPACES = space_class()


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; a text of fewer words is one shingle."""
    got = cut_words(texts, SPACES, True)
    h = got.hashes()
    runs = run_hashes(h, words)
    out = []
    for b, e in zip(got.bounds[:-1].tolist(), got.bounds[1:].tolist(), strict=True):
        if e - b >= words:
            out.append(np.unique(runs[b : e - words + 1]))
        else:
            out.append(span_hashes(h, np.array([b]), np.array([e - b])) if e > b else np.zeros(0, np.uint64))
    return out


def _coefficients(tokens: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * tokens + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:tokens], seeds[tokens:] | np.uint64(1)


def _signatures(sets: list[np.ndarray], tokens: int) -> np.ndarray:
    """Minwise tokens, one row for each set; sets are not empty."""
    joined = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), tokens), np.uint32)
    for i, (x, a) in enumerate(zip(*_coefficients(tokens), strict=True)):
        out[:, i] = np.minimum.reduceat(((joined ^ x) * a) >> np.uint64(32), starts)
    return out


def _sets(docs: DataFrame, text: str, words: int, kind: str) -> DataFrame:
    """For each row its id, key, number of shingles, digest of the set, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            sets = shingle_sets(batch.column(text), words)
            full = [i for i, s in enumerate(sets) if len(s)]
            signature: list = [None] * len(sets)
            if full:
                for i, s in zip(full, _signatures([sets[i] for i in full], TOKENS), strict=True):
                    signature[i] = s.astype("<u4").tobytes()
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(batch.column(k) for k in KEY), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(digest, pa.binary()), pa.array(signature, pa.binary())], ["id", *KEY, "n", "class", "signature"])

    return docs.mapInArrow(run, f"id {kind}, __k1 bigint, __k2 bigint, n bigint, class binary, signature binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), -1)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree: the node where the class starts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = _matrix(batch.column("signature")).astype(np.uint64)
        nodes = []
        for t in range(TREES):
            node = np.full(len(sig), t + 1, np.uint64)
            for k in range(ROOT_TOKENS):
                node = mix(node * np.uint64(0x9E3779B97F4A7C15) + sig[:, (t * ROOT_TOKENS + k) % TOKENS])
            nodes.append(node.view(np.int64))
        classes = pa.concat_arrays([batch.column("class")] * TREES)
        yield pa.RecordBatch.from_arrays([classes, pa.array(np.concatenate(nodes))], ["class", "node"])


def _below(similarity: float, levels: int):
    """The nodes of some levels below: by one token, or by two so often that 1 / similarity is the mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _matrix(batch.column("signature")).astype(np.uint64)
            own, node = np.arange(len(sig)), batch.column("node").to_numpy().view(np.uint64)
            for level in range(1, levels + 1):
                which, at = mix(node + np.uint64(1)), np.arange(len(node))
                token = (which % np.uint64(TOKENS)).astype(np.int64)
                twice = np.flatnonzero((which >> np.uint64(40)) % np.uint64(1000) < int(1000 * (1 / similarity - 1)))
                rows = np.concatenate([at, twice])
                token = np.concatenate([token, (token[twice] + 1 + (which[twice] >> np.uint64(20)).astype(np.int64) % (TOKENS - 1)) % TOKENS])
                own, parent = own[rows], node[rows]
                node = mix(mix(parent + token.astype(np.uint64)) + sig[own, token])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("class").take(pa.array(own)), pa.array(parent.view(np.int64)), pa.array(node.view(np.int64)),
                     pa.array(np.full(len(node), level, np.int32))], ["class", "parent", "node", "level"])

    return run


def _few(df: DataFrame, rows: int | None) -> DataFrame:
    """df for a table of about so many rows, without texts: a small one is not written in many files, which take longer than its rows."""
    return df if rows is None else df.coalesce(max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))


def _leaves(classes: DataFrame, similarity: float, node_limit: int, max_depth: int, rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(class, node) of all nodes small enough to be compared, with two members or more; and the classes of large nodes.

    Nodes of ``LEVELS`` levels are named at once. One is in the tree if the node above it is large; those below it have
    no other members, so that then all above are large. A level has about ``rows`` rows.
    """
    roots = classes.select("class", "signature").mapInArrow(_roots, "class binary, node bigint")
    members = written(_few(roots.join(roots.groupBy("node").count().where("count > 1"), "node"), rows), "near-nodes")
    out = members.where(F.col("count") <= node_limit).select("class", "node")
    large = members.where(F.col("count") > node_limit)
    if large.isEmpty():
        return out, None
    hot = classes.join(large.select("class").distinct(), "class", "left_semi").select("class", *KEY, "signature")
    hot = written(_few(hot, rows), "near-hot")
    for depth in range(0, max_depth, LEVELS):
        levels = min(LEVELS, max_depth - depth)
        below = large.select("class", "node").join(hot.select("class", "signature"), "class").mapInArrow(
            _below(similarity, levels), "class binary, parent bigint, node bigint, level int")
        sizes = below.groupBy("node").agg(F.count("*").alias("count"), F.min("parent").alias("parent"), F.min("level").alias("level"))
        sizes = written(_few(sizes.where("count > 1"), rows), "near-sizes")
        branching = sizes.where(F.col("count") > node_limit).select(F.col("node").alias("parent"), F.lit(True).alias("branches"))
        sizes = sizes.join(branching, "parent", "left").where("level = 1 OR branches")
        sizes = sizes.where((F.col("count") <= node_limit) | (F.col("level") == levels)).select("node", "count")
        members = written(_few(below.select("class", "node").join(sizes, "node"), rows), "near-nodes")
        out = out.unionByName(members.where(F.col("count") <= node_limit).select("class", "node"))
        large = members.where(F.col("count") > node_limit)
        if depth + levels < max_depth and large.isEmpty():
            break
    return out, hot.drop("signature")


def _met(texts: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of texts whose key keys has, and few others: what is joined afterwards need not be sent whole.

    Hashes of the keys set bits; the words of bits are broadcast, ``BITS`` / 64 at most.
    """
    bit = F.pmod(F.xxhash64(*on), F.lit(BITS))
    bits = keys.select(bit.alias("__bit")).groupBy(F.shiftright("__bit", 6).alias("__word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(__bit & 63 AS INT))")).alias("__bits"))
    marked = texts.withColumn("__bit", bit).withColumn("__word", F.shiftright("__bit", 6))
    return marked.join(F.broadcast(bits), "__word").where(
        "shiftright(__bits, CAST(__bit & 63 AS INT)) & 1 = 1").select(*texts.columns)


def _cell_counts(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in slices(batches, "text"):
            for s in shingle_sets(batch.column("text"), words):
                np.add.at(counts, (s % np.uint64(CELLS)).astype(np.int64), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["cell", "count"])

    return run


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """How many first shingles a set needs to meet smaller sets, and how many to be met by sets of its size or more."""
    return n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1


def prefix(shingles: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles in order of their cells' counts, one of which every set of the wanted similarity has too."""
    first, _ = prefix_lengths(len(shingles), percent)
    return shingles[np.lexsort((shingles, counts[(shingles % np.uint64(CELLS)).astype(np.int64)]))[:first]]


def _open_nodes(tokens: DataFrame, node_limit: int, rows: int | None) -> tuple[DataFrame, DataFrame]:
    """The rows of nodes that can still hold a link between two roots: those of small nodes and those of large ones."""
    sizes = tokens.groupBy("node").agg(
        F.count("*").alias("count"), F.count_if("short").alias("shorts"), F.min("root").alias("first"), F.max("root").alias("last"))
    sizes = sizes.where("shorts > 0 AND first < last").drop("first", "last")
    members = written(_few(tokens.join(sizes, "node"), rows), "near-prefixes")
    return members.where(F.col("count") <= node_limit), members.where(F.col("count") > node_limit)


def _blocks(large: DataFrame, node_limit: int) -> DataFrame:
    """Nodes in which the chosen rows of each large node meet all its rows.

    Chosen are the rows with the shingle among their fewer first ones, or those outside the node's largest root,
    whichever are fewer: every pair that can be a link has one of them.
    """
    roots = large.groupBy("node", "root").count()
    main = roots.groupBy("node").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.max("count").alias("inside"))
    by_short = F.col("shorts") <= F.col("count") - F.col("inside")
    few = F.when(by_short, F.col("shorts")).otherwise(F.col("count") - F.col("inside"))
    half = max(node_limit // 2, 1)
    placed = large.join(main, "node").select(
        "class", "root", "short", "node", F.when(by_short, F.col("short")).otherwise(F.col("root") != F.col("main")).alias("chosen"),
        F.ceil(few / half).alias("own"), F.ceil((F.col("count") - few) / half).alias("others"))
    block = F.pmod(F.xxhash64("class"), F.when(F.col("chosen"), F.col("own")).otherwise(F.col("others")))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)).otherwise(
        F.array().cast("array<bigint>"))
    among = F.transform(upto("own"), lambda k: F.xxhash64("node", F.lit("own"), F.least("block", k), F.greatest("block", k)))
    across = F.transform(upto("others"), lambda k: F.xxhash64("node", F.lit("all"), "block", k))
    met = F.transform(upto("own"), lambda k: F.xxhash64("node", F.lit("all"), k, "block"))
    return placed.withColumn("block", block).select(
        "class", "root", "short", F.explode(F.when(F.col("chosen"), F.concat(among, across)).otherwise(met)).alias("node"))


def _every_shingle(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), words)
            owner = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(owner) for c in ("class", "root", "group")), pa.array(mix(np.concatenate(sets)).view(np.int64)),
                 pa.array(np.repeat([len(s) for s in sets], [len(s) for s in sets]))], ["class", "root", "group", "token", "n"])

    return run


def _exact_leaves(texts: DataFrame, words: int, percent: int, node_limit: int, rows: int | None = None) -> DataFrame:
    """(class, root, short, node) so that every two of these classes with the wanted similarity and other roots share a node.

    Classes with one root are linked already; without a column root every class is its own. First shingles are about ``rows``.
    """
    if "root" not in texts.columns:
        texts = texts.withColumn("root", F.col("class"))
    cells = texts.mapInArrow(_cell_counts(words), "cell bigint, count bigint").groupBy("cell").agg(F.sum("count").alias("count")).toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[cells.column("cell").to_numpy()] = cells.column("count").to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), words)
            firsts = [prefix(s, shared.value, percent) for s in sets]
            short = [np.arange(len(f)) < prefix_lengths(len(s), percent)[1] for s, f in zip(sets, firsts, strict=True)]
            owner = pa.array(np.repeat(np.arange(len(firsts)), [len(f) for f in firsts]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("class").take(owner), batch.column("root").take(owner), pa.array(np.concatenate(short)),
                 pa.array(mix(np.concatenate(firsts)).view(np.int64))], ["class", "root", "short", "node"])

    # repeats of a text give the same rows
    tokens = texts.mapInArrow(run, "class binary, root binary, short boolean, node bigint").distinct()
    small, large = _open_nodes(tokens, node_limit, rows)
    columns = ["class", "root", "short", "node"]
    many = large.count()
    if not many:
        return small.select(*columns)
    # shingles that occur in the same class are one group, so that a class is in one group only
    as_key = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    least = large.groupBy("class").agg(F.min("node").alias("least"))
    groups = components(large.join(least, "class").select(as_key("least").alias("a"), as_key("node").alias("b")).distinct(), many)
    grouped = large.select("class", as_key("node").alias("token")).join(
        groups.select(F.col("node").alias("token"), F.col("root").alias("group")), "token").select("class", "group").distinct()
    shingles = written(texts.join(grouped, "class").mapInArrow(
        _every_shingle(words), "class binary, root binary, group binary, token bigint, n bigint").distinct(), "near-shingles")
    often = shingles.groupBy("group", "token").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("class").orderBy("often", "token"))
    first = F.expr(f"n - (n * {percent} + 99) DIV 100 + 1")
    fewer = F.expr(f"n - (2 * {percent} * n + {99 + percent}) DIV {100 + percent} + 1")
    tokens = shingles.join(often, ["group", "token"]).withColumn("place", place).where((F.col("place") <= first) & (F.col("often") > 1))
    within, large = _open_nodes(tokens.select(
        "class", "root", (F.col("place") <= fewer).alias("short"), F.xxhash64("group", "token").alias("node")), node_limit, rows)
    return small.select(*columns).unionByName(within.select(*columns)).unionByName(_blocks(large, node_limit))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
    """The rows of each node, from batches sorted by node; a node is a bounded group."""
    rows: list[dict] = []
    for row in chain.from_iterable(b.slice(i, 256).to_pylist() for b in batches for i in range(0, b.num_rows, 256)):
        if rows and row["node"] != rows[0]["node"]:
            yield rows[0]["node"], rows
            rows = []
        rows.append(row)
    if rows:
        yield rows[0]["node"], rows
    release()


class _Node:
    """The members of a node and which of their pairs the sketches propose."""

    def __init__(self, rows: list[dict], percent: int, least: float):
        self.classes = [r["class"] for r in rows]
        # a row for each token: equal tokens are counted for all members at once
        self.sketch = np.ascontiguousarray(np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint8).reshape(len(rows), -1).T)
        self.roots = np.unique([r["root"].hex() for r in rows], return_inverse=True)[1]
        self.short = np.array([r["short"] for r in rows])
        self.n = np.array([r["n"] for r in rows], np.int64)
        self.percent, self.least = percent, least

    def partners(self, i: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Members from first on of other roots that may be linked with i, and their shares of equal tokens."""
        rest = slice(first, None)
        might = (self.roots[rest] != self.roots[i]) & (self.short[rest] | self.short[i])
        might &= 100 * np.minimum(self.n[rest], self.n[i]) >= self.percent * np.maximum(self.n[rest], self.n[i])
        if not might.any():
            return np.zeros(0, np.int64), np.zeros(0)
        equal = (self.sketch[:, rest] == self.sketch[:, i : i + 1]).view(np.uint8)
        same = np.add.reduce(equal, axis=0, dtype=np.uint16) / len(self.sketch)
        at = np.flatnonzero(might & (same >= self.least))
        return at + first, same[at]

    def proposed(self) -> tuple[list[int], bytes]:
        """The members of proposed pairs, and two hashes of the set of these pairs."""
        keys = np.frombuffer(b"".join(self.classes), "<u8").reshape(-1, 2)
        some, sums = np.zeros(len(keys), bool), np.zeros(2, np.uint64)
        for i in range(len(keys) - 1):
            at, _ = self.partners(i, i + 1)
            if len(at):
                some[at] = some[i] = True
                sums += mix(keys[at] + keys[i]).sum(axis=0)
        return np.flatnonzero(some).tolist(), sums.tobytes()

    def links(self, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """Pairs that connect all members which confirmed pairs connect, one of all with all others; roots become those of the connected."""

        lengths, out = np.array([len(s) for s in sets]), []

        def confirm(i: int, at: np.ndarray) -> None:
            shingles = np.concatenate([sets[j] for j in at])
            place = np.searchsorted(sets[i], shingles)
            place[place == lengths[i]] = 0
            both = np.add.reduceat(sets[i][place] == shingles, np.cumsum(lengths[at]) - lengths[at], dtype=np.int64)
            for j in at[100 * both >= self.percent * (lengths[i] + lengths[at] - both)].tolist():
                if self.roots[i] != self.roots[j]:
                    self.roots[self.roots == self.roots[j]] = self.roots[i]
                    out.append((i, j))

        for i in range(len(sets)):  # the likeliest partner first, so that few pairs are left to compare
            at, same = self.partners(i)
            if len(at):
                confirm(i, at[[same.argmax()]])
        for i in range(len(sets) - 1):
            at, _ = self.partners(i, i + 1)
            while len(at):
                confirm(i, at[:AT_ONCE])
                at = at[AT_ONCE:]
                at = at[self.roots[at] != self.roots[i]]
        # each with the first that it is connected with, so that labels need not pass along chains
        ends = sorted({i for pair in out for i in pair})
        firsts: dict[int, int] = {}
        return [(firsts[r], i) for i in ends if firsts.setdefault(r := int(self.roots[i]), i) != i]


def _active(percent: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _groups(batches):
            node = _Node(rows, percent, least)
            members, pairs = node.proposed()
            if members:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node.classes[k] for k in members], pa.binary()), pa.array([number] * len(members), pa.int64()),
                     pa.array([pairs] * len(members), pa.binary())], ["class", "node", "pairs"])

    return run


def _confirm(text: str, words: int, percent: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            node = _Node(rows, percent, least)
            links = node.links(shingle_sets(pa.array([r[text] for r in rows], pa.large_string()), words))
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node.classes[k] for k in ends], pa.binary()) for ends in zip(*links, strict=True)], ["a", "b"])

    return run


def _links(members: DataFrame, texts: DataFrame, on: list[str], words: int, percent: int, least: float, rows: int) -> DataFrame:
    """Pairs (a, b) that connect what confirmed pairs of the about ``rows`` rows that share a node connect.

    Nodes that propose the same pairs are looked at once.
    """
    # sorted by class too, so that a task that runs again gives the same links
    by_node = lambda df: df.repartition("node").sortWithinPartitions("node", "class")
    active = written(_few(by_node(members.drop(*KEY)).mapInArrow(
        _active(percent, least), "class binary, node bigint, pairs binary"), rows), "near-active")
    once = active.groupBy("class", "pairs").agg(F.min("node").alias("node")).drop("pairs")
    wanted = written(_few(members.join(once, ["class", "node"]), rows), "near-wanted")
    # equal keys are one text; parted by the key they are joined by, they are sent once
    texts = _met(texts, wanted, on).dropDuplicates(on)
    return by_node(wanted.join(texts, on).drop(*KEY)).mapInArrow(
        _confirm("text", words, percent, least), "a binary, b binary")


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) of every linked node; the root is the least node that links lead to.

    Least labels pass along links and are then looked up at the label itself, so that long chains
    take a few rounds. Nothing is gathered but the number of changes and of links, of which there are about ``rows``.
    """
    # both directions of one evaluation: two evaluations could choose different links
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = links.select(F.inline(both)).distinct()
    edges = written(_few(edges, rows), "near-links")
    rows = edges.count()
    labels = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node")
    labels = written(_few(labels, rows), "near-labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        moved = labels.join(near, labels.node == near.a).select(
            "node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        above = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        labels = written(_few(moved.join(above, "root", "left").select(
            "node", F.least("root", F.coalesce("above", "root")).alias("root"),
            (F.least("root", F.coalesce("above", "root")) != F.col("was")).alias("changed")), rows), "near-labels")
        if labels.where("changed").isEmpty():
            return labels.select("node", "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80,
                    node_limit: int = NODE_LIMIT, max_depth: int = MAX_DEPTH) -> DataFrame:
    """For each row of docs: its id, n_shingles, component_id, kept.

    Rows are linked if their sets of ``words``-word shingles (A-Z lower-cased) have at least ``percent`` %
    of their union in common; component_id is the smallest id that links lead to, kept whether it is the
    row's own.

    Null or empty texts have empty sets and are linked with nothing. A null id is larger than none: it
    names a component only if all its ids are null, and is then kept. Repeated rows are equal sets;
    they share the component and are all kept if it bears their id. Other columns are not looked at. An empty
    table gives no rows.
    """
    return _labelled(docs, doc_id, text, words, percent, node_limit, max_depth).drop(*KEY)


def _labelled(docs: DataFrame, doc_id: str, text: str, words: int = 5, percent: int = 80,
              node_limit: int = NODE_LIMIT, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The rows of :func:`near_duplicates` with the key of each row."""
    kind = dict(docs.dtypes)[doc_id]
    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    slim = slim.select("*", *row_key("id", "text"))
    rows = written(_sets(slim, "text", words, kind), "near-sets")
    classes = rows.where("n > 0").groupBy("class").agg(
        F.min("id").alias("id"), F.first(F.struct(*KEY, "n", "signature")).alias("one")).select("class", "id", "one.*")
    classes = written(_few(classes, rows.count()), "near-classes")
    number, shingles = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    most, firsts = TREES * number, number + shingles * (100 - percent) // 100
    least = percent / 100 - 5 * math.sqrt(percent / 100 * (1 - percent / 100) / TOKENS)
    leaves, hot = _leaves(classes, percent / 100, node_limit, max_depth, most)
    # one byte of each token is enough to propose pairs
    low = F.unhex(F.regexp_replace(F.hex("signature"), "(..)......", "$1"))
    sketched = classes.select("class", *KEY, "n", low.alias("sketch"))
    known = written(_few(leaves.join(sketched, "class").select(
        "class", F.col("class").alias("root"), F.lit(True).alias("short"), *KEY, "n", "sketch", "node"), most), "near-known")
    texts = slim.select("text", *KEY)
    linked = components(_links(known, texts, KEY, words, percent, least, most), most)
    if hot is not None:
        roots = linked.select(F.col("node").alias("class"), "root")
        own = hot.join(roots, "class", "left").select("class", *KEY, F.coalesce("root", "class").alias("root"))
        hot_texts = written(_met(texts, hot, KEY).join(own, KEY).dropDuplicates(KEY).select("class", "root", "text"), "near-hot-texts")
        rest = _exact_leaves(hot_texts, words, percent, node_limit, firsts).join(sketched.drop(*KEY), "class")
        rest = written(_few(rest, firsts), "near-rest")
        more = written(_links(rest, hot_texts.select("class", "text"), ["class"], words, percent, least, rest.count()), "near-more")
        if not more.isEmpty():
            linked = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), most)
    named = classes.select("class", "id").join(linked, F.col("class") == F.col("node"), "left")
    least_id = named.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("id").alias("least"))
    named = named.join(least_id, "root", "left").select("class", F.coalesce("least", "id").alias("component_id"))
    out = rows.select("id", *KEY, "n", "class").join(named, "class", "left").select(
        *KEY, F.col("id").alias(doc_id), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.col(doc_id).eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one document of each group; same columns.

    Of rows with equal id and text one stays. Rows without an id are judged like others: copies of a text that
    has an id go, and different texts all stay.
    """
    kept = _labelled(docs, doc_id, text, **options).where("kept").select(*KEY).distinct()
    keyed = docs.select("*", *row_key(doc_id, text))
    return keyed.join(kept, KEY, "left_semi").dropDuplicates(KEY).select(*docs.columns)
