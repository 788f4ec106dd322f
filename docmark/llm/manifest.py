"""Merkle manifest of a table of documents, with inclusion proofs by octopus multiproofs.

Every row is a leaf. The leaves of a group (here: a language), in order, and the groups' roots, in
order, make trees of eight-fold nodes. Proofs are not built one by one: the leaves are dealt to
blocks of neighbouring leaves, and a block

1. names the least set of nodes that all its proofs need and that it cannot derive from its own
   leaves (``missing``): at each level, the rest of the first and the last run it reaches into;
2. fetches these nodes once, by one join of coordinates with the tree's nodes;
3. derives the interior nodes that its proofs share, and expands each leaf's proof locally.

Contents are hashed in one pass inside the JVM; only digests and ids move afterwards. A block holds
at most ``block`` leaves however large a group is, and interior nodes are built level by level, each
an eighth of the one below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmark.llm.common import written
from docmark.operators.ordered import numbered

ARITY = 8
#: Leaves of a block: a power of the arity, so that blocks are whole subtrees.
BLOCK_LEVELS = 4
#: Nodes of the upper levels that every block may ask for, sent to all tasks (110 bytes each).
UPPER_NODES = 50_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(*fields: Column) -> Column:
    """sha256 over each field: '-' if null, else its UTF-8 byte count, ':' and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[
        F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))
        for t in texts]), 256)


def digest_of(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def level_sizes(leaves: int, arity: int = ARITY) -> list[int]:
    """Nodes of each level, the leaves first, up to the single root."""
    sizes = [leaves]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // arity))
    return sizes


def missing(first: int, last: int, leaves: int, arity: int = ARITY) -> list[tuple[int, int]]:
    """(level, index) of the nodes that proofs of the leaves first to last need and cannot derive."""
    out = []
    for level, size in enumerate(level_sizes(leaves, arity)[:-1]):
        start = first // arity * arity
        stop = min(last // arity * arity + arity, size)
        out += [(level, i) for i in range(start, first)] + [(level, i) for i in range(last + 1, stop)]
        first, last = first // arity, last // arity
    return out


def interior(leaves: dict[int, str], first: int, last: int, total: int, fetched: dict[tuple[int, int], str],
             arity: int = ARITY) -> list[dict[int, str]]:
    """For each level the digests at hand: derived from the leaves, or fetched."""
    levels, here = [], dict(leaves)
    sizes = level_sizes(total, arity)
    for level, size in enumerate(sizes):
        known = {**here, **{i: d for (lv, i), d in fetched.items() if lv == level}}
        levels.append(known)
        if level + 1 == len(sizes):
            break
        here = {
            run: digest_of([known[i] for i in range(run * arity, min(run * arity + arity, size))])
            for run in range(first // arity, last // arity + 1)}
        first, last = first // arity, last // arity
    return levels


class Paths:
    """Proofs over the digests at hand; what neighbouring leaves share is worked out once.

    ``levels`` are those of :func:`interior`; ``above`` goes on where the tree ends: (left, right)
    siblings of each further level.
    """

    def __init__(self, levels: list[dict[int, str]], total: int, above: list[tuple[list[str], list[str]]] = (),
                 arity: int = ARITY):
        self.levels, self.above, self.arity = levels, list(above), arity
        self.sizes = level_sizes(total, arity)[:-1]
        self._tails: dict[tuple[int, int], list] = {}
        self._roots: dict[tuple[int, int, str], str] = {}

    def path(self, at: int, level: int = 0) -> list[tuple[list[str], list[str]]]:
        """At each level up to the root the nodes left and right of the way from this node."""
        if level == len(self.sizes):
            return self.above
        found = self._tails.get((level, at))
        if found is None:
            start, known = at // self.arity * self.arity, self.levels[level]
            stop = min(start + self.arity, self.sizes[level])
            own = ([known[i] for i in range(start, at)], [known[i] for i in range(at + 1, stop)])
            found = self._tails[level, at] = [own, *self.path(at // self.arity, level + 1)]
        return found

    def root(self, digest: str, at: int, level: int = 0) -> str:
        """The root that this digest, in this place, and its siblings lead to."""
        if level == len(self.sizes):
            return fold(digest, self.above)
        found = self._roots.get((level, at, digest))
        if found is None:
            left, right = self.path(at, level)[0]
            found = self.root(digest_of([*left, digest, *right]), at // self.arity, level + 1)
            self._roots[level, at, digest] = found
        return found


def fold(digest: str, path: list[tuple[list[str], list[str]]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, right in path:
        digest = digest_of([*left, digest, *right])
    return digest


def _next_level(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes of the next level of every tree that has more than one node left (``size``)."""
    up = nodes.where("size > 1").groupBy(*keys, "size", F.expr(f"idx div {ARITY}").alias("up")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"))
    return up.select(
        *keys, F.col("up").alias("idx"), F.sha2(F.array_join("run.digest", ""), 256).alias("digest"),
        F.expr(f"(size + {ARITY - 1}) div {ARITY}").alias("size"))


def _tree(nodes: DataFrame, keys: list[str], level: int) -> tuple[DataFrame, DataFrame, int]:
    """All nodes from this level up, the roots, and the highest level.

    ``nodes`` has keys, idx, digest and size (nodes of its level in the tree).
    """
    here = written(nodes.withColumn("level", F.lit(level)), "manifest")
    parts = [here]
    while not here.where("size > 1").isEmpty():
        level += 1
        here = written(_next_level(here, keys).withColumn("level", F.lit(level)), "manifest")
        parts.append(here)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every, every.where("size = 1").select(*keys, "digest"), level


def _block_tops(leaves: DataFrame, levels: int) -> DataFrame:
    """The top node of each block: of level ``levels``, or the root of a smaller tree."""

    def top(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        total, digests = int(rows["leaves"].iloc[0]), rows["leaf"].tolist()
        for _ in range(min(levels, len(level_sizes(total)) - 1)):
            digests = [digest_of(digests[i : i + ARITY]) for i in range(0, len(digests), ARITY)]
        return pd.DataFrame({"tree": [key[0]], "idx": [key[1]], "digest": digests, "size": [-(-total // ARITY**levels)]})

    return leaves.select("tree", "block", "pos", "leaf", "leaves").groupBy("tree", "block").applyInPandas(
        top, "tree bigint, idx bigint, digest string, size bigint")


def _with_missing(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Blocks (tree, block, first, last, leaves) with the nodes they miss, as ``fetched``.

    The coordinates follow from positions alone, and one join brings the digests. Nodes of upper levels
    are asked for by very many blocks: they are few, are counted, and go to all tasks. Below, a node is
    asked for by the blocks of its neighbours only.
    """

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([
                (r.tree, r.block, level, i) for r in rows.itertuples()
                for level, i in missing(r.first, r.last, r.leaves)], columns=["tree", "block", "level", "idx"])

    wanted = blocks.select("tree", "block", "first", "last", "leaves").mapInPandas(
        name, "tree bigint, block bigint, level int, idx bigint")
    sizes = {r.level: r["count"] for r in nodes.groupBy("level").count().collect()}
    cut, held = max(sizes, default=0) + 1, 0
    while cut - 1 in sizes and held + sizes[cut - 1] <= UPPER_NODES:
        cut -= 1
        held += sizes[cut]
    on = ["tree", "level", "idx"]
    digests, high = nodes.select(*on, "digest"), F.col("level") >= cut
    found = wanted.where(high).join(F.broadcast(digests.where(high)), on).unionByName(
        wanted.where(~high).join(digests.where(~high), on))
    lists = found.groupBy("tree", "block").agg(F.collect_list(F.struct("level", "idx", "digest")).alias("fetched"))
    return blocks.join(lists, ["tree", "block"], "left")


def _nodes_at_hand(fetched) -> dict[tuple[int, int], str]:
    return {} if fetched is None else {(d["level"], d["idx"]): d["digest"] for d in fetched}


_PATH = "array<struct<left: array<string>, right: array<string>>>"


def _trees(groups: DataFrame) -> tuple[DataFrame, str | None]:
    """(tree, subroot, above) for groups (tree, trees, subroot), and the root over all of them.

    A group's root is a leaf of the upper tree, and a block of its own there.
    """
    nodes, top, _ = _tree(groups.select(
        F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("idx"), F.col("subroot").alias("digest"),
        F.col("trees").alias("size")), ["tree"], 0)

    def climb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                levels = interior({r.block: r.subroot}, r.block, r.block, r.leaves, _nodes_at_hand(r.fetched))
                path = Paths(levels, r.leaves).path(r.block)
                out.append((r.block, r.subroot, [{"left": a, "right": b} for a, b in path]))
            yield pd.DataFrame(out, columns=["tree", "subroot", "above"])

    blocks = groups.select(
        F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("block"), F.col("tree").alias("first"),
        F.col("tree").alias("last"), F.col("trees").alias("leaves"), "subroot")
    root = top.head()
    paths = _with_missing(blocks, nodes).mapInPandas(climb, f"tree bigint, subroot string, above {_PATH}")
    return paths, root.digest if root else None


def _expand(key: tuple, rows: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
    """Proof digest, folded root and path of each leaf of one block."""
    rows, head = rows.sort_values("pos"), info.iloc[0]
    at, total = [int(p) for p in rows["pos"]], int(head["leaves"])
    levels = interior(dict(zip(at, rows["leaf"], strict=True)), at[0], at[-1], total, _nodes_at_hand(head["fetched"]))
    paths = Paths(levels, total, [([*s["left"]], [*s["right"]]) for s in head["above"]])
    ways = [paths.path(p) for p in at]
    folded = [paths.root(shown, p) for p, shown in zip(at, rows["shown"], strict=True)]
    return rows[["doc_id", "leaf"]].assign(
        subroot=head["subroot"],
        proof_sha256=[digest_of([d for left, right in way for d in (*left, *right)]) for way in ways],
        folded_root=folded, path=[[{"left": a, "right": b} for a, b in way] for way in ways])


def prove(docs: DataFrame, doc_id: str = "doc_id", group: str = "lang",
          fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
          shown: Column | None = None, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """An inclusion proof of every row: doc_id, leaf, subroot, root, path, proof_sha256, folded_root,
    verified.

    A leaf is :func:`leaf_digest` of ``fields``. ``path`` has the siblings of each level, from the leaf
    to the root, ``proof_sha256`` is the digest of them all. ``shown`` is the digest that is checked
    against the tree (default: the leaf itself): ``folded_root`` is where it leads, ``verified``
    whether that is the root.

    Leaves of a group are ordered by id, null first, then by digest; equal rows are equal leaves, each
    with its own place. A null group is one like any other, and the first. Null fields are told from
    empty ones; texts are hashed whole, whatever their length. Other columns play no part, whatever
    their names. An empty table gives no rows.
    """
    leaf = leaf_digest(*[F.col(f) for f in fields])
    rows = written(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(group).cast("string").alias("lang"), leaf.alias("leaf"),
        (leaf if shown is None else shown).alias("shown")), "manifest")
    groups = written(numbered(
        rows.groupBy("lang").agg(F.count(F.lit(1)).alias("leaves")), [], ["lang"], "tree", "trees"), "manifest")
    placed = numbered(rows, ["lang"], ["doc_id", "leaf"])
    size = ARITY**block_levels
    leaves = placed.join(groups, placed["lang"].eqNullSafe(groups["lang"])).select(
        "doc_id", "leaf", "shown", "pos", "leaves", "tree", F.expr(f"pos div {size}").alias("block"))
    nodes, subroots, _ = _tree(_block_tops(leaves, block_levels), ["tree"], block_levels)
    above, root = _trees(written(groups.join(subroots.withColumnRenamed("digest", "subroot"), "tree"), "manifest"))
    blocks = nodes.where(F.col("level") == block_levels).join(groups.select("tree", "leaves"), "tree").select(
        "tree", F.col("idx").alias("block"), (F.col("idx") * size).alias("first"),
        (F.least(F.col("leaves"), (F.col("idx") + 1) * size) - 1).alias("last"), "leaves")
    info = _with_missing(blocks, nodes).join(above, "tree")
    kind = dict(docs.select(doc_id).dtypes)[doc_id]
    # ids go through pandas as text, which keeps nulls and every digit
    proofs = leaves.select("tree", "block", "pos", F.col("doc_id").cast("string").alias("doc_id"), "leaf", "shown").groupBy(
        "tree", "block").cogroup(info.groupBy("tree", "block")).applyInPandas(
            _expand, f"doc_id string, leaf string, subroot string, proof_sha256 string, folded_root string, path {_PATH}")
    return proofs.select(
        F.col("doc_id").cast(kind).alias("doc_id"), "leaf", "subroot", F.lit(root).cast("string").alias("root"), "path",
        "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))


def tampered(docs_id: str = "doc_id", text: str = "text",
             fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), every: int = 3) -> Column:
    """Leaves of rows whose text was changed for some: lower-cased where ``every`` divides the id's crc32."""
    changed = F.crc32(F.col(docs_id).cast("string").cast("binary")) % every == 0
    lowered = F.translate(F.col(text), _UPPER, _LOWER)
    return leaf_digest(*[F.when(changed, lowered).otherwise(F.col(f)) if f == text else F.col(f) for f in fields])


def digest(proofs: DataFrame) -> DataFrame:
    return proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


_FIELD = """CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR) END"""
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", "n_chars")) + " || {text})"
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(8 * length(CAST(doc_id AS VARCHAR))),
    lambda i: (ascii(substr(CAST(doc_id AS VARCHAR), CAST(i // 8 + 1 AS INTEGER), 1)) >> CAST(i % 8 AS INTEGER)) & 1)),
    lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""


def _sql(levels: int = 8) -> str:
    """The same in SQL, with the levels of a tree written out one by one."""
    lowered = f"translate(text, '{_UPPER}', '{_LOWER}')"
    out = [f"""leaves AS (
  SELECT doc_id, lang, {_LEAF.format(text=_FIELD.format("text"))} AS leaf,
    CASE WHEN {_CRC32} % 3 = 0 THEN {_LEAF.format(text=_FIELD.format(lowered))}
      ELSE {_LEAF.format(text=_FIELD.format("text"))} END AS shown
  FROM documents),
a0 AS (
  SELECT *, leaf AS node, shown AS fold, '' AS proof,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY lang) AS size FROM leaves),
n0 AS (SELECT lang, idx, size, node FROM a0)"""]

    def climb(name: str, rows: str, k: int, key: str) -> None:
        """Nodes of the next level, and every row's proof and fold so far."""
        same = f"x.{key} IS NOT DISTINCT FROM r.{key}"
        out.append(f"""{name}{k + 1} AS (
  SELECT {key}, idx // 8 AS idx, (any_value(size) + 7) // 8 AS size,
    CASE WHEN any_value(size) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY idx)) END AS node
  FROM {name}{k} GROUP BY {key}, idx // 8),
{rows}s{k} AS (
  SELECT r.{key} AS k, r.idx AS i, coalesce(string_agg(x.node, '' ORDER BY x.idx) FILTER (x.idx < r.idx), '') AS l,
    coalesce(string_agg(x.node, '' ORDER BY x.idx) FILTER (x.idx > r.idx), '') AS g
  FROM {name}{k} r JOIN {name}{k} x ON {same} AND x.idx // 8 = r.idx // 8 GROUP BY ALL),
{rows}{k + 1} AS (
  SELECT r.* REPLACE (r.idx // 8 AS idx, (r.size + 7) // 8 AS size, r.proof || s.l || s.g AS proof,
    CASE WHEN r.size = 1 THEN r.fold ELSE sha256(s.l || r.fold || s.g) END AS fold)
  FROM {rows}{k} r JOIN {rows}s{k} s ON s.k IS NOT DISTINCT FROM r.{key} AND s.i = r.idx)""")

    for k in range(levels):
        climb("n", "a", k, "lang")
    out.append(f"""m0 AS (
  SELECT 0 AS tree, lang, node AS subroot, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx,
    count(*) OVER () AS size FROM n{levels}),
b0 AS (
  SELECT a.* REPLACE (m.idx AS idx, m.size AS size), m.tree, m.subroot
  FROM a{levels} a JOIN m0 m ON a.lang IS NOT DISTINCT FROM m.lang)""")
    for k in range(levels):
        climb("m", "b", k, "tree")
    return f"""WITH {",\n".join(out)}
SELECT doc_id, leaf, subroot, m.node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = m.node AS verified
FROM b{levels} CROSS JOIN m{levels} m"""


SQL = _sql()
