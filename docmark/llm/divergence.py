"""Audit of how sources diverge in their words, over token-start pointers sorted in place.

1. A shard is a run of texts in one Arrow buffer. Pointers to the starts of its words are sorted by
   multikey quicksort: every slice of pointers that agree so far is ordered by its next eight bytes,
   until no slice has more to compare. Words are never cut out of the buffer to be compared.
2. Equal runs of pointers are the terms. A run's pointers, still in text order, give the documents it
   occurs in and its count in each (language, source); one string a run is made.
3. Spark sums these rows over the shards, drops rare terms, and scores what is left. Distances of
   sources are summed over blocks of terms and tiles of sources, so that no task holds a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmark.llm.common import LOWER, Words, cut_words, slices, written
from docmark.operators.ordered import numbered

LEAST_DOCS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
PRIOR = 5
#: Text bytes whose pointers are sorted together.
SHARD_BYTES = 4_000_000
#: Sources of one side of a tile, and counts that a block of terms aims at.
TILE, BLOCK_ROWS = 64, 10_000
_CHUNK_CELLS = 1 << 22


def letter_class() -> np.ndarray:
    """Bytes of ASCII letters and of all characters beyond ASCII."""
    table = np.zeros(256, bool)
    table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


LETTERS = letter_class()


def _next_bytes(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes of each word as one number in byte order, zero beyond its end."""
    windows = np.ndarray((len(data) - 7,), ">u8", data.data, 0, (1,))
    got = windows[at].astype(np.uint64)
    short = left < 8
    got[short] &= ~((np.uint64(1) << (np.uint64(8) * (8 - left[short]).astype(np.uint64))) - np.uint64(1))
    return got


def sorted_pointers(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers in the order of their bytes, equal words in text order; and where each run begins."""
    n = len(words.starts)
    data = np.concatenate([words.data, np.zeros(8, np.uint8)])
    lengths = words.ends - words.starts
    order = np.argsort(key := _next_bytes(data, words.starts, lengths), kind="stable")
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    depth = 8
    while True:
        # slices that agree so far and hold a longer word; a word that ends is told by its zero bytes
        group = np.cumsum(new) - 1
        longer = np.bincount(group, lengths[order] > depth, minlength=1)[group] > 0 if n else np.zeros(0, bool)
        alone = new & np.append(new[1:], True)
        at = np.flatnonzero(longer & ~alone)
        if not len(at):
            return order, np.flatnonzero(new)
        ids = order[at]
        left = np.maximum(lengths[ids] - depth, 0)
        key = np.zeros(len(at), np.uint64)
        more = left > 0
        key[more] = _next_bytes(data, words.starts[ids[more]] + depth, left[more])
        slice_of = group[at]
        turn = np.lexsort((key, slice_of))
        order[at] = ids[turn]
        key = key[turn]
        new[at[1:]] |= (key[1:] != key[:-1]) & (slice_of[1:] == slice_of[:-1])
        depth += 8


def _shard_counts(lang: str, source: str, text: str):
    """Of each shard: (lang, source, term, n, docs)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SHARD_BYTES):
            words = cut_words(batch.column(text), LETTERS, False)
            if not len(words.starts):
                continue
            words.data = LOWER[words.data]
            order, runs = sorted_pointers(words)
            pairs = pa.StructArray.from_arrays([batch.column(lang), batch.column(source)], ["l", "s"])
            codes, kinds = pd.factorize(pd.Series(pairs.to_pylist()).map(lambda p: (p["l"], p["s"])))
            doc = np.searchsorted(words.bounds, order, "right") - 1
            run = np.zeros(len(order), np.int64)
            run[runs[1:]] = 1
            run = np.cumsum(run)
            # pointers of a run are in text order, so a document's stand together
            fresh = np.ones(len(order), bool)
            fresh[1:] = (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(fresh)
            times = np.diff(np.append(first, len(order)))
            cell = run[first] * len(kinds) + codes[doc[first]]
            by = np.argsort(cell, kind="stable")
            cell, times = cell[by], times[by]
            head = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            which, kind = cell[head] // len(kinds), cell[head] % len(kinds)
            lead = order[runs]
            terms = pa.array([words.data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(
                words.starts[lead].tolist(), words.ends[lead].tolist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([
                pa.array([kinds[k][0] for k in kind], pa.string()), pa.array([kinds[k][1] for k in kind], pa.string()),
                terms.take(pa.array(which)), pa.array(np.add.reduceat(times, head)),
                pa.array(np.diff(np.append(head, len(cell))))], ["lang", "source", "term", "n", "docs"])

    return count


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs) of all texts: occurrences and documents, each row a document."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in (
        (lang, "lang"), (source, "source"), (text, "text"))])
    counted = rows.mapInArrow(
        _shard_counts("lang", "source", "text"), "lang string, source string, term string, n bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)) in whole numbers; null without terms."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(20,0)")
    below = (total + PRIOR * terms).cast("decimal(20,0)")
    return F.when(terms > 0, F.floor((top - top % below) / below).cast("long") + 1)


def _sum_of_distances(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one block of terms and one tile of sources: source numbers of both sides, sums of |p - q|, terms seen."""
    heads = rows[rows["term"].isna()].drop_duplicates("no").sort_values("no")
    numbers, base = heads["no"].to_numpy(np.int64), heads["p"].to_numpy(np.int64)
    sides = heads["side"].to_numpy()
    cells = rows[rows["term"].notna()]
    cols, terms = pd.factorize(cells["term"])
    line = np.searchsorted(numbers, cells["no"].to_numpy(np.int64))
    p = cells["p"].to_numpy(np.int64)
    a, b = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
    total = np.zeros((len(a), len(b)), np.int64)
    step = max(1, _CHUNK_CELLS // max(1, len(numbers)))
    for start in range(0, len(terms), step):
        stop = min(start + step, len(terms))
        dense = np.repeat(base[:, None], stop - start, axis=1)
        here = (cols >= start) & (cols < stop)
        dense[line[here], cols[here] - start] = p[here]
        for i, k in enumerate(a):
            total[i] += np.abs(dense[b] - dense[k]).sum(axis=1)
    return numbers, a, b, total, len(terms)


def _distances(cells: DataFrame, groups: DataFrame, tile: int, block_rows: int) -> DataFrame:
    """(lang, a, b, value) of every two sources a < b of a language, by their numbers."""
    sizes = cells.groupBy("lang").count().select("lang", F.ceil(F.col("count") / block_rows).alias("blocks"))
    per = groups.join(sizes, "lang").withColumn("tile", F.expr(f"no div {tile}"))
    last = F.expr(f"(sources - 1) div {tile}")

    def in_tiles(rows: DataFrame) -> DataFrame:
        """A row goes to its tile's pairs with all tiles; side 0 and 1, or 2 where both are the same."""
        pairs = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        return pairs.select(
            "lang", "block", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"),
            F.when(F.col("tile") == F.col("other"), 2).when(F.col("tile") < F.col("other"), 0).otherwise(1).alias("side"),
            "no", "term", "p")

    heads = per.select("lang", "tile", "sources", "no", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"),
                       F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    own = cells.select("lang", "source", "term", "p").join(per.drop("p0"), ["lang", "source"]).select(
        "lang", "tile", "sources", "no", "term", "p", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"))

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        numbers, a, b, total, seen = _sum_of_distances(rows)
        ia, ib = np.repeat(numbers[a], len(b)), np.tile(numbers[b], len(a))
        keep = ia < ib
        return pd.DataFrame({"lang": key[0], "a": ia[keep], "b": ib[keep], "value": total.reshape(-1)[keep], "seen": seen})

    parts = in_tiles(heads).unionByName(in_tiles(own)).groupBy("lang", "block", "ta", "tb").applyInPandas(
        add, "lang string, a bigint, b bigint, value bigint, seen bigint")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS,
          top: int = TOP_TERMS, tile: int = TILE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """How far the sources of a language are from each other and which terms set one apart.

    lang, source, part, item, value, rank. Part ``pair``: item is another source of the language, value
    the sum over all kept terms of the difference of their shares. Part ``term``: the ``top`` terms whose
    share exceeds the language's most. A language keeps the terms in at least ``least_docs`` of its
    documents. Shares are whole numbers, see :func:`share`.

    Null texts, languages and sources count as empty; empty texts have no terms, and a group without
    terms still has pairs. Long texts are one shard each. Each of several equal rows is a document.
    Equal values rank by item. Other columns play no part, whatever their names; an empty table gives
    no rows.
    """
    found = written(term_counts(docs, lang, source, text), "divergence")
    common = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(
        F.col("docs") >= least_docs).drop("docs")
    kept = written(found.drop("docs").join(common, ["lang", "term"]), "divergence")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_distinct("term").alias("terms"))
    occurring = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in (
        (lang, "lang"), (source, "source"))]).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = numbered(occurring, ["lang"], ["source"], "no", "sources").join(totals, ["lang", "source"], "left").join(
        langs, "lang", "left").select(
            "lang", "source", "no", "sources", F.coalesce("total", F.lit(0)).alias("total"),
            F.coalesce("lang_total", F.lit(0)).alias("lang_total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    zero = F.lit(0).cast("long")
    groups = written(groups.withColumn("p0", share(zero, F.col("total"), F.col("terms"))), "divergence")

    scored = kept.join(groups.drop("no", "sources", "p0"), ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("all_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = scored.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    sums = _distances(scored, groups.select("lang", "source", "no", "sources", "p0"), tile, block_rows)
    side = lambda n: groups.select(
        F.col("lang"), F.col("no").alias(n), F.col("source").alias(f"s{n}"), F.col("p0").alias(f"p{n}"), "terms")
    # every two sources of a language: that is what is asked for
    every = side("a").join(side("b").drop("terms"), "lang").where("a < b").join(sums, ["lang", "a", "b"], "left")
    apart = F.coalesce(F.col("value") + (F.col("terms") - F.col("seen")) * F.abs(F.col("pa") - F.col("pb")), zero)
    pairs = every.select("lang", apart.alias("value"), F.explode(F.array(
        F.struct(F.col("sa").alias("source"), F.col("sb").alias("item")),
        F.struct(F.col("sb").alias("source"), F.col("sa").alias("item")))).alias("d")).select(
            "lang", "d.source", F.lit("pair").alias("part"), "d.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms.select(pairs.columns))


SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
words AS (
  SELECT d, lang, source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT d, lang, source, unnest(terms) AS t FROM docs)),
common AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= {LEAST_DOCS}),
langs AS (SELECT lang, sum(n) AS total, count(*) AS v FROM common GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN common USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT t.lang, t.source, c.term, coalesce(n.n, 0) AS n,
    1 + (CAST({SCALE} AS HUGEINT) * (coalesce(n.n, 0) + {PRIOR})) // (t.total + {PRIOR} * l.v) AS p,
    1 + (CAST({SCALE} AS HUGEINT) * (c.n + {PRIOR})) // (l.total + {PRIOR} * l.v) AS q
  FROM totals t JOIN langs l USING (lang) JOIN common c USING (lang)
  LEFT JOIN counts n ON n.lang = t.lang AND n.source = t.source AND n.term = c.term),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  WHERE a.lang NOT IN (SELECT lang FROM langs)
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
