"""Mixing of sources to target weights, in DataFrame functions only.

1. One pass over the texts gives every document its size and its draws, numbers from a hash of the
   document. They are written as a narrow table; texts are not read again until copies are made.
2. Sizes are summed by source before any shuffle. Targets follow from a weight for each place in the
   sources' order: the level is filled like water, a source over its limit is set to the limit and the
   rest is shared anew, until none is above. Each round is one sum over the sources.
3. A source's repetition rate is its target over its size. A document is taken floor(rate) times, plus
   once more if its draw is under the fraction: a Bernoulli copy, seeded by hash alone.

A hash yields 32 independent draws. Sums of what each of them would take are made in the same
aggregate, and a source uses the draw that comes nearest to its target: sources with few or very uneven
documents come nearer to it than by one draw, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmark.llm.common import written
from docmark.operators.ordered import numbered

WEIGHTS = (5, 2, 1)
#: No source is repeated more often than this.
MOST = 3
DRAWS = 32
_DRAW_RANGE = float(1 << 32)
#: Bytes of the table of rates up to which it goes to all tasks.
MAX_BROADCAST = 32_000_000
#: Parts of each source where the rates are too many for that.
SALTS = 64
_EXACT = "decimal(38,0)"


def word_count(text: Column) -> Column:
    """Words parted by ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seed(doc_id: Column, text: Column) -> Column:
    """A hash of id and text; nulls count as empty."""
    return F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))), 256)


def draws(seeded: Column) -> Column:
    """Numbers from 0 to 2**32, eight out of each further hash of the seed."""
    hashes = [F.sha2(F.concat(seeded, F.lit(str(k))), 256) for k in range(DRAWS // 8)]
    return F.array(*[F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for h in hashes for i in range(8)])


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds target and rate to sources (source, source_size), each of its own.

    The i-th source in code-point order, null last, has weight i of the repeating weights. All sizes
    together are shared by weight, up to ``most`` times a source's size. Comparisons are of whole numbers.
    """
    places = numbered(sources.withColumn("__last", F.col("source").isNull()), [], ["__last", "source"], "place")
    which = F.col("place") % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (which + 1).cast("int"))
    table = written(places.select("source", "source_size", weight.cast("long").alias("weight")), "mixing")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    total = table.agg(F.sum(exact("source_size")).cast(_EXACT).alias("t")).head().t or 0
    over, rest, shares = F.lit(False), total, None
    while True:
        found = table.agg(
            F.sum(F.when(over, exact("source_size"))).alias("capped"), F.count_if(over).alias("n"),
            F.sum(F.when(~over, exact("weight"))).alias("shares")).head()
        rest = total - most * (found.capped or 0)
        if shares is not None and int(found.shares or 0) == shares:
            break
        shares = int(found.shares or 0)
        over = (exact("source_size") * F.lit(most * shares).cast("decimal(19,0)")
                < exact("weight") * F.lit(int(rest)).cast("decimal(19,0)"))
    whole = F.col("source_size").cast("double")
    target = F.when(over, whole * float(most)).otherwise(
        F.lit(float(rest)) * F.col("weight").cast("double") / F.lit(float(max(shares, 1))))
    return table.select("source", "source_size", target.alias("target"),
                        F.when(F.col("source_size") > 0, target / whole).otherwise(0.0).alias("rate"))


def copies(rate: Column, draw: Column) -> Column:
    """floor(rate) copies, and one more where the draw falls under the fraction."""
    sure = F.floor(rate)
    return sure + (draw.cast("double") / F.lit(_DRAW_RANGE) < rate - sure).cast("long")


def _with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Rows with the columns of their source's rate; a source may hold any share of the rows."""
    size = rates.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64)).head()[0] or 0
    if size <= MAX_BROADCAST:
        few = F.broadcast(rates)
        return rows.join(few, rows["source"].eqNullSafe(few["source"])).drop(few["source"])
    salted = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("seed"), F.lit(SALTS)).cast("int"))
    here = rows["source"].eqNullSafe(salted["source"]) & (rows["__salt"] == salted["__salt"])
    return rows.join(salted, here).drop(salted["source"]).drop("__salt")


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
         weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Sized documents (doc_id, source, size, seed) and sources (source, source_size, target, rate, draw).

    draw is the number of the source's draw. Sizes are counted in words of whole texts.
    """
    sized = written(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
        word_count(F.col(text)).alias("size"), seed(F.col(doc_id), F.col(text)).alias("seed")), "mixing")
    rates = written(targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mixing")
    taken = [F.sum(F.col("size") * copies(F.col("rate"), F.col("draws")[i])).cast("double") for i in range(DRAWS)]
    off = [F.abs(t - F.first("target")) for t in taken]
    best = _with_rates(sized, rates).withColumn("draws", draws(F.col("seed"))).groupBy("source").agg(
        F.array_min(F.array(*[F.struct(o.alias("off"), F.lit(i).alias("draw")) for i, o in enumerate(off)]))["draw"].alias("draw"))
    chosen = rates.join(best, rates["source"].eqNullSafe(best["source"])).drop(best["source"])
    return sized, written(chosen, "mixing")


def _number(rows: DataFrame) -> Column:
    return copies(F.col("rate"), F.element_at(draws(F.col("seed")), F.col("draw") + 1))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed documents: each row of docs as often as the mix takes it, with copy_no from 1.

    Null texts are empty and have size 0. Null is a source of its own. Rows that agree in id and text
    draw alike; rows of null ids are told apart by their texts. A source without words takes nothing,
    an empty table gives no rows. Other columns stay, whatever their names, but an input column
    copy_no is replaced.
    """
    _, rates = plan(docs, doc_id, text, source, weights, most)
    own = [c for c in docs.columns if c != "copy_no"]
    rows = docs.select(F.struct(*own).alias("row"), F.col(source).cast("string").alias("source"),
                       seed(F.col(doc_id), F.col(text)).alias("seed"))
    n = _with_rates(rows, rates).withColumn("n", _number(rows)).where("n > 0")
    return n.select("row.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy_no"))


def digest(planned: tuple[DataFrame, DataFrame]) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken (words)."""
    sized, rates = planned
    rows = _with_rates(sized, rates)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * _number(rows)).alias("taken"))


SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    sha256(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, source, size, list_transform(range({DRAWS}), lambda i:
    CAST(CAST('0x' || substr(sha256(h || (i // 8)), CAST(8 * (i % 8) + 1 AS INTEGER), 8) AS BIGINT) AS DOUBLE)
      / 4294967296.0) AS draws FROM sized),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight
  FROM drawn GROUP BY source),
-- those with the least size for their weight reach their limit first
filled AS (
  SELECT *, (SELECT sum(source_size) FROM sources) - {MOST} * coalesce(sum(source_size) OVER before, 0) AS rest,
    sum(weight) OVER after AS shares
  FROM (SELECT *, row_number() OVER (ORDER BY source_size / weight, source) AS k FROM sources)
  WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    after AS (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (SELECT k, rest, shares FROM filled WHERE {MOST} * source_size * shares >= weight * rest ORDER BY k LIMIT 1),
rates AS (
  SELECT s.source, source_size, CASE WHEN s.k < l.k THEN CAST(source_size AS DOUBLE) * {MOST}.0
    ELSE CAST(l.rest AS DOUBLE) * CAST(weight AS DOUBLE) / CAST(l.shares AS DOUBLE) END AS target
  FROM filled s, level l),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0.0 END AS rate FROM rates),
chances AS (
  SELECT doc_id, d.source, size, source_size, target,
    list_transform(draws, lambda u: size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT)) AS takes
  FROM drawn d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source),
chosen AS (
  SELECT source, arg_min(i, (off, i)) AS i FROM (
    SELECT source, u.i, abs(CAST(sum(takes[CAST(u.i AS INTEGER)]) AS DOUBLE) - any_value(target)) AS off
    FROM chances, (SELECT unnest(range(1, {DRAWS + 1})) AS i) u GROUP BY source, u.i) GROUP BY source)
SELECT doc_id, size, source_size, target, takes[CAST(i AS INTEGER)] AS taken
FROM chances c JOIN chosen x ON c.source IS NOT DISTINCT FROM x.source"""
