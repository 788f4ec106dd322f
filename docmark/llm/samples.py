"""Bounded samples of labelled rows, the same at every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = 1 << 30


def balanced_ids(labels: DataFrame, doc_id: str, label: str, per_label: int) -> DataFrame:
    """(id, label) of about per_label rows of each label, chosen by a hash of the id.

    Reads ids and labels only; what is chosen is at most a few times per_label in all.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("__id"), F.col(label).alias("__label")).distinct()
    counts = {r["__label"]: r["count"] for r in rows.groupBy("__label").count().collect()}
    if not counts:
        return rows.limit(0)
    chosen = F.lit(False)
    for value, n in sorted(counts.items()):
        cut = int(STEPS * min(1.0, per_label / n))
        chosen = chosen | ((F.col("__label") == value) & (F.pmod(F.xxhash64("__id"), F.lit(STEPS)) < cut))
    return rows.where(chosen)


def sampled_texts(docs: DataFrame, ids: DataFrame, doc_id: str, text: str) -> list[tuple[str, object]]:
    """The whole texts of the sampled ids with their labels, in a fixed order."""
    found = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).where(F.col(text).isNotNull()).join(
        F.broadcast(ids), "__id")
    return [(r["__text"], r["__label"]) for r in sorted(found.collect(), key=lambda r: (r["__id"], str(r["__label"]), r["__text"]))]
