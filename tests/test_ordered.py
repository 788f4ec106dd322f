"""Places of rows in an order, for keys of any size."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from docmark.operators.ordered import numbered


@pytest.mark.parametrize("partitions", [1, 7])
def test_places_are_row_numbers(spark, partitions):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, rng.randrange(40)]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, t int, i int").repartition(5)
    got = numbered(df, ["k"], ["t", "i"], "place", "of", partitions)
    groups = defaultdict(list)
    for k, t, i in rows:
        groups[k].append((t is not None, t or 0, i))
    want = {(k, r[2], p, len(g)) for k, g in groups.items() for p, r in enumerate(sorted(g))}
    assert {(r.k, r.i, r.place, r.of) for r in got.collect()} == want


def test_places_without_keys_and_without_rows(spark):
    df = spark.range(50).repartition(4)
    assert [(r.id, r.pos) for r in numbered(df, [], ["id"], partitions=4).orderBy("id").collect()] == [(i, i) for i in range(50)]
    assert numbered(df.limit(0), [], ["id"]).count() == 0
