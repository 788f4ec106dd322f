"""Byte patterns by their anchors, against a plain search."""

from __future__ import annotations

import random

import pytest

from docmark import dims
from docmark.operators import patterns, scanning


def frame(spark, found):
    return spark.createDataFrame([(bytearray(p) if p is not None else None,) for p in found], "pattern binary")


@pytest.mark.parametrize("limit", [patterns.MAX_BROADCAST, 2_000])
def test_hits_match_a_plain_search(spark, limit):
    rng = random.Random(3)
    some = lambda n: bytes(rng.choice(b"abAB\\x00\\xff") for _ in range(n))
    wanted = [some(rng.choice([5, 8, 9, 12, 30])) for _ in range(60)] + [b"common prefix " + some(4) for _ in range(30)]
    contents = [some(rng.randrange(0, 60)) for _ in range(150)] + [None, b"", b"a" * 9]
    contents += [some(5) + rng.choice(wanted) + some(rng.randrange(3)) for _ in range(40)] + [p[:-1] for p in wanted[60:]]
    contents += [b"." * (1 << 20) + wanted[70] + b"." * 10]
    files = spark.createDataFrame([(i, bytearray(c) if c is not None else None) for i, c in enumerate(contents)],
                                  "task_id int, content binary").repartition(3)
    got = patterns.pattern_hits(files, frame(spark, [*wanted, None, b"", wanted[0]]), max_broadcast=limit)
    want = [i for i, c in enumerate(contents) if c is not None and any(p in c for p in wanted)]
    assert sorted(r.task_id for r in got.collect()) == want
    assert patterns.pattern_hits(files, frame(spark, [])).isEmpty()


def test_a_hundred_thousand_patterns_have_the_plan_of_two(spark):
    files = spark.createDataFrame([(i, bytearray(f"text {i} with key-{i * 700:09} inside", "ascii")) for i in range(300)],
                                  "task_id int, content binary")
    many = spark.range(100_000).selectExpr("cast(concat('key-', lpad(id, 9, '0')) as binary) as pattern")
    few = frame(spark, [b"key-000000000", b"key-000000700"])
    none = spark.createDataFrame([], "sha256 string")
    plans = []
    for table, want in ((few, [0, 1]), (many, list(range(143)))):
        got = scanning.signature_scan(files, none, table)
        assert sorted((r.task_id, r.error) for r in got.collect()) == [(i, dims.VIRUS) for i in want]
        plans.append(len(got._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert plans[0] == plans[1]
