"""Files that arrive for two sinks, and tables that retention purges."""

from __future__ import annotations

import contextlib
import datetime as dt
import io

import pytest
from pyspark.sql import functions as F

from docmark import dims
from docmark.operators import status
from docmark.sources import expiring, uploads

NOW = dt.datetime(2024, 3, 10, 12)
SCHEMA = "id string, finished_at timestamp"


def hours_ago(h):
    return NOW - dt.timedelta(hours=h)


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture
def table(spark, tmp_path):
    rows = [("new", hours_ago(1)), ("edge", hours_ago(24)), ("kept", hours_ago(23)), ("early", hours_ago(30)),
            ("old", hours_ago(80)), ("older", hours_ago(200)), ("open", None)]
    path = str(tmp_path / "outputs")
    expiring.write_by_end(spark.createDataFrame(rows, SCHEMA), path)
    return path


def ids(spark, path):
    return sorted(r.id for r in spark.read.parquet(path).collect())


def test_purge_deletes_what_has_expired_and_nothing_else(spark, table):
    due = expiring.expired(spark.read.parquet(table), NOW, 86_400)
    assert sorted(r.id for r in due.collect()) == ["early", "edge", "old", "older"]
    assert "PartitionFilters: [isnotnull(ended_on" in plan_of(due) and due.columns == ["id", "finished_at"]
    for _ in range(2):
        expiring.purge(spark, table, NOW, 86_400)
        assert ids(spark, table) == ["kept", "new", "open"]
    expiring.purge(spark, table, NOW + dt.timedelta(hours=2), 86_400)
    assert ids(spark, table) == ["new", "open"]
    expiring.purge(spark, table + "-none", NOW)


def test_every_kind_has_its_own_clock(spark, table, tmp_path):
    archive = str(tmp_path / "archives")
    expiring.write_by_end(spark.createDataFrame([("b1", hours_ago(2)), ("b2", hours_ago(90))], SCHEMA), archive)
    gone = expiring.expired(spark.read.parquet(table), NOW, 86_400)
    states = spark.createDataFrame([("new",), ("old",), ("open",)], "id string")
    assert sorted(r.id for r in status.without_purged(states, gone, "id").collect()) == ["new", "open"]
    expiring.purge(spark, archive, NOW, 86_400)
    assert ids(spark, archive) == ["b1"] and "old" in ids(spark, table)


def test_arriving_files_go_to_their_sinks(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for turn in range(2):
        (src / f"small{turn}.txt").write_bytes(b"x" * 10)
        (src / f"big{turn}.pdf").write_bytes(b"x" * 200)
        for writer in uploads.write_uploads(spark, str(src), out, max_bytes=100):
            assert writer.trigger(availableNow=True).start().awaitTermination(120)
    taken = spark.read.parquet(f"{out}/uploads").select("filename", F.length("content")).collect()
    assert sorted(map(tuple, taken)) == [("small0.txt", 10), ("small1.txt", 10)]
    refused = spark.read.parquet(f"{out}/rejects").select("filename", "length", "error").collect()
    assert sorted(map(tuple, refused)) == [("big0.pdf", 200, dims.TOO_LARGE), ("big1.pdf", 200, dims.TOO_LARGE)]
    listed = uploads.read_uploads(spark, str(src), 100)
    assert "PushedFilters" in plan_of(listed[0]) and "LessThanOrEqual(length,100)" in plan_of(listed[0])
    assert "content" not in plan_of(listed[1]).split("ReadSchema")[1].split("\n")[0]
