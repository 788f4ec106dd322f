"""Streams give the rows of their batch operators, however the input is cut."""

import datetime as dt
import random
from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docmark import dims, scratch
from docmark.operators import status, validation
from docmark.plans import queries
from docmark.sources import uploads
from docmark.streaming import intake, progress
from tests.test_status import SCHEMA, STAGES, at


def life(rng, task, start):
    """One task: an init, some advances, perhaps an end and stray updates after it."""
    now, rows = start, [(task, start, "init", "UPLOADED", "PENDING", None)]
    for _ in range(rng.randint(0, 7)):
        now += rng.choice([0, 2, 30, 150])
        x = rng.random()
        if x < 0.1:
            rows.append((task, now, "fail", "PARSING", "FAILURE", "why"))
        else:
            rows.append((task, now, "advance", rng.choice(STAGES), "SUCCESS" if x > 0.85 else "ACTIVE", None))
    return rows


def make_log(seed=9, tasks=25):
    rng = random.Random(seed)
    rows = [r for t in range(tasks) for r in life(rng, f"t{t}", rng.randint(0, 600))]
    rows += [("ghost", 50, "advance", "PARSING", "ACTIVE", None)]
    rows.sort(key=lambda r: r[1])
    return [(r[0], i, at(r[1]), *r[2:]) for i, r in enumerate(rows)]


TICK = (None, None, at(10**6), None, None, None, None)


def play(spark, path, chunks, start, tick=True):
    """Feed the chunks one file a micro-batch, with a restart of the query after each."""
    src = f"{path}/in"
    for chunk in [*chunks, *([[TICK]] if tick else [])]:
        spark.createDataFrame(chunk, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
        query = start(stream).trigger(availableNow=True).start()
        assert query.awaitTermination(300)
    return lambda table: progress.results(spark, str(path), table)


def unsorted_chunks(log, n, by, seed=1):
    """The log cut in n by time, where any row may slip by up to ``by`` seconds."""
    rng = random.Random(seed)
    slipped = sorted(log, key=lambda r: r[2] + dt.timedelta(seconds=rng.uniform(0, by)))
    size = len(log) // n + 1
    chunks = [slipped[i:i + size] for i in range(0, len(log), size)]
    for chunk in chunks:
        rng.shuffle(chunk)
    return chunks


def bag(df, cols):
    return Counter(map(tuple, df.select(cols).collect()))


SENT = ["task_id", "event_id", "ts", "stage", "status", "error_reason", "emit_no", "error"]
BEATS = ["task_id", "event_id", "beat_no", "beat_at"]
ROLLED = ["batch_id", "event_id", "ts", "status", "stage", "error_reason", "error"]
END = at(10**6 - 100) + dt.timedelta(microseconds=1)


@pytest.mark.parametrize("parts", [1, 4])
def test_streams_give_the_rows_of_their_batch_operators(spark, tmp_path, parts):
    log, ttl = make_log(), 100
    places = [(f"b{t // 3}", t % 3, f"t{t}") for t in range(25)]
    members = spark.createDataFrame(places, "batch_id string, pos int, task_id string")
    got = play(spark, tmp_path, unsorted_chunks(log, parts, ttl), lambda s: progress.stream_heartbeats(
        s, str(tmp_path), 20, ttl_s=ttl, members=lambda spark: members, split=False))
    events = spark.createDataFrame(log, SCHEMA)
    sent = status.stage_transitions(events, ttl_s=ttl, until=F.lit(END))
    assert bag(got("sent"), SENT) == bag(sent, SENT)
    assert bag(got("beats"), BEATS) == bag(status.heartbeats(sent, 20, until=F.lit(END)), BEATS)
    rolled = status.batch_transitions(status.rollup_history(events, members, ttl_s=ttl, until=F.lit(END)))
    assert bag(got("rollups"), ROLLED) == bag(rolled, ROLLED)
    assert got("late").isEmpty()
    assert {r.error for r in sent.collect()} == {None, "task_not_found"}
    assert {r.error for r in rolled.collect()} == {None, "no_tasks_found"}


def test_late_rows_come_out_and_change_nothing(spark, tmp_path):
    first = [("a", 0, at(0), "init", "UPLOADED", "PENDING", None), ("a", 1, at(500), "advance", "PARSING", "ACTIVE", None)]
    late = [("a", 2, at(300), "advance", "PACKAGING", "SUCCESS", None), ("a", 3, None, "fail", "PARSING", "FAILURE", "x")]
    got = play(spark, tmp_path, [first, late], lambda s: progress.stream_transitions(
        s, str(tmp_path), ttl_s=1_000, delay_s=100))
    assert {r.event_id for r in got("late").collect()} == {2, 3}
    assert {(r.event_id, r.stage, r.error) for r in got("sent").collect()} == {
        (0, "UPLOADED", None), (1, None, "task_not_found"), (1, "PARSING", None)}


def test_a_micro_batch_played_again_changes_nothing(spark, tmp_path):
    log = make_log(6, 12)
    members = spark.createDataFrame([(f"b{t // 4}", t % 4, f"t{t}") for t in range(12)], "batch_id string, pos int, task_id string")
    step = progress.Follower(str(tmp_path), ttl_s=200, interval_s=30, members=lambda spark: members, split=False)
    tables = ["sent", "beats", "rollups", "late", "tasks", "batches", "waiting"]
    content = lambda: {t: Counter(map(str, progress.results(spark, str(tmp_path), t).collect())) for t in tables}
    chunks = [spark.createDataFrame(c, SCHEMA) for c in unsorted_chunks(log, 3, 150)]
    for number, chunk in enumerate(chunks):
        step(chunk, number)
        once = content()
        step(chunk, number)
        assert content() == once
    assert sum(once["sent"].values()) and sum(once["rollups"].values())
    with pytest.raises(ValueError, match="another query"):
        step(chunks[0], 9)


def test_members_that_are_added_later_take_part(spark, tmp_path):
    table = str(tmp_path / "members")
    schema = "batch_id string, pos int, task_id string"
    spark.createDataFrame([("b", 1, "y")], schema).write.parquet(table)
    step = progress.Follower(str(tmp_path), ttl_s=1_000, delay_s=0, members=lambda s: s.read.schema(schema).parquet(table))
    step(spark.createDataFrame([("x", 0, at(0), "init", "UPLOADED", "PENDING", None),
                                ("y", 1, at(1), "init", "UPLOADED", "PENDING", None)], SCHEMA), 0)
    spark.createDataFrame([("b", 0, "x")], schema).write.mode("append").parquet(table)
    step(spark.createDataFrame([("x", 2, at(2), "fail", "SCANNING", "FAILURE", "first")], SCHEMA), 1)
    step(spark.createDataFrame([("y", 3, at(3), "advance", "PACKAGING", "SUCCESS", None)], SCHEMA), 2)
    got = progress.results(spark, str(tmp_path), "rollups").orderBy("event_id").collect()
    assert [(r.event_id, r.status, r.stage, r.error_reason) for r in got] == [
        (1, "ACTIVE", "UPLOADED", None), (2, "FAILURE", "UPLOADED", "first")]


def test_idle_task_beats_until_it_expires(spark, tmp_path):
    log = [("a", 0, at(0), "init", "UPLOADED", "PENDING", None)]
    other = [("b", 1, at(1_000), "init", "UPLOADED", "PENDING", None)]
    late = [("a", 2, at(1_001), "advance", "PARSING", "ACTIVE", None)]
    got = play(spark, tmp_path, [log, other, late], lambda s: progress.stream_heartbeats(
        s, str(tmp_path), 15, ttl_s=60, delay_s=1), tick=False)
    assert {(r.task_id, r.ts, r.error) for r in got("sent").collect()} == {
        ("a", at(0), None), ("a", at(60), "task_not_found"), ("b", at(1_000), None)}
    assert sorted((r.task_id, r.beat_no, r.beat_at) for r in got("beats").collect()) == [
        ("a", n, at(15 * n)) for n in (1, 2, 3)]


def test_heartbeat_bounds(spark, tmp_path):
    stream = spark.readStream.format("rate").load().select(
        F.col("timestamp").alias("ts"), F.lit("t").alias("task_id"), F.col("value").alias("event_id"),
        F.lit("init").alias("op"), F.lit("UPLOADED").alias("stage"), F.lit("ACTIVE").alias("status"),
        F.lit("").alias("error_reason"))
    for bad in (3, 61):
        with pytest.raises(ValueError):
            progress.stream_heartbeats(stream, str(tmp_path), bad)
    assert progress.stream_heartbeats(stream, str(tmp_path), 30) is not None
    assert progress.results(spark, str(tmp_path), "beats").isEmpty()


def test_validate(spark, tmp_path):
    for name, raw in [("a.txt", b"fine"), ("b.pdf", b"no"), ("c.exe", b"x"), ("d.pdf", b"%PDF-1"),
                      ("big.txt", b"x" * 5_000)]:
        (tmp_path / name).write_bytes(raw)
    stream, rejects = uploads.stream_uploads(spark, str(tmp_path), max_bytes=1_000)

    def result(df, name):
        query = (df.writeStream.format("parquet").trigger(availableNow=True)
                 .option("checkpointLocation", scratch.scratch_path(spark, name))
                 .start(str(tmp_path.parent / f"{tmp_path.name}-{name}")))
        assert query.awaitTermination(60)
        return spark.read.parquet(str(tmp_path.parent / f"{tmp_path.name}-{name}"))

    checked = result(intake.stream_validate(stream), "checked")
    want = validation.checked_uploads(uploads.read_uploads(spark, str(tmp_path), 1_000)[0])
    cols = ["filename", "mime", "error"]
    assert set(map(tuple, checked.select(cols).collect())) == set(map(tuple, want.select(cols).collect()))
    assert {r.filename for r in intake.accepted(checked).collect()} == {"a.txt", "d.pdf"}
    assert {r.filename for r in intake.quarantined(checked).collect()} == {"b.pdf", "c.exe"}
    assert [(r.filename, r.error) for r in result(rejects, "rejects").collect()] == [
        ("big.txt", dims.TOO_LARGE)]


def test_scratch_is_where_the_session_says(spark, tmp_path, monkeypatch):
    assert scratch.scratch_path(spark, "x").startswith("/tmp/")
    monkeypatch.setattr(scratch, "CONF", "docmark.test.dir")
    spark.conf.set(scratch.CONF, str(tmp_path))
    assert scratch.scratch_path(spark, "x").startswith(str(tmp_path))


def _user_events(spark, path, rows):
    kinds = F.array(*[F.lit(k) for k in ("signup", "view", "click", "purchase", "error")])
    spark.range(0, rows, 1, 1).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 20).alias("ts"),
        (F.col("id") % 40).alias("user_id"), F.get(kinds, F.expr("CAST(id DIV 40 % 5 AS INT)")).alias("event_type")).write.parquet(
        f"{path}/events.parquet")
    return str(path)


def test_members_are_derived_once_for_all_micro_batches(spark, tmp_path, monkeypatch):
    calls = []
    derive = queries.b.run_members
    monkeypatch.setattr(queries.b, "run_members", lambda events: calls.append(1) or derive(events))
    got = queries.stream_rollup(spark, _user_events(spark, tmp_path, 600))
    assert got.count() > 0
    assert len(calls) == 1


def test_a_file_of_the_stream_can_be_read_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries.b, "STREAM_BLOCK_BYTES", 64 << 10)
    _, _, path = queries._arriving(spark, _user_events(spark, tmp_path, 20_000))
    groups = [pq.ParquetFile(f).num_row_groups for f in Path(path, "in").glob("*.parquet")]
    assert max(groups) > 1
