"""Progress of tasks and batches on a stream of status events.

Each micro-batch applies the batch operators of :mod:`docmark.operators.status` to the events that
became due and to one row for each task that is still alive, and writes its results, and the rows that
carry on, as tables below one folder:

* ``sent`` stage transitions, ``beats`` heartbeats, ``rollups`` changes of batches
* ``late`` events that came after the clock had passed them; they change nothing
* ``tasks`` the latest state of every live task, ``batches`` what was sent last of every live batch,
  ``waiting`` events the clock has not reached yet
* ``clock`` the time all this is complete up to, written last

The clock is the latest event time less ``delay_s``, so events may come out of order by that much.
The default is the TTL of states: whoever is later than that updates a state that has lapsed.
A row without ``task_id`` is a tick, which moves the clock and nothing else.

Every table has a folder for each micro-batch, which reads the folders of the micro-batch before and
overwrites its own: a micro-batch that is played again changes nothing. The checkpoint lies beside
the tables, so the numbers always are those of the query that wrote them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from docmark.limits import DEFAULT
from docmark.operators import status
from docmark.scratch import exists, remove

EVENTS = (
    "task_id string, event_id long, ts timestamp, op string, stage string, status string, "
    "error_reason string")
_STATE = "status: string, stage: string, error_reason: string"
SCHEMAS = {
    "sent": "task_id string, event_id long, ts timestamp, stage string, status string, "
            "error_reason string, emit_no int, error string",
    "beats": "task_id string, event_id long, beat_no long, beat_at timestamp",
    "rollups": "batch_id string, event_id long, ts timestamp, kind int, status string, stage string, "
               "error_reason string, error string",
    "late": EVENTS,
    "waiting": EVENTS,
    "tasks": "task_id string, event_id long, ts timestamp, stage string, status string, "
             "error_reason string, done boolean, sent_event_id long, sent_at timestamp",
    "batches": f"batch_id string, sent struct<{_STATE}>, done boolean",
    "clock": "reached_us bigint",
}
_LIVE = ("tasks", "batches", "waiting")

Members = Callable[[SparkSession], DataFrame]


@dataclass(frozen=True)
class Follower:
    """What a micro-batch does; see the module. ``members`` gives the table of batch members anew for
    each micro-batch, so that members which are added later take part from then on."""

    path: str
    ttl_s: int = DEFAULT.state_ttl_s
    delay_s: int | None = None
    interval_s: int | None = None
    members: Members | None = None
    max_members: int = DEFAULT.max_batch_files
    split: bool | None = None

    def folder(self, table: str, number: int) -> str:
        return f"{self.path}/{table}/batch={number}"

    def _read(self, spark: SparkSession, table: str, number: int) -> DataFrame:
        if number < 0 or not exists(spark, self.folder(table, number)):
            return spark.createDataFrame([], SCHEMAS[table])
        return spark.read.schema(SCHEMAS[table]).parquet(self.folder(table, number))

    def _write(self, rows: DataFrame, table: str, number: int) -> DataFrame:
        names = rows.sparkSession.createDataFrame([], SCHEMAS[table]).columns
        rows.select(*names).write.mode("overwrite").parquet(self.folder(table, number))
        return self._read(rows.sparkSession, table, number)

    def _clock(self, spark: SparkSession, number: int):
        if number < 0:
            return None
        if not exists(spark, self.folder("clock", number)):
            raise ValueError(f"{self.path} has no micro-batch {number}: it belongs to another query")
        return self._read(spark, "clock", number).first().reached_us

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, last = batch.sparkSession, number - 1
        rows = batch.select(
            "task_id", F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"),
            "op", "stage", "status", "error_reason").persist()
        before = self._clock(spark, last)
        delay = self.ttl_s if self.delay_s is None else self.delay_s
        latest = rows.agg(F.unix_micros(F.max("ts")).alias("us")).first().us
        known = [us for us in (before, latest and latest - delay * 1_000_000) if us is not None]
        reached = max(known) if known else None
        past, clock = (F.timestamp_micros(F.lit(us).cast("long")) for us in (before, reached))
        events = rows.where(F.col("task_id").isNotNull())
        on_time = F.col("ts").isNotNull() if before is None else F.coalesce(F.col("ts") > past, F.lit(False))
        self._write(events.where(~on_time), "late", number)
        waiting = self._read(spark, "waiting", last).unionByName(events.where(on_time))
        is_due = F.coalesce(F.col("ts") <= clock, F.lit(False))
        self._write(waiting.where(~is_due), "waiting", number)
        self._follow(spark, waiting.where(is_due), number, past, clock)
        self._write(spark.createDataFrame([(reached,)], SCHEMAS["clock"]), "clock", number)
        rows.unpersist()
        for table in _LIVE:  # what the micro-batch before this one has read is not needed again
            remove(spark, self.folder(table, number - 2))

    def _follow(self, spark: SparkSession, due: DataFrame, number: int, past: Column, clock: Column) -> None:
        tasks = self._read(spark, "tasks", number - 1)
        carried = tasks.select(
            "task_id", "event_id", "ts", F.lit("init").alias("op"), "stage", "status", "error_reason",
            F.lit(True).alias("_carried"), F.col("done").alias("_done"),
            F.struct("sent_event_id", "sent_at").alias("_last"))
        due = due.withColumns({
            "_carried": F.lit(False), "_done": F.lit(False),
            "_last": F.lit(None).cast("struct<sent_event_id: bigint, sent_at: timestamp>")})
        until = clock + F.expr("INTERVAL 0.000001 SECONDS")
        lives = status.task_lives(due.unionByName(carried), self.ttl_s, split=self.split).persist()
        sent = self._write(status.transitions_of(lives, self.ttl_s, until), "sent", number)
        if self.interval_s is not None:
            self._beat(tasks, sent, number, past, until)
        self._write(self._alive(lives, clock), "tasks", number)
        if self.members is not None:
            self._roll_up(lives, number, until)
        lives.unpersist()

    def _beat(self, tasks: DataFrame, sent: DataFrame, number: int, past: Column, until: Column) -> None:
        none = F.lit(None).cast("string")
        idle = tasks.where(~F.col("done") & F.col("sent_at").isNotNull()).select(
            "task_id", F.col("sent_event_id").alias("event_id"), F.col("sent_at").alias("ts"), "stage", "status",
            "error_reason", F.lit(1).alias("emit_no"), none.alias("error"))
        beats = status.heartbeats(
            idle.unionByName(sent), self.interval_s, False, until, split=self.split, after=past)
        self._write(beats, "beats", number)

    def _alive(self, lives: DataFrame, clock: Column) -> DataFrame:
        """The last write of every life that has not lapsed, with the row that was sent last."""
        at = F.struct(*status.ORDER)
        sent = F.when(F.col("_carried"), F.col("_last")).when(
            F.col("_changed") & ~F.col("_over"),
            F.struct(F.col("event_id").alias("sent_event_id"), F.col("ts").alias("sent_at"))).when(
            F.col("_fresh"), F.lit(None).cast("struct<sent_event_id: bigint, sent_at: timestamp>"))
        told = F.col("_carried") | F.col("_fresh") | (F.col("_changed") & ~F.col("_over"))
        done = F.col("_over") | F.col("_done") | status.is_terminal(F.col("status"))
        found = lives.groupBy("task_id").agg(
            F.max_by(F.struct("event_id", "ts", "stage", "status", F.col("_reason").alias("error_reason"),
                              done.alias("done")), at).alias("s"),
            F.max_by(F.struct(sent.alias("v")), F.when(told, at)).alias("l"))
        return found.select("task_id", "s.*", "l.v.sent_event_id", "l.v.sent_at").where(
            F.col("ts") + F.make_dt_interval(secs=F.lit(self.ttl_s)) > clock)

    def _roll_up(self, lives: DataFrame, number: int, until: Column) -> None:
        spark = lives.sparkSession
        members = self.members(spark).select("batch_id", F.col("pos").cast("int").alias("pos"), "task_id")
        changes = status.member_changes(lives, self.ttl_s, until).join(members, "task_id").join(
            self._read(spark, "batches", number - 1).withColumnsRenamed({"sent": "_sent", "done": "_done"}),
            "batch_id", "left")
        rolled = status.followed_rollups(
            status.rollups_of(changes, split=self.split, max_members=self.max_members), split=self.split).persist()
        self._write(rolled.where("_emit"), "rollups", number)
        at = F.struct("ts", "event_id", "kind")
        state = F.struct("status", "stage", "error_reason")
        kept = rolled.groupBy("batch_id").agg(
            F.max_by("error", at).alias("error"),
            F.max_by(F.when(F.col("_emit"), state).otherwise(F.col("_sent")),
                     F.when(F.col("_emit") | F.col("_carried"), at)).alias("sent"),
            F.coalesce(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), at)), F.lit(False)).alias("done"))
        self._write(kept.where("error IS NULL"), "batches", number)
        rolled.unpersist()


def follow(stream: DataFrame, path: str, **options) -> DataStreamWriter:
    """A writer that follows the events into the tables below ``path``; start it with any trigger.

    Options are those of :class:`Follower`.
    """
    return stream.writeStream.foreachBatch(Follower(path, **options)).option(
        "checkpointLocation", f"{path}/checkpoint")


def stream_transitions(stream: DataFrame, path: str, **options) -> DataStreamWriter:
    """Stage transitions and closing rows on a stream, into ``sent``."""
    return follow(stream, path, **options)


def stream_heartbeats(stream: DataFrame, path: str, interval_s: int = DEFAULT.heartbeat_s,
                      check_range: bool = True, **options) -> DataStreamWriter:
    """Heartbeats besides, into ``beats``: up to the clock and the end of each life."""
    if check_range:
        status.check_heartbeat(interval_s)
    return follow(stream, path, interval_s=interval_s, **options)


def stream_rollup(stream: DataFrame, path: str, members: Members, **options) -> DataStreamWriter:
    """Changes of each batch's roll-up besides, into ``rollups``."""
    return follow(stream, path, members=members, **options)


def results(spark: SparkSession, path: str, table: str) -> DataFrame:
    """All rows of one table that complete micro-batches have written."""
    if not exists(spark, f"{path}/clock"):
        return spark.createDataFrame([], SCHEMAS[table])
    done = spark.read.parquet(f"{path}/clock").agg(F.max("batch")).first()[0]
    if not exists(spark, f"{path}/{table}"):
        return spark.createDataFrame([], SCHEMAS[table])
    rows = spark.read.schema(f"{SCHEMAS[table]}, batch long").parquet(f"{path}/{table}")
    return rows.where(F.col("batch") <= done).drop("batch")
