"""Task and batch progress, derived from a log of status events.

Events have ``task_id, event_id, ts, op, stage, status, error_reason`` with ``op`` one of
``init``, ``advance``, ``fail``; ``(ts, event_id)`` orders a task's events. Results that
need a task's last row only are aggregations with map-side combine; results that need
its neighbours use :class:`Timeline`, so that a task with a large share of all events is
spread over many tasks of the job (``split``: whether there is one; None counts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmark import dims
from docmark.limits import DEFAULT
from docmark.operators.carry import Timeline

ORDER = ("ts", "event_id")
_BEATS_PER_SLICE = 10_000


def is_terminal(status: Column) -> Column:
    return F.coalesce(status.isin(*dims.TERMINAL), F.lit(False))


def _after(ts: Column, seconds: int | float) -> Column:
    return F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) + F.lit(int(seconds * 1_000_000)))


# --- latest state ------------------------------------------------------------


def latest_state(events: DataFrame) -> DataFrame:
    """Last written state of every task that was initialised.

    A failure's reason stays through later advances and is cleared by an init.
    """
    ord_ = F.struct(*ORDER)
    init_ord = F.when(F.col("op") == "init", ord_)
    fail_ord = F.when(F.col("op") == "fail", ord_)
    kept = [c for c in ("batch_id", "original_name", "output_mode") if c in events.columns]
    last = events.groupBy("task_id").agg(
        F.max(init_ord).alias("_init"),
        F.max(fail_ord).alias("_fail"),
        F.max_by("error_reason", fail_ord).alias("_reason"),
        *[F.max_by(c, init_ord).alias(c) for c in kept],
        F.max_by("stage", ord_).alias("stage"),
        F.max_by("status", ord_).alias("status"),
        F.max("ts").alias("updated_at"),
    )
    reason = F.when(F.col("_fail") > F.col("_init"), F.col("_reason"))
    return last.filter(F.col("_init").isNotNull()).select(
        "task_id", *kept, "stage", "status", reason.alias("error_reason"), "updated_at")


def finished_tasks(events: DataFrame) -> DataFrame:
    """``task_id, status, finished_at`` of tasks at their first terminal event."""
    done = F.when(is_terminal(F.col("status")), F.struct(*ORDER))
    return (
        events.groupBy("task_id")
        .agg(F.min(done).alias("_end"), F.min_by("status", done).alias("status"))
        .filter(F.col("_end").isNotNull())
        .select("task_id", "status", F.col("_end.ts").alias("finished_at")))


# --- acceptance and expiry ---------------------------------------------------


def _accepted(line: Timeline, df: DataFrame, ttl_s: int | None) -> DataFrame:
    df = line.window(df, _before=line.lag("ts"))
    init = F.col("op") == "init"
    lapsed = F.lit(False) if ttl_s is None else (F.col("ts") > _after(F.col("_before"), ttl_s))
    starts = init | F.col("_before").isNull() | lapsed
    df = line.window(df, _known=line.running_last(F.when(starts, init)))
    return df.filter(F.col("_known")).drop("_before", "_known")


def accepted_events(events: DataFrame, ttl_s: int | None = None,
                    ranges: int | None = None, split: bool | None = None) -> DataFrame:
    """Events that find their task known and not expired; inits are always accepted.

    A gap over the TTL, or an init, starts an island. Only islands that start with an
    init are accepted, which is exact: every update inside such an island is a write
    that renews the TTL.
    """
    line = Timeline(["task_id"], ORDER, split)
    return _accepted(line, line.spread(events, ranges), ttl_s).select(*events.columns)


def apply_known_tasks(updates: DataFrame, inits: DataFrame, ttl_s: int | None = None,
                      ranges: int | None = None, split: bool | None = None) -> DataFrame:
    """Updates of tasks with an init before them and no expiry between."""
    both = updates.unionByName(inits)
    return accepted_events(both, ttl_s, ranges, split).filter(F.col("op") != "init")


def task_lives(events: DataFrame, ttl_s: int | None = None, ranges: int | None = None,
               split: bool | None = None) -> DataFrame:
    """The writes that are accepted, each with what it means in its task's life.

    Adds ``_changed`` (its stage is another than the one before in this life), ``_over`` (a
    terminal state was sent before), ``_fresh`` (starts a life), ``_next`` (time of the next
    write in any life) and ``_reason`` (the state's reason after it).
    """
    plain = [c for c, v in (("_carried", False), ("_done", False)) if c not in events.columns]
    events = events.withColumns({c: F.lit(False) for c in plain})
    line = Timeline(["task_id"], ORDER, split)
    df = line.spread(events, ranges)
    if ttl_s is not None:
        df = _accepted(line, df, ttl_s)
    # a failure's reason stays until an init clears it
    told = F.when(F.col("_carried") | (F.col("op") == "fail"), F.col("error_reason"))
    df = line.window(
        df, _prev=line.lag(F.struct("ts", "stage")), _next=line.lead("ts"),
        _told=line.running_last(F.when(F.col("op") != "advance", F.struct(told.alias("reason")))))
    lapsed = F.lit(False) if ttl_s is None else F.col("ts") > _after(F.col("_prev.ts"), ttl_s)
    df = df.withColumn("_fresh", F.col("_prev").isNull() | lapsed)
    ends = is_terminal(F.col("status")) | F.col("_done")
    df = line.window(df, _ended=line.running_last(
        F.when(ends, True).when(F.col("_fresh"), False), inclusive=False))
    before = F.when(~F.col("_fresh"), F.col("_prev.stage"))
    return df.select(
        *events.columns, "_fresh", "_next", F.col("_told.reason").alias("_reason"),
        (~F.col("stage").eqNullSafe(before)).alias("_changed"),
        (~F.col("_fresh") & F.coalesce("_ended", F.lit(False))).alias("_over"))


def _lapses(ttl_s: int | None, until: Column | None) -> Column:
    """Whether a life ends after this write, as far as is known."""
    if ttl_s is None:
        return F.lit(False)
    expiry = _after(F.col("ts"), ttl_s)
    known = F.lit(False) if until is None else until.cast("timestamp") > expiry
    return F.when(F.col("_next").isNull(), F.coalesce(known, F.lit(False))).otherwise(
        F.col("_next").cast("timestamp") > expiry)


def state_ttl(events: DataFrame, ttl_s: int = DEFAULT.state_ttl_s,
              ranges: int | None = None, split: bool | None = None) -> DataFrame:
    """Add ``expires_at``, ``valid_until`` and ``lapsed`` to every write.

    A state can be read from its write until the next write or its expiry, whichever
    is first; ``lapsed`` tells that no write renewed it in time.
    """
    line = Timeline(["task_id"], ORDER, split)
    df = line.spread(events, ranges)
    df = line.window(df, _next=line.lead("ts"))
    expires = _after(F.col("ts"), ttl_s)
    nxt = F.col("_next").cast("timestamp")
    return df.select(
        *events.columns,
        expires.alias("expires_at"),
        F.least(nxt, expires).alias("valid_until"),
        (nxt.isNull() | (nxt > expires)).alias("lapsed"))


def retention(finished: DataFrame, now: Column, keep_s: int = DEFAULT.retention_s
              ) -> tuple[DataFrame, DataFrame]:
    """``(kept, purged)`` by ``finished_at``; success and failure are treated alike.

    A pure filter, so partitions by finish date are pruned.
    """
    live = F.col("finished_at") > (now - F.expr(f"INTERVAL {int(keep_s)} SECONDS"))
    return finished.filter(live), finished.filter(~live)


def without_purged(rows: DataFrame, purged: DataFrame, key: str = "task_id") -> DataFrame:
    """Rows of states or outputs that are left after a purge; a missing item is no error."""
    return rows.join(purged.select(key), key, "left_anti")


# --- progress of a task ------------------------------------------------------


def stage_transitions(events: DataFrame, ranges: int | None = None, split: bool | None = None,
                      ttl_s: int | None = None, until: Column | None = None) -> DataFrame:
    """Rows a progress stream sends: each change of stage, and the terminal state once more.

    A change of stage into a terminal status gives two rows (``emit_no`` 1 and 2); nothing follows
    the first terminal event of a life. A life that lapses without one is closed by a row with
    ``error`` task_not_found at its expiry, and an init after that starts anew.
    """
    return transitions_of(task_lives(events, ttl_s, ranges, split), ttl_s, until)


def transitions_of(lives: DataFrame, ttl_s: int | None, until: Column | None = None) -> DataFrame:
    ends = is_terminal(F.col("status"))
    seen = ~F.col("_over") & ~F.col("_carried")
    closes = ~F.col("_over") & ~ends & ~F.col("_done") & F.col("_lapses")
    ts = F.col("ts").cast("timestamp")
    state = [F.col(c).alias(c) for c in ("stage", "status", "error_reason")]
    none = [F.lit(None).cast("string").alias(c) for c in ("stage", "status", "error_reason")]

    def row(on: Column, at: Column, values: list[Column], emit_no: Column, error: str | None) -> Column:
        return F.struct(
            on.alias("on"), at.alias("ts"), *values, emit_no.cast("int").alias("emit_no"),
            F.lit(error).cast("string").alias("error"))

    sent = F.array(
        row(seen & F.col("_changed"), ts, state, F.lit(1), None),
        row(seen & ends, ts, state, F.col("_changed").cast("int") + 1, None),
        row(closes, _after(F.col("ts"), ttl_s or 0), none, F.lit(1), dims.TASK_NOT_FOUND))
    ended = lives.withColumn("_lapses", _lapses(ttl_s, until))
    return ended.select("task_id", "event_id", F.inline(F.filter(sent, lambda r: r["on"]))).drop("on")


def check_heartbeat(interval_s: int) -> None:
    low, high = DEFAULT.heartbeat_range_s
    if not low <= interval_s <= high:
        raise ValueError(f"heartbeat interval must be between {low} and {high} seconds")


def heartbeats(emitted: DataFrame, interval_s: int = DEFAULT.heartbeat_s,
               check_range: bool = True, until: Column | None = None,
               ranges: int | None = None, split: bool | None = None,
               after: Column | None = None, key: str = "task_id") -> DataFrame:
    """One beat per full idle interval after each sent row, until the next one is sent.

    No beat follows a terminal or closing row. After a key's last row beats go on to ``until``
    (exclusive), or stop when it is not given; only beats after ``after`` are given. Long gaps
    are expanded slice by slice, so that no single array holds all beats of a gap.
    """
    if check_range:
        check_heartbeat(interval_s)
    order = [c for c in (*ORDER, "kind", "emit_no") if c in emitted.columns]
    line = Timeline([key], order, split)
    df = line.spread(emitted, ranges)
    df = line.window(df, _next=line.lead("ts"))
    end = F.col("_next") if until is None else F.coalesce(F.col("_next"), until)
    start_us = F.unix_micros(F.col("ts").cast("timestamp"))
    step_us = interval_s * 1_000_000
    beats = F.floor((F.unix_micros(end.cast("timestamp")) - start_us - 1) / F.lit(step_us))
    first = F.lit(1).cast("long")
    if after is not None:
        past = F.floor((F.unix_micros(after.cast("timestamp")) - start_us) / F.lit(step_us))
        first = F.greatest(first, F.coalesce(past, F.lit(0)).cast("long") + 1)
    ended = is_terminal(F.col("status"))
    if "error" in emitted.columns:
        ended = ended | F.col("error").isNotNull()
    idle = (
        df.filter(~ended)
        .select(key, "event_id", start_us.alias("_us"), first.alias("_first"), beats.cast("long").alias("_n"))
        .filter(F.col("_n") >= F.col("_first")))
    size = F.lit(_BEATS_PER_SLICE).cast("long")
    sliced = idle.withColumn("_slice", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("_n") - F.col("_first")) / size))))
    low = F.col("_first") + F.col("_slice") * size
    return sliced.withColumn("beat_no", F.explode(F.sequence(low, F.least(F.col("_n"), low + size - 1)))).select(
        key, "event_id", "beat_no",
        F.timestamp_micros(F.col("_us") + F.col("beat_no") * step_us).alias("beat_at"))


def stage_timeline(state: DataFrame) -> DataFrame:
    """Five rows per state: ``stage_no, stage_key, label, mark``.

    Marks are done, active, failed and pending; the current stage of a task that still
    waits carries none of them, and an unknown stage leaves all pending.
    """
    stages = F.array(*[
        F.struct(F.lit(i).alias("stage_no"), F.lit(s).alias("stage_key"), F.lit(t).alias("label"))
        for i, (s, t) in enumerate(dims.STAGES.items())])
    current = dims.lookup(F.col("stage"), {s: i for i, s in enumerate(dims.STAGES)}, -1)
    here = F.when(F.col("status") == "SUCCESS", "done").when(
        F.col("status") == "ACTIVE", "active").when(
        F.col("status") == "FAILURE", "failed").otherwise("none")
    mark = F.when(F.col("stage_no") < current, "done").when(
        F.col("stage_no") == current, here).otherwise("pending")
    return state.select("*", F.inline(stages)).withColumn("mark", mark)


# --- batches -----------------------------------------------------------------


def expand_batches(batches: DataFrame, states: DataFrame) -> DataFrame:
    """Members of each batch in order, with their state; members without one are left out.

    ``batches`` has ``batch_id`` and ``task_ids``, a JSON array.
    """
    ids = F.from_json(F.col("task_ids"), T.ArrayType(T.StringType()))
    members = batches.select("batch_id", F.posexplode(ids).alias("pos", "task_id"))
    return members.join(states, "task_id").select(
        "batch_id", "pos", "task_id", *[c for c in states.columns if c not in (
            "task_id", "batch_id")])


def successful_outputs(members: DataFrame, state: DataFrame, outputs: DataFrame) -> DataFrame:
    """Outputs of the members that ended well."""
    good = state.filter(F.col("status") == "SUCCESS").select("task_id")
    return members.select("batch_id", "task_id").join(good, "task_id").join(outputs, "task_id")


def batch_rollup(states: DataFrame) -> DataFrame:
    """One state per batch from ``batch_id, pos, stage, status, error_reason``.

    All members successful makes a success, else any failure makes a failure, else the
    batch is active. Stage is the earliest one, reason the first in member order.
    """
    status = F.col("status")
    return states.groupBy("batch_id").agg(
        F.when(F.bool_and(status == "SUCCESS"), "SUCCESS")
        .when(F.bool_or(status == "FAILURE"), "FAILURE")
        .otherwise("ACTIVE").alias("status"),
        F.min_by("stage", F.struct(dims.stage_rank(F.col("stage")), F.col("pos"))).alias("stage"),
        F.min_by("error_reason", F.when(F.col("error_reason") != "", F.col("pos")))
        .alias("error_reason"),
    ).withColumnRenamed("batch_id", "task_id")


def batch_barrier(states: DataFrame, timeout_s: int = DEFAULT.barrier_timeout_s) -> DataFrame:
    """When each batch closes and how many outputs it takes.

    ``states`` has ``batch_id, started_at`` (the batch's start, on each row),
    ``finished_at`` (NULL while running) and ``status``. A batch closes when its last
    member ends or at the timeout; members not successful by then are left out.
    """
    deadline = _after(F.col("started_at"), timeout_s)
    finished = F.col("finished_at").cast("timestamp")
    taken = (F.col("status") == "SUCCESS") & (finished <= deadline)
    return states.groupBy("batch_id").agg(
        F.when(F.count(F.when(finished.isNull(), 1)) == 0, F.max(finished)).alias("_last"),
        F.min(deadline).alias("_deadline"),
        F.count(F.lit(1)).alias("members"),
        F.count_if(taken).alias("included"),
    ).select(
        "batch_id",
        F.least("_last", "_deadline").alias("closes_at"),
        (F.col("_last").isNull() | (F.col("_last") > F.col("_deadline"))).alias("timed_out"),
        "members", "included")


def member_changes(lives: DataFrame, ttl_s: int | None, until: Column | None = None) -> DataFrame:
    """Each write as a state of its task (``kind`` 0), and the end of each life (``kind`` 1)."""
    ts = F.col("ts").cast("timestamp")
    none = F.lit(None).cast("string")
    change = lambda on, at, kind, stage, status, reason: F.struct(
        on.alias("on"), at.alias("ts"), F.lit(kind).alias("kind"), stage.alias("stage"),
        status.alias("status"), reason.alias("error_reason"))
    rows = F.array(
        change(F.lit(True), ts, 0, F.col("stage"), F.col("status"), F.col("_reason")),
        change(F.col("_lapses"), _after(F.col("ts"), ttl_s or 0), 1, none, none, none))
    carried = F.col("_carried") & (F.col("kind") == 0)
    ended = lives.withColumn("_lapses", _lapses(ttl_s, until))
    return ended.select("task_id", "event_id", "_carried", F.inline(F.filter(rows, lambda r: r["on"]))).select(
        "task_id", "event_id", "ts", "kind", "stage", "status", "error_reason", carried.alias("_carried"))


def rollup_history(events: DataFrame, members: DataFrame, ranges: int | None = None,
                   split: bool | None = None, ttl_s: int | None = None, until: Column | None = None,
                   max_members: int = DEFAULT.max_batch_files) -> DataFrame:
    """The batch roll-up after each write of a member, and after the end of each member's life.

    ``members`` has ``batch_id, pos, task_id`` with ``pos`` from 0 and under ``max_members``;
    others are an error. See :func:`batch_rollup` for the rule; a batch without any living
    member has ``error`` no_tasks_found.
    """
    changes = member_changes(task_lives(events, ttl_s, ranges, split), ttl_s, until)
    return rollups_of(changes.join(members.select("batch_id", "pos", "task_id"), "task_id"),
                      ranges, split, max_members).drop("_carried")


def rollups_of(changes: DataFrame, ranges: int | None = None, split: bool | None = None,
               max_members: int = DEFAULT.max_batch_files) -> DataFrame:
    """Roll-ups after each of the changes (with ``batch_id, pos``).

    A batch holds few members, so the last state of each is one running value, and the
    rule is applied to the array of them in member order.
    """
    place = F.when(F.col("pos").between(0, max_members - 1), F.col("pos")).otherwise(F.raise_error(
        F.concat(F.lit(f"more than {max_members} members in batch "), F.col("batch_id").cast("string"))))
    line = Timeline(["batch_id"], [*ORDER, "kind"], split)
    own = [c for c in changes.columns if c not in ("task_id", "pos", "stage", "status", "error_reason")]
    state = F.struct("stage", "status", "error_reason", (F.col("kind") == 0).alias("alive"))
    df = line.spread(changes.withColumn("pos", place.cast("int")), ranges)
    df = line.window(df, **{
        f"_m{i}": line.running_last(F.when(F.col("pos") == i, state)) for i in range(max_members)})
    alive = F.filter(F.array(*[f"_m{i}" for i in range(max_members)]), lambda m: m["alive"])
    df = df.withColumn("_alive", alive)
    any_of = lambda test: F.exists("_alive", lambda m: F.coalesce(test(m["status"]), F.lit(False)))
    status = F.when(F.size("_alive") == 0, None).when(
        ~any_of(lambda s: ~s.eqNullSafe(F.lit("SUCCESS"))), "SUCCESS").when(
        any_of(lambda s: s == "FAILURE"), "FAILURE").otherwise("ACTIVE")
    earliest = F.array_min(F.transform("_alive", lambda m, i: F.struct(
        dims.stage_rank(m["stage"]).alias("rank"), i.alias("i"), m["stage"].alias("stage"))))
    reasons = F.filter(F.transform("_alive", lambda m: m["error_reason"]), lambda r: r != "")
    return df.select(
        *own, status.alias("status"), earliest["stage"].alias("stage"), F.get(reasons, F.lit(0)).alias("error_reason"),
        F.when(F.size("_alive") == 0, dims.NO_TASKS_FOUND).alias("error"))


def batch_transitions(rollups: DataFrame, ranges: int | None = None,
                      split: bool | None = None) -> DataFrame:
    """Roll-ups that differ from the one before, up to and with the first terminal one.

    When no member is alive any more, that is sent as the last row; a member that starts later
    begins anew.
    """
    return followed_rollups(rollups, ranges, split).filter("_emit").select(*rollups.columns)


def followed_rollups(rollups: DataFrame, ranges: int | None = None, split: bool | None = None) -> DataFrame:
    """Adds ``_emit``, whether a roll-up is sent, and ``_mark``: true where sending ends, false where
    it can begin anew.

    On streams, ``_carried`` rows have in ``_sent`` what was sent last, and in ``_done`` whether
    sending had ended.
    """
    streamed = "_carried" in rollups.columns
    carried = F.col("_carried") if streamed else F.lit(False)
    state = F.struct("status", "stage", "error_reason")
    none_left = F.col("error").isNotNull() if "error" in rollups.columns else F.lit(False)
    mark = F.when(none_left, False).when(is_terminal(F.col("status")), True)
    if streamed:
        mark = F.when(carried, F.coalesce("_done", F.lit(False))).otherwise(mark)
    line = Timeline(["batch_id"], [c for c in (*ORDER, "kind") if c in rollups.columns], split)
    df = line.spread(rollups.withColumn("_mark", mark), ranges)
    last = F.when(carried, F.col("_sent")).otherwise(state) if streamed else state
    df = line.window(
        df, _prev=line.lag(last), _ended=line.running_last(F.col("_mark"), inclusive=False))
    fresh = ~state.eqNullSafe(F.col("_prev"))
    return df.withColumn("_emit", ~carried & fresh & ~F.coalesce("_ended", F.lit(False)))
