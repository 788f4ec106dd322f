"""Progress operators against brute force, on random logs with a dominant key.

Every window operator runs as plain windows and as a cut timeline; both must agree.
"""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docmark import dims
from docmark.operators import carry, scanning, stats, status

T0 = dt.datetime(2024, 1, 1)
STAGES = list(dims.STAGES)
SCHEMA = ("task_id string, event_id long, ts timestamp, op string, stage string, status string, "
          "error_reason string")
SPLITS = [False, True]


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def random_log(seed=3, n=900, terminal=0.06):
    """Events of a few tasks; the first task has a third of them. Ties in time are common."""
    rng = random.Random(seed)
    rows, now = [], 0
    for i in range(n):
        now += rng.choice([0, 0, 1, 5, 40, 400])
        task = "hot" if rng.random() < 0.34 else f"t{rng.randint(0, 12)}"
        op = rng.choices(["init", "advance", "fail"], [0.15, 0.8, 0.05])[0]
        done = rng.random() < terminal
        state = {"init": ("UPLOADED", "PENDING"), "fail": ("PARSING", "FAILURE")}.get(
            op, (rng.choice(STAGES + [None, "ODD"]), "SUCCESS" if done else "ACTIVE"))
        rows.append((task, i, at(now), op, *state, "broken" if op == "fail" else None))
    rng.shuffle(rows)
    return rows


def by_task(rows, key=0):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        out[r[key]].append(r)
    return out


@pytest.fixture(scope="module")
def rows():
    return random_log()


@pytest.fixture(scope="module")
def events(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def sent_rule(log):
    """What a follower of one task is sent."""
    out, last = [], object()
    for r in log:
        n = 0
        if r[4] != (None if not isinstance(last, (str, type(None))) else last):
            n += 1
            out.append((r[0], r[1], r[4], n))
        last = r[4]
        if r[5] in ("SUCCESS", "FAILURE"):
            out.append((r[0], r[1], r[4], n + 1))
            break
    return out


@pytest.mark.parametrize("split", SPLITS)
def test_transitions(events, rows, split):
    got = status.stage_transitions(events, ranges=7, split=split)
    want = {x for log in by_task(rows).values() for x in sent_rule(log)}
    have = [(r.task_id, r.event_id, r.stage, r.emit_no) for r in got.collect()]
    assert set(have) == want and len(have) == len(want)


@pytest.mark.parametrize("split", SPLITS)
def test_terminal_change_is_sent_twice(spark, split):
    log = [("t", 0, at(0), "init", "UPLOADED", "PENDING", None),
           ("t", 1, at(1), "advance", "UPLOADED", "ACTIVE", None),
           ("t", 2, at(2), "advance", "PACKAGING", "SUCCESS", None),
           ("t", 3, at(3), "advance", "PARSING", "ACTIVE", None),
           ("u", 4, at(0), "advance", "PACKAGING", "ACTIVE", None),
           ("u", 5, at(9), "advance", "PACKAGING", "SUCCESS", None)]
    got = status.stage_transitions(spark.createDataFrame(log, SCHEMA), 1, split).collect()
    assert sorted((r.task_id, r.event_id, r.emit_no) for r in got) == [
        ("t", 0, 1), ("t", 2, 1), ("t", 2, 2), ("u", 4, 1), ("u", 5, 1)]


@pytest.mark.parametrize("split", SPLITS)
def test_heartbeats(spark, events, rows, split):
    sent = status.stage_transitions(events, 300, split)
    end = at(20_000)
    got = status.heartbeats(sent, 30, until=F.lit(end), ranges=7, split=split)
    want = set()
    for log in by_task(rows).values():
        times = {r[1]: r for r in log}
        out = sent_rule(log)
        for i, (task, eid, _, _) in enumerate(out):
            if times[eid][5] in ("SUCCESS", "FAILURE"):
                continue
            stop = times[out[i + 1][1]][2] if i + 1 < len(out) else end
            beat = times[eid][2] + dt.timedelta(seconds=30)
            while beat < stop:
                want.add((task, eid, beat))
                beat += dt.timedelta(seconds=30)
    have = [(r.task_id, r.event_id, r.beat_at) for r in got.collect()]
    assert set(have) == want and len(have) == len(want)


def test_heartbeat_bounds_and_cases(spark):
    for bad in (3, 61):
        with pytest.raises(ValueError):
            status.check_heartbeat(bad)
    status.check_heartbeat(30)
    idle = [("t", 0, at(0), "advance", "PARSING", "ACTIVE", None),
            ("t", 1, at(46), "advance", "PACKAGING", "SUCCESS", None)]
    sent = status.stage_transitions(spark.createDataFrame(idle, SCHEMA))
    assert [r.beat_no for r in status.heartbeats(sent).orderBy("beat_no").collect()] == [1, 2, 3]
    busy = [(*r[:2], at(14 * i), *r[3:]) for i, r in enumerate(idle)]
    assert status.heartbeats(status.stage_transitions(spark.createDataFrame(busy, SCHEMA))).isEmpty()
    exact = [(*r[:2], at(15 * i), *r[3:]) for i, r in enumerate(idle)]
    assert status.heartbeats(status.stage_transitions(spark.createDataFrame(exact, SCHEMA))).isEmpty()


def test_long_gap_is_expanded_in_slices(spark):
    idle = [("t", 0, at(0), "advance", "PARSING", "ACTIVE", None),
            ("t", 1, at(25_000 * 5 + 1), "advance", "PACKAGING", "SUCCESS", None)]
    beats = status.heartbeats(status.stage_transitions(spark.createDataFrame(idle, SCHEMA)), 5)
    row = beats.agg(F.count("*").alias("n"), F.min("beat_no").alias("a"), F.max("beat_no").alias("z"),
                    F.count_distinct("beat_at").alias("d")).first()
    assert (row.n, row.a, row.z, row.d) == (25_000, 1, 25_000, 25_000)


def accepted_rule(log, ttl):
    alive, out = None, []
    for r in log:
        if alive is not None and ttl is not None and (r[2] - alive).total_seconds() > ttl:
            alive = None
        if r[3] == "init" or alive is not None:
            alive = r[2]
            out.append(r[1])
    return out


@pytest.mark.parametrize("split", SPLITS)
@pytest.mark.parametrize("ttl", [None, 40, 400, 2_000])
def test_acceptance(events, rows, split, ttl):
    got = status.accepted_events(events, ttl, 300, split)
    want = sorted(e for log in by_task(rows).values() for e in accepted_rule(log, ttl))
    assert sorted(r.event_id for r in got.collect()) == want
    known = status.apply_known_tasks(
        events.filter("op <> 'init'"), events.filter("op = 'init'"), ttl, 300, split)
    inits = {r[1] for r in rows if r[3] == "init"}
    assert sorted(r.event_id for r in known.collect()) == [e for e in want if e not in inits]


@pytest.mark.parametrize("split", SPLITS)
def test_state_ttl(events, rows, split):
    got = {r.event_id: r for r in status.state_ttl(events, 100, 300, split).collect()}
    for log in by_task(rows).values():
        for r, nxt in zip(log, [*log[1:], None]):
            expiry = r[2] + dt.timedelta(seconds=100)
            lapsed = nxt is None or nxt[2] > expiry
            assert got[r[1]].lapsed == lapsed
            assert got[r[1]].valid_until == (expiry if lapsed else nxt[2])


def test_latest_state(events, rows):
    want = {}
    for task, log in by_task(rows).items():
        state = None
        for r in log:
            if r[3] == "init":
                state = (r[4], r[5], None)
            elif state is not None or any(x[3] == "init" for x in log):
                state = (r[4], r[5], r[6] if r[3] == "fail" else (state or (0, 0, None))[2])
        if any(r[3] == "init" for r in log):
            want[task] = state
    got = {r.task_id: (r.stage, r.status, r.error_reason)
           for r in status.latest_state(events).collect()}
    assert got == want


def test_retention(spark):
    df = spark.createDataFrame(
        [("a", at(0), "SUCCESS"), ("b", at(1), "FAILURE"), ("c", at(2), "SUCCESS")],
        "task_id string, finished_at timestamp, status string")
    kept, purged = status.retention(df, F.lit(at(601)), 600)
    assert [r.task_id for r in kept.collect()] == ["c"]
    assert sorted(r.task_id for r in purged.collect()) == ["a", "b"]
    states = spark.createDataFrame([("a",), ("c",)], "task_id string")
    assert [r.task_id for r in status.without_purged(states, purged).collect()] == ["c"]


def test_timeline_marks(spark):
    states = [("p", "SCANNING", "PENDING"), ("a", "PARSING", "ACTIVE"), ("f", "UPLOADED", "FAILURE"),
              ("s", "PACKAGING", "SUCCESS"), ("u", "SUCCESS", "SUCCESS")]
    df = spark.createDataFrame(states, "task_id string, stage string, status string")
    got = defaultdict(list)
    for r in status.stage_timeline(df).orderBy("stage_no").collect():
        got[r.task_id].append(r.mark)
    assert got == {
        "p": ["done", "none", "pending", "pending", "pending"],
        "a": ["done", "done", "active", "pending", "pending"],
        "f": ["failed"] + ["pending"] * 4, "s": ["done"] * 5, "u": ["pending"] * 5}


def rollup_rule(states):
    """Of states (pos, stage, status, reason): counts of statuses, and the least by rank and place."""
    counts = Counter(status for _, _, status, _ in states)
    overall = "FAILURE" if counts["FAILURE"] else "ACTIVE"
    if counts["SUCCESS"] == len(states):
        overall = "SUCCESS"
    known = {s: i for i, s in enumerate(STAGES)}
    _, _, stage = min((known.get(stage, 0), pos, stage) for pos, stage, _, _ in states)
    told = {pos: reason for pos, _, _, reason in states if reason}
    return overall, stage, told[min(told)] if told else None


def test_rollup(spark):
    rng = random.Random(5)
    rows = [(f"b{b}", p, rng.choice([*STAGES, "ODD"]),
             rng.choices(["SUCCESS", "ACTIVE", "FAILURE", "PENDING"], [6, 1, 1, 1])[0],
             rng.choice([None, "", "x", "y"]))
            for b in range(200) for p in range(rng.randint(1, 4))]
    df = spark.createDataFrame(
        rows, "batch_id string, pos int, stage string, status string, error_reason string").repartition(7)
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r[1:])
    got = {r.task_id: (r.status, r.stage, r.error_reason) for r in status.batch_rollup(df).collect()}
    assert got == {k: rollup_rule(sorted(v)) for k, v in groups.items()}


@pytest.mark.parametrize("split", SPLITS)
def test_batch_history(spark, split):
    rng = random.Random(11)
    members = [(f"b{t // 4}", t % 4, f"t{t}") for t in range(24)]
    log, i = [], 0
    for _, _, t in members:
        now = rng.randint(0, 500)
        log.append((t, i, at(now), "init", "UPLOADED", "PENDING", None))
        for _ in range(rng.randint(0, 8)):
            i += 1
            now += rng.choice([0, 3, 200])
            end = rng.random()
            if end < 0.12:
                log.append((t, i, at(now), "fail", "PARSING", "FAILURE", f"why {t}"))
                break
            done = "SUCCESS" if end > 0.75 else "ACTIVE"
            log.append((t, i, at(now), "advance", rng.choice(STAGES), done, None))
            if done == "SUCCESS":
                break
        i += 1
    place = {t: (b, p) for b, p, t in members}
    want = []
    for b in sorted({b for b, _, _ in members}):
        seen, last = {}, None
        for r in sorted((r for r in log if place[r[0]][0] == b), key=lambda r: (r[2], r[1])):
            seen[place[r[0]][1]] = (place[r[0]][1], r[4], r[5], r[6])
            now = rollup_rule([seen[p] for p in sorted(seen)])
            if now != last:
                want.append((b, r[1], *now))
                last = now
            if now[0] in dims.TERMINAL:
                break
    events = spark.createDataFrame(log, SCHEMA).repartition(4)
    m = spark.createDataFrame(members, "batch_id string, pos int, task_id string")
    history = status.rollup_history(events, m, 100, split)
    got = [(r.batch_id, r.event_id, r.status, r.stage, r.error_reason)
           for r in status.batch_transitions(history, 100, split).collect()]
    assert sorted(got) == sorted(want)


def lives_rule(log, ttl, end):
    """The lives of one task: (writes, expiry or None), by a walk along its log."""
    lives, alive = [], None
    for r in log:
        if alive is not None and (r[2] - alive).total_seconds() > ttl:
            lives[-1][1] = alive + dt.timedelta(seconds=ttl)
            alive = None
        if alive is None and r[3] != "init":
            continue
        if alive is None:
            lives.append([[], None])
        lives[-1][0].append(r)
        alive = r[2]
    if alive is not None and alive + dt.timedelta(seconds=ttl) < end:
        lives[-1][1] = alive + dt.timedelta(seconds=ttl)
    return lives


@pytest.mark.parametrize("split", SPLITS)
def test_transitions_end_with_the_state(events, rows, split):
    ttl, end = 300, at(200_000)
    got = status.stage_transitions(events, 7, split, ttl, F.lit(end))
    want = Counter()
    for log in by_task(rows).values():
        for writes, expiry in lives_rule(log, ttl, end):
            want.update((*x, None) for x in sent_rule(writes))
            if expiry and not any(r[5] in dims.TERMINAL for r in writes):
                want[writes[-1][0], writes[-1][1], None, 1, dims.TASK_NOT_FOUND] += 1
    assert Counter((r.task_id, r.event_id, r.stage, r.emit_no, r.error) for r in got.collect()) == want
    assert any(k[4] for k in want)


@pytest.mark.parametrize("split", SPLITS)
def test_batches_lose_members_whose_state_lapses(spark, split):
    rng, ttl, end = random.Random(12), 150, at(3_000)
    places = {f"t{t}": (f"b{t // 4}", t % 4) for t in range(24)}
    log = []
    for task in places:
        now = rng.randint(0, 400)
        for k in range(rng.randint(1, 7)):
            op = rng.choices(["init", "advance", "fail"], [0.2, 0.7, 0.1])[0] if k else "init"
            state = {"init": ("UPLOADED", "PENDING", None), "fail": ("PARSING", "FAILURE", f"why {now}")}.get(
                op, (rng.choice(STAGES), rng.choice(["ACTIVE", "ACTIVE", "SUCCESS"]), None))
            log.append((task, len(log), at(now), op, *state))
            now += rng.choice([0, 20, 100, 200])
    want = []
    changes = defaultdict(list)
    for task, writes in by_task(log).items():
        b, p = places[task]
        for own, expiry in lives_rule(writes, ttl, end):
            reason = None
            for r in own:
                reason = {"init": None, "fail": r[6]}.get(r[3], reason)
                changes[b].append((r[2], r[1], 0, p, (p, r[4], r[5], reason)))
            if expiry:
                changes[b].append((expiry, own[-1][1], 1, p, None))
    for b, rows in changes.items():
        seen, last, ended = {}, None, False
        for ts, event, _, p, state in sorted(rows, key=lambda c: c[:3]):
            seen[p] = state
            alive = [s for _, s in sorted(seen.items()) if s]
            now = (*rollup_rule(alive), None) if alive else (None, None, None, dims.NO_TASKS_FOUND)
            if now != last and not ended:
                want.append((b, event, ts, *now))
            last, ended = now, bool(alive) and (ended or now[0] in dims.TERMINAL)
    m = spark.createDataFrame([(b, p, t) for t, (b, p) in places.items()], "batch_id string, pos int, task_id string")
    history = status.rollup_history(
        spark.createDataFrame(log, SCHEMA).repartition(4), m, 5, split, ttl, F.lit(end))
    got = status.batch_transitions(history, 5, split).select(
        "batch_id", "event_id", "ts", "status", "stage", "error_reason", "error")
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert any(w[-1] for w in want) and any(w[5] for w in want)
    with pytest.raises(Exception, match="more than 3 members"):
        status.rollup_history(spark.createDataFrame(log, SCHEMA), m, max_members=3).collect()


def test_bursts_and_sparse_keys_are_cut_by_rows(spark):
    """Equal times, and a key with far more rows a second than another."""
    rows = [("burst", i, at(0)) for i in range(4_000)] + [("sparse", i, at(86_400 * i)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, event_id long, ts timestamp").repartition(3)
    line = carry.Timeline(["k"], ["ts", "event_id"], large_rows=1_000)
    spread = line.spread(df)
    sizes = [r["count"] for r in spread.groupBy("k", carry.BUCKET).count().collect()]
    assert line.split and max(sizes) < 1_000
    got = line.window(spread, n=line.running_sum(F.lit(1)), prev=line.lag("event_id"), next=line.lead("event_id"))
    assert {(r.k, r.event_id): (r.n, r.prev, r.next) for r in got.collect()} == {
        (k, i): (i + 1, i - 1 if i else None, i + 1 if i + 1 < (4_000 if k == "burst" else 300) else None) for k, i, _ in rows}


def test_barrier(spark):
    rows = [("all", at(0), at(10), "SUCCESS"), ("all", at(0), at(20), "FAILURE"),
            ("late", at(0), at(10), "SUCCESS"), ("late", at(0), at(301), "SUCCESS"),
            ("open", at(5), None, "ACTIVE"), ("open", at(5), at(305), "SUCCESS")]
    df = spark.createDataFrame(
        rows, "batch_id string, started_at timestamp, finished_at timestamp, status string")
    got = {r.batch_id: (r.closes_at, r.timed_out, r.members, r.included)
           for r in status.batch_barrier(df).collect()}
    assert got == {"all": (at(20), False, 2, 1), "late": (at(300), True, 2, 1),
                   "open": (at(305), True, 2, 1)}


def test_expand_and_outputs(spark):
    batches = spark.createDataFrame([("b", '["x","y","z"]'), ("e", "[]")], "batch_id string, task_ids string")
    states = spark.createDataFrame(
        [("z", "SUCCESS"), ("x", "FAILURE")], "task_id string, status string")
    members = status.expand_batches(batches, states)
    assert sorted((r.batch_id, r.pos, r.task_id) for r in members.collect()) == [
        ("b", 0, "x"), ("b", 2, "z")]
    outs = spark.createDataFrame([("z", "z.md"), ("x", "x.md")], "task_id string, file_name string")
    assert [r.file_name for r in status.successful_outputs(members, states, outs).collect()] == ["z.md"]


def test_stats_of_nothing(spark, events):
    none = spark.createDataFrame([], "visitors long")
    zero = spark.createDataFrame([], "conversions long")
    assert tuple(stats.current_stats(none, zero).first()) == (0, 0)
    assert stats.count_visitors(events.withColumnRenamed("task_id", "user_id")).first().visitors == 14


@pytest.mark.parametrize("parts", [1, 3, 10])
def test_increments_of_any_split_give_the_total(spark, tmp_path, parts):
    rng = random.Random(parts)
    log = [(rng.choice([None, *range(150)]), rng.choice(["SUCCESS", "ACTIVE"])) for _ in range(900)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(log)], "i int, user_id long, status string")
    kept = stats.Counters(spark, str(tmp_path))
    assert tuple(kept.current().first()) == (0, 0)
    for n in [*range(parts), 0]:
        kept.add(df.where(F.col("i") % parts == n), n)
    want = len({u for u, _ in log if u is not None}), sum(s == "SUCCESS" for _, s in log)
    assert tuple(kept.current().first()) == want
    guess = kept.current(exact=False).first()
    assert guess.conversions == want[1] and abs(guess.visitors - want[0]) <= 0.05 * want[0]
    alone = stats.totals(stats.counter_increment(df)).first()
    assert tuple(alone) == tuple(guess)


def test_size_check_picks_the_plan(spark, events, rows):
    line = carry.Timeline(["task_id"], ["ts", "event_id"], large_rows=10_000)
    assert carry.BUCKET not in line.spread(events).columns
    assert line.split is False
    line = carry.Timeline(["task_id"], ["ts", "event_id"], large_rows=100)
    df = line.spread(events)
    assert line.split is True
    sizes = df.groupBy("task_id", carry.BUCKET).count().agg(F.max("count").alias("n")).first()
    assert sizes.n < 100 < sum(r[0] == "hot" for r in rows)
    numbered = line.window(df, n=line.running_sum(F.lit(1)))
    want = {r[1]: i + 1 for log in by_task(rows).values() for i, r in enumerate(log)}
    assert {r.event_id: r.n for r in numbered.collect()} == want


@pytest.mark.parametrize("split", SPLITS)
def test_reconnects(spark, split):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.5 else f"c{i % 3}", at(i // 2), i, rng.random() > 0.85)
            for i in range(500)]
    want, fails = {}, defaultdict(int)
    for c, _, i, ok in rows:
        if ok:
            fails[c] = 0
        else:
            want[i] = min(2 ** fails[c], 30)
            fails[c] += 1
    df = spark.createDataFrame(rows, "client_id string, ts timestamp, event_id long, ok boolean")
    got = scanning.reconnect_delays(df.repartition(3), ranges=6, split=split)
    assert {r.event_id: r.delay_s for r in got.collect()} == want


def test_attempts(spark):
    cases = {"ttt": ("unavailable", 3, 9), "ts": ("success", 2, 3), "s": ("success", 1, 0),
             "p": ("unavailable", 1, 0), "ttp": ("unavailable", 3, 9), "tts": ("success", 3, 9),
             "ttts": ("unavailable", 3, 9), "t": ("pending", 1, 3), "sp": ("success", 1, 0),
             "tt": ("pending", 2, 9), "s" + "t" * 500: ("success", 1, 0)}
    full = {"t": "transient", "s": "success", "p": "permanent"}
    rows = [(c, at(i), i, full[x]) for c in cases for i, x in enumerate(c)]
    df = spark.createDataFrame(rows, "file_id string, ts timestamp, event_id long, outcome string")
    got = {r.file_id: (r.verdict, r.attempts_used, r.wait_s)
           for r in scanning.resolve_attempts(df.repartition(3)).collect()}
    assert got == cases


def test_verdicts(spark):
    files = spark.createDataFrame(
        [("ok", True), ("found", True), ("odd", True), ("none", False), ("empty", True), ("first", True)],
        "file_id string, answered boolean")
    results = spark.createDataFrame(
        [("ok", 0, "OK"), ("found", 0, "OK"), ("found", 1, "FOUND"), ("found", 2, "ERROR"),
         ("odd", 0, "ERROR"), ("first", 1, "FOUND"), ("first", 0, "ERROR")],
        "file_id string, ord int, status string")
    got = {r.file_id: r.verdict for r in scanning.scan_verdict(files, results).collect()}
    assert got == {"ok": "clean", "found": "infected", "odd": "unavailable", "none": "unavailable",
                   "empty": "clean", "first": "unavailable"}


def test_signature_scan(spark):
    # the standard antivirus test string, in halves so that scanners leave this file alone
    sample = (r"X5O!P%@AP[4\PZX54(P^)7CC)7}$" + "EICAR-STANDARD-ANTIVIRUS-TEST-FILE!$H+H*").encode()
    rows = [("a", bytearray(b"clean")), ("b", bytearray(b"xx" + sample)), ("c", bytearray(b"known")),
            ("d", bytearray(b"known "))]
    df = spark.createDataFrame(rows, "task_id string, content binary")
    listed = df.filter("task_id = 'c'").select(F.sha2("content", 256).alias("sha256"))
    hits = scanning.signature_scan(df, listed.union(listed), [sample])
    assert sorted((r.task_id, r.error) for r in hits.collect()) == [("b", dims.VIRUS), ("c", dims.VIRUS)]
    clean, infected = scanning.split_by_scan(df, hits)
    assert sorted(r.task_id for r in clean.collect()) == ["a", "d"]
    assert sorted(r.task_id for r in infected.collect()) == ["b", "c"]
