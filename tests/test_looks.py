"""Order-dependent operators against plain loops, with chunks small enough to be crossed."""

from __future__ import annotations

import inspect
import random

import pytest
from pyspark.sql import functions as F

from stowage.operators import longkeys as K, readiness as R
from stowage.operators.longkeys import mark_runs, time_chunk
from stowage.operators.progress import grid_rows, stalled, trim_finished
from stowage.schema import Readiness as X
from stowage.streaming.readiness import Gate

LOOKS = "path string, length bigint, probe int, observed_ms bigint, seq bigint"


def track(looks, quiet):
    """The tracker, one look at a time."""
    state, out = {}, []
    for path, length, probe, now, seq in sorted(looks, key=lambda r: (r[3], r[4])):
        key, known = path.lower(), state.get(path.lower())
        if probe in (1, 5):
            state.pop(key, None)
            out.append((seq, probe, None))
        elif known is None or known[0] != length:
            state[key] = (length, now)
            out.append((seq, X.SETTLING if known is None else X.GROWING, 0))
        elif probe == 2:
            out.append((seq, X.LOCKED, now - known[1]))
        elif now - known[1] < quiet:
            out.append((seq, X.SETTLING, now - known[1]))
        else:
            state.pop(key)
            out.append((seq, X.READY, now - known[1]))
    return sorted(out)


def random_looks(seed, count, paths, step):
    """Most looks fall on the first path."""
    rng, now, looks = random.Random(seed), 1_700_000_000_000, []
    lengths = [0] * paths
    for seq in range(count):
        now += rng.randrange(0, step)
        p = 0 if rng.random() < 0.5 else rng.randrange(paths)
        if rng.random() < 0.15:
            lengths[p] = rng.randrange(3)
        name = f"F{p}.raw" if rng.random() < 0.3 else f"f{p}.raw"
        probe = rng.choices([0, 2, 1, 5], [12, 4, 1, 1])[0]
        looks.append((name, lengths[p], probe, now, seq))
    return looks


@pytest.mark.parametrize("seed, quiet, width", [
    (1, 10_000, 10_000), (2, 10_000, 25_000), (3, 40_000, 40_000), (4, 1, 5_000), (5, 3_000, 10**9)])
def test_readiness_matches_the_loop(rows, seed, quiet, width):
    looks = random_looks(seed, 600, 4, 3_000)
    got = R.readiness(rows(LOOKS, *looks), quiet, width).select("seq", "reason", "quiet_ms").collect()
    assert sorted((r.seq, r.reason, r.quiet_ms) for r in got) == track(looks, quiet)


def test_quiet_period_examples(rows):
    looks = [("a", 5, 0, 0, 0), ("a", 5, 0, 9_000, 1), ("a", 5, 0, 11_000, 2),
             ("b", 5, 0, 0, 3), ("b", 6, 0, 9_000, 4), ("b", 6, 0, 11_000, 5), ("b", 6, 0, 19_000, 6),
             ("c", 1, 2, 0, 7), ("c", 1, 2, 60_000, 8), ("c", 1, 0, 61_000, 9)]
    got = R.with_detail(R.readiness(rows(LOOKS, *looks))).orderBy("seq").collect()
    assert [r.reason for r in got] == [4, 4, 0, 4, 3, 4, 0, 4, 2, 0]
    assert got[1].detail == "Unchanged for 9s; waiting for 10s."
    assert got[4].detail == "Still being written (5 to 6 bytes since the last check)."


def test_forty_five_minutes_of_holding_release_once(rows):
    looks = [("run.raw", 7, 2, i * 60_000, i) for i in range(45)] + [("run.raw", 7, 0, 45 * 60_000, 45)]
    got = [r.reason for r in R.readiness(rows(LOOKS, *looks)).orderBy("seq").collect()]
    assert got.count(X.READY) == 1 and got[-1] == X.READY


@pytest.mark.parametrize("seed, window", [(1, 1000), (2, 5000), (3, 250)])
def test_suppressed_and_thinned_match_the_loop(rows, seed, window):
    rng, now, data = random.Random(seed), 0, []
    for seq in range(900):
        now += rng.choice([0, 50, 200, 400, 900, 2500])
        data.append((f"n{0 if rng.random() < 0.6 else rng.randrange(5)}", "changed", False, now, seq))
    last, kept, thin_last, thin_kept = {}, [], {}, []
    for path, _, _, ts, seq in data:
        if path not in last or ts - last[path] >= window:
            last[path] = ts
            kept.append(seq)
        if path not in thin_last or ts - thin_last[path] >= window or seq % 50 == 0:
            thin_last[path] = ts
            thin_kept.append(seq)
    frame = rows("path string, kind string, is_dir boolean, ts_ms bigint, seq bigint", *data)
    got = R.suppress_repeats(frame, window)
    assert sorted(r.seq for r in got.select("seq").collect()) == kept
    reports = frame.select(F.col("path").alias("local_path"), "ts_ms", "seq",
                           F.when(F.col("seq") % 50 == 0, 10).otherwise(1).alias("bytes"),
                           F.lit(10).alias("total"))
    thinned = R.thin_progress(reports, window)
    assert sorted(r.seq for r in thinned.select("seq").collect()) == thin_kept


@pytest.mark.parametrize("width", [1, 7, 50, 10_000])
def test_runs_cross_chunks(rows, width):
    rng = random.Random(width)
    data = [(f"k{rng.randrange(2)}", t, rng.choice(["a", "a", "a", "b", None])) for t in range(300)]
    expected, seen = [], {}
    for key, t, value in data:
        run, start, position, before = seen.get(key, (0, None, 0, None))
        first = key not in seen
        if first or before != value:
            seen[key] = (run + 1, t, 1, value)
        else:
            seen[key] = (run, start, position + 1, value)
        expected.append((key, t, *seen[key][:3], None if first else before))
    got = mark_runs(rows("k string, t bigint, v string", *data), "k", ["t"], time_chunk("t", width),
                    F.col("v"), F.col("t"))
    found = got.select("k", "t", "run", "run_start", "position", "previous").collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected


def test_streak_hands_back(rows):
    verdicts = [("a", i, i, X.LOCKED) for i in range(9)] + [("a", 9, 9, X.GROWING), ("a", 10, 10, X.LOCKED)]
    got = R.locked_streak(rows("path string, observed_ms bigint, seq bigint, reason int", *verdicts),
                          max_checks=3, width_ms=2).orderBy("seq").collect()
    assert [r.streak for r in got] == [1, 2, 3, 4, 1, 2, 3, 4, 1, 0, 1]
    assert [r.seq for r in got if r.handed_back] == [3, 7]


def test_islands_and_deadline(rows):
    looks = [("a", 1, 0, 0, 0), ("a", 1, 0, 5, 1), ("a", 2, 0, 9, 2), ("a", 2, 1, 10, 3), ("a", 2, 0, 12, 4),
             ("b", 1, 5, 3, 5), ("c", 4, 2, 1, 6), ("c", 4, 2, 50, 7)]
    frame = rows(LOOKS, *looks)
    islands = R.stability_islands(frame, width_ms=4).orderBy("path_key", "run").collect()
    assert [(r.path_key, r.length, r.first_ms, r.last_ms, r.looks) for r in islands] == [
        ("a", 1, 0, 5, 2), ("a", 2, 9, 9, 1), ("a", 2, 12, 12, 1), ("c", 4, 1, 50, 2)]
    fates = {r.path: (r.outcome, r.reason) for r in R.gate_bounded(frame, 60, quiet_ms=5).collect()}
    assert fates == {"a": ("released", 0), "b": ("abandoned", 5), "c": ("waiting", 2)}


def test_gate_hands_back_after_too_many_locked_looks():
    gate, state, seen = Gate(10_000, 3), None, []
    for now in range(0, 8_000, 1_000):
        reason, _, _, state = gate._look(state, 5, X.LOCKED, now)
        if state is not None and state[2] > gate.max_checks:
            seen.append((now, reason))
            state = None
    assert seen == [(4_000, X.LOCKED)]


PROGRESS = "local_path string, state int, bytes bigint, seq bigint, ts_ms bigint"


def test_grid_keeps_what_is_unresolved(rows):
    reports = [(f"f{i}", 4, 1, i, i) for i in range(6)] + [("x", 9, 1, 6, 6), ("y", 2, 1, 7, 7)]
    reports += [("f0", 5, 1, 8, 8), ("f1", 2, 1, 9, 9), ("f1", 4, 1, 10, 10)]
    grid = grid_rows(rows(PROGRESS, *reports))
    entered = {r.local_path: r.entered_seq for r in grid.collect()}
    assert entered["f0"] == 0 and entered["f1"] == 10 and entered["y"] == 7
    assert {r.local_path for r in trim_finished(grid, 4).collect()} == {"x", "y", "f1", "f5"}
    assert {r.local_path for r in trim_finished(grid, 1).collect()} == {"x", "y"}


def test_stalled(rows):
    reports = [("a", 2, 10, 0, 0), ("a", 2, 10, 1, 100_000), ("b", 2, 5, 2, 0), ("b", 2, 6, 3, 100_000),
               ("c", 4, 9, 4, 0)]
    got = stalled(rows(PROGRESS, *reports), 130_000).collect()
    assert [(r.local_path, r.last_change_ms, r.idle_ms) for r in got] == [("a", 0, 130_000)]


def replayed(rows, wait, restart):
    """(code, since) of rows (key, t, fires, forced) in order, one by one."""
    out, last, since = [], None, None
    for key, t, fires, forced in rows:
        since, last = (since if key == last else None), key
        found = since
        if forced == K.FORCE_CLEAR:
            code, since = K.CLEAR, None
        elif forced == K.FORCE_START or since is None:
            code, since = K.START, t
        elif fires and t - since >= wait:
            code, since = K.FIRE, t if restart else None
        else:
            code = K.HOLD
        out.append((code, found))
    return out


@pytest.mark.parametrize("restart", [True, False])
@pytest.mark.parametrize("hot", [True, False])
def test_timers_across_parts(spark, restart, hot):
    rng = random.Random(hot * 2 + restart)
    keys = ["hot"] * 1500 if hot else [f"k{rng.randint(0, 12):02}" for _ in range(1500)]
    rows = sorted((key, rng.randint(0, 6000), i, rng.random() < 0.8, rng.choice((0,) * 40 + (1, 2))) for i, key in enumerate(keys))
    want = replayed([(k, t, f, g) for k, t, _, f, g in rows], 25, restart)
    frame = spark.createDataFrame(rows, "key string, t bigint, seq bigint, fires boolean, forced int")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        done = K.run_cycles(frame, "key", "t", "seq", 25, F.col("fires"), F.col("forced"), restart).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [(r.code, r.since) for r in sorted(done, key=lambda r: (r.key, r.t, r.seq))] == want
    assert "collect_list" not in inspect.getsource(K)


@pytest.fixture
def many_parts(spark):
    """Forty parts, however small."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    yield
    for key, value in was.items():
        spark.conf.set(key, value)


def test_one_path_in_one_hour_goes_through_many_parts(spark, many_parts):
    """Looks of one path within an hour are spread, and their runs, verdicts and timers come out as one by one."""
    looks = random_looks(11, 3000, 1, 2_000)
    assert looks[-1][3] - looks[0][3] < 3_600_000
    frame = spark.createDataFrame(looks, LOOKS)
    sizes = [r["count"] for r in K.in_parts(frame.withColumn("k", F.lit("f")), "k", ["observed_ms", "seq"]).groupBy("_part").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 5 * 3000 / 40
    got = R.readiness(frame, 9_000).select("seq", "reason", "quiet_ms").collect()
    assert sorted((r.seq, r.reason, r.quiet_ms) for r in got) == track(looks, 9_000)

    islands, last = [], None
    for path, length, probe, now, _ in looks:
        sight = None if probe in (1, 5) else length
        if sight is not None and sight == last:
            islands[-1][2:] = [now, islands[-1][3] + 1]
        elif sight is not None:
            islands.append([length, now, now, 1])
        last = sight
    found = R.stability_islands(frame).orderBy("run").collect()
    assert [[r.length, r.first_ms, r.last_ms, r.looks] for r in found] == islands

    streak, want = 0, []
    for seq, reason, _ in track(looks, 9_000):
        streak = streak % 4 + 1 if reason == X.LOCKED else 0
        want.append((seq, streak, streak > 3))
    verdicts = R.readiness(frame, 9_000)
    assert sorted((r.seq, r.streak, r.handed_back) for r in R.locked_streak(verdicts, 3).collect()) == want


def test_exits_are_chained_in_tasks(spark, many_parts):
    """Nothing but two numbers for each part comes to the driver."""
    assert "times" not in inspect.getsource(K._entries).split("told = ")[-1].split("collect")[-1]
    rows = sorted((key, t, t, t % 3 > 0, 0) for key in ("a", "b") for t in range(0, 9000, 7))
    frame = spark.createDataFrame(rows, "key string, t bigint, seq bigint, fires boolean, forced int")
    for wait, restart in ((5, True), (2_000, True), (2_000, False), (60_000, True)):
        done = K.run_cycles(frame, "key", "t", "seq", wait, F.col("fires"), F.col("forced"), restart).collect()
        want = replayed([(k, t, f, g) for k, t, _, f, g in rows], wait, restart)
        assert [(r.code, r.since) for r in sorted(done, key=lambda r: (r.key, r.t))] == want


def gated(looks, quiet, most):
    """The gate, one look at a time: (seq, reason, quiet time, locked looks, handed back)."""
    gate, states, out = Gate(quiet, most), {}, []
    for path, length, probe, now, seq in sorted(looks, key=lambda r: (r[3], r[4])):
        reason, _, still, state = gate._look(states.get(path.lower()), length, probe, now)
        checks = state[2] if state is not None else 0
        back = checks > most
        states[path.lower()] = None if back else state
        out.append((seq, reason, still, checks, back))
    return sorted(out)


@pytest.mark.parametrize("paths, most, quiet", [(1, 0, 4_000), (1, 2, 9_000), (3, 1, 2_000), (1, 6, 60_000)])
def test_a_hand_back_forgets_the_file(spark, many_parts, paths, most, quiet):
    """Streaks of locked looks that end in a hand-back within a part, at its border and across many."""
    rng = random.Random(most)
    looks = random_looks(most + paths, 1500, paths, 2_000)
    stretch = 0
    for i, (path, length, probe, now, seq) in enumerate(looks):
        stretch = rng.choice([0, 3, 40, 200]) if stretch == 0 and rng.random() < 0.05 else max(stretch - 1, 0)
        looks[i] = (path, length, 2 if stretch else probe, now, seq)
    frame = spark.createDataFrame(looks, LOOKS)
    verdicts = R.readiness(frame, quiet, max_checks=most)
    streaks = {r.seq: (r.streak, r.handed_back) for r in R.locked_streak(verdicts, most).collect()}
    got = sorted((r.seq, r.reason, r.quiet_ms, *streaks[r.seq]) for r in verdicts.collect())
    want = gated(looks, quiet, most)
    assert got == want and sum(w[4] for w in want) > 5
