"""Streams over growing and replaced files, alarms by timer, and compacted views."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from duetframe.sources import logs
from duetframe.streaming import growing, live

ATTEMPT = ["run_id", "dyad_id", "attempt"]


def turn(d, t, agent="mentor", finish="stop"):
    return json.dumps({"run_id": "r", "dyad_id": d, "attempt": 1, "turn": t, "agent": agent, "finish_reason": finish, "text": "é" * t, "ts": f"2026-01-01T00:{t:02d}:00+0000"}) + "\n"


def append(path, text):
    with open(path, "a", encoding="utf-8") as f:
        f.write(text)


def drained(rows, path, keys, check, mode="update"):
    q = live.run_live(rows, path, keys, check, mode, every="0 seconds")
    q.processAllAvailable()
    q.stop()


def test_a_growing_file_gives_each_whole_line_once_over_restarts(spark, tmp_path):
    log, out, check = tmp_path / "log", f"{tmp_path}/out", f"{tmp_path}/check"
    (log / "r").mkdir(parents=True)
    f = log / "r" / "turns.jsonl"
    rows = [turn("d", t) for t in range(1, 40)]
    f.write_text("".join(rows[:9]) + "[1]\ngarbage\n\n" + rows[9][:25])

    def go(**bounds):
        drained(growing.tail_growing(spark, f"file://{log}", "turns", "turns.jsonl", **bounds).select("turn", "text", "generation"), out, [], check, "append")
        return sorted((r["turn"], r["text"], r["generation"]) for r in live.view(spark, out, []).collect())

    want = lambda n: [(t, "é" * t, 0) for t in range(1, n + 1)]
    assert go(read_bytes=400, task_bytes=90) == want(9)
    append(f, rows[9][25:] + "".join(rows[10:30]))
    (log / "r" / "other.jsonl").write_text(rows[0])  # not of the pattern
    assert go(read_bytes=10, task_bytes=7) == want(30)
    assert go() == want(30)
    append(f, "".join(rows[30:]))
    assert go() == want(39)


def test_a_replaced_file_starts_its_counts_again(spark, tmp_path):
    log, out, check = tmp_path / "log", f"{tmp_path}/out", f"{tmp_path}/check"
    log.mkdir()
    a, b = log / "a.jsonl", log / "b.jsonl"
    a.write_text("".join(turn("d", t) for t in (1, 2, 3)) + turn("d", 4, "seeker") + turn("d", 5, finish="error"))
    b.write_text(turn("d", 6))
    keys = ["file", "generation", *ATTEMPT]

    def go():
        drained(live.progress_by_file(growing.tail_growing(spark, str(log), "turns", "*.jsonl")), out, keys, check)
        return sorted(tuple(r) for r in live.current_progress(live.view(spark, out, keys)).collect())

    assert go() == [("r", "d", 1, 4, "2026-01-01T00:06:00+0000")]
    new = tmp_path / "new"
    new.write_text("".join(turn("e", t) for t in range(1, 9)))
    os.replace(new, a)  # longer than before: only its identity tells
    assert go() == [("r", "d", 1, 1, "2026-01-01T00:06:00+0000"), ("r", "e", 1, 8, "2026-01-01T00:08:00+0000")]
    a.write_text(turn("e", 1))  # shrunk in place
    append(b, turn("d", 7))
    assert go() == [("r", "d", 1, 2, "2026-01-01T00:07:00+0000"), ("r", "e", 1, 1, "2026-01-01T00:01:00+0000")]


def test_line_ends(tmp_path):
    f = tmp_path / "x"
    f.write_bytes(b"ab\ncdefgh\nij")
    with open(f, "rb") as g:
        end = lambda start, limit: growing._line_end(g, start, limit, 12)
        assert [end(0, 12), end(0, 3), end(0, 5), end(3, 5), end(0, 1), end(10, 12), end(3, 10)] == [10, 3, 3, 10, 3, 10, 10]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_a_run_stalls_by_itself_and_goes_on_with_a_new_row(spark, tmp_path, rocks):
    log, out = tmp_path / "log", f"{tmp_path}/out"
    log.mkdir()
    row = lambda run, d, s: json.dumps({"run_id": run, "dyad_id": d, "attempt": 1, "status": s, "ts": "2026-01-01T00:00:00+0000"}) + "\n"
    (log / "s.jsonl").write_text(row("r", "a", "started") + row("r", "b", "started") + row("r", "b", "complete") + row("done", "a", "started") + row("done", "a", "failed"))
    planned = spark.createDataFrame([("r", 3), ("done", 1), ("never", 2)], "run_id string, planned long")
    q = live.run_live(live.alarms(growing.tail_growing(spark, str(log), "status"), stall_seconds=6), out, ATTEMPT, f"{tmp_path}/check", every="1 second")

    def states():
        return {r["run_id"]: tuple(r)[1:] for r in live.liveness(live.view(spark, out, ATTEMPT), planned).collect()}

    def wait(want, seconds=60):
        until = time.time() + seconds
        while time.time() < until:
            if os.path.exists(out) and live._parts(spark, out)[1] and (got := states()) == want:
                return
            assert q.exception() is None
            time.sleep(0.3)
        raise AssertionError((states(), want))

    rest = {"done": ("finished", 1, 0), "never": ("stalled", 0, 0)}
    wait({"r": ("running", 1, 1)} | rest)
    wait({"r": ("stalled", 1, 1)} | rest)  # nothing came: the timers fired
    append(log / "s.jsonl", row("r", "a", "complete"))
    wait({"r": ("pending", 2, 0)} | rest)
    wait({"r": ("stalled", 2, 0)} | rest)
    q.stop()


def test_views_stay_small_and_a_batch_written_again_counts_once(spark, tmp_path):
    path, write = str(tmp_path / "v"), live.upsert(str(tmp_path / "v"), ["k"], compact_every=5)
    for n in range(23):
        write(spark.createDataFrame([(n % 7, n), (100 + n, n)], "k int, x int").coalesce(1), n)
    bases, batches = live._parts(spark, path)
    assert bases == [14, 19] and batches == [*range(15, 23)]
    write(spark.createDataFrame([(22 % 7, 22), (122, 22)], "k int, x int").coalesce(1), 22)
    want = {n % 7: n for n in range(23)} | {100 + n: n for n in range(23)}
    got = live.view(spark, path, ["k"])
    assert {r["k"]: r["x"] for r in got.collect()} == want and got.count() == len(want)
    assert len({f for f in got.inputFiles()}) <= 4 * 1 + 5  # a base, and the batches after it
    os.remove(f"{path}/base=19/_SUCCESS")  # a compaction that was cut off
    assert {r["k"]: r["x"] for r in live.view(spark, path, ["k"]).collect()} == want


def test_a_batch_formula_with_planned_counts(spark):
    states = spark.createDataFrame([("a", "x", 1, True), ("b", "x", 1, False)], "run_id string, dyad_id string, attempt int, ended boolean").withColumn("last_at", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    planned = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1)], "run_id string, planned long")
    early = {r["run_id"]: r["state"] for r in live.liveness(states, planned, F.lit("2026-01-01 00:01:00").cast("timestamp")).collect()}
    assert early == {"a": "pending", "b": "running", "c": "stalled"}
    assert logs.with_place is not None
