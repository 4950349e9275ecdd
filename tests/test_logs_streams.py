"""Logs on disk: strict and tolerant scans, appended and replaced tables, streams against their batch twins."""

import json

import pytest
from pyspark.sql import functions as F

from duetframe.operators import assignment, attempts
from duetframe.sources import logs, sinks
from duetframe.streaming import live

ROWS = [{"run_id": "r", "dyad_id": d, "attempt": a, "status": s, "ts": f"2026-01-01T00:0{i}:00+0000"} for i, (d, a, s) in enumerate([("a", 1, "started"), ("b", 1, "started"), ("a", 1, "failed"), ("a", 2, "started"), ("b", 1, "complete"), ("a", 2, "complete"), ("c", 1, "started")])]


def test_scans(spark, tmp_path):
    f = tmp_path / "r" / "status.jsonl"
    f.parent.mkdir()
    f.write_text("".join(json.dumps(r) + "\n" for r in ROWS))
    strict = logs.read_log(spark, str(f), "status")
    assert [r["status"] for r in strict.orderBy("pos").collect()] == [r["status"] for r in ROWS]
    assert logs.read_log(spark, str(tmp_path / "none.jsonl"), "status").count() == 0
    assert [r["status"] for r in logs.read_rows_of(spark, str(f), "status", "b").collect()] == ["started", "complete"]
    f.write_text(f.read_text() + '[1]\n"x"\ngarbage\n' + json.dumps(ROWS[0])[:40])
    assert logs.read_log(spark, str(f), "status", strict=False).count() == len(ROWS)
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST"):
        logs.read_log(spark, str(f), "status").collect()
    (run,) = logs.list_runs(spark, str(tmp_path)).collect()
    assert (run["run_id"], run["files"], run["complete"], run["failed"], run["running"]) == ("r", ["status.jsonl"], 2, 0, 1)


def test_the_later_row_of_a_log_of_several_files_counts(spark, tmp_path):
    """The second file is the larger one, which scans read first."""
    row = lambda status, pad="": json.dumps({"run_id": "r", "dyad_id": "a", "attempt": 1, "status": status, "ts": "t", "reason": pad}) + "\n"
    (tmp_path / "part-0.json").write_text(row("complete"))
    (tmp_path / "part-1.json").write_text("".join(row("started", "x" * 500) for _ in range(200)) + row("failed"))
    log = logs.read_log(spark, str(tmp_path), "status")
    assert attempts.latest_status(log).first()["status"] == "failed"
    assert attempts.latest_status(logs.read_log(spark, str(tmp_path), "status", strict=False)).first()["status"] == "failed"
    live.run_to_table(live.resume_index(live.tail(spark, str(tmp_path), "status")), f"{tmp_path}/out", ["run_id", "dyad_id"], f"{tmp_path}/check").awaitTermination()
    assert live.view(spark, f"{tmp_path}/out", ["run_id", "dyad_id"]).first()["status"] == "failed"


def test_liveness(spark):
    at = lambda run, dyad, minute, ended: (run, dyad, 1, ended, f"2026-01-01 00:{minute:02d}:00")
    rows = [at("busy", "a", 30, False), at("busy", "b", 2, True), at("silent", "a", 2, False), at("done", "a", 1, True), at("done", "b", 2, True), at("more", "a", 30, True)]
    states = spark.createDataFrame(rows, "run_id string, dyad_id string, attempt int, ended boolean, last_at string").withColumn("last_at", F.col("last_at").cast("timestamp"))
    got = {r["run_id"]: tuple(r)[1:] for r in live.liveness(states, 2, F.lit("2026-01-01 00:40:00").cast("timestamp")).collect()}
    assert got == {"busy": ("running", 1, 1), "silent": ("stalled", 0, 1), "done": ("finished", 2, 0), "more": ("pending", 1, 0)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, x int")
    for _ in range(2):
        sinks.append_log(df, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4
    sinks.replace_derived(df, f"{tmp_path}/flags")
    sinks.replace_derived(df.where("run_id = 'r1'").selectExpr("run_id", "x + 10 as x"), f"{tmp_path}/flags")
    assert sorted(r["x"] for r in spark.read.parquet(f"{tmp_path}/flags").collect()) == [2, 11]
    config = lambda seed: spark.createDataFrame([("r1", {"run_seed": seed, "concurrency": seed})], "run_id string, config map<string,string>")
    assert sinks.record_runs(config("1"), f"{tmp_path}/runs").count() == 0
    assert sinks.record_runs(config("2"), f"{tmp_path}/runs").count() == 1


@pytest.mark.parametrize("twin", ["resume", "progress"])
def test_streams_equal_their_batch_twins_after_a_restart(spark, tmp_path, twin):
    if twin == "resume":
        kind, rows, view, keys = "status", ROWS, live.resume_index, ["run_id", "dyad_id"]
    else:
        kind, view, keys = "turns", live.progress, ["run_id", "dyad_id", "attempt"]
        rows = [{"run_id": "r", "dyad_id": d, "attempt": 1, "turn": t, "agent": a, "finish_reason": "error" if t == 3 else "stop", "ts": f"2026-01-01T00:0{t}:00+0000"} for d in "ab" for t in (1, 2, 3) for a in ("seeker", "mentor")]
    source = tmp_path / "log"
    source.mkdir()

    def run():
        live.run_to_table(view(live.tail(spark, str(source), kind)), f"{tmp_path}/out", keys, f"{tmp_path}/check").awaitTermination()
        return sorted(map(tuple, live.view(spark, f"{tmp_path}/out", keys).select(*keys, "*").distinct().collect()))

    for i, part in enumerate((rows[:3], rows[3:5])):
        (source / f"{i}.json").write_text("".join(json.dumps(r) + "\n" for r in part))
    run()
    (source / "2.json").write_text("".join(json.dumps(r) + "\n" for r in rows[5:]) + '{"half')
    got = run()
    assert got == run()
    batch = view(logs.read_log(spark, str(source), kind, strict=False))
    assert got == sorted(map(tuple, batch.select(*keys, "*").collect()))


def design(spark, n, modes):
    levels = lambda *names: spark.createDataFrame([(x, x[:6], i, {f"{x}_text": "t"}) for i, x in enumerate(names)], "level string, code string, place int, slots map<string,string>")
    ideologies = ("strong_left", "lean_left", "moderate", "lean_right", "strong_right")
    variants = spark.createDataFrame([(p, f"{p}-{i}", i, {"name": f"N{i}"}) for p in ideologies for i in range(1 if n == 5 else 3)], "parent string, variant string, place int, slots map<string,string>")
    control = {"factor": "ideology", "level": "none", "by": ["topic"], "persona": "Ask.", "reminder": "Ask.", "mode": "reinforced", "n": n}
    factors = {"topic": levels("immigration_enforcement", "decarbonization"), "ideology": spark.createDataFrame([(x, x, i, None) for i, x in enumerate(ideologies)], "level string, code string, place int, slots map<string,string>"), "openness": levels("open", "closed")}
    return assignment.Design(factors, "{name} on {topic}", "{name}", n, 40, modes, ("role", "ideology", variants), control=control)


@pytest.mark.parametrize(("n", "modes", "rows"), [(5, ("reinforced", "once"), 210), (135, ("reinforced",), 2970)])
def test_assignment_sizes_and_seeds(spark, n, modes, rows):
    d = design(spark, n, modes)
    got = assignment.manifest(d, 42).collect()
    assert len(got) == rows == assignment.study_size(d).first()["rows"]
    assert len({r["seed"] for r in got}) == len({r["dyad_id"] for r in got}) == rows and all(0 < r["seed"] < 1 << 31 for r in got)
    assert {r["n"] for r in assignment.summary(assignment.manifest(d, 42)).where("grouping = 'cell'").collect()} == {n * len(modes), n} - ({n} if len(modes) == 1 else set()) | {n}
    some = {r["dyad_id"]: r["seed"] for r in assignment.manifest(d, 42, ["decarbonization/moderate/open"]).collect()}
    assert len(some) == n * len(modes) and some.items() <= {r["dyad_id"]: r["seed"] for r in got}.items()
    assert {r["seed"] for r in assignment.manifest(d, 43).collect()} != {r["seed"] for r in got}


def test_uneven_variants_are_refused(spark):
    with pytest.raises(ValueError, match="evenly"):
        assignment.manifest(design(spark, 7, ("once",)), 1)


def test_ledger_ties(spark):
    df = spark.createDataFrame([("r", "a", 1, "complete", 1), ("r", "a", 1, "started", 2), ("r", None, 1, "started", 3), ("r", "b", None, "started", 4)], "run_id string, dyad_id string, attempt int, status string, pos long")
    assert [tuple(r) for r in attempts.latest_status(df).collect()] == [("r", "a", 1, "started")]


def test_scratch_tables_outlive_their_inputs_until_removed(spark):
    from duetframe import storage

    df = storage.materialize(spark.range(5).withColumnRenamed("id", "x"), "test")
    assert sorted(r["x"] for r in df.collect()) == [0, 1, 2, 3, 4]
    assert storage.scratch_path(spark, "a") != storage.scratch_path(spark, "a")


def test_remove_scratch_takes_all_that_an_application_has_left(spark):
    from duetframe import storage

    df = storage.materialize(spark.range(3), "left")
    assert df.count() == 3
    storage.remove_scratch(spark)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|FileNotFound"):
        df.collect()
    assert storage.materialize(spark.range(2), "again").count() == 2


def test_temporary_tables_go_but_for_those_kept(spark):
    from duetframe import storage

    df = spark.range(3).withColumnRenamed("id", "x")
    with storage.temporary_tables(spark):
        with storage.temporary_tables(spark):
            gone, kept = storage.materialize(df, "gone"), storage.materialize(df, "kept", keep=True)
        assert kept.count() == 3
        with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|FileNotFound"):
            gone.collect()
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|FileNotFound"):
        kept.collect()
