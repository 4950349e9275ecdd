"""Digests, write-once records, numbered lines, canonical JSON and slot sources."""

import hashlib
import json
import threading

import pytest
from pyspark.sql import functions as F

from duetframe.functions import scalars
from duetframe.operators import assignment, audits
from duetframe.sources import files, logs, sinks


def test_digests_of_files_beyond_two_gigabytes(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "small.jsonl").write_bytes(b"x" * 10)
    (tmp_path / "empty").write_bytes(b"")
    with open(tmp_path / "large", "wb") as f:
        f.truncate((2 << 30) + 5)  # a hole: no disk
    got = {r["file"]: (r["bytes"], r["sha256"]) for r in sinks.file_digests(spark, str(tmp_path)).collect()}
    h = hashlib.sha256()
    for _ in range(1 << 11):
        h.update(bytes(1 << 20))
    h.update(bytes(5))
    assert got == {"small.jsonl": (10, hashlib.sha256(b"x" * 10).hexdigest()), "empty": (0, hashlib.sha256(b"").hexdigest()), "large": ((2 << 30) + 5, h.hexdigest())}


def test_one_of_many_writers_creates_a_record(tmp_path):
    made, path = [], f"{tmp_path}/d/r.json"
    threads = [threading.Thread(target=lambda i=i: made.append((files.create_once(path, f"{i}".encode() * 1000), i))) for i in range(16)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    (winner,) = [i for ok, i in made if ok]
    with open(path) as f:
        assert f.read() == f"{winner}" * 1000


def test_a_store_creates_once(spark, tmp_path):
    path = f"file://{tmp_path}/x/r.json"
    assert sinks.create_in_store(spark, path, b"a") and not sinks.create_in_store(spark, path, b"b")
    assert (tmp_path / "x" / "r.json").read_bytes() == b"a" and not list((tmp_path / "x").glob("*.draft"))


def config(spark, **seeds):
    return spark.createDataFrame([(k, {"run_seed": v, "concurrency": v}) for k, v in seeds.items()], "run_id string, config map<string,string>")


def test_of_two_writers_of_a_run_one_has_a_conflict(spark, tmp_path, monkeypatch):
    path, before = f"{tmp_path}/runs", sinks.stored_runs
    assert sinks.record_runs(config(spark, a="1", b="1"), path).count() == 0
    assert sinks.record_runs(config(spark, a="1", c="1"), path).count() == 0  # the same again, and a new one
    assert sorted(r["run_id"] for r in before(spark, path).collect()) == ["a", "b", "c"]

    def late(spark, path):  # another writer comes between the look and the creation
        rows = before(spark, path).collect()
        monkeypatch.setattr(sinks, "stored_runs", before)
        files.create_once(f"{path}/d.json", json.dumps({"run_id": "d", "config": {"run_seed": "9"}}).encode())
        return spark.createDataFrame(rows, sinks.RECORD)

    monkeypatch.setattr(sinks, "stored_runs", late)
    assert [r["run_id"] for r in sinks.record_runs(config(spark, d="1", e="1"), path).collect()] == ["d"]
    assert [r["run_id"] for r in sinks.record_runs(config(spark, a="2", f="1"), path).collect()] == ["a"]
    assert "f" not in {r["run_id"] for r in before(spark, path).collect()}
    assert sinks.record_runs(config(spark, **{"../g h": "1"}), path).count() == 0 and not list(tmp_path.glob("g*"))


def test_lines_are_numbered_over_files_and_blocks(spark, tmp_path):
    parts = [[f"{i}.{k}" if (i + k) % 5 else "" for k in range(n)] for i, n in enumerate((400, 1, 0, 1500, 3))]
    for i, p in enumerate(parts):
        (tmp_path / f"part-{i}.json").write_text("".join(x + "\n" for x in p))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # many blocks, dealt out by size
    try:
        got = {r["line"]: r["value"] for r in logs.numbered_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == dict(enumerate((x for p in parts for x in p), 1))


def test_a_manifest_row_outside_the_grid_says_its_line(spark, tmp_path):
    ok = {"topic": "t", "ideology": "i", "openness": "o", "role": "r"}
    rows = [ok, {**ok, "ideology": "none", "openness": None, "role": None}, {**ok, "topic": "x"}, {**ok, "role": ""}, {**ok, "ideology": "none"}]
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps({"run_id": "r", "dyad_id": f"d{i}", "condition": c}) + ("\n" if i == 1 else "") for i, c in enumerate(rows)) + "\n")
    levels = spark.createDataFrame([("topic", "t"), ("ideology", "i"), ("openness", "o")], "factor string, level string")
    got = audits.conditions_outside(logs.read_planned(spark, f"{tmp_path}/m.jsonl"), levels).collect()
    assert sorted((r["line"], r["dyad_id"], r["reason"]) for r in got) == [(4, "d2", "topic not in the grid"), (5, "d3", "treated row without a role"), (6, "d4", "control with openness or role")]


@pytest.mark.parametrize(("text", "want"), [
    ('{"b": {"z": 1, "a": [ {"y": null, "x": true}, 2 ]}, "a": "é\\n"}', '{"a":"é\\n","b":{"a":[{"x":true,"y":null},2],"z":1}}'), ("[]", "[]"), ('{"a":{}}', '{"a":{}}'), ('{"B":1,"a":2,"10":3,"9":4}', '{"10":3,"9":4,"B":1,"a":2}'), ("{half", None), (None, None)])
def test_canonical_json(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(scalars.canonical_json(F.col("t")).alias("c"), scalars.canonical_json_digest(F.col("t")).alias("d"))
    assert tuple(df.first()) == (want, None if want is None else hashlib.sha256(want.encode()).hexdigest())


def small_design(spark, **changes):
    level = lambda names, slots: spark.createDataFrame([(n, n, i, {s: "x" for s in slots}) for i, n in enumerate(names)], "level string, code string, place int, slots map<string,string>")
    variants = spark.createDataFrame([("l", "v1", 0, {"name": "N"}), ("r", "v2", 0, {"name": "M", "age": "9"})], "parent string, variant string, place int, slots map<string,string>")
    table = spark.createDataFrame([("t", ["a", "b"]), ("u", ["c"])], "topic string, items array<string>")
    given = {
        "factors": {"topic": level("tu", ["long"]), "side": level("lr", [])}, "persona": "{name} {facts} on {topic} {hello}", "reminder": "{age}", "n_per_cell": 1, "n_turns": 2, "nested": ("role", "side", variants),
        "tables": {"facts": (("topic",), " ", "fact_", table)}, "derived": {"hello": "Hi {long}"}, "control": {"factor": "side", "level": "none", "by": ["topic"], "persona": "{hello}", "reminder": "{topic}", "mode": "once", "n": 1}}
    return assignment.Design(**(given | changes))


def test_slots_of_a_sound_design(spark):
    d = small_design(spark)
    assert audits.unused_slots(d).count() == audits.clashing_slots(d).count() == audits.unavailable_slots(d).count() == 0
    control = {(r["slot"], r["source"]) for r in audits.slot_sources(d).where("cells = 'control'").collect()}
    assert control == {("topic", "factor:topic"), ("long", "level:topic"), ("hello", "derived")}


def test_slots_of_a_flawed_design(spark):
    c = {"factor": "side", "level": "none", "by": ["topic"], "persona": "{hello} {fact_1} {deep}", "reminder": "{topic}", "mode": "once", "n": 1}
    d = small_design(spark, persona="{nme} {hello}", derived={"hello": "Hi {later}", "later": "{topic}", "deep": "{hello}", "age": "9"}, control=c)
    assert {tuple(r) for r in audits.unused_slots(d).collect()} == {("name", "variant:role"), ("long", "level:topic")}
    assert {(r["slot"], tuple(r["sources"])) for r in audits.clashing_slots(d).collect()} == {("age", ("derived", "variant:role"))}
    got = {tuple(r) for r in audits.unavailable_slots(d).collect()}
    assert got == {("derived.hello", "later", "not defined by anything before"), ("templates.persona", "nme", "not defined"), ("control.persona", "fact_1", "not available in the control"), ("control.persona", "deep", "not available in the control")}


def test_a_catalogue_in_lines_equals_the_catalogue_in_one_object(spark, tmp_path):
    role = lambda i: {"slug": f"s{i}", "name": f"n{i}", "backstory": None, "reminder_self": "r"}
    roles, anchors = {"left": [role(i) for i in range(25)], "right": [role(i) for i in range(7)]}, {"left": {"a": ["x", "y", "z"], "b": []}}
    (tmp_path / "whole.json").write_text(json.dumps({"roles": roles, "anchors": anchors}, indent=1))
    (tmp_path / "lines").mkdir()
    parts = [{"roles": {k: v[i:i + 4] for k, v in roles.items() if v[i:i + 4]}} for i in range(0, 25, 4)] + [{"anchors": {"left": {"a": ["x", "y"]}}}, {"anchors": {"left": {"b": [], "a": ["z"]}}}]
    for i in range(3):
        (tmp_path / "lines" / f"part-{i}.json").write_text("".join(json.dumps(p) + "\n" for p in parts[3 * i:3 * i + 3]))
    whole, lines = logs.read_catalogue(spark, str(tmp_path / "whole.json")), logs.read_catalogue(spark, str(tmp_path / "lines"), lines=True)
    for a, b in zip(whole, lines, strict=True):
        assert a.dtypes == b.dtypes and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert whole[0].count() == 32 and {(r["topic"], *r["items"]) for r in lines[1].collect()} == {("a", "x", "y", "z"), ("b",)}
