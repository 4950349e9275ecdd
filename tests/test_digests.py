"""Digests of a log that is larger than one file should be."""

import hashlib
from pathlib import Path

from duetframe.queries import base, logs
from duetframe.sources import sinks


class Source:
    def __init__(self, spark, turns):
        self.spark, self.turns = spark, turns


def test_logs_are_digested_in_bounded_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(logs, "FILE_ROWS", 100, raising=False)
    monkeypatch.setattr(logs, "scratch_path", lambda spark, name: f"file://{tmp_path}/{name}")
    turns = spark.range(950).selectExpr("id as pos", "'r1' as run_id", "concat('d', id) as dyad_id", "1 as attempt", "2 as turn", "'mentor' as agent", "'é' as text")
    monkeypatch.setattr(base, "Tables", lambda spark, sf_dir: Source(spark, turns))
    got = {(r["sha256"], r["bytes"]) for r in logs.R.queries["snk04_digests"](spark, "").collect()}
    files = [f.read_bytes() for f in Path(tmp_path).rglob("part-*")]
    files = [f for f in files if f]
    assert got == {(hashlib.sha256(f).hexdigest(), len(f)) for f in files}
    assert max(f.count(b"\n") for f in files) <= 100 and len(files) >= 10
    assert sorted(x.decode().split("|")[1] for f in files for x in f.splitlines()) == sorted(f"d{i}" for i in range(950))


def test_many_files_share_tasks_and_are_not_listed_on_the_driver(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"run=a%2F{i % 3}" / f"part={i}").mkdir(parents=True)
        (tmp_path / f"run=a%2F{i % 3}" / f"part={i}" / "part-0").write_bytes(b"%d" % i)
        (tmp_path / f"run=a%2F{i % 3}" / f"part={i}" / ".part-0.crc").write_bytes(b"x")
    got = sinks.file_digests(spark, str(tmp_path))
    assert {r["sha256"] for r in got.collect()} == {hashlib.sha256(b"%d" % i).hexdigest() for i in range(300)}
    assert got.count() == 300 and got.rdd.getNumPartitions() <= 8
    (tmp_path / "none").mkdir()
    assert sinks.file_digests(spark, str(tmp_path / "none")).count() == 0
    single = f"{tmp_path}/run=a%2F1/part=1/part-0"
    assert [tuple(r) for r in sinks.file_digests(spark, single).select("file", "bytes").collect()] == [("part-0", 1)]
