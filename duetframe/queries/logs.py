"""Queries over sources, sinks and streams: relations are written as logs to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assignment, attempts, scores
from ..plans import composites
from ..schemas import SCHEMAS
from ..sources import logs, sinks
from ..storage import scratch_path
from ..streaming import growing, live
from .base import Registry, Tables
from .design import SEED, SQL, design
from .dialogue import OK, RATES, judge
from .ledger import LATEST

R = Registry()


def as_log(df: DataFrame, kind: str) -> DataFrame:
    """The columns of a relation that its log holds, in file order."""
    names = [x.split()[0] for x in SCHEMAS[kind].split(", ")]
    return df.select("pos", *[c for c in names if c in df.columns])


#: Rows of a log file that is digested.
FILE_ROWS = 50_000


def written(t: Tables, kind: str, df: DataFrame, files: int = 4, most_rows: int = 0) -> str:
    """A log of ``df`` as JSON lines in a folder for each run, with at most ``most_rows`` in a file if given; the folder above."""
    path = scratch_path(t.spark, f"log-{kind}")
    as_log(df, kind).repartitionByRange(files, "pos").sortWithinPartitions("pos").drop("pos").write.option("maxRecordsPerFile", most_rows).json(path)
    return path


@R.add("src01_strict_scan", "turns", "SELECT run_id, agent, count(*) AS n, cast(sum(seed) AS bigint) AS seeds FROM turns GROUP BY ALL")
def _(t: Tables):
    rows = logs.read_log(t.spark, written(t, "turns", t.turns), "turns")
    return rows.groupBy("run_id", "agent").agg(F.count("*").alias("n"), F.sum("seed").alias("seeds"))


@R.add("src02_tolerant_scan", "status", "SELECT status, count(*) AS n FROM status WHERE pos % 5 <> 0 GROUP BY 1")
def _(t: Tables):
    path = scratch_path(t.spark, "torn-log")
    line = F.to_json(F.struct("run_id", "dyad_id", "attempt", "status", "ts"))
    torn = F.when(F.col("pos") % 5 != 0, line).when(F.col("pos") % 2 == 0, F.substring(line, F.lit(1), F.char_length(line) - 7)).otherwise("[1, 2]")
    t.status.select(torn.alias("value")).write.text(path)
    return logs.read_log(t.spark, path, "status", strict=False).groupBy("status").agg(F.count("*").alias("n"))


@R.add("src03_rows_of_one_dyad", "turns", "SELECT turn, agent, seed FROM turns WHERE dyad_id = 'd7' ORDER BY pos")
def _(t: Tables):
    return logs.read_rows_of(t.spark, written(t, "turns", t.turns), "turns", "d7").select("turn", "agent", "seed")


@R.add("src01_files_of_one_log", "status", LATEST.format("status") + " SELECT run_id, dyad_id, attempt, status FROM latest")
def _(t: Tables):
    path = scratch_path(t.spark, "log-in-parts")
    rows = as_log(t.status, "status")
    cut = rows.agg(F.max("pos").alias("last")).first()["last"] or 0
    for i, (a, b) in enumerate(((0, 0.02), (0.02, 0.2), (0.2, 2))):  # three files of very different sizes
        rows.where((F.col("pos") >= a * cut) & (F.col("pos") < b * cut)).orderBy("pos").drop("pos").coalesce(1).write.json(f"{path}/{i}")
    return attempts.latest_status(logs.read_log(t.spark, f"{path}/*", "status"))


RUNS_SQL = LATEST.format("status") + """, counts AS (SELECT run_id, count(*) FILTER (WHERE status = 'complete') AS complete, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'started') AS running FROM latest GROUP BY 1)
SELECT run_id, complete, failed, running, m.planned, '2026-01-01' AS started_at, CASE WHEN mentor_path < seeker_path THEN mentor_path || ',' || seeker_path WHEN mentor_path = seeker_path THEN mentor_path ELSE seeker_path || ',' || mentor_path END AS models, true AS has_status
FROM counts JOIN (SELECT run_id, count(DISTINCT dyad_id) AS planned FROM manifest GROUP BY 1) m USING (run_id) JOIN runs USING (run_id)"""


@R.add("src04_runs", "status manifest runs", RUNS_SQL)
def _(t: Tables):
    base = scratch_path(t.spark, "runs")
    as_log(t.status, "status").withColumn("run", F.col("run_id")).repartitionByRange(4, "run", "pos").sortWithinPartitions("run", "pos").drop("pos").write.partitionBy("run").json(base)
    role = lambda r: F.struct(F.lit(None).cast("string").alias("alias"), F.col(f"{r}_path").alias("model_path"), F.col(f"{r}_sha256").alias("model_sha256"), F.lit(None).cast("string").alias("family"))
    manifests = t.runs.select("run_id", F.lit("2026-01-01").alias("started_at"), role("seeker").alias("seeker"), role("mentor").alias("mentor"), F.lit(None).cast("struct<alias:string,model_path:string,model_sha256:string,family:string>").alias("judge"))
    rows = logs.list_runs(t.spark, base, manifests, t.manifest, log="*.json")
    return rows.select("run_id", "complete", "failed", "running", "planned", "started_at", F.array_join("models", ",").alias("models"), (F.size("files") > 0).alias("has_status"))


@R.add("src05_manifests", "runs", "SELECT run_id, role, sha FROM (SELECT run_id, 'seeker' AS role, seeker_sha256 AS sha FROM runs UNION ALL SELECT run_id, 'mentor', mentor_sha256 FROM runs) x")
def _(t: Tables):
    path = scratch_path(t.spark, "manifests")
    role = lambda r: F.struct(F.col(f"{r}_path").alias("model_path"), F.col(f"{r}_sha256").alias("model_sha256"))
    t.runs.select("run_id", role("seeker").alias("seeker"), role("mentor").alias("mentor")).repartition(8, "run_id").write.option("maxRecordsPerFile", 1).json(path)
    return logs.role_info(logs.read_manifest(t.spark, path)).select("run_id", "role", F.col("model_sha256").alias("sha"))


@R.add("src06_instrument", "surveys", "SELECT event_type AS item_id, CASE WHEN event_type IN ('view', 'click') THEN 'ideological' ELSE 'thermometer' END AS battery, cast(row_number() OVER (ORDER BY event_type) - 1 AS int) AS place FROM (SELECT DISTINCT event_type FROM events) e")
def _(t: Tables):
    path = scratch_path(t.spark, "instrument")
    item = F.struct(F.col("item_id").alias("id"), "battery", F.struct(F.col("lo").alias("min"), F.col("hi").alias("max")).alias("scale"), F.lit("How much?").alias("text"))
    t.surveys.select(item.alias("i")).distinct().agg(F.array_sort(F.collect_list("i")).alias("items")).coalesce(1).write.json(path)
    return logs.read_instrument(t.spark, path).select("item_id", "battery", "place")


@R.add("src07_design_files", "", "SELECT 'ideology' AS factor, p AS level FROM (SELECT DISTINCT o_orderpriority AS p FROM orders) o UNION ALL SELECT 'topic', l FROM (SELECT DISTINCT lang AS l FROM documents WHERE lang IS NOT NULL) d")
def _(t: Tables):
    path = scratch_path(t.spark, "grid")
    levels = t.orders.select(F.lit("ideology").alias("k"), F.col("o_orderpriority").alias("v")).union(t.documents.where("lang is not null").select(F.lit("topic"), "lang")).distinct()
    levels.groupBy("k").agg(F.array_sort(F.collect_list("v")).alias("v")).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("factors")).write.json(path)
    return logs.read_grid(t.spark, path).select("factor", "level")


@R.add("src07_catalogue_variants", "", """SELECT o_orderpriority AS parent, place, 'c' || o_custkey AS variant, 'Customer ' || o_custkey AS name, CASE WHEN o_custkey % 2 = 0 THEN 'Even.' END AS backstory
FROM (SELECT o_orderpriority, o_custkey, cast(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) - 1 AS int) AS place FROM (SELECT DISTINCT o_orderpriority, o_custkey FROM orders) x) y""")
def _(t: Tables):
    return logs.read_catalogue(t.spark, catalogue_files(t), lines=True)[0].select("parent", "place", "variant", F.col("slots")["name"].alias("name"), F.col("slots")["backstory"].alias("backstory"))


@R.add("src07_catalogue_anchors", "", "SELECT o_orderpriority AS parent, o_orderstatus AS topic, count(DISTINCT o_custkey % 7) AS n, min(o_custkey % 7) AS least FROM orders GROUP BY ALL")
def _(t: Tables):
    return logs.read_catalogue(t.spark, catalogue_files(t), lines=True)[1].select("parent", "topic", F.size("items").cast("long").alias("n"), F.get("items", F.lit(0)).cast("long").alias("least"))


#: Customer keys of a line of the catalogue, and so its variants at most.
LINE_VARIANTS = 1_000


def catalogue_files(t: Tables) -> str:
    """A catalogue of the customers of each priority, with anchors by order state, as lines of bounded size.

    Variants are sorted by range, so that lines follow each other in their order, by file and in it.
    """
    path = scratch_path(t.spark, "catalogue")
    parent, slug = F.col("o_orderpriority").alias("parent"), F.col("o_custkey")
    role = F.struct(slug.alias("place"), F.concat(F.lit("c"), slug).alias("slug"), F.concat(F.lit("Customer "), slug).alias("name"), F.when(slug % 2 == 0, "Even.").alias("backstory"), F.lit("Stay.").alias("reminder_self"))
    block = F.floor(slug / LINE_VARIANTS).alias("block")  # a key comes once for each priority, so a line has that many at most
    rows = t.orders.select(parent, block, slug).distinct().select("parent", "block", role.alias("r"))
    roles = rows.groupBy("parent", "block").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r.dropFields("place")).alias("v"))
    roles = roles.repartitionByRange("parent", "block").sortWithinPartitions("parent", "block")
    roles.select(F.create_map("parent", "v").alias("roles")).write.json(f"{path}/roles")
    anchors = t.orders.select(parent, F.col("o_orderstatus").alias("topic"), (slug % 7).cast("string").alias("item")).distinct()
    anchors = anchors.groupBy("parent", "topic").agg(F.array_sort(F.collect_set("item")).alias("items"))  # seven at most
    anchors.select(F.create_map("parent", F.create_map("topic", "items")).alias("anchors")).write.json(f"{path}/anchors")
    return f"{path}/*"


@R.add("src07_study_levels", "", """SELECT 'status' AS factor, cast(row_number() OVER (ORDER BY s) - 1 AS int) AS place, s AS level, CASE WHEN s = 'F' THEN 'F' ELSE 'code_' || s END AS code, n FROM (SELECT o_orderstatus AS s, cast(count(*) AS varchar) AS n FROM orders GROUP BY 1) o
UNION ALL SELECT 'lang', cast(row_number() OVER (ORDER BY l) - 1 AS int), l, 'code_' || l, n FROM (SELECT lang AS l, cast(count(*) AS varchar) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1) d""")
def _(t: Tables):
    path = scratch_path(t.spark, "study")
    levels = t.orders.select(F.lit("status").alias("key"), F.col("o_orderstatus").alias("id")).unionAll(t.documents.where("lang is not null").select(F.lit("lang"), "lang"))
    level = F.struct("id", F.when(F.col("id") != "F", F.concat(F.lit("code_"), "id")).alias("code"), F.create_map(F.lit("n"), F.col("n").cast("string")).alias("slots"))
    factors = levels.groupBy("key", "id").agg(F.count("*").alias("n")).select("key", level.alias("l")).groupBy("key").agg(F.array_sort(F.collect_list("l"), lambda a, b: F.when(a["id"] < b["id"], -1).otherwise(1)).alias("levels"))
    factors.agg(F.collect_list(F.struct("key", "levels")).alias("factors")).write.json(path)
    return logs.read_study(t.spark, path).select("factor", "place", "level", "code", F.col("slots")["n"].alias("n"))


@R.add("src08_benchmark_files", "streams", "SELECT model, n, prefill FROM (SELECT model, count(*) AS n, cast(sum(prompt_tokens) AS bigint) AS prefill FROM streams GROUP BY 1) x")
def _(t: Tables):
    path = scratch_path(t.spark, "bench")
    t.streams.select(F.col("model").cast("string").alias("model"), F.col("np").alias("n_parallel"), F.col("prompt_tokens").alias("cold_pp_tokens")).write.json(path)
    rows = logs.read_benchmark(t.spark, path)
    return rows.groupBy(F.col("model").cast("int").alias("model")).agg(F.count("*").alias("n"), F.sum("cold_pp_tokens").alias("prefill"))


@R.add("snk01_append", "turns", "SELECT run_id, count(*) * 2 AS n FROM turns GROUP BY 1")
def _(t: Tables):
    path = scratch_path(t.spark, "appended")
    for _ in range(2):
        sinks.append_log(t.turns.select("run_id", "dyad_id", "turn"), path)
    return t.spark.read.parquet(path).groupBy("run_id").agg(F.count("*").alias("n"))


@R.add("snk02_replace", "turns", "SELECT run_id, CASE run_id WHEN 'r1' THEN count(*) FILTER (WHERE agent = 'seeker') ELSE count(*) END AS n FROM turns GROUP BY 1")
def _(t: Tables):
    path = scratch_path(t.spark, "derived")
    sinks.replace_derived(t.turns.select("run_id", "dyad_id", "agent"), path)
    sinks.replace_derived(t.turns.select("run_id", "dyad_id", "agent").where("run_id = 'r1' and agent = 'seeker'"), path)
    return t.spark.read.parquet(path).groupBy("run_id").agg(F.count("*").alias("n"))


@R.add("snk03_manifest_files", "", None)
def _(t: Tables):
    path = scratch_path(t.spark, "manifest")
    sinks.write_manifest(assignment.manifest(design(t), SEED), path)
    return logs.read_planned(t.spark, f"{path}/manifest").select("line", "dyad_id", "persona_mode", "seed", "n_turns")


R.sql["snk03_manifest_files"] = SQL + "SELECT row_number() OVER (ORDER BY shuffle_key) AS line, dyad_id, persona_mode, seed, 40 AS n_turns FROM planned"


@R.add("snk03_assignment_file", "", None)
def _(t: Tables):
    path = scratch_path(t.spark, "manifest")
    sinks.write_manifest(assignment.manifest(design(t), SEED), path)
    lines = logs.numbered_lines(t.spark, f"{path}/assignment")
    return lines.select("line", F.from_json("value", "grouping string, key string, n bigint").alias("r")).select("line", "r.*")


R.sql["snk03_assignment_file"] = SQL + """SELECT row_number() OVER (ORDER BY "grouping", key) AS line, "grouping", key, n FROM (SELECT 'cell' AS "grouping", cell AS key, count(*) AS n FROM planned GROUP BY cell UNION ALL SELECT 'cell/variant', cell || coalesce('/' || variant, ''), count(*) FROM planned GROUP BY cell, variant UNION ALL SELECT 'mode', persona_mode, count(*) FROM planned GROUP BY persona_mode) g"""


@R.add("snk04_digests", "turns", f"SELECT sha256(string_agg(line, '' ORDER BY pos)) AS sha256, cast(sum(octet_length(encode(line))) AS bigint) AS bytes FROM (SELECT run_id, pos // {FILE_ROWS} AS part, pos, run_id || '|' || dyad_id || '|' || attempt || '|' || turn || '|' || agent || '|' || coalesce(text, '') || chr(10) AS line FROM turns) x GROUP BY run_id, part")
def _(t: Tables):
    path = scratch_path(t.spark, "digested")
    part = F.floor(F.col("pos") / FILE_ROWS).alias("part")
    line = F.concat_ws("|", "run_id", "dyad_id", "attempt", "turn", "agent", F.coalesce("text", F.lit("")))
    rows = t.turns.select("run_id", part, "pos", line.alias("value")).repartition("run_id", "part").sortWithinPartitions("run_id", "part", "pos")
    rows.select("run_id", "part", "value").write.partitionBy("run_id", "part").text(path)
    return sinks.file_digests(t.spark, path).where(F.col("file").startswith("part-")).select("sha256", "bytes")


@R.add("snk05_run_records", "runs", "SELECT run_id FROM runs WHERE run_id = 'r2'")
def _(t: Tables):
    path = scratch_path(t.spark, "records")
    config = lambda odd: t.runs.select("run_id", F.create_map(F.lit("run_seed"), F.when(F.col("run_id") == odd, "8").otherwise("7"), F.lit("now"), F.col("now")).alias("config"))
    sinks.record_runs(config(""), path)
    return sinks.record_runs(config("r2"), path).select("run_id")


def streamed(t: Tables, kind: str, df: DataFrame, updates, keys: list[str], mode: str = "update") -> DataFrame:
    """The view that a stream over a log of several files has made, one file at a time."""
    rows = live.tail(t.spark, written(t, kind, df, files=5), kind)
    out, checkpoint = scratch_path(t.spark, "view"), scratch_path(t.spark, "checkpoint")
    live.run_to_table(updates(rows), out, keys, checkpoint, mode).awaitTermination()
    return live.view(t.spark, out, keys) if keys else t.spark.read.parquet(out).drop("batch")


@R.add("st01_tail", "turns", "SELECT run_id, agent, count(*) AS n FROM turns GROUP BY ALL")
def _(t: Tables):
    rows = streamed(t, "turns", t.turns, lambda s: s.select("run_id", "dyad_id", "attempt", "turn", "agent"), [], "append")
    return rows.groupBy("run_id", "agent").agg(F.count("*").alias("n"))


@R.add("st02_progress", "turns", "SELECT run_id, dyad_id, attempt, count(*) FILTER (WHERE agent = 'mentor' AND finish_reason <> 'error') AS turns_done, max(ts) AS last_ts FROM turns GROUP BY ALL")
def _(t: Tables):
    return streamed(t, "turns", t.turns, live.progress, ["run_id", "dyad_id", "attempt"])


@R.add("st03_score_index", "scores", "SELECT DISTINCT run_id, metric, judge_sha256 FROM scores")
def _(t: Tables):
    return streamed(t, "scores", t.scores, live.score_index, [], "append")


@R.add("st04_resume_index", "status", LATEST.format("status") + " SELECT run_id, dyad_id, attempt, status FROM latest")
def _(t: Tables):
    return streamed(t, "status", t.status, live.resume_index, ["run_id", "dyad_id"])


@R.add("st01_growing_files", "turns", "SELECT run_id, agent, count(*) AS n, cast(sum(seed) AS bigint) AS seeds FROM turns GROUP BY ALL")
def _(t: Tables):
    """The stream is stopped and started again; the second start finds what the first has left, and more files."""
    path, out, checkpoint = scratch_path(t.spark, "growing"), scratch_path(t.spark, "view"), scratch_path(t.spark, "checkpoint")
    rows = as_log(t.turns, "turns").repartitionByRange(4, "pos").sortWithinPartitions("pos").drop("pos")
    for half in (F.col("turn") <= 1, F.col("turn") > 1):
        rows.where(half).write.mode("append").json(path)
        stream = growing.tail_growing(t.spark, path, "turns", "part-*.json", task_bytes=1 << 20).select("run_id", "agent", "seed")
        query = live.run_live(stream, out, [], checkpoint, "append", every="0 seconds")
        query.processAllAvailable()
        query.stop()
    return live.view(t.spark, out, []).groupBy("run_id", "agent").agg(F.count("*").alias("n"), F.sum("seed").alias("seeds"))


@R.add("st02_progress_by_file", "turns", "SELECT run_id, dyad_id, attempt, cast(count(*) FILTER (WHERE agent = 'mentor' AND finish_reason <> 'error') AS bigint) AS turns_done, max(ts) AS last_ts FROM turns GROUP BY ALL")
def _(t: Tables):
    out, keys = scratch_path(t.spark, "view"), ["file", "generation", *ATTEMPT]
    stream = growing.tail_growing(t.spark, written(t, "turns", t.turns, files=5), "turns", "part-*.json")
    query = live.run_live(live.progress_by_file(stream), out, keys, scratch_path(t.spark, "checkpoint"), every="0 seconds")
    query.processAllAvailable()
    query.stop()
    return live.current_progress(live.view(t.spark, out, keys))


STATES = ", counts AS (SELECT run_id, count(DISTINCT dyad_id || '/' || attempt) AS begun, count(DISTINCT CASE WHEN status IN ('complete', 'failed') THEN dyad_id || '/' || attempt END) AS finished FROM status WHERE dyad_id IS NOT NULL AND attempt IS NOT NULL AND status IS NOT NULL {} GROUP BY 1), plan AS (SELECT run_id, count(*) * 2 AS planned FROM manifest GROUP BY 1) SELECT run_id, CASE WHEN {} THEN 'stalled' WHEN begun > finished THEN 'running' WHEN finished < coalesce(planned, 0) THEN 'pending' ELSE 'finished' END AS state, coalesce(finished, 0) AS finished, coalesce(begun - finished, 0) AS running FROM counts FULL JOIN plan USING (run_id)"
LEFT = "(begun IS NULL AND planned > 0 OR begun > finished OR finished < coalesce(planned, 0))"
ATTEMPT = ["run_id", "dyad_id", "attempt"]


def planned_twice(t: Tables) -> DataFrame:
    """Twice as many attempts as the manifest has rows, so that runs without an open attempt are pending."""
    return t.manifest.groupBy("run_id").agg((F.count("*") * 2).alias("planned"))


@R.add("st05_liveness", "status manifest", STATES.format("AND run_id IN ('r1', 'r2')", "begun IS NULL"))
def _(t: Tables):
    """Two of the runs that are planned have begun, and their last rows have just come."""
    states = streamed(t, "status", t.status, live.attempt_states, ATTEMPT).where("run_id in ('r1', 'r2')")
    return live.liveness(states, planned_twice(t), now=F.lit("1970-01-01").cast("timestamp"))


@R.add("st05_pending", "status manifest", STATES.format("AND status IN ('complete', 'failed')", "begun IS NULL"))
def _(t: Tables):
    """Of the ledger only what has ended: nothing runs, and what is left of the plan is pending."""
    states = streamed(t, "status", t.status.where("status in ('complete', 'failed')"), live.attempt_states, ATTEMPT)
    return live.liveness(states, planned_twice(t), now=F.lit("1970-01-01").cast("timestamp"))


@R.add("st05_stalled", "status manifest", STATES.format("", LEFT))
def _(t: Tables):
    """The alarms of a stream to which nothing is added: timers fire, and the view says so."""
    conf, name = t.spark.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = scratch_path(t.spark, "view")
    try:
        stream = live.alarms(live.tail(t.spark, written(t, "status", t.status, files=2), "status", files_per_trigger=2), stall_seconds=2)
        query = live.run_live(stream, out, ATTEMPT, scratch_path(t.spark, "checkpoint"), every="1 second")
        live.await_silence(t.spark, query, out, ATTEMPT)
        query.stop()
    finally:
        conf.set(name, before)
    return live.liveness(live.view(t.spark, out, ATTEMPT), planned_twice(t))


@R.add("pf09_role_info", "runs", "SELECT run_id, seeker_path AS model_path FROM runs")
def _(t: Tables):
    role = lambda r: F.struct(F.lit(None).cast("string").alias("alias"), F.col(f"{r}_path").alias("model_path"), F.col(f"{r}_sha256").alias("model_sha256"), F.lit(None).cast("string").alias("family"))
    rows = t.runs.select("run_id", F.lit("2026-01-01").alias("started_at"), role("seeker").alias("seeker"), role("mentor").alias("mentor"), F.lit(None).cast("struct<alias:string,model_path:string,model_sha256:string,family:string>").alias("judge"))
    return logs.role_info(rows).where("role = 'seeker'").select("run_id", "model_path")


@R.add("rp01_analysis_curves", "scores status dyads", LATEST.format("status") + f", last AS (SELECT run_id, dyad_id, attempt, turn, agent, arg_max(score, pos) AS score FROM scores WHERE metric = 'alignment' AND {OK} AND score IS NOT NULL AND judge_sha256 = sha256('judge-1') GROUP BY ALL) SELECT 'all' AS level, turn, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score) / sqrt(count(*)), 6) AS se FROM last JOIN complete USING (run_id, dyad_id, attempt) GROUP BY turn")
def _(t: Tables):
    return composites.analyze_run(t.dyads, t.status, t.surveys, t.scores, None, "alignment", judge(t))["curves"]


@R.add("rp02_run_summary", "manifest status", "SELECT run_id, planned, seen FROM (SELECT run_id, count(*) AS planned FROM manifest GROUP BY 1) m JOIN (SELECT run_id, count(DISTINCT dyad_id) AS seen FROM status GROUP BY 1) s USING (run_id)")
def _(t: Tables):
    return composites.run_summary(t.dyads, t.status, t.turns, t.scores, t.manifest)["planned"]


@R.add("rp03_dyad_detail", "turns status", "SELECT attempt, turn, agent, cast(row_number() OVER (ORDER BY turn, agent DESC) AS int) AS place FROM turns WHERE dyad_id = 'd7' AND attempt = 2")
def _(t: Tables):
    return composites.dyad_detail(t.dyads, t.status, t.turns, t.surveys, t.scores, "d7")["turns"].select("attempt", "turn", "agent", "place")


@R.add("rp04_flags", "scores status dyads", RATES + " SELECT * FROM counted_flags")
def _(t: Tables):
    return scores.flags(t.dyads, t.status, t.scores, 0.6, run_length=2, judge=judge(t)).drop("topic", "openness", "role", "metric", "threshold", "run_length", "rule").orderBy("dyad_id", "attempt")


@R.add("rp05_agreement", "scores", f", last AS (SELECT run_id, dyad_id, attempt, turn, agent, judge_sha256, arg_max(score, pos) AS score FROM scores WHERE metric = 'line_to_line' AND {OK} AND score IS NOT NULL GROUP BY ALL) SELECT judge_sha256, count(*) AS n, round(avg(score), 6) AS mean FROM last GROUP BY 1")
def _(t: Tables):
    return composites.agreement_report(t.scores, "line_to_line")["per_judge"]


@R.add("rp09_audit_models", "turns runs", "SELECT t.run_id, agent, model_sha256, count(*) AS n FROM turns t JOIN runs r USING (run_id) WHERE model_sha256 <> CASE agent WHEN 'seeker' THEN seeker_sha256 ELSE mentor_sha256 END GROUP BY ALL")
def _(t: Tables):
    return composites.run_audit(t.manifest, t.dyads, t.status, t.turns, t.surveys, t.scores, t.runs, 7, "ideology")["models"]
