"""Scans of run logs: JSON lines in a folder for each run, with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import status_label
from ..operators.attempts import clean_ledger
from ..schemas import BENCH, INSTRUMENT, MANIFEST, PLANNED, SCHEMAS
from ..storage import materialize

CORRUPT = "_corrupt_record"


POS = "struct<file:string,start:bigint,row:bigint>"


def with_place(df: DataFrame, row: Column | None = None) -> DataFrame:
    """``pos``: a row's place in its log, which decides which of two rows is the later one.

    The files of a log follow each other by name, blocks of a file by where they start, rows of a block by their order. The
    number of a row alone would not do: scans deal files out by size. ``row`` replaces that number where there is none, as in
    a stream.
    """
    row = F.monotonically_increasing_id() if row is None else row
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), row.alias("row"))
    return df.select("*", place.alias("pos"))


def read_log(spark: SparkSession, path: str, kind: str, strict: bool = True) -> DataFrame:
    """SRC-1, SRC-2: the rows of a log. Strict: a bad line is an error. Else lines that are no JSON object, and half-written
    last ones, are left out. A path that matches nothing has no rows."""
    schema = SCHEMAS[kind]
    try:
        if strict:
            return with_place(spark.read.schema(schema).option("mode", "FAILFAST").json(path))
        lines = with_place(spark.read.text(path))
    except Exception as e:  # a run without this log yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, pos {POS}")
    rows = lines.where(F.trim("value") != "").select("pos", F.from_json("value", f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT}).alias("r")).where(f"r.{CORRUPT} is null")
    return rows.select("r.*", "pos").drop(CORRUPT)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of a text, numbered from 1 over its files by name, empty ones counted.

    Tasks count the lines of their blocks; what comes before a block is a sum over these counts, a row for each block, and
    a line's number is that plus its place in the block. No task holds more than a block.
    """
    lines = materialize(with_place(spark.read.text(path)), "lines")
    blocks = lines.groupBy("pos.file", "pos.start").agg(F.min("pos.row").alias("first"), F.count("*").alias("n")).collect()  # a row for each block of the scan
    before, rows = 0, []
    for b in sorted(blocks, key=lambda b: (b["file"], b["start"])):
        rows.append((b["file"], b["start"], before - b["first"] + 1))
        before += b["n"]
    shift = spark.createDataFrame(rows, "file string, start long, shift long")
    placed = lines.join(F.broadcast(shift), (F.col("pos.file") == F.col("file")) & (F.col("pos.start") == F.col("start")))
    return placed.select((F.col("pos.row") + F.col("shift")).alias("line"), "value")


def read_planned(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an input manifest with the number of their ``line`` (JN-8); lines that are no JSON object have null fields."""
    rows = numbered_lines(spark, path).where(F.trim("value") != "")
    return rows.select("line", F.from_json("value", PLANNED).alias("r")).select("line", "r.*")


def read_rows_of(spark: SparkSession, path: str, kind: str, dyad_id: str) -> DataFrame:
    """SRC-3: one dyad's rows: lines that hold the id are parsed, the others are not."""
    lines = spark.read.text(path).where(F.contains("value", F.lit(f'"{dyad_id}"')))
    rows = with_place(lines).select(F.from_json("value", SCHEMAS[kind]).alias("r"), "pos")
    return rows.where(F.col("r.dyad_id") == dyad_id).select("r.*", "pos")


def run_files(spark: SparkSession, base: str) -> DataFrame:
    """(run_id, file, modified, bytes) of all logs under ``base``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").load(base)
    run, name = F.regexp_replace(F.element_at(F.split("path", "/"), -2), "^[^=]*=", ""), F.element_at(F.split("path", "/"), -1)
    return files.select(run.alias("run_id"), name.alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def list_runs(spark: SparkSession, base: str, manifests: DataFrame | None = None, planned: DataFrame | None = None, log: str = "status.jsonl") -> DataFrame:
    """SRC-4: a row for each run: last change, which logs it has, dyads by state; newest first, by ``place``.

    With ``manifests`` (see ``read_manifest``) also when it began and its models; with ``planned`` (run_id, dyad_id) how many
    dyads it plans. A run's folder has its name, or key=name, and its ledger is what ``log`` matches there.
    """
    files = run_files(spark, base).groupBy("run_id").agg(F.max("modified").alias("modified"), F.array_sort(F.collect_set(F.when(F.col("bytes") > 0, F.col("file")))).alias("files"))
    status = read_log(spark, f"{base}/*/{log}", "status", strict=False)
    latest = clean_ledger(status).groupBy("run_id", "dyad_id").agg(F.max_by("status", F.struct("attempt", "pos")).alias("status"))
    counts = latest.groupBy("run_id").agg(*[F.count_if(status_label(F.col("status")) == s).alias(s) for s in ("complete", "failed", "running")])
    out = files.join(counts, "run_id", "left").na.fill(0)
    if planned is not None:
        out = out.join(planned.groupBy("run_id").agg(F.count_distinct("dyad_id").alias("planned")), "run_id", "left").na.fill(0, ["planned"])
    if manifests is not None:
        models = role_info(manifests).groupBy("run_id").agg(F.array_sort(F.collect_set(F.coalesce("alias", "model_path"))).alias("models"))
        begun = manifests.groupBy("run_id").agg(F.min("started_at").alias("started_at"))
        out = out.join(begun, "run_id", "left").join(models, "run_id", "left")
    newest = Window.orderBy(F.desc("modified"), "run_id")  # runs are few: one row each
    return out.withColumn("place", F.row_number().over(newest)).orderBy("place")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5, PF-9: run manifests (or judge provenance); files that are no such object give nothing."""
    df = spark.read.schema(f"{MANIFEST}, {CORRUPT} string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return df.where(F.col(CORRUPT).isNull() & F.col("run_id").isNotNull()).drop(CORRUPT)


def role_info(manifests: DataFrame) -> DataFrame:
    """PF-9: the fields of a run's roles that summaries show, a row for each role."""
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}.alias"), F.col(f"{r}.model_path"), F.col(f"{r}.model_sha256"), F.col(f"{r}.family")) for r in ("seeker", "mentor", "judge")])
    return manifests.select("run_id", "started_at", F.explode(roles).alias("x")).select("run_id", "started_at", "x.*").where("model_sha256 is not null")


def read_instrument(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6: survey items in the order in which they are asked."""
    df = spark.read.schema(INSTRUMENT).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return df.select(F.posexplode("items").alias("place", "i")).select("place", F.col("i.id").alias("item_id"), "i.battery", F.col("i.scale.min").alias("lo"), F.col("i.scale.max").alias("hi"), "i.text")


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7: a grid's levels: (factor, place, level)."""
    df = spark.read.schema("factors map<string,array<string>>").option("multiLine", "true").json(path)
    return df.select(F.explode("factors").alias("factor", "levels")).select("factor", F.posexplode("levels").alias("place", "level"))


ROLE = "struct<slug:string,name:string,backstory:string,reminder_self:string>"


def read_catalogue(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """SRC-7: a catalogue's variants (parent, place, variant, slots) and anchors (parent, topic, items).

    A file is one object, which a task reads whole. A catalogue too large for that comes as ``lines``: each is an object of
    the same form with a part of it; a parent's variants follow each other by file name and line, and so do a topic's items.
    No task then holds more than a block of lines, but for a topic's items.
    """
    schema = f"roles map<string,array<{ROLE}>>, anchors map<string,map<string,array<string>>>"
    read = spark.read.schema(schema)
    if lines:
        df = materialize(with_place(read.option("mode", "FAILFAST").json(path)), "catalogue")
    else:
        df = read.option("multiLine", "true").json(path)
    roles = df.select(*["pos"] * lines, F.explode("roles").alias("parent", "v")).select(*["pos"] * lines, "parent", F.posexplode("v").alias("place", "r"))
    anchors = df.select(*["pos"] * lines, F.explode("anchors").alias("parent", "t")).select(*["pos"] * lines, "parent", F.explode("t").alias("topic", "items"))
    if lines:
        roles = _places_over_lines(roles)
        parts = anchors.groupBy("parent", "topic").agg(F.array_sort(F.collect_list(F.struct("pos", "items"))).alias("x"))
        anchors = parts.select("parent", "topic", F.flatten("x.items").alias("items"))
    slots = F.create_map(*[x for k in ("name", "backstory", "reminder_self") for x in (F.lit(k), F.col(f"r.{k}"))])
    return roles.select("parent", "place", F.col("r.slug").alias("variant"), slots.alias("slots")), anchors


def _places_over_lines(roles: DataFrame) -> DataFrame:
    """``roles`` (pos, parent, place, r) with places that go on from line to line; what comes before a line is a sum over the
    counts of lines, of which a window sees a row for each line and parent."""
    counts = roles.groupBy("parent", "pos").agg(F.count("*").alias("n"))
    before = counts.select(F.col("parent").alias("of"), F.col("pos").alias("line"), (F.sum("n").over(Window.partitionBy("parent").orderBy("pos")) - F.col("n")).alias("before"))
    placed = roles.join(before, (F.col("parent") == F.col("of")) & (F.col("pos") == F.col("line")))
    return placed.withColumn("place", (F.col("place") + F.col("before")).cast("int"))


def read_study(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7: a study file's levels: (factor, place, level, code, slots)."""
    schema = "factors array<struct<key:string,levels:array<struct<id:string,code:string,slots:map<string,string>>>>>"
    df = spark.read.schema(schema).option("multiLine", "true").json(path)
    each = df.select(F.explode("factors").alias("f")).select(F.col("f.key").alias("factor"), F.posexplode("f.levels").alias("place", "l"))
    return each.select("factor", "place", F.col("l.id").alias("level"), F.coalesce("l.code", "l.id").alias("code"), "l.slots")


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: serving benchmarks, CSV or JSON lines by the path's ending."""
    reader = spark.read.schema(BENCH)
    return reader.option("header", "true").option("enforceSchema", "false").csv(path) if path.endswith(".csv") else reader.json(path)
