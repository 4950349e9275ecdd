"""Writers of logs, derived relations, manifests and digests."""

from __future__ import annotations

import urllib.parse
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.assignment import summary
from ..operators.audits import config_conflicts
from ..storage import materialize
from .files import create_once, digests, inside


def append_log(df: DataFrame, path: str) -> None:
    """SNK-1: add rows; what is there never changes."""
    df.write.mode("append").partitionBy("run_id").parquet(path)


def replace_derived(df: DataFrame, path: str) -> None:
    """SNK-2: replace a derived relation for the runs in ``df``, leaving other runs alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    """SNK-3: the assignment table in its shuffled order, and its summary beside it. Files follow each other by name."""
    rows.orderBy("shuffle_key").drop("shuffle_key", "place").write.mode("errorifexists").json(f"{path}/manifest")
    summary(rows).orderBy("grouping", "key").coalesce(1).write.mode("errorifexists").json(f"{path}/assignment")


#: Files, and bytes on the average, that one task digests.
TASK_FILES, TASK_BYTES = 500, 128 << 20


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes) of all files below ``root``, with paths that begin there: tasks list folders, a level after the other."""
    few = spark.sparkContext.defaultParallelism * 2
    folders, files = spark.createDataFrame([("",)], "path string"), spark.createDataFrame([], "path string, bytes long")
    while n := folders.count():
        found = materialize(folders.repartition(min(n, few), "path").mapInArrow(inside(root), "path string, bytes long"), "listed")
        folders, files = found.where("bytes is null"), files.unionByName(found.where("bytes is not null"))
    return files


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SNK-4: (file, bytes, sha256, path) of the files under ``path``, of any size and number.

    A task reads its files piece by piece, and no row holds one. The number of tasks follows from the files and their bytes; what
    there is to read is never on the driver.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    files = listed_files(spark, root)
    files = files.where(~F.element_at(F.split(F.concat(F.lit(root), "path"), "/"), -1).rlike("^[._]"))
    n = files.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).first()
    tasks = max(n["files"] // TASK_FILES, (n["bytes"] or 0) // TASK_BYTES, min(n["files"], spark.sparkContext.defaultParallelism * 2), 1)
    found = files.repartition(tasks, "path").mapInArrow(digests(root), "path string, bytes long, sha256 string")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256", "path")


def create_in_store(spark: SparkSession, path: str, content: bytes) -> bool:
    """Create a file in any store whose rename does not replace (HDFS) unless there is one; whether it was made here."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    draft, final = hadoop.Path(f"{path}.{uuid.uuid4().hex}.draft"), hadoop.Path(path)
    fs = final.getFileSystem(conf)
    out = fs.create(draft)
    out.write(content)
    out.close()
    try:
        hadoop.FileContext.getFileContext(final.toUri(), conf).rename(draft, final, spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
        return True
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        return False


RECORD = "run_id string, config map<string,string>"


def stored_runs(spark: SparkSession, path: str) -> DataFrame:
    """SNK-5: the records that are there."""
    try:
        return spark.read.schema(RECORD).option("pathGlobFilter", "*.json").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], RECORD)


def record_runs(incoming: DataFrame, path: str) -> DataFrame:
    """SNK-5: store the configuration of new runs; runs that are stored with another one are returned, and then nothing is stored.

    A record is a file of its own that only one writer can create. Of two writers of a run the second finds the first one's
    record: it is a conflict if they differ in what affects results. ``incoming`` has a row for each run that begins; of
    several rows of a run the first by its JSON counts.
    """
    spark = incoming.sparkSession
    conflicts = config_conflicts(stored_runs(spark, path), incoming)
    if not conflicts.isEmpty():
        return conflicts
    rows = incoming.select("run_id", F.to_json(F.struct("run_id", "config")).alias("record")).groupBy("run_id").agg(F.min("record").alias("record"))

    name = lambda run: f"{path}/{urllib.parse.quote(run, safe='')}.json"

    def create(batches):
        for batch in batches:
            for run, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                create_once(name(run), record.encode() + b"\n")
            yield batch

    if path.startswith(("/", "file:")):
        rows.mapInArrow(create, rows.schema).count()
    else:
        for r in rows.toLocalIterator():  # runs that begin now
            create_in_store(spark, name(r["run_id"]), r["record"].encode() + b"\n")
    return config_conflicts(stored_runs(spark, path), incoming)
