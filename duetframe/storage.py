"""Shared storage: where tables go that outlive a job's stages."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, on a local master only, a new one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(shared_dir, "local"):
        shared_dir.local = "file://" + tempfile.mkdtemp(prefix="spark-duetframe-")
    return shared_dir.local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; one folder for each application, so that a finished application's can be removed."""
    return f"{shared_dir(spark)}/duetframe-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: The tables of each open ``temporary_tables``, innermost last.
_SCOPES: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


@contextlib.contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables materialised inside are removed at the end, but for those that are kept: these belong to the scope around it.

    What is lazy and reads them has to be written before the end.
    """
    made: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in made:
            remove_path(spark, path)
        spark._jvm.System.gc()  # Spark removes the files of a shuffle once the driver's collector has found that nothing refers to it


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The lineage is cut at a table that outlives any executor, so a lost one costs a reread and nothing is computed twice.
    Inside ``temporary_tables`` the table goes at the end, or with ``keep`` at the end of the scope around it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    scopes = _SCOPES.get()
    if len(scopes) > keep:
        scopes[-2 if keep else -1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder with all that is in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove_scratch(spark: SparkSession) -> None:
    """Remove what this application has left in the shared folder; results that are not yet written elsewhere go with it."""
    remove_path(spark, f"{shared_dir(spark)}/duetframe-{spark.sparkContext.applicationId}")
