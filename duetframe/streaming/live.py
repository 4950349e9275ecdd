"""Live views of a run that is still being written, as Structured Streaming jobs.

A log grows by new files (``tail``) or in place (``growing.tail_growing``). Each view is an incremental aggregation in update
mode that a ``foreachBatch`` adds to a table in the shared folder, which is compacted now and then; the checkpoint makes a
restart go on where it ended.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import attempt_or_first, instant
from ..schemas import SCHEMAS
from ..sources.logs import with_place
from ..storage import remove_path

# The order of states at the same time, and the minutes without news after which a run counts as stalled.
STATUS_RANK = {"started": 0, "failed": 1, "complete": 2}
STALL_MINUTES = 20


def tail(spark: SparkSession, path: str, kind: str, files_per_trigger: int = 1) -> DataFrame:
    """ST-1: new rows of a log, a bounded number of files at a time; half-written lines are left out."""
    rows = spark.readStream.schema(f"{SCHEMAS[kind]}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").option("maxFilesPerTrigger", files_per_trigger).json(path)
    at = F.unix_micros(instant(F.col("ts"))) if "ts" in rows.columns else F.lit(0).cast("long")  # a stream does not count rows
    return with_place(rows, at).where("_corrupt_record is null").drop("_corrupt_record")


def progress(turns: DataFrame) -> DataFrame:
    """ST-2: the mentor's finished turns and the last activity, by attempt; works on streams and on tables."""
    done = F.count_if((F.col("agent") == "mentor") & ~F.col("finish_reason").eqNullSafe(F.lit("error")))
    return turns.withColumn("attempt", attempt_or_first(F.col("attempt"))).groupBy("run_id", "dyad_id", "attempt").agg(done.alias("turns_done"), F.max("ts").alias("last_ts"))


def score_index(scores: DataFrame, watermark: str | None = None) -> DataFrame:
    """ST-3: the metrics and judges seen so far. With a watermark their state can be dropped, and later rows with it."""
    if watermark:
        scores = scores.withColumn("at", instant(F.col("ts"))).withWatermark("at", watermark)
        return scores.select("run_id", "metric", "judge_sha256", "at").dropDuplicatesWithinWatermark(["run_id", "metric", "judge_sha256"]).drop("at")
    return scores.select("run_id", "metric", "judge_sha256").dropDuplicates(["run_id", "metric", "judge_sha256"])


def resume_index(status: DataFrame) -> DataFrame:
    """ST-4: each dyad's latest attempt and status. Of one attempt's rows the later in the log counts, as in a batch (WN-1); a
    stream tells rows of one file apart by time, and at the same time by the states' order."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for pair in STATUS_RANK.items() for x in pair])[F.col("status")], F.lit(-1))
    known = status.dropna(subset=["dyad_id", "attempt", "status"])
    return known.groupBy("run_id", "dyad_id").agg(F.max("attempt").alias("attempt"), F.max_by("status", F.struct("attempt", "pos", rank)).alias("status"))


def attempt_states(status: DataFrame) -> DataFrame:
    """ST-5, kept up to date: by attempt, whether it has ended, and when its last row came. A key is one attempt, so that no
    run's dyads meet in one task or state."""
    known = status.dropna(subset=["dyad_id", "attempt", "status"])
    return known.groupBy("run_id", "dyad_id", "attempt").agg(F.bool_or(F.col("status").isin("complete", "failed")).alias("ended"), F.max(instant(F.col("ts"))).alias("last_at"))


class _Alarm(StatefulProcessor):
    """An attempt's state, and an alarm when no row of it has come for a while, by the clock of the machine it is on."""

    def __init__(self, stall_ms: int) -> None:
        self.stall_ms = stall_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("attempt", "ended boolean, last_at bigint")

    def handleInputRows(self, key, rows, timerValues):
        ended, last = self.state.get() if self.state.exists() else (False, None)
        for r in rows:
            ended = ended or r["status"] in ("complete", "failed")
            last = max((x for x in (last, r["at"]) if x is not None), default=None)
        self.state.update((ended, last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stall_ms)
        yield Row(run_id=key[0], dyad_id=key[1], attempt=key[2], ended=ended, last_at=last, silent=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        ended, last = self.state.get()
        yield Row(run_id=key[0], dyad_id=key[1], attempt=key[2], ended=ended, last_at=last, silent=True)


def alarms(status: DataFrame, stall_seconds: float = 60 * STALL_MINUTES) -> DataFrame:
    """ST-5 as a stream of changes: (run_id, dyad_id, attempt, ended, last_at, silent), one row whenever rows of an attempt
    come, and one with ``silent`` when none has come for a while, without any input. ``liveness`` reads the states of runs
    off the view of it.

    A key is one attempt, so a run with a third of all rows is spread over all tasks. Timers need the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``), and a trigger that goes on (``run_live``).
    """
    known = status.dropna(subset=["dyad_id", "attempt", "status"]).select("run_id", "dyad_id", "attempt", "status", F.unix_micros(instant(F.col("ts"))).alias("at"))
    schema = "run_id string, dyad_id string, attempt int, ended boolean, last_at bigint, silent boolean"
    changes = known.groupBy("run_id", "dyad_id", "attempt").transformWithState(_Alarm(int(stall_seconds * 1000)), schema, "Update", "ProcessingTime")
    return changes.withColumn("last_at", F.timestamp_micros("last_at"))


def liveness(states: DataFrame, planned: DataFrame | int, now: Column | None = None, stall_minutes: int = STALL_MINUTES) -> DataFrame:
    """ST-5: (run_id, state, finished, running): running, pending while fewer attempts have ended than planned, finished; or
    stalled if no row came for a while and there is something left.

    ``states`` is the view of ``alarms``, where a run is silent if all its attempts are; or that of ``attempt_states``, where
    ``now`` decides. ``planned``: (run_id, planned) of the runs (JN-12), or one number for all. A planned run without a row
    is stalled.
    """
    silent = F.bool_and("silent") if "silent" in states.columns else F.lit(None).cast("boolean")
    by = states.groupBy("run_id").agg(F.count_if("ended").alias("finished"), F.count_if(~F.col("ended")).alias("running"), F.max("last_at").alias("last_at"), silent.alias("silent"))
    by = by.join(planned.select("run_id", "planned"), "run_id", "full") if isinstance(planned, DataFrame) else by.withColumn("planned", F.lit(planned))
    by = by.na.fill(0, ["finished", "running", "planned"])
    late = (F.current_timestamp() if now is None else now) > F.col("last_at") + F.make_dt_interval(mins=F.lit(stall_minutes))
    quiet = F.col("last_at").isNull() | (F.coalesce("silent", F.lit(True)) if "silent" in states.columns else late)
    left = (F.col("running") > 0) | (F.col("finished") < F.col("planned"))
    state = F.when(quiet & left, "stalled").when(F.col("running") > 0, "running").when(F.col("finished") < F.col("planned"), "pending").otherwise("finished")
    return by.select("run_id", state.alias("state"), "finished", "running")


def await_silence(spark: SparkSession, query: StreamingQuery, path: str, keys: list[str], seconds: float = 300) -> None:
    """Wait until the view of ``alarms`` has attempts, and nothing but silent ones; an error after so many seconds, or if the query ends.

    (A stream with timers always has a next batch, so it cannot be waited for until all is processed.)
    """
    until = time.monotonic() + seconds

    def silent() -> bool:
        if not any(_parts(spark, path)):
            return False
        found = view(spark, path, keys).agg(F.count("*").alias("n"), F.count_if("silent").alias("silent")).first()
        return 0 < found["n"] == found["silent"]

    while not silent():
        if time.monotonic() > until or not query.isActive:
            raise RuntimeError(f"attempts are not silent yet: {query.exception() or query.lastProgress}")
        query.awaitTermination(1)


def progress_by_file(turns: DataFrame) -> DataFrame:
    """ST-2 over ``growing.tail_growing``: as ``progress``, for each file and its generation."""
    done = F.count_if((F.col("agent") == "mentor") & ~F.col("finish_reason").eqNullSafe(F.lit("error")))
    return turns.withColumn("attempt", attempt_or_first(F.col("attempt"))).groupBy("file", "generation", "run_id", "dyad_id", "attempt").agg(done.alias("turns_done"), F.max("ts").alias("last_ts"))


def current_progress(by_file: DataFrame, newest: DataFrame | None = None) -> DataFrame:
    """ST-2: ``progress`` out of the view of ``progress_by_file``; what a replaced file had said no longer counts.

    ``newest``: (file, generation) of the files now, if one may have been replaced by a file without rows of this kind.
    """
    newest = by_file.groupBy("file").agg(F.max("generation").alias("generation")) if newest is None else newest
    rows = by_file.join(newest, ["file", "generation"], "left_semi")
    return rows.groupBy("run_id", "dyad_id", "attempt").agg(F.sum("turns_done").alias("turns_done"), F.max("last_ts").alias("last_ts"))


#: Batches after which a view's table is compacted.
COMPACT_EVERY = 20


def _parts(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """The numbers of the finished bases and batches below ``path``, rising."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return tuple(sorted(int(n.split("=")[1]) for n in names if n.startswith(kind) and done(n)) for kind in ("base=", "batch="))


def _merged(spark: SparkSession, path: str, keys: list[str], base: int | None, batches: list[int]) -> DataFrame:
    """The newest row of each key of a base and the batches after it; without keys all rows."""
    parts = [spark.read.parquet(f"{path}/base={base}").withColumn("_batch", F.lit(-1))] if base is not None else []
    if batches:
        parts.append(spark.read.option("basePath", path).parquet(*[f"{path}/batch={n}" for n in batches]).withColumnRenamed("batch", "_batch"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if not keys:
        return rows.drop("_batch")
    rest = [c for c in rows.columns if c not in (*keys, "_batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, "r.*")


def compact(spark: SparkSession, path: str, keys: list[str]) -> None:
    """Fold the batches that are there into a new base. It counts from when its marker of success is written, at once.

    The base and the batches before it stay until the next time, for views that are reading them.
    """
    bases, batches = _parts(spark, path)
    base = bases[-1] if bases else None
    new = [n for n in batches if base is None or n > base]
    if not new:
        return
    _merged(spark, path, keys, base, new).write.mode("overwrite").parquet(f"{path}/base={new[-1]}")
    for old in (f"base={b}" for b in bases[:-1]):
        remove_path(spark, f"{path}/{old}")
    for old in (f"batch={n}" for n in batches if base is not None and n <= base):
        remove_path(spark, f"{path}/{old}")


def upsert(path: str, keys: list[str], compact_every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` that writes each batch under its number and compacts now and then; ``view`` reads the newest row of each key.

    Writing a batch twice replaces it, so a restarted batch counts once. A key that comes twice in a batch is an error of the
    query: aggregations in update mode give each once.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number % compact_every == compact_every - 1:
            compact(batch.sparkSession, path, keys)

    return write


def view(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The current state that ``upsert`` has written: a base, and at most as many batches as are between two compactions."""
    bases, batches = _parts(spark, path)
    base = bases[-1] if bases else None
    return _merged(spark, path, keys, base, [n for n in batches if base is None or n > base])


def run_to_table(updates: DataFrame, path: str, keys: list[str], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Run a view over all that is there now, then stop (start it again for what came since)."""
    writer = updates.writeStream.outputMode(mode).foreachBatch(upsert(path, keys)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def run_live(updates: DataFrame, path: str, keys: list[str], checkpoint: str, mode: str = "update", every: str = "10 seconds") -> StreamingQuery:
    """Run a view until it is stopped."""
    writer = updates.writeStream.outputMode(mode).foreachBatch(upsert(path, keys)).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).start()
