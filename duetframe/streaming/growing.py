"""A streaming data source over files that grow in place: whole new lines since the last read, by byte.

The offset of the stream has, for each file, its generation and how many bytes were read. A trigger reads a bounded number of
bytes of each file, up to the end of the line they fall in, and tasks of it take a bounded range each. A line that is still
being written is left for later. A file that was replaced (another inode, or another first line where a file system has
none) or has shrunk begins a new generation, from its first byte.

Memory: a task holds one chunk, or one line. The driver reads a few bytes before the end of each file that grew.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..schemas import SCHEMAS
from ..sources.files import open_store

#: Bytes of a file that a trigger reads, of which a task takes so many; bytes that are read at once.
READ_BYTES, TASK_BYTES, CHUNK = 256 << 20, 32 << 20, 1 << 20
LINES = "file string, generation int, at long, value string"


def _line_end(f, start: int, limit: int, size: int) -> int:
    """Where the last whole line of [start, limit) ends; if none does, where the first one after it ends, or ``start``."""
    stop = limit
    while stop > start:
        begin = max(start, stop - CHUNK // 16)
        f.seek(begin)
        at = f.read(stop - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        stop = begin
    f.seek(limit)
    at = limit
    while at < size and (part := f.read(min(CHUNK, size - at))):
        found = part.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(part)
    return start


@dataclass
class Range(InputPartition):
    """Lines of a file that begin in [start, stop); ``first``: a line begins at ``start``."""

    file: str
    generation: int
    identity: str
    start: int
    stop: int
    end: int
    first: bool


class GrowingFilesReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.most, self.task = int(options.get("readbytes", READ_BYTES)), int(options.get("taskbytes", TASK_BYTES))
        self.seen: dict | None = None

    def initialOffset(self) -> dict:
        self.seen = {}
        return {}

    def _identity(self, store, path: str) -> str:
        try:
            stat = os.stat(path) if store.type_name == "local" else None
        except OSError:
            return ""
        if stat:
            return f"{stat.st_dev}:{stat.st_ino}"
        with store.open_input_file(path) as f:
            return hashlib.sha256(f.read(CHUNK).split(b"\n", 1)[0]).hexdigest()[:16]

    def latestOffset(self) -> dict:
        from pyarrow import fs

        store, base = open_store(self.path)
        files = [i for i in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)) if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, self.pattern)]
        restarted, out = self.seen is None, dict(self.seen or {})
        for info in sorted(files, key=lambda i: i.path):
            old, identity = out.get(info.path), self._identity(store, info.path)
            if old is None or old["id"] != identity or info.size < old["end"]:
                old = {"generation": old["generation"] + 1 if old else 0, "id": identity, "end": 0}
            if info.size > old["end"]:
                # a restarted reader does not know yet where the stream is: it catches up, in tasks of the same bound
                limit = info.size if restarted else min(info.size, old["end"] + self.most)
                with store.open_input_file(info.path) as f:
                    old = old | {"end": _line_end(f, old["end"], limit, info.size)}
            if old["end"] or info.path in out:
                out[info.path] = old
        if not restarted:
            self.seen = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for file, now in end.items():
            old = start.get(file)
            if old and self.seen is None and (old["id"] != now["id"] or old["end"] > now["end"]):
                now["generation"] = max(now["generation"], old["generation"] + 1)
            at = old["end"] if old and old["id"] == now["id"] and old["end"] <= now["end"] else 0
            out += [Range(file, now["generation"], now["id"], i, min(i + self.task, now["end"]), now["end"], i == at) for i in range(at, now["end"], self.task)]
        self.seen = end
        return out

    def commit(self, end: dict) -> None:
        pass

    def read(self, r: Range) -> Iterator[tuple]:
        store, _ = open_store(self.path)
        if self._identity(store, r.file) != r.identity:
            return  # replaced since: its new generation is read instead
        with store.open_input_file(r.file) as f:
            # a range that begins inside the file skips the line before it, which ends at its start or later
            at = r.start if r.first else r.start - 1
            f.seek(at)
            rest, skip = b"", not r.first
            while at < r.stop:
                part = f.read(min(CHUNK, r.end - at - len(rest)))
                if not part:
                    return
                rest += part
                lines = rest.split(b"\n")
                rest = lines.pop()
                for line in lines:
                    if skip:
                        skip = False
                    elif at < r.stop and line.strip():
                        yield (r.file, r.generation, at, line.decode("utf-8", "replace"))
                    at += len(line) + 1
                    if at >= r.stop:
                        return


class GrowingFiles(DataSource):
    """Options: path (a folder), pattern (of file names), readBytes, taskBytes."""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> GrowingFilesReader:
        return GrowingFilesReader({k.lower(): v for k, v in self.options.items()})


def tail_growing(spark: SparkSession, path: str, kind: str, pattern: str = "*", read_bytes: int = READ_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """ST-1: new rows of the logs below ``path`` that still grow, with ``file`` and ``generation``; ``pos`` is a row's place in its file.

    Lines that are no JSON object are left out.
    """
    spark.dataSource.register(GrowingFiles)
    lines = spark.readStream.format("growing_files").option("path", path).option("pattern", pattern).option("readBytes", read_bytes).option("taskBytes", task_bytes).load()
    row = F.from_json("value", f"{SCHEMAS[kind]}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.select("file", "generation", "at", row.alias("r")).where("r._corrupt_record is null")
    place = F.struct("file", F.col("generation").cast("long").alias("start"), F.col("at").alias("row"))
    return rows.select("r.*", "file", "generation", place.alias("pos")).drop("_corrupt_record")
