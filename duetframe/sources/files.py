"""Files that Python workers read themselves, in pieces."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

#: Bytes that are read at once.
CHUNK = 4 << 20


def open_store(path: str):
    """(file system, path in it) of a path or URI; ``file:/x`` as well, the way Spark spells it."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = path[5:]
    return fs.FileSystem.from_uri(path)


def digest(store, path: str) -> tuple[int, str]:
    """Bytes and SHA-256 of a file of any size, in the memory of one piece."""
    total, h = 0, hashlib.sha256()
    with store.open_input_stream(path) as f:
        while part := f.read(CHUNK):
            total += len(part)
            h.update(part)
    return total, h.hexdigest()


def create_once(path: str, content: bytes) -> bool:
    """Create a file on a POSIX file system unless there is one; whether it was made here.

    It is a link to a file that is already written: one writer gets it, and readers see all of it or nothing.
    """
    _, path = open_store(path)
    parent, _, name = path.rpartition("/")
    os.makedirs(parent, exist_ok=True)
    draft = f"{parent}/.{name}.{os.urandom(8).hex()}"
    with open(draft, "wb") as f:
        f.write(content)
    try:
        os.link(draft, path)
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(draft)


def inside(root: str):
    """For ``mapInArrow``: the ``path`` of folders below ``root`` to (path, bytes) of what is in each; folders have no bytes."""
    def run(folders: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        store, base = open_store(root)
        for batch in folders:
            for folder in batch.column("path").to_pylist():
                here = store.get_file_info(f"{base}{folder}")
                if here.is_file:  # the root itself
                    yield pa.RecordBatch.from_arrays([pa.array([folder]), pa.array([here.size], pa.int64())], ["path", "bytes"])
                    continue
                found = store.get_file_info(fs.FileSelector(f"{base}{folder}"))
                names, sizes = [f"{folder}/{x.base_name}" for x in found], [None if x.type == fs.FileType.Directory else x.size for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return run


def digests(root: str):
    """For ``mapInArrow``: the ``path`` of files below ``root`` to (path, bytes, sha256)."""
    def run(paths: Iterator) -> Iterator:
        import pyarrow as pa

        store, base = open_store(root)
        for batch in paths:
            names = batch.column("path").to_pylist()
            found = [digest(store, f"{base}{x}") for x in names]
            yield pa.RecordBatch.from_arrays([pa.array([f"{root}{x}" for x in names], pa.string()), pa.array([n for n, _ in found], pa.int64()), pa.array([d for _, d in found], pa.string())], ["path", "bytes", "sha256"])

    return run
