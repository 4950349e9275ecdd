"""Line dedup: every line key stays only in the smallest document that holds it.

A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys under ``min_chars`` code points are left
alone. 128-bit hashes of the keys are range-partitioned by (hash, document, position) and sorted, so a key that a third of
all documents share is cut over as many partitions as its rows need. Each partition streams its rows once: a row whose
hash was first seen with another document is dropped. Only a partition's first hash can have begun in an earlier one;
those few rows ("heads") are held against the last hash of each partition ("tails", one row for each partition, which
bounds what is broadcast). What comes out is a compressed keep bitmap for each document that loses lines, no text.

Edge cases: null and empty texts are one empty line; a null id counts as the largest id, and all null ids as one document;
rows that repeat an id keep what their document keeps (bitmaps are kept by id and a hash of the text); other columns are
not looked at. Ids are integers (others end in Spark's cast error). A text of any length is split in one task; its lines are
rows of their own from then on.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, materialize, shuffle_partitions

#: Rows of an Arrow batch that the operators give back at a time.
BATCH = 20_000
DROP, HEAD, TAIL = 0, 1, 2


def line_keys(text: bytes, min_chars: int) -> list[tuple[int, bytes]]:
    """(position, key) of the lines that take part."""
    out = []
    for at, line in enumerate(text.split(b"\n")):
        key = line.strip().lower()
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
            out.append((at, key))
    return out


def _texts(batch: pa.RecordBatch, i: int) -> list[bytes]:
    return [x or b"" for x in batch.column(i).cast(pa.binary()).to_pylist()]


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "th", "pos", "h", "n_lines"]

        def full(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32()), strict=True)], names)

        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for d, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch, 2), strict=True):
                keys = line_keys(text, min_chars)
                rows[0] += [d] * len(keys)
                rows[1] += [th] * len(keys)
                rows[2] += [at for at, _ in keys]
                rows[3] += [xxhash.xxh3_128_digest(k) for _, k in keys]
                rows[4] += [text.count(b"\n") + 1] * len(keys)
                if len(rows[0]) >= BATCH:
                    yield full(rows)
                    rows = [[], [], [], [], []]
            if rows[0]:
                yield full(rows)

    return run


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hash, document, position) in; drops, heads and the tail out."""
    schema = pa.schema([("tag", pa.int8()), ("doc_id", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("h", pa.binary()), ("n_lines", pa.int32())])
    seen, first, heading = None, None, False
    for batch in batches:
        out = []
        for d, th, at, h, n in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if h != seen:
                heading = seen is None
                seen, first = h, d
            if d != first:
                out.append((DROP, d, th, at, None, n))
            elif heading:
                out.append((HEAD, d, th, at, h, n))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    if seen is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((TAIL, first, None, None, seen, None), schema, strict=True)], schema=schema)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, n_lines, dropped positions) in; the compressed bitmap and how many lines go out."""
    for batch in batches:
        keeps = []
        for n, dropped in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            keep = np.ones(n, np.uint8)
            keep[np.asarray(dropped, np.int64)] = 0
            keeps.append(zlib.compress(np.packbits(keep).tobytes(), 6))
        sizes = pa.compute.list_value_length(batch.column(3)).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2).cast(pa.int64()), sizes, pa.array(keeps, pa.binary())], ["doc_id", "th", "n_lines", "n_dropped", "keep"])


def read_bitmap(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """One byte for each line: 1 keeps it. No bitmap keeps all."""
    if bitmap is None:
        return np.ones(n_lines, np.uint8)
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def line_keep_bitmaps(docs: DataFrame, *, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, n_lines, n_dropped, keep) for the documents that lose lines; ``th`` is ``xxhash64`` of the text."""
    spark = docs.sparkSession
    slim = _keyed(docs, id_col, text_col)
    lines = materialize(slim.mapInArrow(_hash_lines(min_chars), "doc_id long, th long, pos int, h binary, n_lines int"), "line-hashes")  # sampled for the ranges, then read
    order = [F.col("h"), F.col("doc_id").asc_nulls_last(), F.col("pos")]
    streamed = lines.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(_first_seen, "tag byte, doc_id long, th long, pos int, h binary, n_lines int")
    found = materialize(streamed, "line-firsts")
    tails = found.where(F.col("tag") == TAIL).groupBy("h").agg(F.min("doc_id").alias("first"))
    heads = found.where(F.col("tag") == HEAD)
    late = heads.join(F.broadcast(tails), "h").where("first < doc_id or (doc_id is null and first is not null)")
    drops = found.where(F.col("tag") == DROP).select("doc_id", "th", "pos", "n_lines").unionByName(late.select("doc_id", "th", "pos", "n_lines"))
    lost = drops.groupBy("doc_id", "th", "n_lines").agg(F.collect_set("pos").alias("dropped"))
    return lost.mapInArrow(_bitmaps, "doc_id long, th long, n_lines long, n_dropped long, keep binary")


def _apply(digest_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, lost = [], [], []
            for text, bitmap in zip(_texts(batch, 1), batch.column(2).to_pylist(), strict=True):
                n = text.count(b"\n") + 1
                if bitmap is not None:
                    keep = read_bitmap(bitmap, n)
                    text = b"\n".join(x for x, k in zip(text.split(b"\n"), keep, strict=True) if k)
                    lost.append(n - int(keep.sum()))
                else:
                    lost.append(0)
                total.append(n)
                kept.append(hashlib.sha256(text).hexdigest() if digest_only else text)
            kept = pa.array(kept, pa.string()) if digest_only else pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(lost, pa.int64()), kept], ["row", "n_lines", "n_dropped", "kept"])

    return run


def apply_keep_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, digest_only: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, n_lines, n_dropped, kept) for each row of ``docs``: ``row`` holds its other columns, ``kept`` the lines that stay or their SHA-256.

    Only documents that may have a bitmap move; the others are read where they are.
    """
    bitmaps = materialize(bitmaps, "line-bitmaps")
    text = F.coalesce(F.col(text_col), F.lit(""))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] if not digest_only else [F.col(id_col)]
    rows = docs.select(F.struct(*others).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    key = F.xxhash64("doc_id", "th")
    loses = among(bitmaps.select(key.alias("h")))(key)
    some = rows.where(loses)
    joined = some.join(bitmaps, some["doc_id"].eqNullSafe(bitmaps["doc_id"]) & (some["th"] == bitmaps["th"]), "left").select("row", "text", "keep")
    joined = joined.unionByName(rows.where(~loses).select("row", "text", F.lit(None).cast("binary").alias("keep")))
    return joined.mapInArrow(_apply(digest_only), f"row {rows.schema['row'].dataType.simpleString()}, n_lines long, n_dropped long, kept string")


def dedup_lines(docs: DataFrame, *, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated lines taken out of its texts; columns as before."""
    kept = apply_keep_bitmaps(docs, line_keep_bitmaps(docs, min_chars=min_chars, id_col=id_col, text_col=text_col), id_col=id_col, text_col=text_col)
    return kept.select(*[F.col("kept").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
