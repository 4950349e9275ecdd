"""Helpers shared by the corpus operators: ASCII folding, words, labelled samples, spans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize

#: ASCII white space, as a Java character class. ``bytes.split()`` and ``bytes.strip()`` use the same set.
WHITE = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and leave every other character as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{WHITE}+"), "")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """The third of the ids that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(place, text, label) of at most ``bound`` labelled documents outside the held-out third, the first in hash order.

    ``place`` is the hash that orders them. The chosen ids are at most ``bound`` rows, which is what makes them fit to
    broadcast. Of several texts or labels of an id the smallest hash and the smallest label count, so that reruns agree.
    """
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    ids = ids.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(bound)
    ids = materialize(ids.select("id", "label", F.xxhash64("id").alias("place")), "labelled-ids")
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(ids), F.col("doc") == F.col("id"))
    return texts.groupBy("id", "place", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("place", "t.text", "label")


def slices(batch: pa.RecordBatch, column: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose values of ``column`` (texts, binaries or lists) have ``most`` bytes or elements at most, or of one row."""
    sizes = (pa.compute.list_value_length(column) if pa.types.is_list(column.type) else pa.compute.binary_length(column)).fill_null(0).to_numpy(zero_copy_only=False)
    total, at = np.concatenate([[0], np.cumsum(sizes)]), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


#: Folds of a model's training rows, by their order; job ``FOLDS`` learns from all of them.
FOLDS = 3


def fit_jobs(rows: DataFrame, fit, schema: str) -> dict[int, Row]:
    """One task for each fold, which learns from the others, and one for the final model, side by side; the result of each by number.

    ``fit`` takes (job, its rows in order); the bound of the sample bounds each task's input.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [pdf for pdf in batches if len(pdf)]
        for job, pdf in pd.concat(parts).groupby("job") if parts else ():
            yield fit(int(job), pdf.sort_values("place", kind="stable"))

    each = materialize(rows, "sample").withColumn("job", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))))
    return {r["job"]: r for r in each.repartitionByRange(FOLDS + 1, "job").mapInPandas(run, schema).collect()}  # by range: a task each


#: Bits of a set of hashes for each of them, and the bytes that a set may take at most.
BITS_EACH, SET_BYTES = 512, 4 << 20


def _spots(h: Column, size: int) -> list[tuple[Column, Column]]:
    """The (element, bit) of the two bits that a hash has in a set of ``size`` elements, a power of two."""
    halves = [h, F.shiftrightunsigned(h, 32)]
    return [(F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(size - 1)).cast("int"), x.bitwiseAND(F.lit(63)).cast("int")) for x in halves]


def among(hashes: DataFrame, nested: bool = False) -> Callable[[Column], Column]:
    """A test whether a hash may be one of ``hashes`` (h long); those that are always pass, and few others while the set has
    room. The set takes at most ``SET_BYTES``; with very many hashes it lets everything pass.

    It is a table of one row that the plan reads as a subquery. Lambdas cannot hold one: for them (``nested``) the set is a
    literal, which every copy of the plan's text repeats.
    """
    size = min(1 << (hashes.count() * BITS_EACH // 64).bit_length(), SET_BYTES // 8)
    spots = F.array(*[F.struct(at.alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")) for at, bit in _spots(F.col("h"), size)])
    found = hashes.select(F.explode(spots).alias("x")).groupBy("x.at").agg(F.bit_or("x.bit").alias("bits"))
    if nested:
        bits = {r["at"]: r["bits"] for r in found.toLocalIterator()}  # size rows at most
        known = F.from_json(F.lit("[" + ",".join(str(bits.get(i, 0)) for i in range(size)) + "]"), "array<bigint>")
    else:
        every = hashes.sparkSession.range(size).select(F.col("id").cast("int").alias("at")).join(found, "at", "left")
        whole = every.agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("x"))  # size rows
        known = materialize(whole.select(F.col("x.bits").alias("bits")), "hashes").scalar()

    def test(h: Column) -> Column:
        first, second = (F.getbit(F.get(known, at), bit) == 1 for at, bit in _spots(h, size))
        return first & second

    return test


SPAN = "struct<start:int,end:int,text:string>"
#: Matches that are placed one after the other.
RUN = 256


def find_spans(text: Column, pattern: str, *, group: int | None = None) -> Column:
    """array<struct<start, end, text>>: the leftmost non-overlapping matches, in code points, end exclusive.

    What lies between the matches comes from splitting by the same pattern; adding up lengths gives the places. ``text`` of
    a span is the match, or its ``group``. The pattern must not match the empty string.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(found, F.slice(F.split(text, pattern), 1, F.size(found)), lambda m, gap: F.struct(m.alias("text"), F.char_length(gap).alias("gap"), F.char_length(m).alias("n")))
    if group is not None:
        parts = F.zip_with(parts, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda p, g: F.struct(g.alias("text"), p["gap"].alias("gap"), p["n"].alias("n")))

    def placed(run: Column, at: Column) -> Column:
        def step(s: Column, p: Column) -> Column:
            start = s["at"] + p["gap"]
            return F.struct((start + p["n"]).alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), (start + p["n"]).alias("end"), p["text"].alias("text")))).alias("out"))

        return F.aggregate(run, F.struct(at.alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), step, lambda s: s["out"])

    def in_runs(p: Column) -> Column:
        # adding to an array copies it, so many matches are placed in runs, and only the lengths of runs are added up along the text
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / RUN).cast("int")), lambda i: F.slice(p, i * RUN + 1, RUN))

        def along(rs: Column) -> Column:
            lengths = F.transform(rs, lambda r: F.aggregate(r, F.lit(0), lambda n, x: n + x["gap"] + x["n"]))
            begins = F.aggregate(lengths, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
            return F.flatten(F.zip_with(rs, F.slice(begins, 1, F.size(rs)), placed))

        return bound(runs, along)

    return bound(parts, lambda p: F.when(F.size(p) <= RUN, placed(p, F.lit(0))).otherwise(in_runs(p)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def span_list(spans: Column, kinds: list[str], by_kind: bool) -> Column:
    """"kind:start:end,...": by kind as listed and then start, or by start and then kind; ``spans`` has kind, start, end."""
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])

    def key(s: Column) -> Column:
        r = rank[s["kind"]]
        head = [r.alias("a"), s["start"].alias("b")] if by_kind else [s["start"].alias("a"), r.alias("b")]
        return F.struct(*head, s["end"].alias("c"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))

    return F.array_join(F.transform(F.array_sort(F.transform(spans, key)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def literal_doubles(values: list[float]) -> Column:
    """A constant array<double>; one literal after constant folding."""
    return F.from_json(F.lit("[" + ",".join(map(repr, values)) + "]"), "array<double>")
