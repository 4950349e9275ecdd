"""Mixing sources to target weights by fitting subset sums over exact lengths.

1. Sizes: one scan, no shuffle of texts; from here on only (doc_id, source, size) moves.
2. Source totals give every source a target (water filling under a cap).
3. Documents are counted by (source, exact length). A source's remaining budget is filled by a proportional share of
   each length and a bounded knapsack over what is left, which sees counts and never documents.
4. For each (source, length) the first documents in a seeded hash order are taken. Hash buckets with counts replace a
   global rank: only the one bucket that the cut falls in is sorted, to find the last document taken, and every document
   is then held against that one. A length that a third of all rows share is spread over all its buckets.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; size 0 takes nothing; rows that
repeat an id or have none are documents of their own, in the order of their texts' hashes; an empty table gives an empty
result. The length of a text does not matter: only its number of words moves. Columns named like the operator's own do not
clash, as those of the input are read by the names given and stay inside ``row``.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, words

#: Documents of one (source, length) in a hash bucket, about.
BUCKET_ROWS = 256
#: A length of a source that has more than one of so many shares of all documents is hot.
HOT_SHARE = 1_000
#: Budget, in words, that proportional shares leave to the knapsack: eight of the longest documents, but no more than this.
#: The knapsack is exact for what is left: a document longer than twice that could only lead away from it, all others take part.
KNAPSACK_WORDS = 20_000


def source_targets(totals: dict[str | None, int], weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> dict[str | None, float]:
    """Share out ``share`` times all sizes by weights dealt in code point order (null last), none above ``cap`` times its size."""
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    open_, left, out = list(order), share * sum(totals.values()), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > cap * totals[s]]
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s in full:
            out[s] = float(cap * totals[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def fit_counts(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many documents of each length to take, so that their words come as near to ``budget`` as can be found.

    A proportional share of each length first, then the longest that still fit until little is left, then a bounded
    knapsack (binary-split counts, reachable sums as bits of an integer) for the rest.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget <= 0 or not total:
        return [0] * len(lengths)
    if budget >= total:
        return list(counts)
    slack = min(KNAPSACK_WORDS, 8 * max(lengths), budget)
    take = [c * (budget - slack) // total for c in counts]
    left = budget - sum(n * k for n, k in zip(lengths, take, strict=True))
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        more = min(counts[i] - take[i], max(0, left - slack) // lengths[i])
        take[i] += more
        left -= more * lengths[i]
    spare = [i for i in sorted(range(len(lengths)), key=lambda i: lengths[i]) if take[i] < counts[i]]
    if not spare or left <= 0:
        return take
    top = 2 * left  # beyond it no sum is nearer than none at all
    mask, reach, steps = (1 << (top + 1)) - 1, 1, []
    for i in spare:
        room, size = min(counts[i] - take[i], top // lengths[i]), 1
        while room > 0:
            size = min(size, room)
            steps.append((i, size, reach))
            reach |= (reach << (size * lengths[i])) & mask
            room, size = room - size, size * 2
        if reach >> left & 1:
            break
    below = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    above_bits = reach >> (left + 1)
    above = left + (above_bits & -above_bits).bit_length() if above_bits else None
    at = above if above is not None and above - left < left - below else below
    for i, size, before in reversed(steps):
        if not before >> at & 1:
            take[i] += size
            at -= size * lengths[i]
    return take


def _plan(targets: dict[str | None, float], totals: dict[str | None, int]):
    def plan(key: tuple, hist: pd.DataFrame) -> pd.DataFrame:
        source = None if key[0] is None or key[0] != key[0] else key[0]
        hist = hist.sort_values("size")
        lengths, counts, total = hist["size"].tolist(), hist["n"].tolist(), totals[source]
        whole, rest = divmod(round(targets[source]), total)
        extra = fit_counts(lengths, counts, rest)
        words = whole * total + sum(n * k for n, k in zip(lengths, extra, strict=True))
        return pd.DataFrame({"source": source, "size": lengths, "n": counts, "whole": whole, "extra": extra, "source_taken": words}).astype({"source": object})

    return plan


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size, th): the number of words of each document and a hash of its text; and the columns to ``keep``."""
    text = F.col(text_col)
    return docs.select(*keep, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words(text)).cast("long").alias("size"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"))


def mix_sources(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies, source_taken), a row for each row of ``docs``.

    ``copies`` is how often the mix repeats the document (0, 1 or 2 for a cap of 2), ``taken`` is copies times size, and
    ``source_taken`` the sum of these over the source, which shows how near its target the fit came. Columns to ``keep`` come
    first. The driver holds one row for each source and no more.
    """
    spark = docs.sparkSession
    slim = materialize(sized(docs, id_col, text_col, source_col, keep).withColumn("row_number", F.monotonically_increasing_id()), "mix-sizes")
    totals = {r["source"]: r["size"] for r in slim.groupBy("source").agg(F.sum("size").alias("size")).toLocalIterator()}
    targets = source_targets(totals, weights, share, cap)
    plan = slim.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")).groupBy("source").applyInPandas(_plan(targets, totals), "source string, size long, n long, whole long, extra long, source_taken long")
    plan = materialize(plan.withColumnsRenamed({"source": "of", "size": "length"}), "mix-plan")
    got = {r["of"]: r["words"] for r in plan.groupBy("of").agg(F.max("source_taken").alias("words")).toLocalIterator()}
    plan = plan.drop("source_taken")
    by_source = spark.createDataFrame([(s, totals[s], targets[s], got.get(s, 0)) for s in totals], "of string, source_size long, target double, source_taken long")

    h = F.xxhash64(F.lit(seed), "doc_id", "th")
    bucket = F.shiftrightunsigned(h, 1) % F.ceil(F.col("n") / BUCKET_ROWS)
    place = F.struct(bucket.alias("bucket"), h.alias("h"), F.col("doc_id").alias("doc_id"), F.col("th").alias("th"), F.col("row_number").alias("row_number"))
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("length"))
    often = F.col("n") > sum(r["n"] for r in plan.agg(F.sum("n").alias("n")).collect() if r["n"]) / HOT_SHARE

    def planned(plan: DataFrame) -> DataFrame:
        """``slim`` with its rows of ``plan``, if any; lengths with more than a thousandth of the rows, fewer than a thousand
        then, are broadcast, so that a hot one does not meet its documents in one task."""
        split = slim.join(F.broadcast(plan.where(often)), same, "left")
        rest = split.where("length is null").select(*slim.columns).join(plan.where(~often), same, "left")
        return split.where("length is not null").unionByName(rest)

    cut = planned(plan.where("0 < extra and extra < n")).where("length is not null").select("of", "length", "extra", place.alias("place"))
    counts = cut.groupBy("of", "length", "extra", F.col("place.bucket").alias("bucket")).agg(F.count("*").alias("here"))
    upto = Window.partitionBy("of", "length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("here").over(upto), F.lit(0))).where("before < extra and extra <= before + here")
    counts = counts.select(F.col("of").alias("s"), F.col("length").alias("l"), "bucket", (F.col("extra") - F.col("before")).alias("more"))
    inside = cut.join(counts, cut["of"].eqNullSafe(F.col("s")) & (cut["length"] == F.col("l")) & (F.col("place.bucket") == F.col("bucket")))
    inside = inside.withColumn("rank", F.row_number().over(Window.partitionBy("of", "length").orderBy("place"))).where("rank = more")
    last = materialize(inside.select(F.col("of").alias("s"), F.col("length").alias("l"), F.col("place").alias("last")), "mix-cuts")
    plan = plan.join(last, plan["of"].eqNullSafe(last["s"]) & (plan["length"] == last["l"]), "left").drop("s", "l")

    picked = (F.col("extra") > 0) & (F.col("last").isNull() | (place <= F.col("last")))
    copies = F.when(F.col("size") > 0, F.col("whole") + picked.cast("long")).otherwise(F.lit(0))
    out = planned(plan).withColumn("copies", copies).drop("of")
    return out.join(by_source, out["source"].eqNullSafe(by_source["of"]), "left").select(
        *keep, "doc_id", "source", "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"),
        (F.col("copies") * F.col("size")).alias("taken"), "copies", F.coalesce("source_taken", F.lit(0)).alias("source_taken"))


def mixed_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(row, mix): each row of ``docs`` with its own figures; rows are numbered in a table, so that equal ones are told apart."""
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct("*").alias("row")), "mix-rows")
    slim = rows.select("uid", *[F.col(f"row.`{c}`").alias(name) for c, name in ((id_col, "doc_id"), (text_col, "text"), (source_col, "source"))])
    figures = mix_sources(slim, keep=["uid"], **options)
    figures = figures.select("uid", F.struct("size", "source_size", "target", "taken", "copies").alias("mix")).where("mix.copies > 0")
    return rows.join(figures, "uid").select("row", "mix")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every document repeated as often as the mix takes it; all its columns, whatever their names."""
    return mixed_rows(docs, **options).select("row", F.explode(F.sequence(F.lit(1), F.col("mix.copies").cast("int")))).select("row.*")
