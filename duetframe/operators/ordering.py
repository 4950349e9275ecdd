"""Places in an order over a whole table, without a task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def with_places(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` with ``place``, from 1 in the order of ``order``; of equals any is first.

    Rows are sorted by ranges; each range is numbered where it lies, and a row for each range says what comes before it.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = materialize(rows, "in-order")
    part = F.shiftright("_at", 33)
    counts = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row for each range
    before, shifts = 0, []
    for k in sorted(counts):
        shifts.append((k, before + 1 - (k << 33)))
        before += counts[k]
    shift = df.sparkSession.createDataFrame(shifts, "_part long, _shift long")
    return rows.join(F.broadcast(shift), part == F.col("_part")).withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
