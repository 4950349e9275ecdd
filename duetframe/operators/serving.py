"""Serving benchmarks: rates by configuration, parallel gain, days of an arm."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def configurations(streams: DataFrame) -> DataFrame:
    """AG-17: by (model, np), over the streams that ended well: how many, tokens, rates, prefill for a turn."""
    ok = streams.where("error is null and tokens > 0")
    return ok.groupBy("model", "np").agg(
        F.count("*").alias("streams_ok"), F.sum("tokens").alias("tokens"), F.max("seconds").alias("wall_s"), F.try_divide(F.sum("tokens"), F.max("seconds")).alias("aggregate_tps"),
        F.avg(F.try_divide("tokens", "seconds")).alias("per_stream_tps"), F.avg("prompt_tokens").alias("prefill_per_turn"))


def acceptance(streams: DataFrame, target: float, within: float = 0.05) -> DataFrame:
    """AG-17, second rule: streams whose prompt came within a share of the wanted depth."""
    return streams.where(F.abs(F.col("prompt_tokens") - target) <= within * target)


def parallel_gain(rates: DataFrame) -> DataFrame:
    """AG-18: each configuration's rate over that of the model's smallest np."""
    first = F.first("aggregate_tps").over(Window.partitionBy("model").orderBy("np").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rates.select("model", "np", "aggregate_tps", F.try_divide("aggregate_tps", first).alias("gain"))


def arm_days(rates: DataFrame, turns: int = 20, dialogues: int = 2970) -> DataFrame:
    """AG-18: days that an arm takes at a rate: 250 over the rate for 20 turns and 2,970 dialogues, in proportion."""
    return rates.select("model", "np", F.try_divide(F.lit(250.0 * turns / 20 * dialogues / 2970), "aggregate_tps").alias("days"))
