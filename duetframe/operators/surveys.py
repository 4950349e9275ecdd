"""Survey shifts: pairs of answers before and after, by level, item and battery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import attempt_or_first, normalised_delta, standard_error
from ..schemas import RUN_KEY
from .attempts import latest_complete, levels


def of_pass(surveys: DataFrame, origin: str = "run") -> DataFrame:
    """PF-3: rows of one pass over the survey; a row without an origin is from the run."""
    return surveys.where((F.coalesce("origin", F.lit("run")) == origin) & F.col("phase").isin("pre", "post"))


def survey_pairs(surveys: DataFrame, origin: str = "run") -> DataFrame:
    """JN-4: (run_id, dyad_id, attempt, item_id, battery, lo, hi, pre, post, delta).

    The last row of an (item, phase) counts, even if its answer is null; battery and scale are those of the item's first
    row. One conditional aggregation over one shuffle instead of a self-join.
    """
    rows = of_pass(surveys, origin).withColumn("attempt", attempt_or_first(F.col("attempt")))
    answer = lambda phase: F.max_by("answer", F.when(F.col("phase") == phase, F.col("pos")))
    pairs = rows.groupBy(*RUN_KEY, "item_id").agg(
        F.min_by(F.struct("battery", "lo", "hi"), "pos").alias("_first"), answer("pre").alias("pre"), answer("post").alias("post"), F.min("pos").alias("pos"))
    return pairs.select(*RUN_KEY, "item_id", "_first.*", "pre", "post", (F.col("post") - F.col("pre")).alias("delta"), "pos")


def leveled_pairs(dyads: DataFrame, status: DataFrame, surveys: DataFrame, factor: str | None, origin: str = "run") -> DataFrame:
    """Pairs of the attempts that count, with their level."""
    return survey_pairs(surveys, origin).join(levels(latest_complete(status), dyads, factor), RUN_KEY)


def n_dyads(dyads: DataFrame, status: DataFrame, factor: str | None = None) -> DataFrame:
    """AG-4: dyads by level, whether or not they have survey rows."""
    return levels(latest_complete(status), dyads, factor).groupBy("level").agg(F.count("*").alias("n_dyads"))


def _matrix(dyads: DataFrame, status: DataFrame, pairs: DataFrame, factor: str | None, column: str) -> DataFrame:
    """JN-10: every level with every item (or battery); both sides are short lists of the design."""
    return n_dyads(dyads, status, factor).select("level").crossJoin(pairs.select(column).distinct())


def shift_by_item(dyads: DataFrame, status: DataFrame, surveys: DataFrame, factor: str | None = None, origin: str = "run") -> DataFrame:
    """AG-2: by level and item, over dyads with both answers: n, mean_pre, mean_post, mean_delta, se_delta."""
    pairs = leveled_pairs(dyads, status, surveys, factor, origin)
    both = pairs.where("delta is not null").groupBy("level", "item_id").agg(
        F.count("*").alias("n"), F.avg("pre").alias("mean_pre"), F.avg("post").alias("mean_post"), F.avg("delta").alias("mean_delta"), standard_error(F.col("delta")).alias("se_delta"))
    return _matrix(dyads, status, pairs, factor, "item_id").join(both, ["level", "item_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def dyad_battery_means(pairs: DataFrame) -> DataFrame:
    """AG-21: each dyad's mean shift as a share of the scale, by battery; items without range are left out."""
    share = normalised_delta(F.col("delta"), F.col("lo"), F.col("hi"))
    keys = [*RUN_KEY, *(c for c in ("level",) if c in pairs.columns), "battery"]
    return pairs.withColumn("share", share).where("share is not null").groupBy(*keys).agg(F.avg("share").alias("mean_share"), F.count("*").alias("n_items"))


def shift_by_battery(dyads: DataFrame, status: DataFrame, surveys: DataFrame, factor: str | None = None, origin: str = "run") -> DataFrame:
    """AG-3: by level and battery, mean and standard error over dyads of their mean normalised shifts."""
    pairs = leveled_pairs(dyads, status, surveys, factor, origin)
    per_level = dyad_battery_means(pairs).groupBy("level", "battery").agg(F.count("*").alias("n"), F.avg("mean_share").alias("mean_delta_norm"), standard_error(F.col("mean_share")).alias("se_delta_norm"))
    return _matrix(dyads, status, pairs, factor, "battery").join(per_level, ["level", "battery"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def answer_methods(surveys: DataFrame) -> DataFrame:
    """AG-13: rows by answer method, the share of all rows, and null answers."""
    by = surveys.groupBy("run_id", "answer_method").agg(F.count("*").alias("n"), F.count_if(F.col("answer").isNull()).alias("n_null"))
    total = by.groupBy("run_id").agg(F.sum("n").alias("total"))
    return by.join(total, "run_id").select("run_id", "answer_method", "n", "n_null", (F.col("n") / F.col("total")).alias("share"))
