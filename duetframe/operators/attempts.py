"""The ledger: latest attempts, outstanding work, restriction to complete dialogues, treatments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import attempt_or_first, level_label, status_label
from ..schemas import ALL_LEVEL, RUN_KEY

DYAD = ["run_id", "dyad_id"]


def clean_ledger(status: DataFrame) -> DataFrame:
    """PF-2: ledger rows that say which dyad, which attempt and what."""
    return status.dropna(subset=["dyad_id", "attempt", "status"])


def last_row(df: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """WN-2: of the rows with the same key, the last in file order; one partial aggregation, no sort of groups."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")


def latest_status(status: DataFrame, order: Column | None = None) -> DataFrame:
    """WN-1: (run_id, dyad_id, attempt, status) of each dyad's highest attempt; a later row wins ties."""
    order = F.struct("attempt", "pos") if order is None else order
    return clean_ledger(status).groupBy(*DYAD).agg(F.max("attempt").alias("attempt"), F.max_by("status", order).alias("status"))


def latest_complete(status: DataFrame) -> DataFrame:
    """The attempt that counts of each dyad: its latest, if that is complete."""
    return latest_status(status).where("status = 'complete'").select(*RUN_KEY)


def only_latest_complete(rows: DataFrame, status: DataFrame) -> DataFrame:
    """JN-1: the rows of attempts that count."""
    return rows.withColumn("attempt", attempt_or_first(F.col("attempt"))).join(latest_complete(status), RUN_KEY, "left_semi")


def with_treatment(attempts: DataFrame, dyads: DataFrame, *columns: str) -> DataFrame:
    """JN-2: treatment columns beside attempts, null where the attempt has no treatment row; the last such row counts."""
    wanted = columns or ("condition",)
    given = last_row(dyads.withColumn("attempt", attempt_or_first(F.col("attempt"))).select(*RUN_KEY, *wanted, "pos"), RUN_KEY).drop("pos")
    return attempts.join(given, RUN_KEY, "left")


def levels(attempts: DataFrame, dyads: DataFrame, factor: str | None) -> DataFrame:
    """PF-8 over attempts: (run_id, dyad_id, attempt, level); one level without a factor, "(none)" without a value."""
    if factor is None:
        return attempts.select(*RUN_KEY, F.lit(ALL_LEVEL).alias("level"))
    return with_treatment(attempts, dyads).select(*RUN_KEY, level_label(F.col("condition")[factor]).alias("level"))


def status_counts(status: DataFrame) -> DataFrame:
    """AG-1: dyads of each run by the label of their latest attempt, zeros included."""
    label = status_label(F.col("status"))
    return latest_status(status).groupBy("run_id").agg(*[F.count_if(label == s).alias(s) for s in ("complete", "failed", "running")])


def outstanding(manifest: DataFrame, status: DataFrame) -> DataFrame:
    """JN-7: planned dyads that are not complete, with the attempt to run next."""
    now = latest_status(status).select(*DYAD, F.col("attempt").alias("_a"), F.col("status").alias("_s"))
    return manifest.join(now, DYAD, "left").where("_s is null or _s <> 'complete'").withColumn("next_attempt", F.coalesce(F.col("_a") + 1, F.lit(1))).drop("_a", "_s")


def seen_attempts(dyads: DataFrame, status: DataFrame) -> DataFrame:
    """SE-2: every attempt that either relation knows."""
    one = lambda df: df.where("dyad_id is not null").select(*DYAD, attempt_or_first(F.col("attempt")).alias("attempt"))
    return one(dyads).union(one(clean_ledger(status))).distinct()


def planned_counts(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """JN-12: planned dyads of each run beside those that the ledger has seen."""
    return manifest.groupBy("run_id").agg(F.count("*").alias("planned")).join(latest_status(actual).groupBy("run_id").agg(F.count("*").alias("seen")), "run_id", "left").select("run_id", "planned", F.coalesce("seen", F.lit(0)).alias("seen"))


def retries(status: DataFrame, dyads: DataFrame, factor: str) -> DataFrame:
    """AG-15: by level, the dyads, those of them with a second attempt, their rate, and the level's part of chi-square."""
    tried = latest_status(status).select(*RUN_KEY)
    by = levels(tried, dyads, factor).groupBy("level").agg(F.count("*").alias("n"), F.count_if(F.col("attempt") > 1).alias("retried"))
    every = Window.partitionBy(F.lit(0))  # a row for each level
    share = F.sum("retried").over(every) / F.sum("n").over(every)
    off = F.pow(F.col("retried") - F.col("n") * share, 2)
    chi = F.try_divide(off, F.col("n") * share) + F.try_divide(off, F.col("n") * (1 - share))
    return by.select("level", "n", "retried", (F.col("retried") / F.col("n")).alias("rate"), chi.alias("chi_square_part"))


def unfinished(manifest: DataFrame, status: DataFrame) -> DataFrame:
    """DQ-11: planned dyads without a complete latest attempt, with their state and last reason."""
    last = clean_ledger(status).groupBy(*DYAD).agg(F.max_by("status", F.struct("attempt", "pos")).alias("status"), F.max_by("reason", F.when(F.col("reason").isNotNull(), F.struct("attempt", "pos"))).alias("reason"))
    return manifest.select(*DYAD).distinct().join(last, DYAD, "left").where("status is null or status <> 'complete'").select(*DYAD, F.coalesce("status", F.lit("never started")).alias("status"), "reason")
