"""Judge scores: targets, curves, flags and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import attempt_or_first, in_subsample, metric_rank, speaker_rank, standard_error
from ..schemas import METRICS, RUN_KEY, SEEKER
from .attempts import last_row, latest_complete, levels, with_treatment

TARGET = [*RUN_KEY, "turn", "agent"]
CADENCE = 4
# How near two judges must be to agree, and the name of the flag rule.
WITHIN = 0.1 + 1e-9
RULE = "consecutive scored seeker turns"


def no_failures(rows: DataFrame) -> DataFrame:
    """PF-4: without failed generations and failed judge calls."""
    for column, bad in (("finish_reason", ~F.col("finish_reason").eqNullSafe(F.lit("error"))), ("error", F.coalesce("error", F.lit("")) == "")):
        rows = rows.where(bad) if column in rows.columns else rows
    return rows


def choose_judge(scores: DataFrame, metric: str, prefix: str | None = None) -> str | None:
    """PF-10: the one judge of a metric whose hash starts with ``prefix``; without one, the only judge there is.

    ValueError if the prefix matches not exactly one, or if there are several and no prefix. Judges are a handful.
    """
    judges = [r[0] for r in scores.where(F.col("metric") == metric).select("judge_sha256").where("judge_sha256 is not null").distinct().orderBy("judge_sha256").collect()]
    if prefix:
        found = [j for j in judges if j.startswith(prefix)]
        if len(found) != 1:
            raise ValueError(f"judge {prefix!r} matches {len(found)} of the {len(judges)} judges that scored {metric}")
        return found[0]
    if len(judges) > 1:
        raise ValueError(f"{len(judges)} judges scored {metric}; choose one")
    return judges[0] if judges else None


def metric_agents(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(METRICS, "metric string, agent string")


def select_targets(turns: DataFrame, scope: str, subsample: float | None = None, run_seed: int = 0) -> DataFrame:
    """PF-11: the (message, metric) pairs to score: all of them (pilot), or on every fourth turn and the agent's last one
    the seeker's (main) or the mentor's (stance)."""
    if scope not in ("pilot", "main", "stance"):
        raise ValueError(f"unknown scope {scope!r}")
    rows = turns.where(~F.col("finish_reason").eqNullSafe(F.lit("error"))).withColumn("attempt", attempt_or_first(F.col("attempt")))
    if subsample is not None:
        rows = rows.where(in_subsample(run_seed, F.col("dyad_id"), subsample))
    if scope != "pilot":
        rows = on_cadence(rows.where(F.col("agent") == ("seeker" if scope == "main" else "mentor")))
    return rows.join(F.broadcast(metric_agents(turns)), "agent")  # three rows


def on_cadence(rows: DataFrame) -> DataFrame:
    """WN-7: every fourth turn and the last of the attempt."""
    last = F.max("turn").over(Window.partitionBy(*RUN_KEY, "agent"))
    return rows.withColumn("_last", last).where((F.col("turn") % CADENCE == 0) | (F.col("turn") == F.col("_last"))).drop("_last")


def score_curves(dyads: DataFrame, status: DataFrame, scores: DataFrame, factor: str | None = None, metric: str = "alignment", judge: str | None = None) -> DataFrame:
    """AG-5: (level, turn, n, mean, se) of one judge's scores of a metric; the last number of a target counts."""
    at = levels(latest_complete(status), dyads, factor)
    rows = no_failures(scores.where(F.col("metric") == metric)).withColumn("attempt", attempt_or_first(F.col("attempt"))).join(at, RUN_KEY)
    chosen = choose_judge(rows, metric, judge)
    rows = last_row(rows.where((F.col("judge_sha256") == chosen) & F.col("score").isNotNull()).select(*TARGET, "level", "score", "pos"), TARGET)
    return rows.groupBy("level", "turn").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), standard_error(F.col("score")).alias("se"))


def flag_dialogues(scores: DataFrame, threshold: float, metric: str = "prompt_to_line", run_length: int = 3, judge: str | None = None) -> DataFrame:
    """WN-6 and AG-6: by dyad attempt, whether ``run_length`` scored seeker turns in a row lie strictly under the threshold.

    Gaps and islands: scores that are not under the threshold number the islands, counting inside one gives the run. Null
    scores are unscored: they neither lengthen nor break a run. Repeated rows stay turns of their own.
    """
    if metric not in ("prompt_to_line", "line_to_line") or run_length < 1:
        raise ValueError("a seeker metric and a run of one turn or more are needed")
    rows = no_failures(scores.where((F.col("metric") == metric) & (F.col("agent") == SEEKER))).withColumn("attempt", attempt_or_first(F.col("attempt")))
    chosen = judge or choose_judge(rows, metric)
    rows = rows.where(F.col("judge_sha256").eqNullSafe(F.lit(chosen)))
    order = Window.partitionBy(*RUN_KEY).orderBy("turn", "pos")
    under = F.coalesce(F.col("score") < threshold, F.lit(False))
    rows = rows.withColumn("_under", under).withColumn("_island", F.sum(F.when(F.col("score").isNotNull() & ~F.col("_under"), 1).otherwise(0)).over(order))
    inside = Window.partitionBy(*RUN_KEY, "_island").orderBy("turn", "pos")
    rows = rows.withColumn("_run", F.sum(F.col("_under").cast("int")).over(inside))
    first = F.min(F.when(F.col("_under") & (F.col("_run") >= run_length), F.col("turn")))
    return rows.groupBy(*RUN_KEY).agg(
        first.isNotNull().alias("flagged"), first.alias("first_flag_turn"), F.count("score").alias("scored_turns"), F.count_if(F.col("score").isNull()).alias("unscored_turns"),
        F.count_if("_under").alias("turns_under"), F.min("score").alias("min_score"), F.avg("score").alias("mean_score"), F.max("turn").alias("final_turn"))


def flags(dyads: DataFrame, status: DataFrame, scores: DataFrame, threshold: float, metric: str = "prompt_to_line", run_length: int = 3, judge: str | None = None) -> DataFrame:
    """RP-4: flags of the attempts that count, with their treatment. Flags are computed first and filtered then."""
    found = flag_dialogues(scores, threshold, metric, run_length, judge).join(latest_complete(status), RUN_KEY, "left_semi")
    out = with_treatment(found, dyads, "condition", "persona_mode")
    keys = [F.col("condition")[k].alias(k) for k in ("ideology", "topic", "openness", "role")]
    return out.select(*found.columns, *keys, "persona_mode", F.lit(metric).alias("metric"), F.lit(threshold).alias("threshold"), F.lit(run_length).alias("run_length"), F.lit(RULE).alias("rule"))


def flagged_rates(flagged: DataFrame, *keys: str) -> DataFrame:
    """AG-7: (factor, level, flagged, n, rate) for each of ``keys``, in one aggregation over grouping sets."""
    grouped = flagged.groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys]).agg(F.count_if("flagged").alias("flagged"), F.count("*").alias("n"), *[F.grouping(k).alias(f"_{k}") for k in keys])
    factor, level = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in keys:
        factor, level = F.when(F.col(f"_{k}") == 0, k).otherwise(factor), F.when(F.col(f"_{k}") == 0, F.coalesce(F.col(k).cast("string"), F.lit("(none)"))).otherwise(level)
    return grouped.select(factor.alias("factor"), level.alias("level"), "flagged", "n", (F.col("flagged") / F.col("n")).alias("rate"))


def latest_numbers(scores: DataFrame, metric: str) -> DataFrame:
    """Each judge's last number for each target, of all attempts."""
    rows = no_failures(scores.where((F.col("metric") == metric) & F.col("score").isNotNull())).withColumn("attempt", attempt_or_first(F.col("attempt")))
    return last_row(rows.select(*TARGET, "judge_sha256", "score", "pos"), [*TARGET, "judge_sha256"]).drop("pos")


def judge_means(scores: DataFrame, metric: str = "alignment") -> DataFrame:
    """AG-9: (judge_sha256, n, mean)."""
    return latest_numbers(scores, metric).groupBy("judge_sha256").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))


def shared_targets(scores: DataFrame, metric: str = "alignment") -> DataFrame:
    """JN-6 and SE-3: both scores of each target, for every pair of judges that scored it.

    The judges of a target are gathered into one row first, so pairs come from a short array and no self-join is needed.
    """
    by = latest_numbers(scores, metric).groupBy(*TARGET).agg(F.array_sort(F.collect_list(F.struct("judge_sha256", "score"))).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b["judge_sha256"] > a["judge_sha256"]), lambda b: F.struct(a["judge_sha256"].alias("judge_a"), b["judge_sha256"].alias("judge_b"), a["score"].alias("score_a"), b["score"].alias("score_b")))))
    return by.select(*TARGET, F.explode(pairs).alias("p")).select(*TARGET, "p.*")


def agreement(scores: DataFrame, metric: str = "alignment") -> DataFrame:
    """AG-8: by pair of judges: n, mean absolute difference, Pearson's r (null without variance), share within 0.1."""
    off = F.abs(F.col("score_a") - F.col("score_b"))
    spread = F.stddev_pop("score_a") * F.stddev_pop("score_b")
    return shared_targets(scores, metric).groupBy("judge_a", "judge_b").agg(
        F.count("*").alias("n"), F.avg(off).alias("mean_abs_diff"), F.try_divide(F.covar_pop("score_a", "score_b"), F.nullif(spread, F.lit(0.0))).alias("pearson_r"), F.avg((off <= WITHIN).cast("int")).alias("within"))


def first_seen(rows: DataFrame, column: str) -> DataFrame:
    """WN-8: the values of a column in the order in which they first appear: (run_id, value, place)."""
    firsts = rows.where(F.col(column).isNotNull()).groupBy("run_id", F.col(column).alias("value")).agg(F.min("pos").alias("first"))
    return firsts.select("run_id", "value", F.row_number().over(Window.partitionBy("run_id").orderBy("first")).alias("place"))


def metrics_present(scores: DataFrame) -> DataFrame:
    """AG-12: the metrics of each run in their defined order, others after them as they first appear."""
    firsts = scores.where("metric is not null").groupBy("run_id", "metric").agg(F.min("pos").alias("first"))
    return firsts.select("run_id", "metric", F.row_number().over(Window.partitionBy("run_id").orderBy(metric_rank(F.col("metric")), "first")).alias("place"))


def message_order() -> list[Column]:
    """SO-2: by message, then by the metrics' order."""
    return [*map(F.col, RUN_KEY), F.col("turn"), speaker_rank(F.col("agent")), metric_rank(F.col("metric")), F.col("pos")]


def in_message_order(scores: DataFrame) -> DataFrame:
    """SO-2: scores by message, then by the metrics' order."""
    return scores.orderBy(*message_order())


def score_series(scores: DataFrame) -> DataFrame:
    """AG-22: a dyad's scores of each metric and judge as arrays of (turn, score)."""
    rows = no_failures(scores).where("score is not null")
    return rows.groupBy(*RUN_KEY, "metric", "judge_sha256").agg(F.array_sort(F.collect_list(F.struct("turn", "score"))).alias("series"))


def seeker_selection(scores: DataFrame, candidates: DataFrame, metric: str = "prompt_to_line") -> DataFrame:
    """AG-16: candidates (run_id, model, tokens_per_second) by mean adherence at the final turn, ties by throughput."""
    rows = latest_numbers(scores, metric)
    last = rows.withColumn("_last", F.max("turn").over(Window.partitionBy(*RUN_KEY))).where("turn = _last")
    by = last.groupBy("run_id").agg(F.avg("score").alias("adherence"), F.count("*").alias("n"))
    return by.join(candidates, "run_id").select("model", "adherence", "n", "tokens_per_second").orderBy(F.desc("adherence"), F.desc("tokens_per_second"), "model")
