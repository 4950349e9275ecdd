"""Views that users ask for whole: several relations in, a dictionary of tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import attempts, audits, scores, summaries, surveys
from ..schemas import METRICS, RUN_KEY


def analyze_run(dyads: DataFrame, status: DataFrame, survey_rows: DataFrame, score_rows: DataFrame, factor: str | None = None, metric: str = "alignment", judge: str | None = None, level_order: list[str] | None = None) -> dict[str, DataFrame]:
    """RP-1: what there is to choose from, survey shifts and score curves by a factor of the conditions."""
    known = summaries.condition_levels(dyads)
    if metric not in [m for m, _ in METRICS]:
        raise ValueError(f"unknown metric {metric!r}")
    if factor is not None and not known.isEmpty() and known.where(F.col("factor") == factor).isEmpty():
        raise ValueError(f"{factor!r} is not a condition key of this run")
    at = attempts.levels(attempts.latest_complete(status), dyads, factor)
    order = attempts.clean_ledger(status).groupBy(*RUN_KEY).agg(F.min("pos").alias("pos"))
    firsts = at.join(order, RUN_KEY).groupBy("level").agg(F.min("pos").alias("first"))
    return {
        "factors": known, "levels": summaries.ordered_levels(firsts, level_order), "status_counts": attempts.status_counts(status), "metrics": scores.metrics_present(score_rows), "judges": scores.first_seen(score_rows, "judge_sha256"),
        "n_dyads": surveys.n_dyads(dyads, status, factor), "by_item": surveys.shift_by_item(dyads, status, survey_rows, factor), "by_battery": surveys.shift_by_battery(dyads, status, survey_rows, factor),
        "curves": scores.score_curves(dyads, status, score_rows, factor, metric, judge)}


def run_summary(dyads: DataFrame, status: DataFrame, turns: DataFrame, score_rows: DataFrame, manifest: DataFrame) -> dict[str, DataFrame]:
    """RP-2: a run's counts, its dyads with their progress, its factors, metrics and judges."""
    return {"runs": summaries.runs_overview(manifest, status, dyads), "dyads": summaries.dyad_progress(dyads, status, turns), "factors": summaries.condition_levels(dyads), "metrics": scores.metrics_present(score_rows), "judges": scores.first_seen(score_rows, "judge_sha256"), "planned": attempts.planned_counts(manifest, status)}


def dyad_detail(dyads: DataFrame, status: DataFrame, turns: DataFrame, survey_rows: DataFrame, score_rows: DataFrame, dyad_id: str, attempt: int | None = None) -> dict[str, DataFrame]:
    """RP-3: one dyad's chosen attempt: ledger, messages in order, survey pairs and battery means, scores in order."""
    mine = lambda df: df.where(F.col("dyad_id") == dyad_id)  # noqa: E731  reaches the scans
    chosen = summaries.chosen_attempt(mine(dyads), mine(status), attempt)
    of = lambda df: mine(df).join(F.broadcast(chosen), RUN_KEY, "left_semi")  # noqa: E731  one row
    from ..operators.transcripts import positions

    pairs = surveys.survey_pairs(of(survey_rows))
    return {"status": mine(status), "attempt": chosen, "turns": positions(of(turns)), "pairs": pairs, "battery_means": surveys.dyad_battery_means(pairs), "scores": scores.in_message_order(of(score_rows)), "series": scores.score_series(of(score_rows))}


def agreement_report(score_rows: DataFrame, metric: str = "alignment") -> dict[str, DataFrame]:
    """RP-5: judges, their means, and their agreement in pairs."""
    return {"per_judge": scores.judge_means(score_rows, metric), "pairs": scores.agreement(score_rows, metric)}


def run_audit(manifest: DataFrame, dyads: DataFrame, status: DataFrame, turns: DataFrame, survey_rows: DataFrame, score_rows: DataFrame, runs: DataFrame, run_seed: int, factor: str) -> dict[str, DataFrame]:
    """RP-9: answer methods, quality rates, retries, seeds, records, models, and what is unfinished."""
    return {
        "answer_methods": surveys.answer_methods(survey_rows), "quality": summaries.quality_rates(turns, score_rows), "retries": attempts.retries(status, dyads, factor), "wrong_seeds": audits.wrong_seeds(turns, dyads, run_seed),
        "records": audits.run_records(runs), "models": audits.model_mismatches(turns, runs), "unfinished": attempts.unfinished(manifest, status)}
