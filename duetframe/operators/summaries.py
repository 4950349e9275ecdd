"""Summaries of runs and dyads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import attempt_or_first, instant, level_label, status_label
from ..schemas import NONE_LEVEL, RUN_KEY
from .attempts import DYAD, clean_ledger, last_row, latest_complete, latest_status, seen_attempts
from .ordering import with_places


def turns_done(turns: DataFrame) -> DataFrame:
    """The mentor's messages that did not fail, by attempt."""
    done = F.count_if((F.col("agent") == "mentor") & ~F.col("finish_reason").eqNullSafe(F.lit("error")))
    return turns.withColumn("attempt", attempt_or_first(F.col("attempt"))).groupBy(*RUN_KEY).agg(done.alias("turns_done"))


def last_activity(*relations: DataFrame) -> DataFrame:
    """SC-11: the latest timestamp of each dyad, as text and as an instant."""
    rows = relations[0].select(*DYAD, "ts")
    for r in relations[1:]:
        rows = rows.unionByName(r.select(*DYAD, "ts"))
    return rows.groupBy(*DYAD).agg(F.max("ts").alias("last_ts")).withColumn("last_seen", instant(F.col("last_ts")))


def dyad_progress(dyads: DataFrame, status: DataFrame, turns: DataFrame) -> DataFrame:
    """AG-10: a row for each dyad that the log knows: its attempt, how many there were, status, progress, reason of failure."""
    seen = seen_attempts(dyads, status).groupBy(*DYAD).agg(F.max("attempt").alias("_highest"), F.count("*").alias("attempts"))
    now = latest_status(status).withColumnRenamed("attempt", "_at")
    out = seen.join(now, DYAD, "left").withColumn("attempt", F.coalesce("_at", "_highest")).withColumn("status", status_label(F.col("status")))
    reasons = last_row(clean_ledger(status).select(*RUN_KEY, "reason", "pos"), RUN_KEY).drop("pos")
    given = last_row(dyads.select(*RUN_KEY, "condition", "persona_mode", "n_turns", "pos"), RUN_KEY).drop("pos")
    out = out.join(reasons, RUN_KEY, "left").join(turns_done(turns), RUN_KEY, "left").join(last_activity(status, turns).drop("last_seen"), DYAD, "left").join(given, RUN_KEY, "left")
    return out.select(*RUN_KEY, "attempts", "status", F.coalesce("turns_done", F.lit(0)).alias("turns_done"), F.when(F.col("status") == "failed", F.col("reason")).alias("reason"), "last_ts", "condition", "persona_mode", "n_turns")


def condition_levels(dyads: DataFrame) -> DataFrame:
    """AG-11: condition keys and their levels, in order of first appearance: (run_id, factor, level, place)."""
    each = dyads.select("run_id", "pos", F.explode("condition").alias("factor", "value")).select("run_id", "factor", level_label(F.col("value")).alias("level"), "pos")
    firsts = each.groupBy("run_id", "factor", "level").agg(F.min("pos").alias("first"))
    return firsts.select("run_id", "factor", "level", F.row_number().over(Window.partitionBy("run_id", "factor").orderBy("first")).alias("place"))


def level_rank(level: Column, order: list[str] | None) -> list[Column]:
    """SO-3: sort keys for levels: given ones in their order, others after them, "(none)" last; then first appearance."""
    if not order:
        return []
    given = F.array_position(F.array(*[F.coalesce(F.lit(x), F.lit(NONE_LEVEL)) for x in order]), level)
    return [(level == NONE_LEVEL).asc(), F.when(given == 0, len(order) + 1).otherwise(given).asc()]


def ordered_levels(firsts: DataFrame, order: list[str] | None) -> DataFrame:
    """(level, place) from (level, first) and a given order."""
    keys = [*level_rank(F.col("level"), order), F.col("first").asc()]
    return firsts.select("level", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys)).alias("place"))  # a row for each level


def level_order(grid: DataFrame | None, study: DataFrame | None, factor: str) -> list[str] | None:
    """SO-4: the levels of a factor from the grid, else from the study file, else none; both are tables of the design."""
    for table in (grid, study):
        if table is not None and (found := [r["level"] for r in table.where(F.col("factor") == factor).orderBy("place").collect()]):
            return found
    return None


def filtered_dyads(progress: DataFrame, status: str | None = None, search: str | None = None, **levels: str) -> DataFrame:
    """PF-16: dyads by status, part of the id, and a level for any condition key."""
    if status:
        progress = progress.where(F.col("status") == status)
    if search and search.strip():
        progress = progress.where(F.contains(F.lower("dyad_id"), F.lit(search.strip().lower())))
    for key, wanted in levels.items():
        progress = progress.where(level_label(F.col("condition")[key]) == wanted)
    return progress


def chosen_attempt(dyads: DataFrame, status: DataFrame, attempt: int | None = None) -> DataFrame:
    """PF-15: of each dyad the given attempt, or its latest complete one, else its highest."""
    seen = seen_attempts(dyads, status)
    if attempt is not None:
        return seen.where(F.col("attempt") == attempt)
    highest = seen.groupBy(*DYAD).agg(F.max("attempt").alias("_highest"))
    return highest.join(latest_complete(status), DYAD, "left").select(*DYAD, F.coalesce("attempt", "_highest").alias("attempt"))


def runs_overview(manifest: DataFrame, status: DataFrame, dyads: DataFrame) -> DataFrame:
    """RP-2, by run: planned and known dyads and their states; ``place`` counts from the newest activity (SO-5)."""
    counts = latest_status(status).groupBy("run_id").agg(*[F.count_if(status_label(F.col("status")) == s).alias(s) for s in ("complete", "failed", "running")])
    planned = manifest.groupBy("run_id").agg(F.count("*").alias("planned"))
    known = dyads.groupBy("run_id").agg(F.count_distinct("dyad_id").alias("dyads"))
    last = status.groupBy("run_id").agg(F.max("ts").alias("last_ts"))
    out = planned.join(counts, "run_id", "full").join(known, "run_id", "left").join(last, "run_id", "left")
    return with_places(out.na.fill(0, ["planned", "complete", "failed", "running", "dyads"]), F.desc("last_ts"), F.col("run_id"))


def quality_rates(turns: DataFrame, scores: DataFrame) -> DataFrame:
    """AG-14: by run, shares of cache warnings, truncated and cut messages, and null scores."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    spoken = turns.groupBy("run_id").agg(F.count("*").alias("n_turns"), share(F.col("cache_warning")).alias("cache_warning"), share(F.col("truncated")).alias("truncated"), share(F.col("finish_reason") == "length").alias("cut"))
    judged = scores.groupBy("run_id").agg(F.count("*").alias("n_scores"), share(F.col("score").isNull()).alias("null_scores"))
    return spoken.join(judged, "run_id", "left")


def context_need(runs: DataFrame, headroom: int = 2048) -> DataFrame:
    """AG-19: tokens that the longest dialogue of a run needs, and whether the slot holds them; null if its size is unknown."""
    need = F.col("max_turns") * 2 * F.col("n_predict") + headroom
    return runs.select("run_id", need.cast("long").alias("need"), "n_ctx", (F.col("n_ctx") >= need).alias("fits"))


def text_balance(texts: DataFrame, level: str, text: str = "text") -> DataFrame:
    """AG-20: by level, the number of texts, words and anchors (sentences)."""
    words = F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), ""))
    anchors = F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[.!?]"), F.lit(0)))
    return texts.groupBy(F.col(level).alias("level")).agg(F.count("*").alias("n"), F.avg(words).alias("mean_words"), F.avg(anchors).alias("mean_anchors"))
