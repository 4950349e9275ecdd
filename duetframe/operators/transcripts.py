"""Messages in order, what came before each, and the work lists built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import attempt_or_first, derived_seed, model_family, sha256, speaker_rank, survey_turn
from ..schemas import MENTOR, RUN_KEY, SEEKER
from .attempts import latest_complete, last_row, only_latest_complete
from .scores import TARGET, no_failures, select_targets

CACHE_MARGIN = 64


def message_window(*more: str):
    return Window.partitionBy(*RUN_KEY, *more).orderBy("turn", speaker_rank(F.col("agent")), "pos")


def positions(turns: DataFrame) -> DataFrame:
    """WN-3, SO-1: each message's place in its dialogue: by turn, the seeker first, repeated rows in file order."""
    return turns.withColumn("place", F.row_number().over(message_window()))


def histories(turns: DataFrame) -> DataFrame:
    """WN-4, WN-5: the speaker's earlier lines and the partner's last line before each message, one sort for both."""
    own = F.collect_list("text").over(message_window("agent").rowsBetween(Window.unboundedPreceding, -1))
    before = message_window().rowsBetween(Window.unboundedPreceding, -1)
    last = lambda agent: F.last(F.when(F.col("agent") == agent, F.col("text")), ignorenulls=True).over(before)
    partner = F.when(F.col("agent") == SEEKER, last(MENTOR)).otherwise(last(SEEKER))
    return turns.withColumns({"earlier": own, "partner": partner})


#: Turns of a block. A dialogue that is much longer than usual is worked on in blocks, each in a task of its own.
BLOCK_TURNS = 64


def block_of(turns: int = BLOCK_TURNS) -> Column:
    return F.floor(F.col("turn") / turns).alias("block")


def history_places(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """WN-3 to WN-5 for dialogues of any length: each message's ``place`` and ``partner`` line, and where its speaker's earlier
    lines are: all of the blocks before ``block``, and the first ``nth`` of that block, ``n_earlier`` together, in
    ``agent_line_blocks``. No history is copied, and a task sorts a block of a dialogue, not all of it.
    """
    rows = turns.withColumn("block", block_of(block_turns))
    order = [F.col("turn"), speaker_rank(F.col("agent")), F.col("pos")]
    mine, both = Window.partitionBy(*RUN_KEY, "block", "agent").orderBy(*order), Window.partitionBy(*RUN_KEY, "block").orderBy(*order)
    line = lambda agent: F.when(F.col("agent") == agent, F.col("text"))
    last = lambda agent: F.last(line(agent), ignorenulls=True).over(both.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"_nth": F.row_number().over(both), "nth": F.count("text").over(mine.rowsBetween(Window.unboundedPreceding, -1)), "_seeker": last(SEEKER), "_mentor": last(MENTOR)})
    # a row for each block: what it has, then what the blocks before it have
    latest = lambda agent: F.max_by("text", F.when(line(agent).isNotNull(), F.struct(*order)))
    sums = turns.withColumn("block", block_of(block_turns)).groupBy(*RUN_KEY, "block").agg(F.count("*").alias("n"), F.count(line(SEEKER)).alias("n_seeker"), F.count(line(MENTOR)).alias("n_mentor"), latest(SEEKER).alias("seeker"), latest(MENTOR).alias("mentor"))
    earlier = Window.partitionBy(*RUN_KEY).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    sums = sums.select(*RUN_KEY, "block", total("n").alias("_n"), total("n_seeker").alias("_n_seeker"), total("n_mentor").alias("_n_mentor"), F.last("seeker", ignorenulls=True).over(earlier).alias("_old_seeker"), F.last("mentor", ignorenulls=True).over(earlier).alias("_old_mentor"))
    out = rows.join(sums, [*RUN_KEY, "block"])
    own = F.when(F.col("agent") == SEEKER, F.col("_n_seeker")).otherwise(F.col("_n_mentor"))
    partner = F.when(F.col("agent") == SEEKER, F.coalesce("_mentor", "_old_mentor")).otherwise(F.coalesce("_seeker", "_old_seeker"))
    return out.select(*turns.columns, "block", (F.col("_n") + F.col("_nth")).alias("place"), "nth", (own + F.col("nth")).alias("n_earlier"), partner.alias("partner"))


def agent_line_blocks(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """SC-13: the lines of each agent in order, a row for each block of a dialogue: (block, lines)."""
    rows = F.sort_array(F.collect_list(F.struct("turn", "pos", "text")))
    return turns.where("text is not null").groupBy(*RUN_KEY, "agent", block_of(block_turns)).agg(F.transform(rows, lambda x: x["text"]).alias("lines"))


def agent_totals(turns: DataFrame) -> DataFrame:
    """SC-13: by dialogue and agent, the number of messages and the last line; nothing is gathered."""
    return turns.groupBy(*RUN_KEY, "agent").agg(F.count("*").alias("n_messages"), F.max_by("text", F.struct("turn", "pos")).alias("last_line"))


def view_blocks(turns: DataFrame, dyads: DataFrame, agent: str, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """SC-8 for dialogues of any length: ``views`` cut into rows (block, messages), to be read one after the other.

    The persona comes in a block before the first, the reminder in one after the last.
    """
    role = F.when(F.col("agent") == agent, "assistant").otherwise("user")
    said = F.array_sort(F.collect_list(F.struct("turn", speaker_rank(F.col("agent")).alias("rank"), "pos", role.alias("role"), F.col("text").alias("content"))))
    out = turns.groupBy(*RUN_KEY, block_of(block_turns)).agg(F.transform(said, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
    if agent != SEEKER:
        return out
    persona = last_row(dyads.select(*RUN_KEY, "persona_text", "persona_reminder", "persona_mode", "pos"), RUN_KEY)
    ends = turns.groupBy(*RUN_KEY).agg(F.min("turn").alias("_a"), F.max("turn").alias("_b")).join(persona, RUN_KEY, "left")
    edge = lambda c, turn, by: F.struct((F.floor(F.col(turn) / block_turns) + by).alias("block"), F.coalesce(F.col(c), F.lit("")).alias("content"))
    remind = (F.col("persona_mode") == "reinforced") & (F.coalesce("persona_reminder", F.lit("")) != "")
    both = F.array(edge("persona_text", "_a", -1), F.when(remind, edge("persona_reminder", "_b", 1)))
    system = ends.select(*RUN_KEY, F.explode(F.filter(both, lambda x: x.isNotNull())).alias("e"))
    return out.unionByName(system.select(*RUN_KEY, "e.block", F.array(F.struct(F.lit("system").alias("role"), F.col("e.content").alias("content"))).alias("messages")))


def cache_losses(turns: DataFrame, limit: int) -> DataFrame:
    """WN-9: messages past an agent's first that prefilled far more than expected."""
    again = F.row_number().over(message_window("agent")) > 1
    return turns.withColumn("_again", again).where(F.col("_again") & (F.col("prompt_n") > F.col("expected_new") + CACHE_MARGIN) & (F.col("prompt_n") > limit)).drop("_again")


def agent_lines(turns: DataFrame) -> DataFrame:
    """SC-13: by dialogue and agent, the number of messages, the last line, and all lines in order."""
    rows = F.sort_array(F.collect_list(F.struct("turn", "pos", "text")))
    by = turns.groupBy(*RUN_KEY, "agent").agg(rows.alias("r"))
    return by.select(*RUN_KEY, "agent", F.size("r").cast("long").alias("n_messages"), F.element_at("r", -1)["text"].alias("last_line"), F.transform("r", lambda x: x["text"]).alias("lines"))


def views(turns: DataFrame, dyads: DataFrame, agent: str) -> DataFrame:
    """SC-8: the messages of each dialogue as one agent sees them: its own lines as assistant, the partner's as user.

    The seeker also has its persona in front and, if it is reinforced, the reminder at the end.
    """
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", speaker_rank(F.col("agent")).alias("rank"), "pos", "agent", "text"))), lambda m: F.struct(F.when(m["agent"] == agent, "assistant").otherwise("user").alias("role"), m["text"].alias("content")))
    by = turns.groupBy(*RUN_KEY).agg(said.alias("messages"))
    if agent != SEEKER:
        return by
    persona = last_row(dyads.select(*RUN_KEY, "persona_text", "persona_reminder", "persona_mode", "pos"), RUN_KEY)
    system = lambda c: F.array(F.struct(F.lit("system").alias("role"), F.coalesce(c, F.lit("")).alias("content")))
    remind = (F.col("persona_mode") == "reinforced") & (F.coalesce("persona_reminder", F.lit("")) != "")
    none = F.array().cast("array<struct<role:string,content:string>>")
    return by.join(persona, RUN_KEY, "left").select(*RUN_KEY, F.concat(system(F.col("persona_text")), "messages", F.when(remind, system(F.col("persona_reminder"))).otherwise(none)).alias("messages"))


def completeness(turns: DataFrame, dyads: DataFrame) -> DataFrame:
    """PF-14: attempts that reached their planned last turn without a failed message."""
    by = turns.groupBy(*RUN_KEY).agg(F.max("turn").alias("last"), F.count_if(F.col("finish_reason") == "error").alias("errors"))
    planned = last_row(dyads.select(*RUN_KEY, "n_turns", "pos"), RUN_KEY).drop("pos")
    return by.join(planned, RUN_KEY).where("last = n_turns and errors = 0").select(*RUN_KEY)


def not_scored(targets: DataFrame, scores: DataFrame, judge: str) -> DataFrame:
    """JN-5: targets that the judge has no row for yet; a null score is done, a failed call is not."""
    done = no_failures(scores.where(F.col("judge_sha256") == judge)).withColumn("attempt", attempt_or_first(F.col("attempt")))
    return targets.join(done.select(*TARGET, "metric").distinct(), [*TARGET, "metric"], "left_anti")


def without_treatment(targets: DataFrame, dyads: DataFrame) -> DataFrame:
    """JN-3: targets of attempts that have no treatment row; they become error rows instead of requests."""
    return targets.join(dyads.select(*RUN_KEY).distinct(), RUN_KEY, "left_anti").withColumn("error", F.lit("no treatment row for this attempt"))


def request_text(tasks: dict[str, str], metric: Column, topic: Column, persona: Column, earlier: Column, partner: Column, line: Column) -> Column:
    """SC-7: what the judge reads for one line; ``tasks`` says what to do for each metric, in the words of the study."""
    task = F.lit(None).cast("string")
    for name, text in tasks.items():
        task = F.when(metric == name, text).otherwise(task)
    lines = F.when(F.size(earlier) == 0, "- (none yet)").otherwise(F.array_join(F.transform(earlier, lambda x: F.concat(F.lit("- "), x)), "\n"))
    parts = [F.concat(F.lit("TASK: "), task), F.concat(F.lit("TOPIC: "), F.coalesce(topic, F.lit(""))), F.concat(F.lit("PERSONA:\n"), F.coalesce(persona, F.lit(""))),
             F.when(metric == "line_to_line", F.concat(F.lit("EARLIER LINES:\n"), lines)), F.concat(F.lit("PARTNER'S LINE:\n"), partner), F.concat(F.lit("LINE:\n"), line)]
    return F.concat_ws("\n\n", *parts)  # a part that is null is left out


def target_histories(targets: DataFrame, rows: DataFrame) -> DataFrame:
    """``targets`` with ``earlier`` and ``partner`` (WN-4, WN-5), gathered for these messages only.

    The messages before one are counted in one sort, without gathering. An agent's lines in order are then one array a
    dialogue, made only for dialogues and agents with a target that asks for it, and cut for each target.
    """
    before = message_window().rowsBetween(Window.unboundedPreceding, -1)
    last = lambda agent: F.last(F.when(F.col("agent") == agent, F.col("text")), ignorenulls=True).over(before)
    partner = F.when(F.col("agent") == SEEKER, last(MENTOR)).otherwise(last(SEEKER))
    spoken = lambda agent: F.count(F.when(F.col("agent") == agent, F.col("text"))).over(before)
    nth = F.when(F.col("agent") == SEEKER, spoken(SEEKER)).otherwise(spoken(MENTOR))
    placed = rows.withColumns({"nth": nth, "partner": partner})
    placed = targets.select(*TARGET, "pos", "metric").join(placed, [*TARGET, "pos"])
    asked = targets.where("metric = 'line_to_line'").select(*RUN_KEY, "agent").distinct()
    order = F.struct("turn", speaker_rank(F.col("agent")).alias("rank"), "pos", "text")
    lines = rows.join(asked, [*RUN_KEY, "agent"], "left_semi").where("text is not null").groupBy(*RUN_KEY, "agent").agg(F.array_sort(F.collect_list(order)).alias("lines"))
    mine = placed.join(lines, [*RUN_KEY, "agent"], "left").withColumn("earlier", F.when(F.col("metric") == "line_to_line", F.transform(F.slice("lines", F.lit(1), F.col("nth").cast("int")), lambda x: x["text"])))
    return mine.drop("lines", "nth")


def score_worklist(turns: DataFrame, dyads: DataFrame, status: DataFrame, scores: DataFrame, scope: str, judge: str, run_seed: int, subsample: float | None = None, *, tasks: dict[str, str]) -> DataFrame:
    """RP-7: what a judge still has to score, with seed and request; targets without a treatment carry an error instead.

    The history of a line includes failed messages; only targets leave them out.
    """
    rows = only_latest_complete(turns, status)
    targets = target_histories(not_scored(select_targets(rows, scope, subsample, run_seed), scores, judge), rows)
    given = last_row(dyads.select(*RUN_KEY, "seed", "persona_text", "condition", "pos").withColumnRenamed("seed", "dyad_seed"), RUN_KEY).drop("pos").withColumn("_known", F.lit(True))
    out = targets.join(given, RUN_KEY, "left")
    seed = derived_seed(F.lit(run_seed), F.col("dyad_seed"), F.col("dyad_id"), F.col("attempt"), F.col("turn"), F.concat_ws(":", F.lit("judge"), "agent", "metric"))
    request = F.when(F.col("_known"), request_text(tasks, F.col("metric"), F.col("condition")["topic"], F.col("persona_text"), F.col("earlier"), F.col("partner"), F.col("text")))
    return out.select(*TARGET, "metric", F.lit(judge).alias("judge_sha256"), seed.alias("seed"), request.alias("request"), F.when(F.col("_known").isNull(), "no treatment row for this attempt").alias("error"), "pos")


def survey_worklist(turns: DataFrame, dyads: DataFrame, status: DataFrame, items: DataFrame, run_seed: int) -> DataFrame:
    """RP-8: questions to ask again after the dialogue, for each attempt that counts and item of the instrument.

    A question goes after the dialogue's ``n_messages - 1`` messages as the mentor sees them: ``view_blocks`` has these once
    for all items, ``survey_requests`` puts both together.
    """
    seen = only_latest_complete(turns, status).groupBy(*RUN_KEY).agg((F.count("*") + 1).alias("n_messages"))
    spec = last_row(dyads.select(*RUN_KEY, F.col("seed").alias("dyad_seed"), "n_turns", "pos"), RUN_KEY).drop("pos")
    turn = survey_turn(F.lit("post"), F.col("n_turns"))
    seed = derived_seed(F.lit(run_seed), F.col("dyad_seed"), F.col("dyad_id"), F.col("attempt"), turn, F.concat(F.lit("survey:post:"), F.col("item_id")))
    attempts = latest_complete(status).join(spec, RUN_KEY).join(seen, RUN_KEY)
    return attempts.crossJoin(F.broadcast(items)).select(*RUN_KEY, "item_id", turn.alias("turn"), seed.alias("seed"), "n_messages", F.col("text").alias("question"))  # items: the instrument, a dozen rows


def survey_requests(worklist: DataFrame, turns: DataFrame, dyads: DataFrame) -> DataFrame:
    """The rows of ``survey_worklist`` with all messages to send; each holds its whole dialogue, so choose the rows first."""
    asked = F.concat("messages", F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content"))))
    return worklist.join(views(turns, dyads, MENTOR), RUN_KEY).withColumn("messages", asked)


def judge_conflicts(runs: DataFrame, judges: DataFrame) -> DataFrame:
    """JN-11: judges that are a role of the run, or of the mentor's family; an unknown family does not block."""
    pairs = runs.join(judges, "run_id")
    family = F.coalesce("mentor_family", model_family(F.col("mentor_path")))
    same = F.when(F.col("judge_sha256") == F.col("seeker_sha256"), "judge is the seeker").when(F.col("judge_sha256") == F.col("mentor_sha256"), "judge is the mentor").when(family == model_family(F.col("judge_path")), "judge is of the mentor's family")
    return pairs.select("run_id", "judge_sha256", same.alias("problem")).where("problem is not null")


def text_digests(turns: DataFrame) -> DataFrame:
    """Digest of every message, for comparing logs without their texts."""
    return turns.select(*RUN_KEY, "turn", "agent", sha256(F.coalesce("text", F.lit(""))).alias("text_sha256"))
