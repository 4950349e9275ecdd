"""Queries over scores, flags, agreement, messages and work lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing, scalars
from ..operators import ordering, scores, summaries, transcripts
from ..sources.projections import RUN_SEED
from .base import Registry, Tables
from .ledger import LATEST, S

R = Registry()
J1, J2, J3 = "sha256('judge-1')", "sha256('judge-2')", "sha256('judge-3')"  # the third has scored nothing yet
OK = "coalesce(error, '') = ''"
LAST = f"SELECT run_id, dyad_id, attempt, turn, agent, judge_sha256, arg_max(score, pos) AS score FROM scores WHERE metric = 'alignment' AND {OK} AND score IS NOT NULL GROUP BY ALL"


#: What these queries ask the judge.
TASKS = {"prompt_to_line": "How well does the line fit the persona?", "line_to_line": "How well does the line fit the earlier lines?", "alignment": "How far does the line share the position of the persona?"}


def judge(t: Tables, number: int = 1) -> str:
    return t.spark.sql(f"select sha2('judge-{number}', 256)").first()[0]


@R.add("pf04_no_failures", "turns", "SELECT finish_reason, count(*) AS n FROM turns WHERE finish_reason <> 'error' AND coalesce(error, '') = '' GROUP BY 1")
def _(t: Tables):
    return scores.no_failures(t.turns).groupBy("finish_reason").agg(F.count("*").alias("n"))


@R.add("pf10_chosen_judge", "scores", f"SELECT judge_sha256, count(*) AS n FROM scores WHERE metric = 'alignment' AND judge_sha256 = {J2} GROUP BY 1")
def _(t: Tables):
    chosen = scores.choose_judge(t.scores, "alignment", judge(t, 2)[:10])
    return t.scores.where((F.col("metric") == "alignment") & (F.col("judge_sha256") == chosen)).groupBy("judge_sha256").agg(F.count("*").alias("n"))


def scope_sql(scope: str) -> str:
    if scope == "pilot":
        return "SELECT run_id, dyad_id, attempt, turn, agent, metric FROM turns JOIN (SELECT 'prompt_to_line' AS metric, 'seeker' AS a UNION ALL SELECT 'line_to_line', 'seeker' UNION ALL SELECT 'alignment', 'mentor') m ON agent = a WHERE finish_reason <> 'error'"
    metrics = "(SELECT unnest(['prompt_to_line', 'line_to_line']) AS metric)" if scope == "main" else "(SELECT 'alignment' AS metric)"
    agent = "seeker" if scope == "main" else "mentor"
    return f"SELECT run_id, dyad_id, attempt, turn, agent, metric FROM (SELECT *, max(turn) OVER (PARTITION BY run_id, dyad_id, attempt) AS last FROM turns WHERE finish_reason <> 'error' AND agent = '{agent}') t, {metrics} m WHERE turn % 4 = 0 OR turn = last"


for _scope in ("pilot", "main", "stance"):
    @R.add(f"pf11_targets_{_scope}", "turns", scope_sql(_scope))
    def _(t: Tables, scope: str = _scope):
        return scores.select_targets(t.turns, scope).select("run_id", "dyad_id", "attempt", "turn", "agent", "metric")


@R.add("pf12_subsample", "turns", f"SELECT DISTINCT dyad_id FROM turns WHERE cast('0x' || substr(sha256('{RUN_SEED}|' || dyad_id), 1, 8) AS bigint) / 4294967296.0 < 0.25")
def _(t: Tables):
    return t.turns.where(scalars.in_subsample(RUN_SEED, F.col("dyad_id"), 0.25)).select("dyad_id").distinct()


@R.add("jn03_without_treatment", "turns dyads", "SELECT t.run_id, t.dyad_id, t.attempt, count(*) AS n FROM turns t ANTI JOIN dyads d USING (run_id, dyad_id, attempt) GROUP BY ALL")
def _(t: Tables):
    return transcripts.without_treatment(t.turns, t.dyads).groupBy("run_id", "dyad_id", "attempt").agg(F.count("*").alias("n"))


@R.add("jn05_not_scored", "turns scores", f", targets AS ({scope_sql('pilot')}) SELECT t.run_id, t.dyad_id, t.attempt, t.turn, t.agent, t.metric FROM targets t ANTI JOIN (SELECT * FROM scores WHERE judge_sha256 = {J1} AND {OK}) s USING (run_id, dyad_id, attempt, turn, agent, metric)")
def _(t: Tables):
    return transcripts.not_scored(scores.select_targets(t.turns, "pilot"), t.scores, judge(t)).select("run_id", "dyad_id", "attempt", "turn", "agent", "metric")


SHARED = f", last AS ({LAST}), pairs AS (SELECT a.*, b.judge_sha256 AS judge_b, b.score AS score_b FROM last a JOIN last b USING (run_id, dyad_id, attempt, turn, agent) WHERE a.judge_sha256 < b.judge_sha256)"


@R.add("jn06_judge_pairs", "scores", SHARED + " SELECT run_id, dyad_id, attempt, turn, judge_sha256 AS judge_a, judge_b, round(score, 6) AS score_a, round(score_b, 6) AS score_b FROM pairs")
def _(t: Tables):
    return scores.shared_targets(t.scores).select("run_id", "dyad_id", "attempt", "turn", "judge_a", "judge_b", "score_a", "score_b")


@R.add("se03_shared_targets", "scores", f"SELECT run_id, dyad_id, attempt, turn FROM scores WHERE metric = 'alignment' AND {OK} AND score IS NOT NULL AND judge_sha256 = {J1} INTERSECT SELECT run_id, dyad_id, attempt, turn FROM scores WHERE metric = 'alignment' AND {OK} AND score IS NOT NULL AND judge_sha256 = {J2}")
def _(t: Tables):
    return scores.shared_targets(t.scores).select("run_id", "dyad_id", "attempt", "turn")


@R.add("jn11_judge_conflicts", "runs", ", judges AS (SELECT run_id, sha256('model-' || CASE run_id WHEN 'r0' THEN 'mentor' ELSE 'judge' END) AS j FROM runs) SELECT run_id, j AS judge_sha256, CASE WHEN j = mentor_sha256 THEN 'judge is the mentor' ELSE 'judge is of the mentor''s family' END AS problem FROM runs JOIN judges USING (run_id) WHERE j = mentor_sha256 OR (mentor_path LIKE '%gpt-oss%')")
def _(t: Tables):
    runs = t.runs.withColumn("mentor_family", F.lit(None).cast("string"))
    judges = t.runs.select("run_id", F.sha2(F.concat(F.lit("model-"), F.when(F.col("run_id") == "r0", "mentor").otherwise("judge")).cast("binary"), 256).alias("judge_sha256"), F.lit("gpt_oss-120b").alias("judge_path"))
    return transcripts.judge_conflicts(runs, judges)


@R.add("ag05_score_curves", "scores status dyads", S + f", last AS (SELECT run_id, dyad_id, attempt, turn, agent, arg_max(score, pos) AS score FROM scores WHERE metric = 'alignment' AND {OK} AND score IS NOT NULL AND judge_sha256 = {J1} GROUP BY ALL) SELECT level, turn, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score) / sqrt(count(*)), 6) AS se FROM last JOIN leveled USING (run_id, dyad_id, attempt) GROUP BY level, turn")
def _(t: Tables):
    return scores.score_curves(t.dyads, t.status, t.scores, "ideology", "alignment", judge(t)[:8])


FLAGS = f""", rows_of AS (SELECT *, score < 0.6 AS under FROM scores WHERE metric = 'prompt_to_line' AND agent = 'seeker' AND {OK} AND judge_sha256 = {J1}),
islands AS (SELECT *, sum(CASE WHEN score IS NOT NULL AND NOT under THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, dyad_id, attempt ORDER BY turn, pos) AS island FROM rows_of),
counted AS (SELECT *, sum(CASE WHEN coalesce(under, false) THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, dyad_id, attempt, island ORDER BY turn, pos) AS run FROM islands),
flagged AS (SELECT run_id, dyad_id, attempt, count(*) FILTER (WHERE under AND run >= 2) > 0 AS flagged, min(turn) FILTER (WHERE under AND run >= 2) AS first_flag_turn, count(score) AS scored_turns, count(*) - count(score) AS unscored_turns,
  count(*) FILTER (WHERE under) AS turns_under, round(min(score), 6) AS min_score, round(avg(score), 6) AS mean_score, max(turn) AS final_turn FROM counted GROUP BY ALL)"""


@R.add("wn06_flag_runs", "scores", FLAGS + " SELECT run_id, dyad_id, attempt, flagged, first_flag_turn FROM flagged")
def _(t: Tables):
    return scores.flag_dialogues(t.scores, 0.6, run_length=2, judge=judge(t)).select("run_id", "dyad_id", "attempt", "flagged", "first_flag_turn")


@R.add("ag06_flag_statistics", "scores", FLAGS + " SELECT * EXCLUDE (flagged, first_flag_turn) FROM flagged")
def _(t: Tables):
    return scores.flag_dialogues(t.scores, 0.6, run_length=2, judge=judge(t)).drop("flagged", "first_flag_turn")


RATES = LATEST.format("status") + FLAGS + ", counted_flags AS (SELECT f.*, d.ideology, d.persona_mode FROM flagged f JOIN complete c USING (run_id, dyad_id, attempt) LEFT JOIN dyads d USING (run_id, dyad_id, attempt))"


@R.add("ag07_flagged_rates", "scores status dyads", RATES + " SELECT 'ideology' AS factor, coalesce(ideology, '(none)') AS level, count(*) FILTER (WHERE flagged) AS flagged, count(*) AS n, round(count(*) FILTER (WHERE flagged) / count(*), 6) AS rate FROM counted_flags GROUP BY ideology UNION ALL SELECT 'persona_mode', coalesce(persona_mode, '(none)'), count(*) FILTER (WHERE flagged), count(*), round(count(*) FILTER (WHERE flagged) / count(*), 6) FROM counted_flags GROUP BY persona_mode")
def _(t: Tables):
    return scores.flagged_rates(scores.flags(t.dyads, t.status, t.scores, 0.6, run_length=2, judge=judge(t)), "ideology", "persona_mode")


@R.add("so08_flags", "scores status dyads", RATES + " SELECT run_id, dyad_id, attempt, ideology, persona_mode, flagged, row_number() OVER (ORDER BY dyad_id, attempt, run_id) AS place FROM counted_flags")
def _(t: Tables):
    return scores.flags(t.dyads, t.status, t.scores, 0.6, run_length=2, judge=judge(t)).select("run_id", "dyad_id", "attempt", "ideology", "persona_mode", "flagged").transform(ordering.with_places, "dyad_id", "attempt", "run_id")


@R.add("ag08_agreement", "scores", SHARED + " SELECT judge_sha256 AS judge_a, judge_b, count(*) AS n, round(avg(abs(score - score_b)), 6) AS mean_abs_diff, round(CASE WHEN stddev_pop(score) > 0 AND stddev_pop(score_b) > 0 THEN corr(score, score_b) END, 6) AS pearson_r, round(avg(CASE WHEN abs(score - score_b) <= 0.1 + 1e-9 THEN 1 ELSE 0 END), 6) AS within FROM pairs GROUP BY ALL")
def _(t: Tables):
    return scores.agreement(t.scores)


@R.add("ag09_judge_means", "scores", f", last AS ({LAST}) SELECT judge_sha256, count(*) AS n, round(avg(score), 6) AS mean FROM last GROUP BY 1")
def _(t: Tables):
    return scores.judge_means(t.scores)


@R.add("ag12_metrics_present", "scores", "SELECT run_id, metric, cast(row_number() OVER (PARTITION BY run_id ORDER BY CASE metric WHEN 'prompt_to_line' THEN 0 WHEN 'line_to_line' THEN 1 WHEN 'alignment' THEN 2 ELSE 3 END, min(pos)) AS int) AS place FROM scores GROUP BY run_id, metric")
def _(t: Tables):
    return scores.metrics_present(t.scores)


@R.add("wn08_first_seen", "surveys", "SELECT run_id, item_id AS value, cast(row_number() OVER (PARTITION BY run_id ORDER BY min(pos)) AS int) AS place FROM surveys GROUP BY run_id, item_id")
def _(t: Tables):
    return scores.first_seen(t.surveys, "item_id")


@R.add("ag14_quality_rates", "turns scores", "SELECT * FROM (SELECT run_id, count(*) AS n_turns, round(avg(CASE WHEN cache_warning THEN 1 ELSE 0 END), 6) AS cache_warning, round(avg(CASE WHEN truncated THEN 1 ELSE 0 END), 6) AS truncated, round(avg(CASE WHEN finish_reason = 'length' THEN 1 ELSE 0 END), 6) AS cut FROM turns GROUP BY 1) t JOIN (SELECT run_id, count(*) AS n_scores, round(avg(CASE WHEN score IS NULL THEN 1 ELSE 0 END), 6) AS null_scores FROM scores GROUP BY 1) s USING (run_id)")
def _(t: Tables):
    return summaries.quality_rates(t.turns, t.scores)


@R.add("ag16_seeker_selection", "scores", f", last AS ({LAST.replace('alignment', 'prompt_to_line')}), final AS (SELECT *, max(turn) OVER (PARTITION BY run_id, dyad_id, attempt) AS last_turn FROM last) SELECT 'model ' || run_id AS model, round(avg(score), 6) AS adherence, count(*) AS n, cast(50 AS double) AS tokens_per_second FROM final WHERE turn = last_turn GROUP BY run_id")
def _(t: Tables):
    candidates = t.scores.select("run_id").distinct().select("run_id", F.concat(F.lit("model "), "run_id").alias("model"), F.lit(50.0).alias("tokens_per_second"))
    return scores.seeker_selection(t.scores, candidates)


@R.add("ag22_score_series", "scores", f"SELECT run_id, dyad_id, attempt, metric, judge_sha256, count(*) AS n, string_agg(turn || ':' || cast(cast(round(score * 100) AS int) AS varchar), ',' ORDER BY turn, score) AS series FROM scores WHERE {OK} AND score IS NOT NULL GROUP BY ALL")
def _(t: Tables):
    text = F.array_join(F.transform("series", lambda x: F.concat_ws(":", x["turn"], F.round(x["score"] * 100).cast("int"))), ",")
    return scores.score_series(t.scores).select("run_id", "dyad_id", "attempt", "metric", "judge_sha256", F.size("series").cast("long").alias("n"), text.alias("series"))


ORDER = "ORDER BY turn, CASE agent WHEN 'seeker' THEN 0 ELSE 1 END, pos"


@R.add("wn03_positions", "turns", f"SELECT run_id, dyad_id, attempt, turn, agent, cast(row_number() OVER (PARTITION BY run_id, dyad_id, attempt {ORDER}) AS int) AS place FROM turns")
def _(t: Tables):
    return transcripts.positions(t.turns).select("run_id", "dyad_id", "attempt", "turn", "agent", "place")


@R.add("so01_message_order", "turns", f"SELECT run_id, dyad_id, attempt, sha256(string_agg(text, '|' {ORDER})) AS messages FROM turns GROUP BY ALL")
def _(t: Tables):
    by = transcripts.positions(t.turns).groupBy("run_id", "dyad_id", "attempt").agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("m"))
    return by.select("run_id", "dyad_id", "attempt", F.sha2(F.array_join(F.transform("m", lambda x: x["text"]), "|").cast("binary"), 256).alias("messages"))


@R.add("so02_score_order", "scores", "SELECT run_id, metric, cast(row_number() OVER (PARTITION BY run_id ORDER BY dyad_id, attempt, turn, CASE agent WHEN 'seeker' THEN 0 ELSE 1 END, CASE metric WHEN 'prompt_to_line' THEN 0 WHEN 'line_to_line' THEN 1 ELSE 2 END, pos) AS bigint) AS place, dyad_id, pos FROM scores")
def _(t: Tables):
    placed = ordering.with_places(t.scores, *scores.message_order())
    first = placed.groupBy("run_id").agg(F.min("place").alias("first"))  # a row for each run
    return placed.join(F.broadcast(first), "run_id").select("run_id", "metric", (F.col("place") - F.col("first") + 1).alias("place"), "dyad_id", "pos")


@R.add("wn04_earlier_lines", "turns", f"SELECT run_id, dyad_id, attempt, turn, agent, count(*) OVER w AS n_earlier, sha256(coalesce(string_agg(text, '|') OVER w, '')) AS earlier FROM turns WINDOW w AS (PARTITION BY run_id, dyad_id, attempt, agent {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def _(t: Tables):
    return transcripts.histories(t.turns).select("run_id", "dyad_id", "attempt", "turn", "agent", F.size("earlier").cast("long").alias("n_earlier"), F.sha2(F.array_join("earlier", "|").cast("binary"), 256).alias("earlier"))


@R.add("wn05_partner_line", "turns", f", sides AS (SELECT *, last_value(CASE WHEN agent = 'mentor' THEN text END IGNORE NULLS) OVER w AS m, last_value(CASE WHEN agent = 'seeker' THEN text END IGNORE NULLS) OVER w AS s FROM turns WINDOW w AS (PARTITION BY run_id, dyad_id, attempt {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT run_id, dyad_id, attempt, turn, agent, CASE agent WHEN 'seeker' THEN m ELSE s END AS partner FROM sides")
def _(t: Tables):
    return transcripts.histories(t.turns).select("run_id", "dyad_id", "attempt", "turn", "agent", "partner")


@R.add("wn07_cadence", "turns", "SELECT run_id, dyad_id, attempt, turn, agent FROM (SELECT *, max(turn) OVER (PARTITION BY run_id, dyad_id, attempt, agent) AS last FROM turns) t WHERE turn % 4 = 0 OR turn = last")
def _(t: Tables):
    return scores.on_cadence(t.turns).select("run_id", "dyad_id", "attempt", "turn", "agent")


@R.add("wn09_cache_losses", "turns", f"SELECT run_id, dyad_id, attempt, turn, agent, prompt_n FROM (SELECT *, row_number() OVER (PARTITION BY run_id, dyad_id, attempt, agent {ORDER}) AS i FROM turns) t WHERE i > 1 AND prompt_n > expected_new + 64 AND prompt_n > 100")
def _(t: Tables):
    return transcripts.cache_losses(t.turns, 100).select("run_id", "dyad_id", "attempt", "turn", "agent", "prompt_n")


@R.add("sc01_digests", "turns", "SELECT run_id, dyad_id, attempt, turn, agent, sha256(text) AS text_sha256 FROM turns")
def _(t: Tables):
    return transcripts.text_digests(t.turns)


@R.add("sc02_derived_seeds", "turns dyads", f"SELECT t.run_id, t.dyad_id, t.attempt, t.turn, t.agent, cast('0x' || substr(sha256('{RUN_SEED}|' || coalesce(d.seed, 0) || '|' || t.dyad_id || '|' || t.attempt || '|' || t.turn || '|' || t.agent), 1, 8) AS bigint) AS derived FROM turns t LEFT JOIN dyads d USING (run_id, dyad_id, attempt)")
def _(t: Tables):
    rows = t.turns.join(t.dyads.select("run_id", "dyad_id", "attempt", F.col("seed").alias("dyad_seed")), ["run_id", "dyad_id", "attempt"], "left")
    return rows.select("run_id", "dyad_id", "attempt", "turn", "agent", scalars.derived_seed(F.lit(RUN_SEED), F.col("dyad_seed"), F.col("dyad_id"), F.col("attempt"), F.col("turn"), F.col("agent")).alias("derived"))


@R.add("sc05_model_family", "", "SELECT CASE o_orderkey % 6 WHEN 0 THEN 'gpt-oss' WHEN 1 THEN 'qwen' WHEN 2 THEN 'glm' WHEN 3 THEN 'phi' WHEN 4 THEN 'mistral' END AS family, count(*) AS n FROM orders GROUP BY 1")
def _(t: Tables):
    names = F.array(*map(F.lit, ("/m/GPT_OSS-20b.gguf", "Qwen3.6:35b", "/x/glm-4.7-flash", "phi-4", "Mixtral-8x7B", "/y/unknown.gguf")))
    return t.orders.groupBy(scalars.model_family(F.get(names, (F.col("o_orderkey") % 6).cast("int"))).alias("family")).agg(F.count("*").alias("n"))


REQUESTS = LATEST.format("status") + f""", rows_of AS (SELECT t.*, string_agg('- ' || text, chr(10)) OVER own AS earlier,
  last_value(CASE WHEN agent = 'mentor' THEN text END IGNORE NULLS) OVER w AS m, last_value(CASE WHEN agent = 'seeker' THEN text END IGNORE NULLS) OVER w AS s
  FROM turns t JOIN complete c USING (run_id, dyad_id, attempt) WINDOW w AS (PARTITION BY run_id, dyad_id, attempt {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), own AS (PARTITION BY run_id, dyad_id, attempt, agent {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
last_turns AS (SELECT *, max(turn) OVER (PARTITION BY run_id, dyad_id, attempt) AS last FROM rows_of WHERE finish_reason <> 'error' AND agent = 'seeker'),
targets AS (SELECT t.*, metric FROM last_turns t, (SELECT unnest(['prompt_to_line', 'line_to_line']) AS metric) m WHERE turn % 4 = 0 OR turn = last),
open AS (SELECT * FROM targets t ANTI JOIN (SELECT * FROM scores WHERE judge_sha256 = {J1} AND {OK}) s USING (run_id, dyad_id, attempt, turn, agent, metric))
SELECT o.run_id, o.dyad_id, o.attempt, o.turn, o.metric, cast('0x' || substr(sha256('{RUN_SEED}|' || coalesce(d.seed, 0) || '|' || o.dyad_id || '|' || o.attempt || '|' || o.turn || '|judge:' || o.agent || ':' || metric), 1, 8) AS bigint) AS seed,
  CASE WHEN d.dyad_id IS NULL THEN 'no treatment row for this attempt' END AS error,
  CASE WHEN d.dyad_id IS NOT NULL THEN sha256('TASK: ' || CASE metric WHEN 'prompt_to_line' THEN '{TASKS['prompt_to_line']}' ELSE '{TASKS['line_to_line']}' END || chr(10) || chr(10) || 'TOPIC: ' || topic || chr(10) || chr(10) || 'PERSONA:' || chr(10) || persona_text
    || CASE WHEN metric = 'line_to_line' THEN chr(10) || chr(10) || 'EARLIER LINES:' || chr(10) || coalesce(earlier, '- (none yet)') ELSE '' END || CASE WHEN m IS NOT NULL THEN chr(10) || chr(10) || 'PARTNER''S LINE:' || chr(10) || m ELSE '' END || chr(10) || chr(10) || 'LINE:' || chr(10) || text) END AS request
FROM open o LEFT JOIN dyads d USING (run_id, dyad_id, attempt)"""


@R.add("rp07_score_worklist", "turns dyads status scores", REQUESTS)
def _(t: Tables):
    work = transcripts.score_worklist(t.turns, t.dyads, t.status, t.scores, "main", judge(t), RUN_SEED, tasks=TASKS)
    return work.select("run_id", "dyad_id", "attempt", "turn", "metric", "seed", "error", F.when(F.col("request").isNotNull(), F.sha2(F.col("request").cast("binary"), 256)).alias("request"))


@R.add("sc07_judge_requests", "turns dyads status scores", ", work AS (SELECT o.run_id".join(REQUESTS.replace(J1, J3).rsplit("\nSELECT o.run_id", 1)) + ") SELECT run_id, dyad_id, attempt, turn, request FROM work WHERE metric = 'line_to_line' AND error IS NULL")
def _(t: Tables):
    work = transcripts.score_worklist(t.turns, t.dyads, t.status, t.scores, "main", judge(t, 3), RUN_SEED, tasks=TASKS).where("metric = 'line_to_line' and error is null")
    return work.select("run_id", "dyad_id", "attempt", "turn", F.sha2(F.col("request").cast("binary"), 256).alias("request"))


@R.add("sc08_seeker_views", "turns dyads", """, said AS (SELECT run_id, dyad_id, attempt, string_agg(CASE agent WHEN 'seeker' THEN 'assistant:' ELSE 'user:' END || text, '|' ORDER BY turn, CASE agent WHEN 'seeker' THEN 0 ELSE 1 END, pos) AS m FROM turns GROUP BY ALL)
SELECT s.run_id, s.dyad_id, s.attempt, sha256('system:' || coalesce(persona_text, '') || '|' || m || CASE WHEN persona_mode = 'reinforced' AND coalesce(persona_reminder, '') <> '' THEN '|system:' || persona_reminder ELSE '' END) AS view FROM said s LEFT JOIN dyads d USING (run_id, dyad_id, attempt)""")
def _(t: Tables):
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return transcripts.views(t.turns, t.dyads, "seeker").select("run_id", "dyad_id", "attempt", F.sha2(text.cast("binary"), 256).alias("view"))


ITEMS = ", items AS (SELECT event_type AS item_id, 'How much do you agree about ' || event_type || '?' AS text FROM (SELECT DISTINCT event_type FROM events) e)"


@R.add("rp08_survey_worklist", "turns dyads status", LATEST.format("status") + ITEMS + f", sizes AS (SELECT run_id, dyad_id, attempt, count(*) AS n FROM turns GROUP BY ALL) SELECT c.run_id, c.dyad_id, c.attempt, item_id, d.n_turns + 1 AS turn, cast('0x' || substr(sha256('{RUN_SEED}|' || d.seed || '|' || c.dyad_id || '|' || c.attempt || '|' || (d.n_turns + 1) || '|survey:post:' || item_id), 1, 8) AS bigint) AS seed, n + 1 AS n_messages FROM complete c JOIN dyads d USING (run_id, dyad_id, attempt) JOIN sizes USING (run_id, dyad_id, attempt) CROSS JOIN items")
def _(t: Tables):
    items = t.events.select(F.col("event_type").alias("item_id")).distinct().withColumn("text", F.concat(F.lit("How much do you agree about "), "item_id", F.lit("?")))
    return transcripts.survey_worklist(t.turns, t.dyads, t.status, items, RUN_SEED).drop("question")


@R.add("sc09_survey_turns", "dyads", f"SELECT run_id, dyad_id, attempt, phase, cast(CASE phase WHEN 'pre' THEN 0 ELSE n_turns + 1 END AS int) AS turn FROM dyads, (SELECT unnest(['pre', 'post']) AS phase) p")
def _(t: Tables):
    rows = t.dyads.withColumn("phase", F.explode(F.array(F.lit("pre"), F.lit("post"))))
    return rows.select("run_id", "dyad_id", "attempt", "phase", scalars.survey_turn(F.col("phase"), F.col("n_turns")).alias("turn"))


@R.add("sc10_finish_reasons", "turns", "SELECT CASE WHEN pos % 3 = 0 OR pos % 3 = 1 THEN 'length' ELSE 'stop' END AS reason, count(*) AS n FROM turns GROUP BY 1")
def _(t: Tables):
    raw = F.when(F.col("pos") % 3 == 0, '{"stop_type": "limit"}').when(F.col("pos") % 3 == 1, '{"stopped_limit": true}').otherwise('{"stop_type": "eos", "stopped_limit": false}')
    return t.turns.groupBy(scalars.finish_reason(raw).alias("reason")).agg(F.count("*").alias("n"))


@R.add("sc12_canonical_digests", "dyads", "SELECT count(DISTINCT (topic, ideology, openness, role)) AS n FROM dyads")
def _(t: Tables):
    shuffled = F.map_from_entries(F.reverse(F.map_entries("condition")))
    both = t.dyads.select(scalars.canonical_digest(F.col("condition")).alias("d")).union(t.dyads.select(scalars.canonical_digest(shuffled)))
    return both.agg(F.count_distinct("d").alias("n"))


NESTED = """SELECT dyad_id, attempt, run_id, sha256('{"a":' || seed || ',"b":{"x":[1,{"p":' || CASE WHEN role IS NULL THEN 'null' ELSE '"' || role || '"' END || ',"q":true}],"y":{"i":"' || dyad_id || '","j":[]}}}') AS digest FROM dyads"""


@R.add("sc12_nested_json", "dyads", NESTED)
def _(t: Tables):
    role = F.coalesce(F.concat(F.lit('"'), F.col("condition")["role"], F.lit('"')), F.lit("null"))
    inner = lambda a, b: F.when(F.col("seed") % 2 == 0, F.concat(a, F.lit(" ,\n"), b)).otherwise(F.concat(b, F.lit(","), a))
    deep = inner(F.concat(F.lit('"p": '), role), F.lit('"q" : true'))
    y = inner(F.concat(F.lit('"i":"'), F.col("dyad_id"), F.lit('"')), F.lit('"j":[ ]'))
    b = inner(F.concat(F.lit('"x": [1, {'), deep, F.lit("}]")), F.concat(F.lit('"y":{'), y, F.lit("}")))
    whole = F.concat(F.lit("{"), inner(F.concat(F.lit('"b":{'), b, F.lit("}")), F.concat(F.lit('"a": '), F.col("seed").cast("string"))), F.lit("}"))
    return t.dyads.select("dyad_id", "attempt", "run_id", scalars.canonical_json_digest(whole).alias("digest"))


@R.add("sc13_agent_lines", "turns", "SELECT run_id, dyad_id, attempt, agent, count(*) AS n_messages, arg_max(text, turn * 10000000000000 + pos) AS last_line, sha256(string_agg(text, '|' ORDER BY turn, pos)) AS lines FROM turns GROUP BY ALL")
def _(t: Tables):
    return transcripts.agent_lines(t.turns).withColumn("lines", F.sha2(F.array_join("lines", "|").cast("binary"), 256))


@R.add("wn04_history_places", "turns", f"SELECT run_id, dyad_id, attempt, turn, agent, pos, turn // 2 AS block, count(text) OVER w AS n_earlier, row_number() OVER (PARTITION BY run_id, dyad_id, attempt {ORDER}) AS place, count(text) OVER (PARTITION BY run_id, dyad_id, attempt, agent, turn // 2 {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nth FROM turns WINDOW w AS (PARTITION BY run_id, dyad_id, attempt, agent {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def _(t: Tables):
    return transcripts.history_places(t.turns, 2).select("run_id", "dyad_id", "attempt", "turn", "agent", "pos", "block", "n_earlier", "place", "nth")


@R.add("sc13_line_blocks", "turns", "SELECT run_id, dyad_id, attempt, agent, turn // 2 AS block, sha256(string_agg(text, '|' ORDER BY turn, pos)) AS lines FROM turns WHERE text IS NOT NULL GROUP BY ALL")
def _(t: Tables):
    return transcripts.agent_line_blocks(t.turns, 2).withColumn("lines", F.sha2(F.array_join("lines", "|").cast("binary"), 256))


@R.add("sc13_agent_totals", "turns", "SELECT run_id, dyad_id, attempt, agent, count(*) AS n_messages, arg_max(text, turn * 10000000000000 + pos) AS last_line FROM turns GROUP BY ALL")
def _(t: Tables):
    return transcripts.agent_totals(t.turns)


@R.add("sc08_view_blocks", "turns dyads", """, said AS (SELECT run_id, dyad_id, attempt, turn // 2 AS block, string_agg(CASE agent WHEN 'seeker' THEN 'assistant:' ELSE 'user:' END || text, '|' ORDER BY turn, CASE agent WHEN 'seeker' THEN 0 ELSE 1 END, pos) AS m FROM turns GROUP BY ALL),
ends AS (SELECT s.*, persona_text, persona_reminder, persona_mode FROM (SELECT run_id, dyad_id, attempt, min(block) - 1 AS a, max(block) + 1 AS b FROM said GROUP BY ALL) s LEFT JOIN dyads d USING (run_id, dyad_id, attempt))
SELECT run_id, dyad_id, attempt, block, sha256(m) AS view FROM said UNION ALL SELECT run_id, dyad_id, attempt, a, sha256('system:' || coalesce(persona_text, '')) FROM ends
UNION ALL SELECT run_id, dyad_id, attempt, b, sha256('system:' || persona_reminder) FROM ends WHERE persona_mode = 'reinforced' AND coalesce(persona_reminder, '') <> ''""")
def _(t: Tables):
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return transcripts.view_blocks(t.turns, t.dyads, "seeker", 2).select("run_id", "dyad_id", "attempt", "block", F.sha2(text.cast("binary"), 256).alias("view"))


@R.add("sc03_parsed_answers", "surveys", """SELECT pos, method, value FROM (SELECT pos, lo, hi, pos % 8 AS k, pos % 7 AS j, pos % 5 + 1 AS v5, pos % 6 AS v6, pos % 12 AS v12,
  CASE pos % 8 WHEN 0 THEN pos % 7 WHEN 1 THEN pos % 5 + 1 WHEN 2 THEN pos % 5 + 1 WHEN 4 THEN pos % 6 WHEN 5 THEN pos % 12 WHEN 6 THEN 4 END AS given,
  CASE WHEN pos % 8 = 0 THEN 'json' WHEN pos % 8 IN (1, 4) OR pos % 8 = 2 AND hi = 5 THEN 'labelled' ELSE 'bare' END AS kind FROM surveys) p,
 LATERAL (SELECT CASE WHEN k = 7 THEN 'none' WHEN k = 3 THEN CASE WHEN hi = 0 THEN 'out_of_range' ELSE 'ambiguous' END
   WHEN k = 2 AND hi <> 5 THEN CASE WHEN hi = 0 THEN 'out_of_range' WHEN given = 5 THEN 'bare' ELSE 'ambiguous' END
   WHEN given BETWEEN lo AND hi THEN kind ELSE 'out_of_range' END AS method) q,
 LATERAL (SELECT cast(CASE WHEN method IN ('json', 'labelled', 'bare') THEN given END AS int) AS value) r""")
def _(t: Tables):
    return parsing.parse_scale_answers(t.surveys).select("pos", "method", "value")


@R.add("sc04_parsed_scores", "scores", "SELECT pos, round(CASE WHEN pos % 4 < 2 AND score IS NOT NULL THEN score END, 6) AS score, CASE WHEN pos % 4 = 3 THEN '' ELSE 'because' END AS rationale FROM scores")
def _(t: Tables):
    text = F.when(F.col("pos") % 4 < 2, F.concat(F.lit('{"score": '), F.coalesce(F.col("score").cast("string"), F.lit("null")), F.lit(', "rationale": "because"}'))).when(F.col("pos") % 4 == 2, '{"score": "0.5", "rationale": "because"}').otherwise("I think 0.5")
    return parsing.parse_judge_replies(t.scores.select("pos", "score").withColumn("raw_text", text)).select("pos", "score", "rationale")
