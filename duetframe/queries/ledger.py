"""Queries over ledgers, treatments and surveys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import attempts, summaries, surveys
from .base import Registry, Tables

R = Registry()

# SQL for the attempts that count and their levels, to follow a WITH clause.
LATEST = """, latest AS (SELECT run_id, dyad_id, max(attempt) AS attempt, arg_max(status, attempt * 1000000000000 + pos) AS status FROM {0} GROUP BY run_id, dyad_id),
complete AS (SELECT run_id, dyad_id, attempt FROM latest WHERE status = 'complete')"""
S = LATEST.format("status") + ", leveled AS (SELECT c.*, coalesce(d.ideology, '(none)') AS level FROM complete c LEFT JOIN dyads d USING (run_id, dyad_id, attempt))"
V = LATEST.format("survey_status") + """, leveled AS (SELECT c.*, coalesce(d.ideology, '(none)') AS level FROM complete c LEFT JOIN survey_dyads d USING (run_id, dyad_id, attempt)),
asked AS (SELECT * FROM surveys WHERE coalesce(origin, 'run') = 'run'),
pairs AS (SELECT run_id, dyad_id, attempt, item_id, arg_min(battery, pos) AS battery, arg_min(lo, pos) AS lo, arg_min(hi, pos) AS hi,
  (max(struct_pack(p := pos, a := answer)) FILTER (WHERE phase = 'pre')).a AS pre, (max(struct_pack(p := pos, a := answer)) FILTER (WHERE phase = 'post')).a AS post FROM asked GROUP BY ALL),
paired AS (SELECT p.*, post - pre AS delta, level FROM pairs p JOIN leveled l USING (run_id, dyad_id, attempt)),
shares AS (SELECT level, run_id, dyad_id, attempt, battery, avg(delta / (hi - lo)) AS mean_share, count(*) AS n_items FROM paired WHERE delta IS NOT NULL AND hi <> lo GROUP BY ALL)"""


@R.add("pf01_attempt_default", "", "SELECT cast(coalesce(try_cast(CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN event_type ELSE cast(event_id % 5 AS varchar) END AS int), 1) AS int) AS attempt, count(*) AS n FROM events GROUP BY 1")
def _(t: Tables):
    raw = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 7 == 1, F.col("event_type")).otherwise((F.col("event_id") % 5).cast("string"))
    return t.events.select(scalars.attempt_or_first(raw).alias("attempt")).groupBy("attempt").agg(F.count("*").alias("n"))


@R.add("pf02_clean_ledger", "", "SELECT count(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0")
def _(t: Tables):
    rows = t.ledger.withColumns({"status": F.when(F.col("pos") % 7 != 0, F.col("status")), "dyad_id": F.when(F.col("pos") % 11 != 0, F.col("dyad_id"))})
    return attempts.clean_ledger(rows).agg(F.count("*").alias("n"))


@R.add("pf03_survey_pass", "surveys", "SELECT phase, count(*) AS n FROM surveys WHERE origin = 'readministered' AND phase IN ('pre', 'post') GROUP BY phase")
def _(t: Tables):
    return surveys.of_pass(t.surveys, "readministered").groupBy("phase").agg(F.count("*").alias("n"))


@R.add("pf05_numbers_only", "surveys", "SELECT item_id, count(*) AS n FROM surveys WHERE pos % 4 < 2 GROUP BY item_id")
def _(t: Tables):
    kind = F.col("pos") % 4
    text = F.when(kind == 0, F.col("pos").cast("string")).when(kind == 1, F.concat("pos", F.lit(".5"))).when(kind == 2, "true").otherwise(F.concat(F.lit('"'), "pos", F.lit('"')))
    return t.surveys.where(scalars.is_number(F.parse_json(text))).groupBy("item_id").agg(F.count("*").alias("n"))


@R.add("pf06_ids", "", "SELECT count(*) AS n FROM events WHERE event_id % 5 NOT IN (1, 2, 3)")
def _(t: Tables):
    kind = F.col("event_id") % 5
    name = F.when(kind == 1, "..").when(kind == 2, F.concat(F.lit("-"), "event_type")).when(kind == 3, F.concat("event_type", F.lit("/x"))).otherwise(F.concat("event_type", F.lit("."), F.col("event_id").cast("string")))
    return t.events.where(scalars.well_formed_id(name)).agg(F.count("*").alias("n"))


@R.add("pf07_status_label", "ledger", "SELECT CASE WHEN status IN ('complete', 'failed') THEN status ELSE 'running' END AS label, count(*) AS n FROM ledger GROUP BY 1")
def _(t: Tables):
    return t.ledger.groupBy(scalars.status_label(F.col("status")).alias("label")).agg(F.count("*").alias("n"))


@R.add("pf08_level_label", "dyads", "SELECT coalesce(openness, '(none)') AS level, count(*) AS n FROM dyads GROUP BY 1")
def _(t: Tables):
    return t.dyads.groupBy(scalars.level_label(F.col("condition")["openness"]).alias("level")).agg(F.count("*").alias("n"))


@R.add("pf14_technically_complete", "turns dyads", "SELECT run_id, dyad_id, attempt FROM (SELECT run_id, dyad_id, attempt, max(turn) AS last, count(*) FILTER (WHERE finish_reason = 'error') AS errors FROM turns GROUP BY ALL) x JOIN dyads d USING (run_id, dyad_id, attempt) WHERE last = n_turns AND errors = 0")
def _(t: Tables):
    from ..operators.transcripts import completeness

    return completeness(t.turns, t.dyads)


@R.add("pf15_chosen_attempt", "dyads status", LATEST.format("status") + ", seen AS (SELECT run_id, dyad_id, max(attempt) AS highest FROM (SELECT run_id, dyad_id, attempt FROM dyads UNION SELECT run_id, dyad_id, attempt FROM status) s GROUP BY ALL) SELECT s.run_id, s.dyad_id, cast(coalesce(c.attempt, s.highest) AS int) AS attempt FROM seen s LEFT JOIN complete c USING (run_id, dyad_id)")
def _(t: Tables):
    return summaries.chosen_attempt(t.dyads, t.status)


@R.add("pf16_filtered_dyads", "dyads status", LATEST.format("status") + " SELECT l.run_id, l.dyad_id FROM latest l JOIN dyads d USING (run_id, dyad_id, attempt) WHERE l.status = 'complete' AND contains(l.dyad_id, '1') AND coalesce(d.openness, '(none)') = 'open'")
def _(t: Tables):
    return summaries.filtered_dyads(summaries.dyad_progress(t.dyads, t.status, t.turns), "complete", " 1 ", openness="open").select("run_id", "dyad_id")


@R.add("wn01_latest_status", "ledger", LATEST.format("ledger") + " SELECT run_id, dyad_id, attempt, status FROM latest")
def _(t: Tables):
    return attempts.latest_status(t.ledger)


@R.add("wn02_last_row", "surveys", "SELECT run_id, dyad_id, item_id, phase, arg_max(pos, pos) AS pos, (max(struct_pack(p := pos, a := answer))).a AS answer FROM surveys GROUP BY ALL")
def _(t: Tables):
    return attempts.last_row(t.surveys.select("run_id", "dyad_id", "item_id", "phase", "pos", "answer"), ["run_id", "dyad_id", "item_id", "phase"])


@R.add("jn01_latest_complete_rows", "turns status", LATEST.format("status") + " SELECT t.run_id, t.agent, count(*) AS n FROM turns t JOIN complete c USING (run_id, dyad_id, attempt) GROUP BY ALL")
def _(t: Tables):
    return attempts.only_latest_complete(t.turns, t.status).groupBy("run_id", "agent").agg(F.count("*").alias("n"))


@R.add("jn02_treatments", "status dyads", S + " SELECT run_id, dyad_id, level FROM leveled")
def _(t: Tables):
    return attempts.levels(attempts.latest_complete(t.status), t.dyads, "ideology").select("run_id", "dyad_id", "level")


@R.add("jn04_survey_pairs", "surveys survey_status survey_dyads", V + " SELECT run_id, dyad_id, item_id, battery, pre, post, post - pre AS delta FROM pairs")
def _(t: Tables):
    return surveys.survey_pairs(t.surveys).select("run_id", "dyad_id", "item_id", "battery", "pre", "post", "delta")


@R.add("jn07_outstanding", "manifest status", LATEST.format("status") + " SELECT m.run_id, m.dyad_id, cast(coalesce(l.attempt + 1, 1) AS int) AS next_attempt FROM manifest m LEFT JOIN latest l USING (run_id, dyad_id) WHERE coalesce(l.status, '') <> 'complete'")
def _(t: Tables):
    return attempts.outstanding(t.manifest, t.status).select("run_id", "dyad_id", "next_attempt")


MATRIX_ITEMS = "matrix AS (SELECT level, item_id FROM (SELECT DISTINCT level FROM leveled) a CROSS JOIN (SELECT DISTINCT item_id FROM paired) b)"


@R.add("jn10_complete_matrix", "surveys survey_status survey_dyads", V + ", " + MATRIX_ITEMS + " SELECT m.level, m.item_id, count(b.delta) AS n FROM matrix m LEFT JOIN paired b ON m.level = b.level AND m.item_id = b.item_id GROUP BY ALL")
def _(t: Tables):
    return surveys.shift_by_item(t.survey_dyads, t.survey_status, t.surveys, "ideology").select("level", "item_id", "n")


@R.add("jn12_planned", "manifest status", "SELECT run_id, planned, coalesce(seen, 0) AS seen FROM (SELECT run_id, count(*) AS planned FROM manifest GROUP BY 1) m LEFT JOIN (SELECT run_id, count(DISTINCT dyad_id) AS seen FROM status GROUP BY 1) s USING (run_id)")
def _(t: Tables):
    return attempts.planned_counts(t.manifest, t.status)


@R.add("ag01_status_counts", "ledger", LATEST.format("ledger") + " SELECT run_id, count(*) FILTER (WHERE status = 'complete') AS complete, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'started') AS running FROM latest GROUP BY 1")
def _(t: Tables):
    return attempts.status_counts(t.ledger)


@R.add("ag02_shift_by_item", "surveys survey_status survey_dyads", V + ", " + MATRIX_ITEMS + """
SELECT m.level, m.item_id, count(b.delta) AS n, round(avg(b.pre), 6) AS mean_pre, round(avg(b.post), 6) AS mean_post, round(avg(b.delta), 6) AS mean_delta, round(stddev_samp(b.delta) / sqrt(count(b.delta)), 6) AS se_delta
FROM matrix m LEFT JOIN (SELECT * FROM paired WHERE delta IS NOT NULL) b ON m.level = b.level AND m.item_id = b.item_id GROUP BY ALL""")
def _(t: Tables):
    return surveys.shift_by_item(t.survey_dyads, t.survey_status, t.surveys, "ideology")


@R.add("ag03_shift_by_battery", "surveys survey_status survey_dyads", V + """, matrix AS (SELECT level, battery FROM (SELECT DISTINCT level FROM leveled) a CROSS JOIN (SELECT DISTINCT battery FROM paired) b)
SELECT m.level, m.battery, count(s.mean_share) AS n, round(avg(s.mean_share), 6) AS mean_delta_norm, round(stddev_samp(s.mean_share) / sqrt(count(s.mean_share)), 6) AS se_delta_norm
FROM matrix m LEFT JOIN shares s ON m.level = s.level AND m.battery = s.battery GROUP BY ALL""")
def _(t: Tables):
    return surveys.shift_by_battery(t.survey_dyads, t.survey_status, t.surveys, "ideology")


@R.add("ag04_dyads_by_level", "survey_status survey_dyads", V.split("asked AS")[0].rstrip().rstrip(",") + " SELECT level, count(*) AS n_dyads FROM leveled GROUP BY 1")
def _(t: Tables):
    return surveys.n_dyads(t.survey_dyads, t.survey_status, "ideology")


@R.add("ag10_dyad_progress", "dyads status turns", LATEST.format("status") + """,
seen AS (SELECT run_id, dyad_id, count(*) AS attempts, max(attempt) AS highest FROM (SELECT run_id, dyad_id, attempt FROM dyads UNION SELECT run_id, dyad_id, attempt FROM status) s GROUP BY ALL),
done AS (SELECT run_id, dyad_id, attempt, count(*) FILTER (WHERE agent = 'mentor' AND finish_reason <> 'error') AS turns_done FROM turns GROUP BY ALL),
news AS (SELECT run_id, dyad_id, max(ts) AS last_ts FROM (SELECT run_id, dyad_id, ts FROM status UNION ALL SELECT run_id, dyad_id, ts FROM turns) n GROUP BY ALL),
why AS (SELECT run_id, dyad_id, attempt, (max(struct_pack(p := pos, r := reason))).r AS reason FROM status GROUP BY ALL)
SELECT s.run_id, s.dyad_id, cast(coalesce(l.attempt, s.highest) AS int) AS attempt, s.attempts, CASE WHEN l.status IN ('complete', 'failed') THEN l.status ELSE 'running' END AS status,
       coalesce(d.turns_done, 0) AS turns_done, CASE WHEN l.status = 'failed' THEN w.reason END AS reason, n.last_ts
FROM seen s LEFT JOIN latest l USING (run_id, dyad_id) LEFT JOIN done d ON d.run_id = s.run_id AND d.dyad_id = s.dyad_id AND d.attempt = coalesce(l.attempt, s.highest)
LEFT JOIN why w ON w.run_id = s.run_id AND w.dyad_id = s.dyad_id AND w.attempt = coalesce(l.attempt, s.highest) LEFT JOIN news n ON n.run_id = s.run_id AND n.dyad_id = s.dyad_id""")
def _(t: Tables):
    return summaries.dyad_progress(t.dyads, t.status, t.turns).select("run_id", "dyad_id", "attempt", "attempts", "status", "turns_done", "reason", "last_ts")


@R.add("ag11_condition_levels", "dyads", """, each AS (SELECT run_id, pos, 'topic' AS factor, topic AS level FROM dyads UNION ALL SELECT run_id, pos, 'ideology', ideology FROM dyads UNION ALL SELECT run_id, pos, 'openness', coalesce(openness, '(none)') FROM dyads UNION ALL SELECT run_id, pos, 'role', coalesce(role, '(none)') FROM dyads)
SELECT run_id, factor, level, cast(row_number() OVER (PARTITION BY run_id, factor ORDER BY min(pos)) AS int) AS place FROM each GROUP BY run_id, factor, level""")
def _(t: Tables):
    return summaries.condition_levels(t.dyads)


@R.add("ag13_answer_methods", "surveys", "SELECT run_id, answer_method, count(*) AS n, count(*) FILTER (WHERE answer IS NULL) AS n_null, round(count(*) / sum(count(*)) OVER (PARTITION BY run_id), 6) AS share FROM surveys GROUP BY run_id, answer_method")
def _(t: Tables):
    return surveys.answer_methods(t.surveys)


@R.add("ag15_retries", "status dyads", LATEST.format("status") + """, by_level AS (SELECT coalesce(d.ideology, '(none)') AS level, count(*) AS n, count(*) FILTER (WHERE l.attempt > 1) AS retried FROM latest l LEFT JOIN dyads d USING (run_id, dyad_id, attempt) GROUP BY 1),
all_of AS (SELECT sum(retried) / sum(n) AS p FROM by_level)
SELECT level, n, retried, round(retried / n, 6) AS rate, round(pow(retried - n * p, 2) / (n * p) + pow(retried - n * p, 2) / (n * (1 - p)), 6) AS chi_square_part FROM by_level, all_of""")
def _(t: Tables):
    return attempts.retries(t.status, t.dyads, "ideology")


@R.add("ag21_dyad_battery_means", "surveys survey_status survey_dyads", V + " SELECT run_id, dyad_id, battery, round(mean_share, 6) AS mean_share, n_items FROM shares")
def _(t: Tables):
    return surveys.dyad_battery_means(surveys.leveled_pairs(t.survey_dyads, t.survey_status, t.surveys, "ideology")).select("run_id", "dyad_id", "battery", "mean_share", "n_items")


@R.add("sc06_normalised_delta", "surveys", "SELECT item_id, round(sum(CASE WHEN hi <> lo THEN (answer - lo) / (hi - lo) END), 6) AS total, count(CASE WHEN hi <> lo THEN answer END) AS n FROM surveys GROUP BY 1")
def _(t: Tables):
    share = scalars.normalised_delta(F.col("answer") - F.col("lo"), F.col("lo"), F.col("hi"))
    return t.surveys.groupBy("item_id").agg(F.sum(share).alias("total"), F.count(share).alias("n"))


@R.add("sc11_last_activity", "status turns", "SELECT run_id, dyad_id, max(ts) AS last_ts FROM (SELECT run_id, dyad_id, ts FROM status UNION ALL SELECT run_id, dyad_id, ts FROM turns) n GROUP BY ALL")
def _(t: Tables):
    return summaries.last_activity(t.status, t.turns).where("last_seen is not null").select("run_id", "dyad_id", "last_ts")


@R.add("se02_seen_attempts", "dyads status", "SELECT run_id, dyad_id, attempt FROM dyads UNION SELECT run_id, dyad_id, attempt FROM status")
def _(t: Tables):
    return attempts.seen_attempts(t.dyads, t.status)


@R.add("so03_level_order", "dyads", ", firsts AS (SELECT coalesce(openness, '(none)') AS level, min(pos) AS first FROM dyads GROUP BY 1) SELECT level, cast(row_number() OVER (ORDER BY level = '(none)', CASE level WHEN 'closed' THEN 1 WHEN 'open' THEN 2 ELSE 3 END, first) AS int) AS place FROM firsts")
def _(t: Tables):
    firsts = t.dyads.groupBy(scalars.level_label(F.col("condition")["openness"]).alias("level")).agg(F.min("pos").alias("first"))
    return summaries.ordered_levels(firsts, ["closed", "open"])


@R.add("so04_level_order_source", "dyads", ", firsts AS (SELECT ideology AS level, min(pos) AS first FROM dyads GROUP BY 1) SELECT level, cast(row_number() OVER (ORDER BY level) AS int) AS place FROM firsts")
def _(t: Tables):
    firsts = t.dyads.groupBy(F.col("condition")["ideology"].alias("level")).agg(F.min("pos").alias("first"))
    grid = firsts.select(F.lit("ideology").alias("factor"), "level", F.col("level").alias("place"))  # a grid that lists its levels by name
    return summaries.ordered_levels(firsts, summaries.level_order(None, grid, "ideology"))


@R.add("so05_runs_newest_first", "manifest status dyads", LATEST.format("status") + """, counts AS (SELECT run_id, count(*) FILTER (WHERE status = 'complete') AS complete, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'started') AS running FROM latest GROUP BY 1)
SELECT run_id, planned, complete, failed, running, dyads, last_ts, row_number() OVER (ORDER BY last_ts DESC, run_id) AS place FROM (SELECT run_id, count(*) AS planned FROM manifest GROUP BY 1) m JOIN counts USING (run_id) JOIN (SELECT run_id, count(DISTINCT dyad_id) AS dyads FROM dyads GROUP BY 1) d USING (run_id) JOIN (SELECT run_id, max(ts) AS last_ts FROM status GROUP BY 1) s USING (run_id)""")
def _(t: Tables):
    return summaries.runs_overview(t.manifest, t.status, t.dyads)


@R.add("dq11_unfinished", "manifest status", LATEST.format("status") + ", why AS (SELECT run_id, dyad_id, arg_max(reason, attempt * 1000000000000 + pos) AS reason FROM status WHERE reason IS NOT NULL GROUP BY ALL) SELECT DISTINCT m.run_id, m.dyad_id, coalesce(l.status, 'never started') AS status, w.reason FROM manifest m LEFT JOIN latest l USING (run_id, dyad_id) LEFT JOIN why w USING (run_id, dyad_id) WHERE coalesce(l.status, '') <> 'complete'")
def _(t: Tables):
    return attempts.unfinished(t.manifest, t.status)
