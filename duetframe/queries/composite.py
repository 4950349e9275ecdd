"""Queries over whole composites: each table that they return, against the SQL of what it is."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import composites
from . import design, dialogue, ledger
from .base import Registry, Tables
from .dialogue import RUN_SEED, judge
from .ledger import LATEST

R = Registry()


def same_as(name: str, source: Registry, other: str):
    """Registers a query under ``name`` that must give what the query ``other`` gives."""
    def register(f):
        R.add(name, "", None)(f)
        R.sql[name] = source.sql[other]
        return f

    return register


def survey_analysis(t: Tables, part: str):
    return composites.analyze_run(t.survey_dyads, t.survey_status, t.surveys, t.scores, "ideology")[part]


def score_analysis(t: Tables, part: str):
    return composites.analyze_run(t.dyads, t.status, t.surveys, t.scores, "ideology", "alignment", judge(t)[:8])[part]


def summarised(t: Tables, part: str):
    return composites.run_summary(t.dyads, t.status, t.turns, t.scores, t.manifest)[part]


def audited(t: Tables, part: str):
    return composites.run_audit(t.manifest, t.dyads, t.status, t.turns, t.surveys, t.scores, t.runs, RUN_SEED, "ideology")[part]


same_as("rp01_by_item", ledger.R, "ag02_shift_by_item")(lambda t: survey_analysis(t, "by_item"))
same_as("rp01_by_battery", ledger.R, "ag03_shift_by_battery")(lambda t: survey_analysis(t, "by_battery"))
same_as("rp01_n_dyads", ledger.R, "ag04_dyads_by_level")(lambda t: survey_analysis(t, "n_dyads"))
same_as("rp01_curves", dialogue.R, "ag05_score_curves")(lambda t: score_analysis(t, "curves"))
same_as("rp01_factors", ledger.R, "ag11_condition_levels")(lambda t: score_analysis(t, "factors"))
same_as("rp01_metrics", dialogue.R, "ag12_metrics_present")(lambda t: score_analysis(t, "metrics"))
same_as("rp02_dyads", ledger.R, "ag10_dyad_progress")(lambda t: summarised(t, "dyads").select("run_id", "dyad_id", "attempt", "attempts", "status", "turns_done", "reason", "last_ts"))
same_as("rp02_factors", ledger.R, "ag11_condition_levels")(lambda t: summarised(t, "factors"))
same_as("rp02_metrics", dialogue.R, "ag12_metrics_present")(lambda t: summarised(t, "metrics"))
same_as("rp05_pairs", dialogue.R, "ag08_agreement")(lambda t: composites.agreement_report(t.scores)["pairs"])
same_as("rp09_answer_methods", ledger.R, "ag13_answer_methods")(lambda t: audited(t, "answer_methods"))
same_as("rp09_quality", dialogue.R, "ag14_quality_rates")(lambda t: audited(t, "quality"))
same_as("rp09_retries", ledger.R, "ag15_retries")(lambda t: audited(t, "retries"))
same_as("rp09_wrong_seeds", design.R, "dq09_wrong_seeds")(lambda t: audited(t, "wrong_seeds").select("run_id", "dyad_id", "attempt", "turn", "agent", "expected"))
same_as("rp09_records", design.R, "dq10_run_records")(lambda t: audited(t, "records"))
same_as("rp09_unfinished", ledger.R, "dq11_unfinished")(lambda t: audited(t, "unfinished"))

same_as("rp02_runs", ledger.R, "so05_runs_newest_first")(lambda t: summarised(t, "runs"))


@R.add("rp03_attempt", "dyads status", LATEST.format("status") + """, seen AS (SELECT run_id, dyad_id, max(attempt) AS highest FROM (SELECT run_id, dyad_id, attempt FROM dyads UNION SELECT run_id, dyad_id, attempt FROM status) x WHERE dyad_id = 'd7' GROUP BY ALL)
SELECT s.run_id, s.dyad_id, coalesce(c.attempt, highest) AS attempt FROM seen s LEFT JOIN complete c USING (run_id, dyad_id)""")
def _(t: Tables):
    return composites.dyad_detail(t.dyads, t.status, t.turns, t.surveys, t.scores, "d7")["attempt"].select("run_id", "dyad_id", "attempt")


@R.add("rp03_series", "scores status", LATEST.format("status") + """ SELECT metric, judge_sha256, count(*) AS n, round(sum(score), 6) AS total, min(turn) AS first_turn, max(turn) AS last_turn FROM scores JOIN complete USING (run_id, dyad_id, attempt) WHERE dyad_id = 'd7' AND (error IS NULL OR error = '') AND score IS NOT NULL GROUP BY ALL""")
def _(t: Tables):
    rows = composites.dyad_detail(t.dyads, t.status, t.turns, t.surveys, t.scores, "d7")["series"]
    total = F.aggregate("series", F.lit(0.0), lambda a, x: a + x["score"])
    return rows.select("metric", "judge_sha256", F.size("series").cast("long").alias("n"), total.alias("total"), F.get("series", F.lit(0))["turn"].alias("first_turn"), F.element_at("series", -1)["turn"].alias("last_turn"))


@R.add("rp03_battery_means", "surveys survey_status survey_dyads", ledger.V + " SELECT battery, count(*) AS n_items, round(avg((post - pre) / cast(hi - lo AS double)), 6) AS mean_share FROM pairs WHERE dyad_id = (SELECT min(dyad_id) FROM survey_dyads) AND pre IS NOT NULL AND post IS NOT NULL AND hi <> lo GROUP BY battery")
def _(t: Tables):
    one = t.survey_dyads.agg(F.min("dyad_id").alias("d")).first()["d"]
    rows = composites.dyad_detail(t.survey_dyads, t.survey_status, t.turns, t.surveys, t.scores, one)["battery_means"]
    return rows.select("battery", "n_items", "mean_share")


JUDGES = "SELECT run_id, judge_sha256 AS value, cast(row_number() OVER (PARTITION BY run_id ORDER BY min(pos)) AS int) AS place FROM scores WHERE judge_sha256 IS NOT NULL GROUP BY run_id, judge_sha256"
R.add("rp01_judges", "scores", JUDGES)(lambda t: score_analysis(t, "judges"))
R.add("rp02_judges", "scores", JUDGES)(lambda t: summarised(t, "judges"))


@R.add("rp01_status_counts", "status", LATEST.format("status") + " SELECT run_id, count(*) FILTER (WHERE status = 'complete') AS complete, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'started') AS running FROM latest GROUP BY 1")
def _(t: Tables):
    return score_analysis(t, "status_counts")


@R.add("rp01_levels", "status dyads", LATEST.format("status") + """, begun AS (SELECT run_id, dyad_id, attempt, min(pos) AS pos FROM status GROUP BY ALL),
firsts AS (SELECT coalesce(d.ideology, '(none)') AS level, min(b.pos) AS first FROM complete c LEFT JOIN dyads d USING (run_id, dyad_id, attempt) JOIN begun b USING (run_id, dyad_id, attempt) GROUP BY 1)
SELECT level, cast(row_number() OVER (ORDER BY first, level) AS int) AS place FROM firsts""")
def _(t: Tables):
    return score_analysis(t, "levels")


@R.add("rp03_scores", "scores status", LATEST.format("status") + """ SELECT turn, agent, metric, count(*) AS n, round(sum(score), 6) AS total FROM scores JOIN complete USING (run_id, dyad_id, attempt) WHERE dyad_id = 'd7' GROUP BY ALL""")
def _(t: Tables):
    rows = composites.dyad_detail(t.dyads, t.status, t.turns, t.surveys, t.scores, "d7")["scores"]
    return rows.groupBy("turn", "agent", "metric").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@R.add("rp03_status", "status", "SELECT attempt, status FROM status WHERE dyad_id = 'd7'")
def _(t: Tables):
    return composites.dyad_detail(t.dyads, t.status, t.turns, t.surveys, t.scores, "d7")["status"].select("attempt", "status")


@R.add("rp03_survey_pairs", "surveys survey_status survey_dyads", ledger.V + " SELECT item_id, battery, pre, post, post - pre AS delta FROM pairs WHERE dyad_id = (SELECT min(dyad_id) FROM survey_dyads)")
def _(t: Tables):
    one = t.survey_dyads.agg(F.min("dyad_id").alias("d")).first()["d"]
    return composites.dyad_detail(t.survey_dyads, t.survey_status, t.turns, t.surveys, t.scores, one)["pairs"].select("item_id", "battery", "pre", "post", "delta")
