"""Places over whole tables, and dialogues that are worked on in blocks."""

import random

import pytest
from pyspark.sql import functions as F

from duetframe.operators import ordering, transcripts

TURNS = "run_id string, dyad_id string, attempt int, turn int, agent string, text string, pos long, finish_reason string"
KEY = ["run_id", "dyad_id", "attempt", "turn", "agent", "pos"]


@pytest.fixture(scope="module")
def turns(spark):
    """One dialogue of 300 turns with failed, missing and repeated messages among small ones."""
    r = random.Random(2)
    rows = []
    for d, n in (("long", 300), ("a", 1), ("b", 5), ("late", 3)):
        for t in range(1, n + 1):
            for agent in ("seeker", "mentor"):
                for _ in range(1 + (r.random() < 0.1)):
                    if r.random() > 0.05:
                        rows.append(("r", d, 1, t + 70 * (d == "late"), agent, None if r.random() < 0.1 else f"{d}{agent[0]}{t}", len(rows), "stop"))
    return spark.createDataFrame(rows, TURNS).repartition(5)


def test_history_places_point_at_what_histories_copy(turns):
    whole = {tuple(r[k] for k in KEY): r for r in transcripts.positions(transcripts.histories(turns)).collect()}
    lines = {}
    for r in transcripts.agent_line_blocks(turns, 16).collect():
        lines.setdefault((r["dyad_id"], r["agent"]), {})[r["block"]] = r["lines"]
    got = transcripts.history_places(turns, 16).collect()
    assert len(got) == len(whole)
    for r in got:
        want = whole[tuple(r[k] for k in KEY)]
        mine = lines.get((r["dyad_id"], r["agent"]), {})
        earlier = [x for b in sorted(mine) if b < r["block"] for x in mine[b]] + mine.get(r["block"], [])[:r["nth"]]
        assert (r["place"], r["partner"], earlier, r["n_earlier"]) == (want["place"], want["partner"], want["earlier"], len(want["earlier"]))


def test_no_task_sorts_a_long_dialogue(turns):
    """Windows over messages are keyed by block; only rows of blocks meet by dialogue."""
    plan = transcripts.history_places(turns, 16)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert windows and all("block" in x.split("],")[-2] or "_n" in x or "_old" in x for x in windows)


def test_view_blocks_are_the_views(spark, turns):
    dyads = spark.createDataFrame([("r", "long", 1, "Be kind.", "Stay.", "reinforced", 1), ("r", "a", 1, None, "Stay.", "once", 2), ("r", "late", 1, "Be.", "", "reinforced", 3)], "run_id string, dyad_id string, attempt int, persona_text string, persona_reminder string, persona_mode string, pos long")
    for agent in ("seeker", "mentor"):
        blocks = {}
        for r in transcripts.view_blocks(turns, dyads, agent, 16).collect():
            blocks.setdefault(r["dyad_id"], {})[r["block"]] = [tuple(m) for m in r["messages"]]
        want = {r["dyad_id"]: [tuple(m) for m in r["messages"]] for r in transcripts.views(turns, dyads, agent).collect()}
        assert {d: [m for k in sorted(b) for m in b[k]] for d, b in blocks.items()} == want
        assert max(len(m) for b in blocks.values() for m in b.values()) < 60


def test_agent_totals(turns):
    whole = {(r["dyad_id"], r["agent"]): (r["n_messages"], r["last_line"]) for r in transcripts.agent_lines(turns.where("text is not null")).collect()}
    assert {(r["dyad_id"], r["agent"]): (r["n_messages"], r["last_line"]) for r in transcripts.agent_totals(turns.where("text is not null")).collect()} == whole


def test_survey_requests_add_the_dialogue_once_asked(spark, turns):
    dyads = spark.createDataFrame([("r", "b", 1, 7, 5, 1)], "run_id string, dyad_id string, attempt int, seed long, n_turns int, pos long").withColumns({"persona_text": F.lit("p"), "persona_reminder": F.lit(""), "persona_mode": F.lit("once")})
    status = spark.createDataFrame([("r", "b", 1, "complete", 1)], "run_id string, dyad_id string, attempt int, status string, pos long")
    items = spark.createDataFrame([("i", "How much?"), ("j", "Why?")], "item_id string, text string")
    work = transcripts.survey_worklist(turns, dyads, status, items, 7)
    full = transcripts.survey_requests(work, turns, dyads).collect()
    assert work.count() == len(full) == 2
    for r in full:
        assert len(r["messages"]) == r["n_messages"] and tuple(r["messages"][-1]) == ("user", r["question"])


def test_places_over_a_table(spark):
    values = [random.Random(4).randrange(50) for _ in range(997)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(6)
    for order, key in ((("v", "i"), lambda x: x), ((F.desc("v"), F.col("i")), lambda x: (-x[0], x[1]))):
        got = ordering.with_places(df, *order).collect()
        assert [(r["v"], r["i"]) for r in sorted(got, key=lambda r: r["place"])] == sorted(((v, i) for i, v in enumerate(values)), key=key)
        assert sorted(r["place"] for r in got) == list(range(1, 998))
    assert ordering.with_places(df.limit(0), "v").count() == 0
