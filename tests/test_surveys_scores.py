"""Survey shifts, score curves and levels of a generated run against plain Python; cases of flags and agreement."""

import random
from collections import defaultdict
from statistics import correlation, fmean, stdev

import pytest
from pyspark.sql import functions as F

from duetframe.operators import attempts, scores, summaries, surveys
from duetframe.plans import composites

J1, J2 = "aaaa" + "1" * 60, "bbbb" + "2" * 60
#: item: battery, lowest and highest answer; the last has no range.
ITEMS = {"tax": ("policy", 1, 7), "border": ("policy", 1, 7), "warmth": ("feeling", 0, 100), "fixed": ("feeling", 2, 2)}
CLIMATES = ["dry", "mild", "wet", None]


class Run:
    """A run of thirty dialogues: some tried twice, some failed, some answers missing, some given again later."""

    def __init__(self, seed=11):
        rng = random.Random(seed)
        self.dyads, self.status, self.answers, self.scores = [], [], [], []
        for d in range(30):
            name, tries = f"d{d:02d}", rng.choice([1, 1, 1, 2])
            for a in range(1, tries + 1):
                self.dyads.append((name, a, rng.choice(CLIMATES)))
                self.status.append((name, a, "started"))
                self.status.append((name, a, "failed" if a < tries or rng.random() < 0.2 else "complete"))
                for item, (_, lo, hi) in ITEMS.items():
                    for phase in ("pre", "post"):
                        for origin in ("run", None, "readministered")[: rng.choice([1, 1, 2, 3])]:
                            self.answers.append((name, a, phase, item, rng.choice([None, *range(lo, hi + 1)]) if rng.random() < 0.3 else rng.randint(lo, hi), origin))
                for turn in (2, 5):
                    for judge in (J1, J2):
                        for _ in range(rng.choice([1, 1, 2])):
                            self.scores.append((name, a, turn, judge, rng.choice([None, round(rng.random(), 3), round(rng.random(), 3)]), rng.choice([None, None, None, "no reply"])))

    def counted(self):
        """(dialogue, attempt) to level, of the latest attempts that are complete."""
        last = {(d, a): s for d, a, s in self.status}
        top = {d: max(a for x, a in last if x == d) for d, _ in last}
        return {(d, a): c or "(none)" for d, a, c in self.dyads if a == top[d] and last[d, a] == "complete"}

    def pairs(self, origin="run"):
        """(dialogue, item) to (before, after), both answered, of the attempts that count; later rows replace earlier ones."""
        counted, seen = self.counted(), {}
        for d, a, phase, item, v, o in self.answers:
            if (d, a) in counted and (o or "run") == origin:
                seen[d, a, item, phase] = v
        got = {(d, a, i): (v, seen.get((d, a, i, "post"))) for (d, a, i, phase), v in seen.items() if phase == "pre"}
        return {k: v for k, v in got.items() if None not in v}


def spread(values):
    return stdev(values) / len(values) ** 0.5 if len(values) > 1 else None


@pytest.fixture(scope="session")
def run(spark):
    r = Run()
    dyads = spark.createDataFrame([("r", d, a, {"climate": c} if c else {"other": "x"}, i) for i, (d, a, c) in enumerate(r.dyads)], "run_id string, dyad_id string, attempt int, condition map<string,string>, pos long")
    status = spark.createDataFrame([("r", *s, i) for i, s in enumerate(r.status)], "run_id string, dyad_id string, attempt int, status string, pos long")
    asked = spark.createDataFrame([("r", d, a, p, i, *ITEMS[i], v, o, n) for n, (d, a, p, i, v, o) in enumerate(r.answers)], "run_id string, dyad_id string, attempt int, phase string, item_id string, battery string, lo int, hi int, answer int, origin string, pos long")
    scored = spark.createDataFrame([("r", d, a, t, "mentor", "alignment", j, v, e, i) for i, (d, a, t, j, v, e) in enumerate(r.scores)], "run_id string, dyad_id string, attempt int, turn int, agent string, metric string, judge_sha256 string, score double, error string, pos long")
    return r, dyads, status, asked, scored


def test_shifts_by_item(run):
    r, dyads, status, asked, _ = run
    for origin in ("run", "readministered"):
        by = defaultdict(list)
        for (d, a, item), (x, y) in r.pairs(origin).items():
            by[r.counted()[d, a], item].append((x, y, y - x))
        got = {(x["level"], x["item_id"]): tuple(x)[2:] for x in surveys.shift_by_item(dyads, status, asked, "climate", origin).collect()}
        assert set(got) == {(level, item) for level in set(r.counted().values()) for item in ITEMS}
        for key, figures in got.items():
            x, y, d = zip(*by[key], strict=True) if by[key] else ((), (), ())
            want = (len(d), *(fmean(v) if v else None for v in (x, y, d)), spread(d))
            assert figures == pytest.approx(want), key


def test_shifts_by_battery(run):
    r, dyads, status, asked, _ = run
    own, by = defaultdict(list), defaultdict(list)
    for (d, a, item), (x, y) in r.pairs().items():
        battery, lo, hi = ITEMS[item]
        if hi > lo:
            own[d, a, battery].append((y - x) / (hi - lo))
    for (d, a, battery), shares in own.items():
        by[r.counted()[d, a], battery].append(fmean(shares))
    got = {(x["level"], x["battery"]): tuple(x)[2:] for x in surveys.shift_by_battery(dyads, status, asked, "climate").collect()}
    assert set(got) == {(level, b) for level in set(r.counted().values()) for b in ("policy", "feeling")}
    for key, figures in got.items():
        assert figures == pytest.approx((len(by[key]), fmean(by[key]) if by[key] else None, spread(by[key]))), key


def test_levels_and_counts(run):
    r, dyads, status, asked, _ = run
    counted = r.counted()
    assert {x["level"]: x["n_dyads"] for x in surveys.n_dyads(dyads, status, "climate").collect()} == {level: list(counted.values()).count(level) for level in set(counted.values())}
    (counts,) = attempts.status_counts(status).collect()
    assert tuple(counts) == ("r", len(counted), 30 - len(counted), 0)
    whole = {x["item_id"]: x["n"] for x in surveys.shift_by_item(dyads, status, asked).collect()}
    assert whole == {item: sum(i == item for _, _, i in r.pairs()) for item in ITEMS}
    firsts = dyads.sparkSession.createDataFrame([("mild", 1), ("dry", 2), ("(none)", 0)], "level string, first long")
    order = lambda given: [x["level"] for x in summaries.ordered_levels(firsts, given).orderBy("place").collect()]
    assert order(["dry", "mild"]) == ["dry", "mild", "(none)"] and order([None, "mild"]) == ["mild", "dry", "(none)"] and order(None) == ["(none)", "mild", "dry"]


def test_score_curves(run):
    r, dyads, status, asked, scored = run
    for judge in (J1, J2):
        last, by = {}, defaultdict(list)
        for d, a, turn, j, v, error in r.scores:
            if j == judge and (d, a) in r.counted() and not error and v is not None:
                last[d, a, turn] = v
        for (d, a, turn), v in last.items():
            by[r.counted()[d, a], turn].append(v)
        got = {(x["level"], x["turn"]): tuple(x)[2:] for x in scores.score_curves(dyads, status, scored, "climate", judge=judge[:4]).collect()}
        assert set(got) == set(by)
        for key, figures in got.items():
            assert figures == pytest.approx((len(by[key]), fmean(by[key]), spread(by[key])))
    for prefix in (None, "zz", ""):
        with pytest.raises(ValueError, match="judges"):
            scores.score_curves(dyads, status, scored, judge=prefix)
    with pytest.raises(ValueError):
        composites.analyze_run(dyads, status, asked, scored, "no such factor", judge="aaaa")
    assert set(composites.analyze_run(dyads, status, asked, scored, "climate", judge="aaaa")) >= {"levels", "by_item", "curves"}


def table(spark, rows):
    return spark.createDataFrame([("r", d, 1, t, agent, metric, j, s, None, i) for i, (d, t, agent, metric, j, s) in enumerate(rows)], "run_id string, dyad_id string, attempt int, turn int, agent string, metric string, judge_sha256 string, score double, error string, pos long")


def test_flag_rule(spark):
    m = "prompt_to_line"
    rows = [("a", t, "seeker", m, J1, s) for t, s in ((4, 0.4), (8, None), (12, 0.3), (16, 0.2), (20, 0.9))]
    rows += [("b", t, "seeker", m, J1, s) for t, s in ((4, 0.5), (8, 0.1), (12, 0.5), (16, 0.1), (20, 0.1))] + [("c", 4, "seeker", m, J1, None), ("b", 24, "mentor", "alignment", J1, 0.0), ("b", 24, "seeker", "line_to_line", J1, 0.0)]
    got = {r["dyad_id"]: r for r in scores.flag_dialogues(table(spark, rows), 0.5, run_length=3).collect()}
    a = got["a"]
    assert (a["flagged"], a["first_flag_turn"], a["scored_turns"], a["unscored_turns"], a["turns_under"], a["final_turn"]) == (True, 16, 4, 1, 3, 20) and a["mean_score"] == pytest.approx(0.45)
    assert (got["b"]["flagged"], got["b"]["turns_under"]) == (False, 3)  # 0.5 is not under 0.5
    assert (got["c"]["flagged"], got["c"]["scored_turns"], got["c"]["min_score"], got["c"]["final_turn"]) == (False, 0, None, 4)
    with pytest.raises(ValueError):
        scores.flag_dialogues(table(spark, rows), 0.5, metric="alignment")
    with pytest.raises(ValueError):
        scores.flag_dialogues(table(spark, [*rows, ("a", 4, "seeker", m, J2, 0.1)]), 0.5)


def test_agreement(spark):
    rows = [("a", t, "mentor", "alignment", J1, s) for t, s in ((1, 0.1), (2, 0.5), (3, None), (4, 0.9))] + [("a", t, "mentor", "alignment", J2, s) for t, s in ((1, 0.2), (2, 0.4), (3, 0.3), (4, 0.6))]
    (r,) = scores.agreement(table(spark, rows)).collect()
    assert (r["judge_a"], r["judge_b"], r["n"]) == (J1, J2, 3) and r["mean_abs_diff"] == pytest.approx(0.5 / 3) and r["within"] == pytest.approx(2 / 3)
    assert r["pearson_r"] == pytest.approx(correlation([0.1, 0.5, 0.9], [0.2, 0.4, 0.6]))
    flat = [("a", t, "mentor", "alignment", j, 0.5) for t in (1, 2) for j in (J1, J2)]
    assert scores.agreement(table(spark, flat)).collect()[0]["pearson_r"] is None
    assert scores.agreement(table(spark, rows[:4])).count() == 0


def test_scopes_and_resume(spark):
    turns = spark.createDataFrame([("r", "d", 1, t, a, "error" if (t, a) == (6, "seeker") else "stop") for t in range(1, 7) for a in ("seeker", "mentor")], "run_id string, dyad_id string, attempt int, turn int, agent string, finish_reason string")
    of = lambda scope: sorted((r["turn"], r["metric"]) for r in scores.select_targets(turns, scope).collect())
    assert of("main") == [(4, "line_to_line"), (4, "prompt_to_line"), (5, "line_to_line"), (5, "prompt_to_line")] and of("stance") == [(4, "alignment"), (6, "alignment")] and len(of("pilot")) == 5 * 2 + 6
    for bad in (("other", None), ("main", 0.0), ("main", 1.5)):
        with pytest.raises(ValueError):
            scores.select_targets(turns, *bad)
    manifest = spark.createDataFrame([("r", d) for d in "abcd"], "run_id string, dyad_id string")
    ledger = spark.createDataFrame([("r", "a", 1, "complete", 1), ("r", "b", 1, "failed", 2), ("r", "b", 2, "started", 3), ("r", "c", 1, "complete", 4), ("r", "c", 1, "failed", 5)], "run_id string, dyad_id string, attempt int, status string, pos long")
    assert {r["dyad_id"]: r["next_attempt"] for r in attempts.outstanding(manifest, ledger).collect()} == {"b": 3, "c": 2, "d": 1}
    assert attempts.latest_complete(ledger).select(F.col("dyad_id")).first()["dyad_id"] == "a"
