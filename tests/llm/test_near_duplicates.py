"""Near-duplicates of the pipeline against all pairs compared by brute force."""

import brute
import numpy as np
import pytest
from duetframe.llm import simhash


def shingles(text, k=5):
    w = text.lower().split()
    return {" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def losers(texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    groups = brute.components(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    return {d for d in sets if groups[d] != d}


def found(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    return {r["doc_id"] for r in simhash.near_duplicate_rows(docs).where("not keep").select("row.doc_id").collect()}


def words(rng, n, kind="w"):
    return [f"{kind}{x}" for x in rng.integers(0, 1_000_000, n)]


def passage_edits(rng, similarities, n):
    """Pairs of texts, the second with one passage replaced by other words, so that they have about the similarity."""
    out = {}
    for i, s in enumerate(similarities):
        w = words(rng, n)
        cut, at = round(n * (1 - s) / (1 + s)), int(rng.integers(0, n // 2))
        out[2 * i], out[2 * i + 1] = " ".join(w), " ".join(w[:at] + words(rng, cut, "v") + w[at + cut:])
    return out


def test_passage_edits_of_long_texts(spark):
    texts = passage_edits(np.random.default_rng(1), np.repeat([0.82, 0.85, 0.9], 20), 600)
    want = losers(texts)
    assert len(want) > 50 and found(spark, texts) == want


def test_a_removed_text_still_links_others(spark):
    rng, n = np.random.default_rng(2), 400
    texts = {}
    for g in range(12):  # the first is an edited copy of the second, and the third is one of the second only
        w = words(rng, n)
        edited = lambda at, size: " ".join(w[:at] + words(rng, size, "v") + w[at + size:])  # noqa: E731, B023
        texts |= {10 * g: edited(20, 4), 10 * g + 1: " ".join(w), 10 * g + 2: edited(200, 36)}
        sets = [shingles(texts[10 * g + i]) for i in range(3)]
        assert similarity(sets[1], sets[2]) >= 0.8 > similarity(sets[0], sets[2])
    assert found(spark, texts) == losers(texts) == {10 * g + i for g in range(12) for i in (1, 2)}


def test_similarity_of_long_texts_is_exact(spark):
    texts = passage_edits(np.random.default_rng(3), np.linspace(0.77, 0.83, 60), 1500)
    want = losers(texts)
    assert 20 < len(want) < 40 and found(spark, texts) == want


@pytest.mark.parametrize("sample", [1, 16])
def test_common_passages_and_large_groups(spark, monkeypatch, sample):
    monkeypatch.setattr(simhash, "SAMPLE", sample)
    rng = np.random.default_rng(4)
    common, base, texts = words(rng, 40), words(rng, 150), {}
    for i in range(60):
        texts[i] = " ".join(words(rng, int(rng.integers(10, 60))) + common)
        w = list(base)
        for at in rng.integers(0, len(w), int(rng.integers(0, 6))):
            w[at] = f"v{rng.integers(0, 1_000_000)}"
        texts[100 + i] = " ".join(w)
    assert found(spark, texts) == losers(texts)


def test_components_stop_when_only_stars_are_left(spark, monkeypatch):
    made, materialize = [], simhash.materialize

    def counted(df, name, **options):
        made.append(df)
        return materialize(df, name, **options)

    monkeypatch.setattr(simhash, "materialize", counted)
    stars = [(a, a % 7) for a in range(7, 200)] * 2
    got = simhash.connected_components(spark.createDataFrame(stars, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == [(a, a % 7) for a in range(200)]
    assert len(made) == 1  # no round
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(-500, 500, (400, 2))] + [(0, a) for a in range(1000, 1300)] + [(5000, a) for a in range(2000, 2300)] + [(a, a + 1) for a in range(3000, 3060)]
    near = {frozenset(x) for x in links}
    of = {a: a for x in links if x[0] != x[1] for a in x}
    while (new := {a: min([of[a], *(of[b] for x in near if a in x for b in x)]) for a in of}) != of:
        of = new
    made.clear()
    got = simhash.connected_components(spark.createDataFrame(links * 2, "a long, b long"))
    shuffles = [df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") for df in made[1:]]
    assert sorted(map(tuple, got.collect())) == sorted(of.items())
    assert shuffles and max(shuffles) <= 6  # three; the plan has each twice before it reuses them
