"""The pipeline's stages over a small corpus, each against what it is for."""

from collections import Counter

import brute
import corpus_pipeline
import pytest
from conftest import sentence
from duetframe.llm import mixing
from duetframe.llm.common import materialize


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    base = {i: sentence(i, 80) for i in range(1, 40)}
    base |= {50: base[1], 51: base[2].replace(base[2].split()[40], "changed", 1), 52: "too short", 53: base[3] + "\n" + sentence(500, 12), 54: sentence(78, 70) + "\nthis line is shared by two", 55: sentence(77, 70) + "\nthis line is shared by two"}
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(d, t, "en", f"s{d % 3}", len(t)) for d, t in base.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame([("x", sentence(500, 12))], "item_id string, text string").write.parquet(f"file://{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return base, f"file://{folder}"


def test_stages(spark, corpus):
    base, folder = corpus
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder), name)
        seen.append({r["doc_id"]: r for r in docs.collect()})
        assert docs.columns[: len(columns)] == columns
    good, lines, unique, clean, mixed = seen
    assert set(base) - set(good) == {52}
    assert {d: r["text"] for d, r in lines.items()} == {d: w[2] for d, w in brute.dedup_lines({d: base[d] for d in good}).items()}
    assert set(lines) - set(unique) == {51}  # 50 repeats the one line of 1 and is left empty
    assert set(unique) - set(clean) == {53}
    assert set(mixed) <= set(clean) and all(r["mix_taken"] == r["mix_copies"] * r["mix_size"] > 0 for r in mixed.values())
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == set(mixed)


def test_empty_tables(spark, corpus):
    docs = spark.read.parquet(f"{corpus[1]}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus[1])
        assert docs.count() == 0


CLASHES = ("size", "target", "taken", "copies", "source_size", "row", "mix_size", "id", "keep", "th", "own", "same", "text_", "hits")


@pytest.fixture(scope="module")
def odd(spark, corpus):
    """Null and repeated ids, repeated rows, ties, a very long text, and columns with the names that stages use."""
    a, b, c, d = (sentence(i, 90) for i in (201, 202, 203, 204))
    near = a.replace(a.split()[30], "changed", 1)
    rows = [(1, a), (1, b), (2, near), (None, c), (None, c.upper()), (None, d), (3, d), (4, sentence(205, 60_000)), (5, sentence(206, 90)), (5, sentence(206, 90)), (6, None), (6, ""), (None, None), (7, sentence(207, 60) + "\n" + sentence(500, 12)), (7, sentence(208, 60))]
    rows += [(100 + i, sentence(300 + i, 75)) for i in range(30)] + [(None, sentence(400 + i, 75)) for i in range(30)]
    rows = [(d, t, f"s{i % 2}" if i % 7 else None, *([i % 3] * len(CLASHES))) for i, (d, t) in enumerate(rows)]
    rows[9] = rows[8]  # equal in every column
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in CLASHES)).repartition(3), corpus[1]


def near_groups(rows):
    """Rows by place; which stay: of each group of similar texts the one with the smallest id, nulls last."""
    sets = []
    for r in rows:
        w = brute.words(brute.ascii_lower(r["text"] or ""))
        sets.append({" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    groups = brute.components(dict(enumerate(sets)), lambda x, y: 5 * len(x & y) >= 4 * len(x | y))
    best = {}
    for i, g in groups.items():
        rank = (rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0)
        best[g] = min(best.get(g, rank), rank)
    return groups, best


def counted(rows, *columns):
    return Counter(tuple(r[c] for c in columns) for r in rows)


def test_stages_decide_by_row(spark, odd):
    docs, folder = odd
    every = docs.collect()
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality_rules"](spark, docs, folder).collect()
    assert counted(good, *docs.columns) == counted([r for r in every if not brute.quality_base(r["text"])[-1]], *docs.columns)

    found = stages["simhash_dedup"](spark, docs, folder)
    groups, best = near_groups(every)
    kept = found.collect()
    assert found.columns == docs.columns and len(kept) == len(best)
    assert not counted(kept, *docs.columns) - counted(every, *docs.columns)
    left, _ = near_groups(kept)
    assert len(set(left.values())) == len(kept)  # no two that stay are similar
    assert counted([{"i": r["doc_id"]} for r in kept], "i") == Counter((None if n else d,) for n, d in best.values())

    clean = stages["benchmark_decontamination"](spark, docs, folder).collect()
    hit = brute.decontaminate({i: r["text"] for i, r in enumerate(every)}, {"x": sentence(500, 12)})
    assert counted(clean, *docs.columns) == counted([r for i, r in enumerate(every) if not hit[i][1]], *docs.columns)

    mixed = stages["source_mix"](spark, docs, folder)
    rows = mixed.collect()
    assert mixed.columns[: len(docs.columns)] == docs.columns and not counted(rows, *docs.columns) - counted(every, *docs.columns)
    taken, sizes, targets, longest = Counter(), Counter(), {}, Counter()
    for r in every:
        sizes[r["source"]] += len(brute.words(r["text"]))
        longest[r["source"]] = max(longest[r["source"]], len(brute.words(r["text"])))
    for r in rows:
        assert r["_mix_size"] == len(brute.words(r["text"])) and r["_mix_taken"] == r["_mix_copies"] * r["_mix_size"] and 1 <= r["_mix_copies"] <= 2
        assert r["_mix_source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["_mix_taken"]
        targets[r["source"]] = r["_mix_target"]
    assert targets == pytest.approx(mixing.source_targets(sizes))
    assert all(abs(taken[s] - t) <= longest[s] for s, t in targets.items())


def test_lines_of_repeated_and_missing_ids(spark, odd):
    docs, folder = odd
    shared = sentence(999, 10)
    rows = [(d, f"{t}\n{shared}") for d, t in ((5, sentence(1, 60)), (5, sentence(2, 60)), (None, sentence(3, 60)), (None, sentence(3, 60)), (2, sentence(4, 60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.lines(spark, docs, folder).collect())
    assert got == Counter((d, t if d == 2 else t.split("\n")[0]) for d, t in rows)


def test_whole_run_over_odd_rows(spark, odd, tmp_path):
    docs, folder = odd
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"file://{tmp_path}/{name}.parquet")
    rows = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert rows and all(r["_mix_copies"] > 0 for r in rows)
