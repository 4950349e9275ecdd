"""Cross-tokenizer alignment, whitening and language identification against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from duetframe.llm import alignment, language, whitening

PATHS = [f"{alignment.TOKENIZERS}/{x}" for x in (alignment.BYTE_BPE, alignment.PIECE_BPE)]


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    byte = alignment.byte_level()
    entry = lambda i: bytes(byte[c] for c in a.id_to_token(i))
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return (lambda t: a.encode(f" {t}", add_special_tokens=False).ids, entry), (lambda t: b.encode(t), piece)


def plain_groups(encoders, text):
    """[(A ids, B ids)] of a text, encoded whole, cut where both have ended."""
    if not text:
        return []
    ids, ends = [], []
    for encode, table in encoders:
        i = encode(text)
        parts = [table(x) for x in i]
        if b"".join(parts) != f" {text}".encode():
            return []
        ids.append(i), ends.append(np.cumsum([len(p) for p in parts]).tolist())
    out, x, y = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        i, j = ends[0].index(end) + 1, ends[1].index(end) + 1
        out.append((ids[0][x:i], ids[1][y:j]))
        x, y = i, j
    return out


PIECES = [" ", "  ", "\n", "\t", "a", " the", "Ing", "é", "'s", "'", "12", "3", "!", "...", " ", "▁", "<|endoftext|>", "<s>", "<0x0A>", "日本", "🙂", "\x1c", "\x85", "﻿", "\r\n", "x" * 70, "\x00", "é", "　", " quiet river"]


def aligned_texts(texts):
    r = random.Random(5)
    mixed = ["".join(r.choice(PIECES) for _ in range(r.randrange(1, 12))) for _ in range(400)]
    return [*texts.values(), texts[1], *mixed, "long " + "ab" * 40_000]


def test_alignment_equals_a_plain_version(spark, texts, encoders, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 3_000)
    monkeypatch.setattr(alignment, "SLICE_LINKS", 500)
    monkeypatch.setattr(alignment.Encoder, "KEPT", 50)
    every = aligned_texts(texts)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(every)], "doc_id long, text string, row string, n long").repartition(3)
    made, found = alignment.align(df, *PATHS, row=F.struct("doc_id", "row")), alignment.linked(df, *PATHS, row=F.struct("doc_id", "row")).cache()
    want = [plain_groups(encoders, t) for t in every]
    for r in made.collect():
        groups, x, y = [], 0, 0
        for i, j in zip(r["a_sizes"], r["b_sizes"], strict=True):
            groups.append((r["a_ids"][x:x + i], r["b_ids"][y:y + j]))
            x, y = x + i, y + j
        assert groups == want[r["row"]["doc_id"]] and (x, y) == (len(r["a_ids"]), len(r["b_ids"])), every[r["row"]["doc_id"]]
    links = [[(a[-1], b[-1]) for a, b in g] for g in want]
    counts = Counter(x for g in links for x in g)
    top = {b: max(n for (_, y), n in counts.items() if y == b) for _, b in counts}
    pairs = alignment.pair_counts(found)
    assert {(r["a_id"], r["b_id"]): (r["n"], r["best"]) for r in pairs.collect()} == {k: (n, n == top[k[1]]) for k, n in counts.items()}
    for r in alignment.figures(found, pairs).collect():
        i = r["row"]["doc_id"]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want[i])
        assert tuple(r)[1:] == (sum(len(a) for a, _ in want[i]), sum(len(b) for _, b in want[i]), len(want[i]), len(want[i]), sum(counts[x] == top[x[1]] for x in links[i]), sum(counts[x] for x in links[i]), hashlib.sha256(text.encode()).hexdigest() if text else "")
    best = {r["b_id"]: (r["a_id"], r["n"]) for r in alignment.id_map(pairs).collect()}
    assert best == {b: (min(a for (a, y), m in counts.items() if y == b and m == n), n) for b, n in top.items()}
    found.unpersist()


def test_alignment_of_empty_tables(spark, empty):
    assert alignment.align(empty, *PATHS).count() == 0
    found = alignment.linked(empty, *PATHS)
    assert alignment.figures(found, alignment.pair_counts(found)).count() == 0
    nothing = alignment.linked(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), *PATHS)
    assert [tuple(r)[1:] for r in alignment.figures(nothing, alignment.pair_counts(nothing)).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_galloping_finds_what_a_search_finds():
    r = np.random.default_rng(3)
    into = np.concatenate([np.sort(r.choice(5000, n, replace=False)) for n in (700, 1, 40)])
    off = np.array([0, 700, 701, 741])
    seg = r.integers(0, 3, 2000)
    keys = r.integers(-5, 5005, 2000)
    start = off[seg] + r.integers(0, 800, 2000)
    got = alignment.gallop(keys, into, start, off[seg], off[seg + 1])
    assert (got == [off[s] + np.searchsorted(into[off[s]:off[s + 1]], k) for s, k in zip(seg, keys, strict=True)]).all()


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, row string, component int").repartition(3)


def plain_whitening(vectors):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)) + 100_000
    c = x - x.mean(0)
    e, q = np.linalg.eigh(c.T @ c / len(c))
    return c, e[::-1], q[:, ::-1]


def test_whitening_equals_an_eigendecomposition(spark):
    r = np.random.default_rng(1)
    vectors = (r.standard_normal((60, 12)) * np.linspace(1, 3, 12)).astype(np.float32).tolist()
    vectors += vectors[:3]
    rows = [*enumerate(vectors), (None, vectors[5]), (90, None), (91, [None] + vectors[0][1:]), (92, [float("nan")] + vectors[0][1:]), (93, [float("-inf")] + vectors[0][1:]), (94, [1.0, 2.0]), (95, [])]
    x = whitening.whole_numbers(embeddings(spark, rows), row=F.struct("vec_id", "row", "component"))
    got = whitening.whiten(x, whitening.fit(x)).collect()
    kept = [*vectors, vectors[5]]
    c, e, q = plain_whitening(kept)
    assert len(got) == 8 * len(kept) and {g["n"] for g in got} == {len(kept)} and max(g["identity_error"] for g in got) < 1e-12
    sign = {}
    for g in got:
        i = g["row"]["vec_id"]
        v = 5 if i is None else i
        k = g["component"] - 1
        want = float(c[v] @ q[:, k] / np.sqrt(e[k]))
        sign.setdefault(k, np.sign(want * g["whitened"]))
        assert g["whitened"] * sign[k] == pytest.approx(want, abs=1e-9) and g["explained"] == pytest.approx(e[k] / e.sum(), rel=1e-9)
        whole = [int(np.floor(1024 * float(np.float32(a)))) + 100_000 for a in kept[v]]
        sums = np.sum([[int(np.floor(1024 * float(np.float32(a)))) + 100_000 for a in w] for w in kept], 0).tolist()
        assert g["deviation"] == sum((len(kept) * a - s) ** 2 for a, s in zip(whole, sums, strict=True))


def test_whitening_of_equal_and_vanishing_deviations(spark):
    corners = [[float(s * (i == k)) for i in range(4)] + [0.5, 0.5] for k in range(4) for s in (-1, 1)]  # four equal deviations, two of zero
    x = whitening.whole_numbers(embeddings(spark, enumerate(corners)))
    model = whitening.fit(x)
    assert np.allclose(model.variances, 1024 ** 2 / 4) and np.allclose(model.directions.T @ model.directions, np.eye(4)) and np.allclose(model.directions[4:], 0)
    assert whitening.whiten(x, model).count() == 8 * 4 and model.identity_error < 1e-12


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, [])]])
def test_whitening_without_variance(spark, rows):
    x = whitening.whole_numbers(embeddings(spark, rows) if rows else embeddings(spark, [(1, None)]))
    assert whitening.whiten(x, whitening.fit(x)).count() == 0


def test_deviations_beyond_a_long_are_null():
    x = np.array([[10 ** 12, 0], [0, 0]])
    assert whitening._deviations(x, 2, x.sum(0)) == [None, None]
    assert whitening._deviations(np.array([[1 << 30, 5], [0, 5]]), 2, np.array([1 << 30, 10])) == [1 << 60, 1 << 60]
    assert whitening._deviations(np.array([[1 << 40], [1 << 40], [0]]), 1 << 22, np.array([1 << 62])) == [0, 0, None]


LANGUAGES = {"en": "the quick river and of it is with that stone".split(), "de": "der die und nicht fluß ein mit auf über stein".split(), "日": ["石の川", "静かな", "橋と"]}


def spoken(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join(r.choice(LANGUAGES[lang]) + r.choice(["", "", ",", "."]) for _ in range(n))


def learnable(i):
    return zlib.crc32(str(i).encode()) % 3 != 1


@pytest.fixture(scope="module")
def spoken_docs(spark):
    rows = [(i, spoken(lang, 5 + i % 20, i), lang, "x", 1.0) for i, lang in enumerate(["en", "de", "日", "en"] * 30)]
    rows += [(500, "und nicht mit", "en", "x", 1.0), rows[0], (None, "der stein", "de", "x", 1.0), (501, "the river", None, "x", 1.0), (502, None, "de", "x", 1.0), (503, "", "en", "x", 1.0), (504, "12 3² ... !!", "en", "x", 1.0), (505, "THE QUICK", "en", "x", 1.0), (506, "über " * 30_000, "de", "x", 1.0), (507, "z" * 50_000, None, "x", 1.0), (508, "Ω", None, "x", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double").repartition(3)


def plain_prediction(rows, text):
    """Scores of a text by counts of all words and their runs, without a bound on the model."""
    words = lambda t: ["".join(filter(str.isalpha, w)) for w in language.words_of(t or "") if any(map(str.isalpha, w))]
    counts = {}
    for r in rows:
        if r["lang"] is not None and r["text"] is not None and (r["doc_id"] is None or learnable(r["doc_id"])):
            counts.setdefault(r["lang"], Counter()).update(words(r["text"]))
    counts = {k: c for k, c in counts.items() if c}
    langs = sorted(counts)
    runs = {k: Counter() for k in langs}
    for k in langs:
        for w, n in counts[k].items():
            for length in range(1, 6):
                for run in language.runs_of(w, length):
                    runs[k][run] += n
    total = dict.fromkeys(langs, 0.0)
    vocabulary = {w for c in counts.values() for w in c}
    known = {length: {x for c in runs.values() for x in c if len(x) == length} for length in range(1, 6)}
    if not words(text):
        return "und", total

    def share(n, every, k, entries):
        least = language.SMOOTHING / max(every.values())
        return np.log((n / every[k] + least) / (1 + least * entries))

    for w in words(text):
        if w in vocabulary:
            for k in langs:
                total[k] += share(counts[k][w], {x: sum(c.values()) for x, c in counts.items()}, k, len(vocabulary))
            continue
        for length in range(5, 0, -1):
            found = [x for x in language.runs_of(w, length) if x in known[length]]
            if found:
                every = {k: sum(n for x, n in runs[k].items() if len(x) == length) for k in langs}
                for k in langs:
                    total[k] += np.mean([share(runs[k][x], every, k, len(known[length])) for x in found])
                break
    return max(langs, key=lambda k: (round(total[k], 3), -ord(k[0]))), total


def test_languages_equal_a_plain_version(spark, spoken_docs, monkeypatch):
    monkeypatch.setattr(language, "SLICE_BYTES", 400)
    rows = spoken_docs.collect()
    model = language.train(spoken_docs)
    strange = [(900, "rivers unquickly"), (901, "überstein flüsse"), (902, "石橋"), (903, "xyzzy"), (904, "ΩΩ"), (905, "a²b ²"), (906, "the ²")]
    asked = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows] + strange, "doc_id long, text string")
    for r in language.predict(asked, model).collect():
        text = r["row"]["text"]
        want, total = plain_prediction(rows, text)
        assert r["lang_pred"] == want, text[:100]
        if want == "und":
            assert r["score"] == 0
        else:
            t = np.array(list(total.values()))
            assert r["score"] == pytest.approx(float(np.exp(t.max() - t.max()) / np.exp(t - t.max()).sum()), rel=1e-3)


def test_small_models_fall_back_to_runs_and_still_tell_languages(spark, spoken_docs):
    model = language.train(spoken_docs, words=9, runs=300)
    assert len(model.words) <= 9 + 3 and len(model.runs) <= 5 * 300
    got = [(r["row"]["lang"], r["lang_pred"]) for r in language.predict(spoken_docs.where("doc_id < 120"), model).collect() if not learnable(r["row"]["doc_id"])]
    assert len(got) > 20 and np.mean([a == b for a, b in got]) > 0.95


def test_languages_without_anything_to_learn(spark, spoken_docs):
    assert language.train(spoken_docs.where("lang is null")) is None
    assert {(r["lang_pred"], r["score"]) for r in language.predict(spoken_docs, None).collect()} == {("und", 0.0)}
    assert language.predict(spoken_docs.limit(0), language.train(spoken_docs)).count() == 0


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.predict(docs, language.train(docs), row=F.struct("doc_id", "lang")).where("row.lang is not null and lang_pred <> 'und'").collect()
    away = [r["row"]["lang"] == r["lang_pred"] for r in got if not learnable(r["row"]["doc_id"])]
    assert len(away) > 200 and np.mean(away) > 0.98
