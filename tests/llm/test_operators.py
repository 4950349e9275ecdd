"""Every operator against a plain version, over texts that are null, empty, long, repeated and odd."""

import hashlib

import brute
from conftest import sentence
import numpy as np
import pytest
from pyspark.sql import functions as F

from duetframe import storage
from duetframe.llm import chat, common, crf, decontam, line_dedup, mixing, pii, quality_rules, queries, secrets, simhash, warc


def rows(df, key="doc_id"):
    """Key to row; repeated rows must agree."""
    out = {}
    for r in df.collect():
        assert out.setdefault(r[key], r) == r
    return out


# --- personal data


def test_pii_base_spans(docs, texts):
    found = rows(pii.digest_columns(pii.personal_data(docs)))
    assert found.keys() == texts.keys()
    for d, t in texts.items():
        want = brute.pii(t)
        assert found[d]["base_sha256"] == brute.sha(brute.spans(want)), d
        assert [found[d][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        assert set(want) <= {(k, int(a), int(b)) for k, a, b in (s.split(":") for s in found[d]["spans"].split(",") if s)}


def test_pii_adds_spelled_out_addresses_but_no_failed_cards(spark):
    texts = [(i, f"please email me: ann{i}@example.com today, visa 4111111111111111") for i in range(40)]
    texts += [(100 + i, f"please email me: bob{i} [at] example [dot] com today") for i in range(10)] + [(200 + i, f"order 411111111111111{i}") for i in range(10)]
    found = rows(pii.personal_data(spark.createDataFrame(texts, "doc_id long, text string")))
    assert all(len(found[100 + i]["added"]) == 1 and found[100 + i]["added"][0]["kind"] == "email" for i in range(10))
    assert all(not found[200 + i]["added"] for i in range(10))


def planted(rng, kind, i):
    """(text, span): a base span of a kind, one that only the method can find, and a look-alike of it."""
    card = next(c for c in iter(lambda: "4" + "".join(str(x) for x in rng.integers(0, 10, 15)), "") if brute.luhn(c))
    group = lambda n, sep: sep.join(n[j:j + 4] for j in range(0, 16, 4))
    octets = [10, *rng.integers(1, 255, 3).tolist()]
    number = f"{rng.integers(100, 999)} {rng.integers(1000, 9999)}"
    return {
        "email": (f"email ann{i}@example.com now", f"email ann{i} [at] example [dot] com now", f"version 1.{i} (at) no.5{i} now"),
        "ip": ("server {}.{}.{}.{} is up".format(*octets), "server {}[.]{}[.]{}[.]{} is up".format(*octets), "section 0[.]999[.]{}[.]{} is up".format(*octets[:2])),
        "card": (f"visa {group(card, ' ')} paid", f"visa {group(card, '.')} paid", f"invoice {group(card[:-1] + str((int(card[-1]) + 1) % 10), '.')} paid"),
        "phone": (f"call +49 30 {number} soon", f"call 0049 30 {number} soon", f"isbn 0000 30 {number} soon"),
    }[kind]


def test_pii_by_kind(spark):
    """Of planted spans that no base pattern has, nearly all are added under the right kind; look-alikes are not."""
    rng, texts, extra, decoys = np.random.default_rng(8), [], {}, {}
    for kind in pii.KINDS:
        for i in range(60):
            base, more, decoy = planted(rng, kind, i)
            texts.append((len(texts), base))
            if i < 15:
                extra[len(texts)] = kind
                texts.append((len(texts), more))
                decoys[len(texts)] = kind
                texts.append((len(texts), decoy))
    found = rows(pii.personal_data(spark.createDataFrame(texts, "doc_id long, text string")))
    got = {kind: (sum(any(a["kind"] == kind for a in found[d]["added"]) for d, k in extra.items() if k == kind), sum(bool(found[d]["added"]) for d, k in decoys.items() if k == kind)) for kind in pii.KINDS}
    assert all(hit >= 13 and wrong <= 1 for hit, wrong in got.values()), got


def test_gazetteer_of_the_caller(spark):
    docs = spark.createDataFrame([(i, f"mail ann{i}@host.corp") for i in range(3)], "doc_id long, text string")
    votes = lambda g: pii.candidates(docs, gazetteer=g).first()["found"][0]["votes"][pii.LABELERS.index("gazetteer")]
    table = spark.createDataFrame([("email", "corp", False), ("email", "host.corp", True)], "kind string, entry string, listed boolean")
    assert (votes(None), votes(table), votes(table.where("not listed"))) == (1, 2, 0)


def test_em_separates_good_from_bad_labelers():
    post = pii.reliabilities({("card", (2, 2, 2, 1, 2)): 60, ("card", (2, 0, 1, 1, 2)): 30, ("card", (2, 0, 0, 0, 0)): 20})
    assert post["card", (2, 2, 2, 1, 2)] > 0.9 and post["card", (2, 0, 0, 0, 0)] < 0.1
    assert pii.reliabilities({}) == {}


def test_pii_of_nothing(empty):
    assert pii.personal_data(empty).count() == 0


# --- SimHash


def test_simhash_groups(docs, texts):
    found = rows(simhash.simhash_components(docs))
    prints = {d: brute.fingerprint(t) for d, t in texts.items()}
    groups = brute.components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    for d in texts:
        assert found[d]["fp"] % (1 << 64) == prints[d] and found[d]["component_id"] == groups[d], d


@pytest.mark.parametrize(("radius", "parts", "hot"), [(4, 3, 1000), (4, 3, 5), (3, 4, 1000), (7, 4, 5), (4, 5, 1000), (2, 4, 1000)])
def test_lookups_find_every_pair(spark, radius, parts, hot):
    rng = np.random.default_rng(radius * 10 + parts)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = set()
    for c in centres:
        for _ in range(12):
            x = int(c)
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(b)
            prints.add(x - (1 << 64) if x >> 63 else x)
    nodes = sorted(prints)
    df = spark.createDataFrame([(x, x) for x in nodes], "id long, fp long")
    got = {(r["a"], r["b"]) for r in simhash.hamming_links(df, radius, parts, hot).distinct().collect()}
    want = {(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1:] if ((a ^ b) % (1 << 64)).bit_count() <= radius}
    assert got == want


def test_segments_follow_from_the_number_of_fingerprints():
    assert [simhash.best_parts(n, 4) for n in (1_000, 200_000, 10**8, 10**10)] == sorted((simhash.best_parts(n, 4) for n in (1_000, 200_000, 10**8, 10**10)), reverse=True)
    assert simhash.best_parts(10**8, 4) == 2


def test_hot_fingerprints_join_like_others(spark, monkeypatch):
    df = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one hot text of many copies").otherwise(F.concat(F.lit("word number "), F.col("id").cast("string"), F.lit(" x y"))).alias("text"))
    want = {(r["doc_id"], r["component_id"]) for r in simhash.simhash_components(df).collect()}
    monkeypatch.setattr(simhash, "HOT_SHARE", 0.5)  # none is hot
    assert {(r["doc_id"], r["component_id"]) for r in simhash.simhash_components(df).collect()} == want and len(want) == 900
    assert all(c == 0 for d, c in want if d % 3 == 0)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in simhash.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert simhash.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_one_of_each_group_stays(docs, texts, empty):
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == set(texts) - {2, 3, 5, 6}  # copies of 1, one word changed in 120, and texts without words beside 4
    assert simhash.drop_near_duplicates(docs).columns == docs.columns
    assert simhash.drop_near_duplicates(empty).count() == 0 and simhash.simhash_components(empty).count() == 0


def test_null_ids_have_a_component_or_none(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (None, "only here and not there at all")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.simhash_components(df).collect()}
    assert got == {(None, 5), (5, 5), (None, None)}


# --- WARC


@pytest.fixture(scope="session")
def pages(spark):
    big = "<p>" + "é" * 80 + "</p>"
    got = {1: big, 2: "small", 3: big, 4: "small", 5: None, 6: "", 7: big + "x", 8: "<x>" * 20_000, 9: big, 10: "line\r\n\r\nWARC/1.1\r\n" * 9}
    return got, spark.createDataFrame([(p, f"http://h/{p}\r\nX: 1", h, "x") for p, h in got.items()], "page_id long, url string, html string, payload string").repartition(3)


def test_warc_round_trip(spark, pages):
    html, df = pages
    path = storage.scratch_path(spark, "warc-test")
    warc.archive(df, path)
    got = {}
    for r in warc.read_archive(spark, path).where("record_type <> 'warcinfo'").select(warc.page_of(F.col("record_id")).alias("p"), "*").collect():
        refers = None if r["refers_to"] is None else int(r["refers_to"][10:-1])
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == (html[r["p"]] or "").encode()
        got[r["p"]] = (r["payload_bytes"], r["payload_digest"].removeprefix("sha256:"), r["record_type"], refers)
        assert r["target_uri"] == f"http://h/{r['p']}  X: 1"
    assert got == brute.warc(html)


def test_warc_predicates_are_decided_on_headers(spark, pages):
    _, df = pages
    path = storage.scratch_path(spark, "warc-test")
    warc.archive(df, path)
    found = warc.read_archive(spark, path, payload=False).where("record_type = 'revisit' and target_uri like 'http://h/%'")
    assert {r["record_id"] for r in found.collect()} == {"<urn:page:3>", "<urn:page:9>"}
    assert all(r["payload"] is None for r in found.collect())
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 3)]))
    assert len(left) == 1 and reader.tests == [("record_type", "in", ("revisit",))]


def test_warc_reads_gzip_members_and_reports_torn_files(tmp_path, spark):
    import gzip

    records = [warc.encode_record("response", f"<urn:page:{i}>", "http://h/", "1970-01-01T00:00:00Z", b"body %d" % i, hashlib.sha256(b"body %d" % i).hexdigest(), 6, None) for i in range(5)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    assert [bytes(r["payload"]) for r in warc.read_archive(spark, str(tmp_path)).orderBy("record_id").collect()] == [b"body %d" % i for i in range(5)]
    (tmp_path / "b.warc").write_bytes(records[0][:-30])
    with pytest.raises(Exception, match="ends inside"):
        warc.read_archive(spark, str(tmp_path / "b.warc"), payload=False).collect()


def test_warc_of_nothing(spark, pages):
    path = storage.scratch_path(spark, "warc-test")
    warc.archive(pages[1].where("page_id < 0"), path)
    assert warc.read_archive(spark, path).count() == 0


# --- line chain


def brute_marginals(model, x):
    """Sums over all label sequences."""
    import itertools

    e, out, total = x @ model.emission, np.zeros(len(x)), 0.0
    for y in itertools.product((0, 1), repeat=len(x)):
        w = np.exp(sum(e[i] for i in range(len(x)) if y[i]) + sum(model.transition[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        out += w * np.array(y)
    return out / total


def test_marginals_are_exact():
    rng = np.random.default_rng(3)
    model = crf.Chain(rng.normal(0, 0.3, crf.WIDTH), rng.normal(0, 1, (2, 2)))
    x, _ = crf.line_features(b"first line here\n### bad\n\nlast one, good.\nmore\nand more")
    assert np.allclose(model.marginals(x), brute_marginals(model, x))


def test_chain_gradient_raises_likelihood():
    good, bad = crf.line_features(b"a fine line of words here.\nanother fine line.")[0], crf.line_features(b"### %%% $$$\n$$$ ***")[0]
    model = crf.fit([good, bad] * 5, np.array([1.0, 0.0] * 5))
    assert model.score(b"a fine line of words here.\nanother fine line.") > 0.5 > model.score(b"### %%% $$$\n$$$ ***")


def test_lines_of_a_mixed_document_get_labels_of_their_own():
    """Bad documents hold as many good lines as bad ones; the chain finds which are which."""
    rng = np.random.default_rng(5)
    fine = lambda: " ".join(rng.choice(["river", "stone", "garden", "letter", "market"], 9)) + "."
    junk = lambda: "".join(rng.choice(list("#$%&*|<>"), 30))
    texts = ["\n".join(fine() for _ in range(10)) for _ in range(40)]
    texts += ["\n".join([fine() for _ in range(5)] + [junk() for _ in range(5)]) for _ in range(40)]
    model = crf.fit([crf.line_features(t.encode())[0] for t in texts], np.repeat([1.0, 0.0], 40))
    mixed = [fine(), fine(), junk(), junk(), junk(), fine(), fine()]
    found = model.marginals(crf.line_features("\n".join(mixed).encode())[0])
    assert [p > 0.5 for p in found] == [line.endswith(".") for line in mixed], found


def test_chain_trains_on_bounded_lines():
    x = np.arange(10_000)[:, None]
    parts = crf._parts(x)
    assert sum(map(len, parts)) <= crf.LINES and parts[-1][0, 0] > 9_000 and len(np.concatenate(crf._parts(x[:100]))) == 100


def test_chain_scores_every_text(docs, texts, labels, empty):
    model = crf.train(docs, labels)
    found = rows(crf.score(docs, model))
    assert found.keys() == texts.keys() and all(0 <= r["score"] <= 1 for r in found.values())
    assert crf.score(empty, model).count() == 0
    flat = crf.train(docs, labels.where("quality = 1"))
    assert len({r["score"] for r in crf.score(docs, flat).collect()}) == 1
    assert crf.train(empty, labels).score(b"x") == 0.5


def test_chain_on_held_out_documents(spark):
    """Over 0.9 of the held-out labels of the smallest tables."""
    d = "/root/testdata/sf0.001"
    got = queries.op4_line_crf(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("predicted", "quality").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.9


# --- lines


def test_line_dedup(docs, texts):
    bitmaps = line_dedup.line_keep_bitmaps(docs)
    kept = rows(line_dedup.dedup_lines(docs))
    want = brute.dedup_lines(texts)
    assert {d: r["text"] for d, r in kept.items()} == {d: w[2] for d, w in want.items()}
    lost = rows(bitmaps)
    assert {d: r["n_dropped"] for d, r in lost.items()} == {d: w[1] for d, w in want.items() if w[1]}
    for d, r in lost.items():
        assert line_dedup.read_bitmap(bytes(r["keep"]), r["n_lines"]).sum() == r["n_lines"] - r["n_dropped"] == want[d][0] - want[d][1]


def test_line_dedup_over_many_partitions_of_one_line(spark):
    texts = {d: f"the very same line\nline number {d} alone\nthe very same line" for d in range(400)}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    got = rows(line_dedup.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {d: r["text"] for d, r in got.items()} == {d: w[2] for d, w in brute.dedup_lines(texts).items()}


def test_line_dedup_null_ids_and_nothing(spark, empty):
    df = spark.createDataFrame([(None, "a line that repeats"), (3, "a line that repeats"), (None, "only in null rows"), (None, "only in null rows")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.dedup_lines(df).collect()) == [(0, ""), (0, "only in null rows"), (0, "only in null rows"), (3, "a line that repeats")]
    assert line_dedup.dedup_lines(empty).count() == 0


# --- tool calls


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        (1, 1, "a", "search", '{"q": "x", "n": 2}', None), (1, 2, "b", "search", '{"n": 1, "q": "y", "z": {"b": 1, "a": [true, null]}}', "a"), (1, 3, "c", "search", '{"q": 5}', "b"), (1, 4, "d", "nope", "{}", "gone"),
        (2, 1, "e", "search", '{"q": "x"}', "f"), (2, 2, "f", "search", '{"q": "x"}', "e"), (2, 3, None, "search", '{"q": "x"}', None), (2, 4, "g", "search", "not json", None), (2, 4, "g", "search", "not json", None), (3, 1, "h", "search", '{"q": "x", "q": "y"}', "g"), (3, 2, "i", "search", '{"q": "x"}', "h")],
        "conv_id long, turn long, call_id string, name string, arguments string, after string")
    results = spark.createDataFrame([("a", 9, "later"), ("a", 2, "é\n\"first\""), ("b", 3, None), (None, 1, "x")], "call_id string, turn long, content string")
    schemas = spark.createDataFrame([("search", "q", "string", True), ("search", "n", "integer", False), ("search", "z", "object", False)], "name string, param string, type string, required boolean")
    got = {r["call_id"]: r for r in chat.link_tool_calls(calls, results, schemas).collect()}
    assert {k: (r["level"], r["status"]) for k, r in got.items()} == {
        "a": (0, "ok"), "b": (1, "ok"), "c": (2, "bad_arguments"), "d": (0, "unknown_tool"), "e": (None, "cycle"), "f": (None, "cycle"), None: (None, "no_id"), "g": (0, "bad_arguments"), "h": (1, "bad_arguments"), "i": (2, "missing_result")}
    assert got["b"]["message"] == '{"arguments":{"n":1,"q":"y","z":{"a":[true,null],"b":1}},"call_id":"b","level":1,"name":"search","status":"ok"}'
    assert '"result":"é\\n\\"first\\""' in got["a"]["message"]
    assert chat.link_tool_calls(calls.where("turn < 0"), results, schemas).count() == 0


def test_levels_of_a_long_chain(spark):
    df = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(70)], "call_id string, after string")
    assert {int(r["call_id"]): r["level"] for r in chat.levels(df).collect()} == {i: i for i in range(70)}


def test_levels_beside_cycles(spark):
    rows = [(f"c{i}", f"c{(i + 1) % 9}") for i in range(9)] + [("t1", "c3"), ("t2", "t1"), ("self", "self")] + [(f"a{i}", f"a{i - 1}") for i in range(12)]
    got = {r["call_id"]: r["level"] for r in chat.levels(spark.createDataFrame(rows, "call_id string, after string")).collect()}
    assert got == {c: int(c[1:]) if c[0] == "a" else None for c, _ in rows}


def test_tool_calls_meet_in_hash_joins(spark):
    calls = spark.createDataFrame([(1, 1, "a", "search", "{}", None)], "conv_id long, turn long, call_id string, name string, arguments string, after string")
    plan = chat.link_tool_calls(calls, calls.select("call_id", "turn", F.lit("x").alias("content")), spark.createDataFrame([], "name string, param string, type string, required boolean"))
    text = plan._jdf.queryExecution().toString()
    assert "ShuffledHashJoin" in text and "call_id" in text


# --- decontamination


ITEMS = {"a": "STONE quiet", "b": None, "c": "...", "d": "no such words as these in any of the texts at all"}


@pytest.mark.parametrize("limits", [(1 << 22, 1 << 26), (8, 0)])
def test_decontamination(spark, docs, texts, empty, limits, monkeypatch):
    monkeypatch.setattr(common, "SET_BYTES", limits[0])  # 8 and 0 are too little for any set or broadcast
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", limits[1])
    items = ITEMS | {"e": texts[21], "f": texts[21] + " and more", "g": "short", "h": "É é"}
    items = [*items.items(), ("e", items["e"]), (None, "one"), (None, sentence(2, 12))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = brute.decontaminate(texts, items)
    assert want[7] == (1, 1, []) and want[8][1] >= 12  # what items without an id hold is hit, too
    found = rows(decontam.contamination(docs, bench))
    assert {d: (r["n_words"], r["n_hit"], r["items"]) for d, r in found.items()} == want
    kept = {r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()}
    assert kept == {d for d, w in want.items() if not w[1]}
    cut = rows(decontam.decontaminate(docs, bench, remove="spans"))
    assert {d: len(brute.item_words(r["text"])) for d, r in cut.items()} == {d: w[0] - w[1] for d, w in want.items()}
    assert cut[1]["text"] == texts[1] or want[1][1]
    assert decontam.contamination(empty, bench).count() == 0
    assert decontam.decontaminate(docs, bench.where("item_id = 'none'")).count() == docs.count()


def test_many_test_windows_do_not_let_more_text_through(spark, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 200), i -> concat('w', pmod(xxhash64(id, i), 5000))), ' ')").alias("text"))
    bench = spark.range(1000).select(F.col("id").alias("item_id"), F.expr("array_join(transform(sequence(1, 30), i -> concat('w', pmod(xxhash64(id, i, 7), 5000))), ' ')").alias("text"))
    bench = bench.union(docs.where("doc_id < 5"))
    written = {}
    keep = decontam.materialize
    monkeypatch.setattr(decontam, "materialize", lambda df, name: written.setdefault(name, keep(df, name)))
    found = decontam.contamination(docs, bench).where("n_hit > 0").collect()
    assert {(r["doc_id"], r["n_hit"]) for r in found} == {(i, 200) for i in range(5)}
    let_through = written["decontam-hits"].select(F.sum(F.size("hits"))).first()[0]
    assert 5 * 191 <= let_through < 5 * 191 + 40  # of 76,000 windows that are in no item


# --- quality rules


def test_quality_rules(docs, texts, labels, empty):
    model = quality_rules.train(docs, labels)
    found = {}
    for r in quality_rules.score(docs, model, row=F.struct("doc_id")).collect():
        found[r["row"]["doc_id"]] = r
    for d, t in texts.items():
        r = found[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.quality_base(t), d
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.train(docs, labels.where("quality = 1")) is None
    alone = {r["row"]["doc_id"]: r["kept"] for r in quality_rules.score(docs, None).collect()}
    assert alone == {d: not r["base_failed"] for d, r in found.items()}
    assert quality_rules.keep_good(docs, labels).columns == docs.columns and quality_rules.keep_good(empty, labels).count() == 0


def test_quality_rules_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op8_quality_rules(spark, d).where(common.held_out(F.col("doc_id")) & ~F.col("base_failed")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("kept", "quality").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in got]) > 0.95


# --- secrets


def test_secrets(docs, texts, empty):
    found = rows(secrets.digest_columns(secrets.secrets(docs)))
    for d, t in texts.items():
        want = brute.secrets(t)
        assert found[d]["base_sha256"] == brute.sha(brute.spans(want)), d
        assert [found[d][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[0] == k for s in want) for k in ("assign", "access", "hex")]
    assert secrets.secrets(empty).count() == 0


def test_markov_models_count_all_documents(docs):
    import re
    from collections import Counter

    values, holders, uses = Counter(), {}, Counter()
    for t in (r["text"] or "" for r in docs.collect()):
        values.update(t[a:b] for kind, a, b in brute.secrets(t) if kind != "assign")
        values.update(m[1] for m in re.finditer(secrets.ASSIGN, t) if len(m[1]) >= secrets.MIN_ASSIGN)
        for w in re.findall(secrets.ORDINARY, t):
            holders.setdefault(w, set()).add(t)
            uses[w] += 1
    random, ordinary = Counter(), Counter()
    for counts, tokens in ((random, values), (ordinary, {w: n for w, n in uses.items() if w not in values and (len(w) < secrets.MIN_TOKEN or len(holders[w]) > 1)})):
        for w, n in tokens.items():
            for a, b in zip(w, w[1:], strict=False):
                if ord(a) < 128 and ord(b) < 128:
                    counts[ord(a) * 128 + ord(b)] += n
    assert secrets.train(docs, secrets.candidates(docs)) == pytest.approx(secrets.log_ratios(random, ordinary), abs=1e-9)


def test_markov_models_add_random_tokens(spark):
    import random

    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    secret = lambda: "".join(rng.choice(alphabet) for _ in range(32))
    texts = [(i, f"the quiet garden has token = {secret()} and a river_of_stone_2 winter_morning_window_3") for i in range(200)]
    texts += [(1000 + i, f"see {secret()[:31]}7 for the quiet_garden_morning_letter_9") for i in range(20)]
    found = rows(secrets.secrets(spark.createDataFrame(texts, "doc_id long, text string")))
    assert sum(len(found[1000 + i]["added"]) for i in range(20)) >= 18
    assert all(s["start"] == 4 for i in range(20) for s in found[1000 + i]["added"])
    assert not any(found[i]["added"] for i in range(200))


def test_markov_models_add_letters_without_digits(spark):
    import random

    rng = random.Random(6)
    secret = lambda n, more="": "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + more) for _ in range(n))
    texts = [(i, f"the quiet garden has token = {secret(32, '0123456789')} and {sentence(i, 30)} under the unquestionable circumstances") for i in range(200)]
    texts += [(1000 + i, f"see {secret(24)} for the uncharacteristically quiet_garden") for i in range(20)]
    found = rows(secrets.secrets(spark.createDataFrame(texts, "doc_id long, text string")))
    assert sum(any(s["start"] == 4 for s in found[1000 + i]["added"]) for i in range(20)) >= 17
    assert not any(s["start"] != 4 for i in range(20) for s in found[1000 + i]["added"]) and not any(found[i]["added"] for i in range(200))


# --- mixing


def test_mixing(docs, texts, empty):
    got = mixing.mix_sources(docs).collect()
    sizes, sources = {}, {}
    for r in docs.collect():
        sizes.setdefault(r["source"], 0)
        sizes[r["source"]] += len(brute.words(r["text"]))
    targets = mixing.source_targets(sizes)
    assert abs(sum(targets.values()) - 1.5 * sum(sizes.values())) < 1e-6
    for r in got:
        sources.setdefault(r["source"], 0)
        sources[r["source"]] += r["taken"]
        assert r["size"] == len(brute.words(texts[r["doc_id"]])) and r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
    assert sorted(got) == sorted(mixing.mix_sources(docs.repartition(5)).collect())
    assert len(got) == docs.count() and mixing.mix_sources(empty).count() == 0
    assert all(sources[r["source"]] == r["source_taken"] for r in got)
    repeated = mixing.apply_mix(docs)
    assert repeated.columns == docs.columns and repeated.count() == sum(r["copies"] for r in got)


def plain_targets(sizes):
    """Targets by raising a level until all is given: a source's is its weight times the level, or twice its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    whole, low, high = 1.5 * sum(sizes.values()), 0.0, 1e12
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(weight[s] * level, 2 * sizes[s]) for s in names) < whole else (low, level)
    return {s: min(weight[s] * high, 2 * sizes[s]) for s in names}


def test_mix_has_the_targets_of_a_plain_version(spark):
    from duetframe.llm.queries import op10_mixing

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "text").collect()
    sizes, taken = {}, {}
    for r in docs:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.words(r["text"]))
    want, source = plain_targets(sizes), {r["doc_id"]: r["source"] for r in docs}
    got = op10_mixing(spark, folder).collect()
    assert len(got) == len(docs)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s], rel=1e-6, abs=1e-6) and r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= max(5, 0.001 * want[s]) for s in want)


def test_targets_share_what_caps_leave():
    got = mixing.source_targets({"a": 10, "b": 1000, None: 90, "c": 0})
    assert got["a"] == 20 and got["c"] == 0 and abs(sum(got.values()) - 1650) < 1e-9 and all(got[s] <= 2 * n + 1e-9 for s, n in (("b", 1000), (None, 90)))


@pytest.mark.parametrize("seed", range(6))
def test_knapsack_is_near_the_best_sum(seed):
    rng = np.random.default_rng(seed)
    lengths = sorted(set(rng.integers(3, 60, 8).tolist()))
    counts = rng.integers(1, 6, len(lengths)).tolist()
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    sums = {0}
    for n, c in zip(lengths, counts, strict=True):
        sums = {s + k * n for s in sums for k in range(c + 1)}
    for budget in rng.integers(0, total, 15).tolist():
        take = mixing.fit_counts(lengths, counts, budget)
        assert all(0 <= k <= c for k, c in zip(take, counts, strict=True))
        off = abs(sum(n * k for n, k in zip(lengths, take, strict=True)) - budget)
        best = min(abs(s - budget) for s in sums)
        assert off == best if budget <= 8 * max(lengths) else off <= best + lengths[0] / 2


def test_knapsack_goes_over_when_that_is_nearer():
    assert mixing.fit_counts([1, 30_000], [1, 3], 20_000) == [0, 1]
    assert mixing.fit_counts([1, 30_000], [1, 3], 14_000) == [1, 0]


def test_many_documents_of_one_length_split_exactly(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("source"))
    by = {r["source"]: r for r in mixing.mix_sources(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert all(abs(r["taken"] - r["target"]) <= 3 for r in by.values())
