"""Benchmark decontamination with DataFrame functions only.

The hashes of all test windows become one set of bits (each sets two) that travels with the plan as a literal of
at most ``common.SET_BYTES``. Each document is scanned once: word hashes are combined pairwise into hashes of 2, 4, 8 and 10 words,
so a window costs a handful of hash steps whatever its length, and windows that are not in the set are dropped inside the
row: no text is shuffled. What is left is verified against the test words themselves in a join before it counts. The plan is
the same for any number of test windows; a set that is too small for them lets more windows through to the join, which
broadcasts the test windows only if their bytes, summed beforehand, are within ``BROADCAST_BYTES``.

Edge cases: null and empty texts have no words and are clean; items without words take no part; the windows of an item
without an id count as hits, only the item cannot be listed; items of fewer words than a window are one window; repeated
items and windows count once; rows that repeat an id are judged one by one; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import among, ascii_lower, materialize

#: Not in a word, as a Java character class, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: The same before lower-casing, for cutting spans out of the original text.
WORD_AS_WRITTEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The test windows are broadcast up to so many bytes.
BROADCAST_BYTES = 64 << 20


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), f"{BETWEEN}+"), "")


def _joined_hashes(left: Column, right: Column, shift: int) -> Column:
    """Hashes of the windows that start where ``left``'s do and go on with ``right``'s windows, ``shift`` words on."""
    n = F.greatest(F.size(right) - shift, F.lit(0))
    return F.zip_with(F.slice(left, 1, n), F.slice(right, shift + 1, n), lambda x, y: F.xxhash64(x, y))


def _hash_columns(df: DataFrame, lengths: list[int]) -> tuple[DataFrame, dict[int, str]]:
    """Adds a column of window hashes for each length, made from windows of powers of two words."""
    df = df.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    power = 1
    while 2 * power <= max(lengths, default=1):
        df = df.withColumn(f"h{2 * power}", _joined_hashes(F.col(f"h{power}"), F.col(f"h{power}"), power))
        power *= 2
    names = {}
    for n in lengths:
        powers = [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]
        at, name = powers[0], f"h{powers[0]}"
        for p in powers[1:]:
            df = df.withColumn(f"{name}_{p}", _joined_hashes(F.col(name), F.col(f"h{p}"), at))
            at, name = at + p, f"{name}_{p}"
        names[n] = name
    return df, names


def benchmark_windows(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(n, win, h): each distinct window of the test items with its length and hash; and (n, win, item): who holds it."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), item_words(F.col(text_col)).alias("words")).where("size(words) > 0")
    n = F.least(F.size("words"), F.lit(window))
    wins = items.withColumn("n", n).select("item", "n", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)).alias("at"))
    holds = materialize(wins.select("item", "n", F.slice("words", F.col("at"), F.col("n")).alias("words")).distinct(), "benchmark-windows")
    lengths = sorted(r["n"] for r in holds.select("n").distinct().collect())  # 1 to window
    hashed, names = _hash_columns(holds.select("n", "words").distinct(), lengths)
    h = F.coalesce(*[F.when(F.col("n") == n, F.element_at(F.col(name), 1)) for n, name in names.items()], F.lit(0).cast("long"))
    win = F.array_join("words", " ").alias("win")
    return hashed.select("n", win, h.alias("h")), holds.where("item is not null").select("n", win, "item")


def _bounded(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def window_hits(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(uid, doc_id, n_words, hits), a row for each row of ``docs``, and (uid, item), the test items found in it, each once.

    ``hits`` is an array of (at, n), the verified windows: the first word (from 0) and the number of words.
    """
    wins, holds = benchmark_windows(benchmark, window, item_col, item_text_col)
    wins = materialize(wins, "benchmark-hashes")
    total = wins.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("win") + 48), F.lit(0)).alias("bytes")).first()
    lengths = [r["n"] for r in wins.select("n").distinct().orderBy("n").collect()]
    known = among(wins.select("h"), nested=True)
    words = docs.select(F.col(id_col).alias("doc_id"), item_words(F.col(text_col)).alias("words"))
    hashed, names = _hash_columns(words, lengths)

    def starts(n: int, name: str) -> Column:
        """array<struct<at, n>> of the windows of ``n`` words to verify."""
        def one(h: Column, i: Column) -> Column:
            return F.when(known(h), F.struct(i.alias("at"), F.lit(n).alias("n")))

        found = F.transform(F.col(name), one)
        return F.filter(found, lambda x: x.isNotNull())

    hits = F.concat(F.array().cast("array<struct<at:int,n:int>>"), *[starts(n, name) for n, name in names.items()])
    cut = F.transform("hits", lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), F.array_join(F.slice("words", x["at"] + 1, x["n"]), " ").alias("win")))
    hashed = hashed.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "words", hits.alias("hits"))
    rows = materialize(hashed.select("uid", "doc_id", F.size("words").cast("long").alias("n_words"), cut.alias("hits")), "decontam-hits")
    found = rows.select("uid", F.explode("hits").alias("x")).select("uid", "x.*")
    verified = materialize(found.join(_bounded(wins.select("n", "win"), total["bytes"]), ["n", "win"]), "decontam-verified")
    spots = verified.groupBy("uid").agg(F.collect_list(F.struct("at", "n")).alias("hits"))
    items = verified.select("uid", "n", "win").distinct().join(holds, ["n", "win"]).select("uid", "item").distinct()
    none = F.array().cast("array<struct<at:int,n:int>>")
    return rows.drop("hits").join(spots, "uid", "left").select("uid", "doc_id", "n_words", F.coalesce("hits", none).alias("hits")), items


def covered(hits: Column) -> Column:
    """The number of words inside any of the windows (at, n)."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, x: Column) -> Column:
        end = x["at"] + x["n"]
        return F.struct(F.greatest(s["upto"], end).alias("upto"), (s["n"] + F.greatest(F.lit(0), end - F.greatest(s["upto"], x["at"]))).alias("n"))

    return F.aggregate(F.array_sort(F.transform(hits, lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n")))), start, step, lambda s: s["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, items): words inside test windows, and the test items found, sorted as strings."""
    found, items = window_hits(docs, benchmark, **options)
    items = items.groupBy("uid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = found.join(items, "uid", "left")
    return out.select("doc_id", "n_words", covered(F.col("hits")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _cut_words(text: Column, hits: Column) -> Column:
    """``text`` without the words of the windows and what follows each up to the next word."""
    seps = F.split(text, WORD_AS_WRITTEN)
    written = F.regexp_extract_all(text, F.lit(WORD_AS_WRITTEN), F.lit(0))
    gone = F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1))))
    stays = F.array_except(F.sequence(F.lit(0), F.size(written) - 1), gone)
    kept = F.transform(stays, lambda i: F.concat(F.get(written, i), F.get(seps, i + 1)))
    return F.when(F.size(hits) == 0, text).otherwise(F.concat(F.get(seps, F.lit(0)), F.array_join(kept, "")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a test window, or with those windows cut out (``remove="spans"``).

    Decisions are joined back by id and a hash of the text, so rows that share an id are told apart. Documents that no
    decision can be about do not move.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"))
    keyed = docs.select(key.alias("doc_id"), F.col(text_col).alias("text"))
    found = window_hits(keyed, benchmark, **options)[0].where(F.size("hits") > 0).select("doc_id.id", "doc_id.th", "hits").dropDuplicates(["id", "th"])
    found = materialize(found, "decontam-found")
    hit = among(found.select(F.xxhash64("id", "th").alias("h")))(F.xxhash64("id", "th"))
    rows, clear = rows.where(hit), rows.where(~hit).select("row.*")
    same = rows["id"].eqNullSafe(found["id"]) & (rows["th"] == found["th"])
    if remove == "documents":
        return clear.unionByName(rows.join(found, same, "left_anti").select("row.*"))
    cut = rows.join(found, same, "left").withColumn("cut", F.when(F.col("hits").isNull(), F.col(f"row.`{text_col}`")).otherwise(_cut_words(rows["text"], F.col("hits"))))
    return clear.unionByName(cut.select(*[F.col("cut").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]))
