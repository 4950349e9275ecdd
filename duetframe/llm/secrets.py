"""Secrets by comparing two character Markov models, with DataFrame functions only.

Base spans come from fixed patterns. Further candidates are all unbroken tokens of 12 or more characters, with digits or
without. Two first-order models over characters, one of random strings and one of ordinary identifiers, give each candidate a log-likelihood
ratio; it is added if the ratio is high both in total and for each character. The models learn from labelled samples: the
values of the base spans are random strings, the words of all documents are ordinary (those as long as a candidate only if
two texts have them, as a random string is not found twice; those that are a base span's value not at all).
Learning is counting: words first, then their character pairs; at most 128 * 128 counts of a model ever leave the executors.

Edge cases: a null or empty text has no spans; without samples the ratio is zero and nothing is added; repeated rows are
judged one by one; other columns are not looked at. A text is searched whole, whatever its length. Offsets are code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import find_spans, literal_doubles, materialize, span_list

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
# a run of the right length is what is left of the whole runs once the short ones are dropped
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
MIN_TOKEN = 12
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}+"
ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z_][A-Za-z0-9_-]{4,}+"
MIN_ASSIGN = 12
CODES = 128
SMOOTHING = 0.5
#: Weight of the single characters' shares beside a pair's own count.
BACKOFF = 8.0
#: Natural logarithms of the ratio that a token needs, in total and for each pair of characters.
MIN_TOTAL, MIN_EACH = 20.0, 0.6


def pairs(token: Column) -> Column:
    """array<int>: the numbers of the neighbouring pairs of ASCII characters."""
    at = F.sequence(F.lit(1), F.char_length(token) - 1)
    return F.when(F.char_length(token) > 1, F.transform(at, lambda i: F.ascii(F.substring(token, i, F.lit(1))) * CODES + F.ascii(F.substring(token, i + 1, F.lit(1))))).otherwise(F.array().cast("array<int>"))


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, tokens), a row for each row of ``docs``: base spans (kind, start, end, text) and other long tokens."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    none = F.array().cast("array<struct<kind:string,start:int,end:int,text:string>>")

    def of(kind: str, pattern: str, group: int | None = None) -> Column:
        spans = find_spans(text, pattern, group=group)
        if kind == "assign":
            spans = F.filter(spans, lambda s: F.char_length(s["text"]) >= MIN_ASSIGN)
        spans = F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))
        return F.when(text.rlike(pattern), spans).otherwise(none)  # most texts have none: one pass and no array

    base = F.concat(of("assign", ASSIGN, 1), of("access", ACCESS), of("hex", HEX))
    rows = rows.select("doc_id", base.alias("base"), of("random", TOKEN).alias("tokens"))
    free = F.filter("tokens", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return rows.select("doc_id", "base", free.alias("tokens"))


def _counts(tokens: DataFrame, weight: Column) -> dict[int, int]:
    """Pair to count, each token counted ``weight`` times; 128 * 128 at most."""
    each = tokens.select(weight.alias("weight"), F.explode(pairs(F.col("token"))).alias("pair")).where((F.col("pair") < CODES * CODES) & (F.col("weight") > 0))
    return {r["pair"]: r["count"] for r in each.groupBy("pair").agg(F.sum("weight").alias("count")).toLocalIterator()}


def log_ratios(random: dict[int, int], ordinary: dict[int, int]) -> list[float]:
    """For each pair, the log of its conditional probability as random over that as ordinary.

    A pair that a model has not seen falls back on how common its second character is there.
    """
    def logs(counts: dict[int, int]) -> list[float]:
        seconds = [SMOOTHING] * CODES
        for pair, n in counts.items():
            seconds[pair % CODES] += n
        every = sum(seconds)
        out = []
        for first in range(CODES):
            row = [counts.get(first * CODES + second, 0) for second in range(CODES)]
            total = sum(row) + BACKOFF
            out += [math.log((n + BACKOFF * seconds[second] / every) / total) for second, n in enumerate(row)]
        return out

    if not random or not ordinary:
        return [0.0] * (CODES * CODES)
    return [a - b for a, b in zip(logs(random), logs(ordinary), strict=True)]


def train(docs: DataFrame, found: DataFrame, *, text_col: str = "text") -> list[float]:
    """The ratios of both models: base spans' values as found, ordinary words of all documents by how often each occurs.

    Words are counted before pairs are, so what moves is each distinct word once from each task.
    """
    random = found.select(F.explode("base.text").alias("token"), F.lit(None).cast("long").alias("th"), F.lit(1).alias("secret"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(F.xxhash64(text).alias("th"), F.explode(F.regexp_extract_all(text, F.lit(ORDINARY), F.lit(0))).alias("token")).select("token", "th", F.lit(0).alias("secret"))
    each = random.unionByName(words).groupBy("token").agg(F.sum("secret").alias("as_secret"), F.count("th").alias("as_word"), (F.min("th") < F.max("th")).alias("again"))
    each = materialize(each, "secret-words")
    known = (F.col("as_secret") == 0) & ((F.char_length("token") < MIN_TOKEN) | F.col("again"))
    return log_ratios(_counts(each, F.col("as_secret")), _counts(each, F.when(known, F.col("as_word")).otherwise(F.lit(0))))


def secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added): arrays of (kind, start, end) for each row of ``docs``."""
    found = materialize(candidates(docs, id_col=id_col, text_col=text_col), "secret-candidates")
    model = literal_doubles(train(docs, found, text_col=text_col))
    ratio = lambda s: F.aggregate(pairs(s["text"]), F.lit(0.0), lambda a, p: a + F.get(model, p))
    liked = F.filter("tokens", lambda s: ratio(s) >= F.greatest(F.lit(MIN_TOTAL), MIN_EACH * F.char_length(s["text"])))
    slim = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    return found.select("doc_id", F.transform("base", slim).alias("base"), F.transform(liked, slim).alias("added"))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def digest_columns(found: DataFrame) -> DataFrame:
    """The counts, the digest of the base spans and the list of all spans."""
    return found.select("doc_id", *map(_count, KINDS[:3]), F.sha2(span_list(F.col("base"), KINDS, False).cast("binary"), 256).alias("base_sha256"), span_list(F.concat("base", "added"), KINDS, False).alias("spans"))
