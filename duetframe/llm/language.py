"""Language identification, word first: known words by their frequency in each language, other words by shorter and shorter
runs of their characters.

All documents with a language outside the held-out third are counted: tasks add up words by language before the shuffle, and
the runs of 1 to 5 characters of a word (with its borders) are counted from the words, each as often as the word occurs. The
model keeps the most frequent words and runs of each language, so many at most (``WORDS``, ``RUNS``: its size, which is what
goes to the workers); what it leaves out is scored by shorter runs like any other unseen word. Counts and totals cover all
words. A text is a sum over its words of log frequencies by language, in Arrow batches; nothing is shuffled to score.

Words are runs of letters, lower-cased. A known word adds its log frequency in each language. An unseen one adds the mean log
frequency of its runs of the longest length of which the model knows any.

Edge cases: ``und`` with score 0 for a null or empty text, for one without a letter, and if nothing could be learned; a text
of which nothing is known gets the first of the languages by code point; ties the same; very long texts and words cost what
their letters cost; a null or repeated id is scored (and, as it is not held out when null, learned from) row by row; rows
with a null language teach nothing; other columns are not looked at, ``row`` carries what is asked.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize, slices

#: Words, and runs of each length, that a model keeps at most, shared evenly between its languages.
WORDS, RUNS = 1 << 18, 1 << 16
LONGEST = 5
#: What is added to each count, in the language with most text; a word unseen in one language is known to be rare in it.
SMOOTHING = 0.2
UNKNOWN = "und"
#: Texts of a slice in bytes, entries that a task counts before it passes them on, and words whose scores it keeps.
SLICE_BYTES, HELD = 2 << 20, 200_000

_RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case. Some digits that are no decimals hide among them (see ``letters``)."""
    return _RUN.findall(text.lower())


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def runs_of(word: str, n: int) -> list[str]:
    padded = f"^{word}$" if n > 1 else word
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


def _text(raw: bytes | None) -> str:
    return raw.decode("utf-8", "replace") if raw else ""


def _pairs(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, c in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    for batch in batches:
        for part in slices(batch, batch.column(1), SLICE_BYTES):
            for lang, raw in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(words_of(_text(raw)))
            if sum(map(len, counts.values())) > HELD:
                yield from _pairs(counts)
                counts = {}
    yield from _pairs(counts)


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            mine = counts.setdefault(lang, Counter())
            for k in range(1, LONGEST + 1):
                for run in runs_of(word, k):
                    mine[run] += n
            if len(mine) > HELD:
                yield from _pairs(counts)
                counts = {}
    yield from _pairs(counts)


def word_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """(lang, word, n) over all documents that may be learned from."""
    rows = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)) & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(_count_words, "lang string, word string, n long")
    alone = F.when(F.col("word").rlike(r"^\p{L}+$"), F.col("word")).otherwise(F.regexp_replace("word", r"\P{L}+", ""))
    return counted.select("lang", alone.alias("word"), "n").where("word <> ''").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int, *by: str) -> DataFrame:
    """The words that are among the most frequent of their language (and ``by``), so many at most, with the counts of all languages.

    How frequent that is follows from a histogram of counts by eighths of a power of two, a few hundred rows a language.
    """
    level = F.floor(F.log2("n") * 8).cast("int")
    histogram = counts.groupBy("lang", *by, level.alias("level")).agg(F.count("*").alias("words")).collect()
    room = most // max(1, len({r["lang"] for r in histogram}))
    lowest: dict[tuple, int] = {}
    total: Counter = Counter()
    for r in sorted(histogram, key=lambda r: -r["level"]):
        key = (r["lang"], *(r[c] for c in by))
        total[key] += r["words"]
        if total[key] <= room:
            lowest[key] = r["level"]
    if not lowest:
        return counts.limit(0)
    bounds = counts.sparkSession.createDataFrame([(*k, v) for k, v in lowest.items()], ", ".join(["lang string", *(f"{c} int" for c in by), "least int"]))
    kept = counts.join(F.broadcast(bounds), ["lang", *by]).where(level >= F.col("least")).select("word").distinct()  # a row for each language (and length)
    return counts.join(kept, "word", "left_semi")


@dataclass
class Model:
    """Log frequencies by language of words and of runs, a matrix row for each."""

    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    runs: dict[str, int]
    run_scores: np.ndarray

    def score(self, word: str) -> np.ndarray | None:
        """Log frequencies of a word in each language; None for what has no letter."""
        if not (word := letters(word)):
            return None
        if (at := self.words.get(word)) is not None:
            return self.word_scores[at]
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            if known := [at for run in runs_of(word, n) if (at := self.runs.get(run)) is not None]:
                return self.run_scores[known].mean(0)
        return np.zeros(len(self.languages))


def _scores(table: pa.Table, languages: list[str], totals: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
    """(word to row, log frequencies); ``totals``: of each language, the count of all.

    What is added for smoothing is the same share in every language, or those with little text would be the likeliest for
    what none of them knows.
    """
    encoded = table.column("word").combine_chunks().dictionary_encode()
    entries = encoded.dictionary.to_pylist()
    lang = np.searchsorted(languages, table.column("lang").to_numpy(zero_copy_only=False)) if len(table) else np.zeros(0, int)
    counts = np.zeros((len(entries), len(languages)))
    counts[encoded.indices.to_numpy(), lang] = table.column("n").to_numpy()
    least = SMOOTHING / max(1.0, totals.max())
    return {w: i for i, w in enumerate(entries)}, np.log(counts / np.maximum(totals, 1) + least) - np.log1p(least * len(entries))


def train(docs: DataFrame, *, words: int = WORDS, runs: int = RUNS, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model | None:
    """The model of all documents that may be learned from, or None if there are no words."""
    counts = materialize(word_counts(docs, text_col=text_col, lang_col=lang_col, id_col=id_col), "word-counts")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row for each language
    if not totals:
        return None
    languages = sorted(totals)
    word_at, word_scores = _scores(_frequent(counts, words).toArrow(), languages, np.array([totals[x] for x in languages], float))
    run_counts = counts.mapInArrow(_count_runs, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    run_counts = materialize(run_counts.withColumn("length", F.char_length("word")), "run-counts")
    by_length = {(r["lang"], r["length"]): r["n"] for r in run_counts.groupBy("lang", "length").agg(F.sum("n").alias("n")).collect()}
    kept = _frequent(run_counts, runs, "length").toArrow()
    run_at: dict[str, int] = {}
    parts = []
    for n in range(1, LONGEST + 1):
        at, scores = _scores(kept.filter(pa.compute.equal(kept.column("length"), n)), languages, np.array([by_length.get((x, n), 0) for x in languages], float))
        run_at |= {k: v + sum(map(len, parts)) for k, v in at.items()}
        parts.append(scores)
    return Model(languages, word_at, word_scores.astype(np.float32), run_at, np.concatenate(parts).astype(np.float32))


def _predict(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = known.value
        n_langs = len(model.languages) if model else 1
        names, seen = np.array([*(model.languages if model else []), UNKNOWN], object), {}
        for batch in batches:
            for part in slices(batch, batch.column(1), SLICE_BYTES):
                texts = [words_of(_text(x)) if model else [] for x in part.column(1).cast(pa.binary()).to_pylist()]
                place: dict[str, int] = {}
                which = np.array([place.setdefault(w, len(place)) for text in texts for w in text], np.int64)
                text_of = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
                if len(seen) > HELD:
                    seen = {}
                table, lettered = np.zeros((len(place), n_langs)), np.zeros(len(place), bool)
                for w, i in place.items():
                    if w not in seen:
                        seen[w] = model.score(w)
                    if (s := seen[w]) is not None:
                        table[i], lettered[i] = s, True
                total = np.stack([np.bincount(text_of, table[which, k], len(texts)) for k in range(n_langs)], 1) if len(texts) else np.zeros((0, n_langs))
                has = np.bincount(text_of, lettered[which], len(texts)) > 0
                share = np.exp(total - total.max(1, keepdims=True))
                share /= share.sum(1, keepdims=True)
                best = total.argmax(1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[np.where(has, best, len(names) - 1)], pa.string()), pa.array(np.where(has, share.max(1), 0.0))], ["row", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None, *, row: Column | None = None, text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score) of each row; the score is the language's share of the likelihood."""
    rows = docs.select((F.struct("*") if row is None else row).alias("row"), F.col(text_col).alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(model)  # WORDS + LONGEST * RUNS entries at most
    return rows.mapInArrow(_predict(known), f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")
