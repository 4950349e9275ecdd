"""Quality rules: fixed base rules, then a calibrated logistic regression on hashed word and character n-grams.

Texts are read once, in Arrow batches; each one's features, score and base figures are made together, so the job is a
map over the documents with no shuffle. The regression learns from a bounded sample of labelled rows (``SAMPLE``): three
folds, whose margins for the rows left out calibrate it, and the final weights are fitted side by side, each in a task whose
input that bound limits; the driver sees only weights and the sample's margins.

Edge cases: a null or empty text has no words and fails the base rules; without labels of both kinds the verdict is the
base rules' alone; repeated rows are judged one by one; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLDS, fit_jobs, labelled_sample

#: Labelled documents to learn from, at most.
SAMPLE = 3_000
#: Buckets for each kind of feature: words, word pairs, runs of four characters.
BUCKETS = 1 << 14
#: A document stays with a probability of good quality of at least this.
THRESHOLD = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_IS_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in runs of three that the text has twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    v = len(ids)
    pairs = w[:-1] * v + w[1:]
    if v >= 1 << 21:  # else three ids fit into one number
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, at, n = np.unique(pairs[:-1] * v + w[2:], return_inverse=True, return_counts=True)
    often = n[at] > 1
    hit = np.zeros(len(words), bool)
    for i in range(3):
        hit[i:len(often) + i] |= often
    return int(hit.sum())


def base_figures(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    b = np.frombuffer(text, np.uint8)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), int(_STARTS_CHAR[b].sum() - _IS_WHITE[b].sum()), int(_IS_SYMBOL[b].sum()), len(lines) - len(set(lines)), repeated_words(words)


def features(text: bytes, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and their values: logarithms of counts, scaled to length one."""
    w = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    b = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    runs = (b[:-3] + b[1:-2] * np.uint32(257) + b[2:-1] * np.uint32(66_049) + b[3:] * np.uint32(16_974_593)) * np.uint32(2_654_435_761) if len(b) > 3 else b[:0]
    pairs = (w[:-1] * np.uint32(31) + w[1:]) * np.uint32(2_654_435_761)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    at = np.concatenate([(w * np.uint32(2_654_435_761)) >> shift, (pairs >> shift) + np.uint32(BUCKETS), (runs >> shift) + np.uint32(2 * BUCKETS)])
    n = np.bincount(at, minlength=3 * BUCKETS)
    used = n.nonzero()[0]
    v = np.log1p(n[used])
    return used.astype(np.int32), (v / max(np.sqrt(v @ v), 1e-9)).astype(np.float32)


@dataclass
class Model:
    """Weights by bucket, and the line that calibrates a margin to log odds."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, used: np.ndarray, values: np.ndarray) -> float:
        margin = self.weights[used] @ values + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_margin(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, *, steps: int = 120, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression over sparse rows by accelerated gradient steps; the classes weigh the same."""
    used, values = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    w, b = np.zeros(3 * BUCKETS), 0.0
    look_w, look_b, rate = w, b, 4.0
    for step in range(steps):
        margin = np.bincount(row, look_w[used] * values, len(rows)) + look_b
        pull = (_sigmoid(margin) - y) * weight
        new_w = look_w - rate * (np.bincount(used, pull[row] * values, len(w)) + ridge * look_w)
        new_b = look_b - rate * pull.sum()
        keep = step / (step + 3)
        look_w, look_b = new_w + keep * (new_w - w), new_b + keep * (new_b - b)
        w, b = new_w, new_b
    return w, float(b)


def calibrate(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of Platt scaling, with its smoothed targets, by Newton steps."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, beta = np.stack([margin, np.ones_like(margin)]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = _sigmoid(beta @ x)
        beta = beta - np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2), x @ (p - target) + 1e-3 * (beta - [1.0, 0.0]))
    return float(beta[0]), float(beta[1])


def _fit(job: int, pdf: pd.DataFrame) -> pd.DataFrame:
    """Job ``FOLDS``: the weights from all rows. Another: the margins of the rows of that fold, from the others' weights."""
    rows = [(np.frombuffer(u, np.int32), np.frombuffer(v, np.float32)) for u, v in zip(pdf["used"], pdf["v"], strict=True)]
    y, fold = pdf["label"].to_numpy(float), np.arange(len(pdf)) % FOLDS
    train, test = np.flatnonzero(fold != job), np.flatnonzero(fold == job)
    weights, bias, margin = np.zeros(3 * BUCKETS), 0.0, np.zeros(len(test))
    if len(set(y[train])) == 2:
        weights, bias = fit_margin([rows[i] for i in train], y[train])
        margin = np.array([weights[rows[i][0]] @ rows[i][1] + bias for i in test])
    final = job == FOLDS
    return pd.DataFrame({"job": [job], "weights": [weights.astype(np.float32).tobytes() if final else None], "bias": [bias], "kinds": [len(set(y))], "margin": [margin.tobytes()], "y": [y[test].tobytes()]})


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            text = text or b""
            out.append(features(text, text.split()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([u.tobytes() for u, _ in out], pa.binary()), pa.array([v.tobytes() for _, v in out], pa.binary())], ["place", "label", "used", "v"])


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, **columns) -> Model | None:
    """The model, or None if the sample lacks one of the labels."""
    chosen = labelled_sample(docs, labels, sample, **columns).select("place", "text", "label")
    rows = chosen.mapInArrow(_sample_features, "place long, label int, used binary, v binary")
    got = fit_jobs(rows, _fit, "job int, weights binary, bias double, kinds int, margin binary, y binary")
    if not got or got[FOLDS]["kinds"] < 2:
        return None
    folds = [got[k] for k in range(FOLDS)]
    line = calibrate(np.concatenate([np.frombuffer(r["margin"]) for r in folds]), np.concatenate([np.frombuffer(r["y"]) for r in folds]))
    return Model(np.frombuffer(got[FOLDS]["weights"], np.float32), got[FOLDS]["bias"], *line)


SCORES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"


def _score(model: Model | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                text = text or b""
                words = text.split()
                base = base_figures(text, words)
                failed = base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEAT_PERCENT * base[0]
                p = model.probability(*features(text, words)) if model else None
                rows.append((*base, failed, p, not failed and (p is None or p >= threshold)))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["row", *(x.split()[0] for x in SCORES.split(", "))])

    return run


def score(docs: DataFrame, model: Model | None, *, threshold: float = THRESHOLD, row=None, text_col: str = "text") -> DataFrame:
    """(row, base figures, base_failed, probability, kept) for each row of ``docs``; ``row`` is what to carry along, all columns by default."""
    rows = docs.select((F.struct("*") if row is None else row).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(model, threshold), f"row {rows.schema['row'].dataType.simpleString()}, {SCORES}")


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, sample: int = SAMPLE, text_col: str = "text") -> DataFrame:
    """``docs`` without what the rules reject; columns as before."""
    return score(docs, train(docs, labels, sample=sample, text_col=text_col), threshold=threshold, text_col=text_col).where("kept").select("row.*")
