"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad. A line's features are its own shape (character classes, word statistics, repeats) and
those of its two neighbours; the chain adds transitions. Scoring runs the exact forward-backward recursions over all lines
of a text and takes the mean of the marginals, weighted by line length; a Platt line fitted on the training documents turns
that mean into the score. Scoring is a map over documents in Arrow batches, without any shuffle.

The chain learns from a bounded sample of labelled documents (``SAMPLE``, and ``LINES`` of each). Only documents have labels,
so those of lines are latent. A classifier of single lines first learns how likely a line by itself is to stand in a good
document; its log odds, moved a little towards the document's label, are evidence about each line. The chain's likelihood is
maximised over all label sequences under that evidence (forward-backward with and without it), so a bad document may have
good lines, and the transitions see changes of state. Three folds, which calibrate the score on documents left out, and the
final chain are fitted side by side, each in a task whose input the bounds limit.

Edge cases: a null or empty text is one empty line and has a score; a text of empty lines weighs them alike; without labels
of both kinds every score is the share of label 1 (0.5 without labels); repeated rows are scored one by one; other columns
are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLDS, fit_jobs, labelled_sample

#: Labelled documents to learn from, at most.
SAMPLE = 1_500
#: Lines of a chain in training, and of a document there at most (chains evenly spread over it); scoring takes all lines in one.
CHAIN, LINES = 32, 512
#: Log odds by which a document's label moves the evidence about each of its lines.
DOCUMENT = 0.5

_B = np.arange(256)
_CLASSES = [np.isin(_B, list(chars)) for chars in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>", b"|", b"!?", b".,;:", b"(){}[]=_/\\@")] + [_B >= 128]
_WHITE = np.isin(_B, [9, 10, 11, 12, 13, 32])
#: Features of a line by itself.
OWN = len(_CLASSES) + 9
WIDTH = 3 * OWN + 1


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each line (own, previous line's, next line's, 1), and the lines' lengths."""
    b = np.frombuffer(text + b"\n", np.uint8)
    ends = np.flatnonzero(b == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    length = ends - starts

    def per_line(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask)])
        return upto[ends] - upto[starts]

    size = np.maximum(length, 1)
    white = _WHITE[b]
    n_words = per_line(~white & np.concatenate([[True], white[:-1]]))
    solid = length - per_line(white)
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    again = np.zeros(len(lines))
    distinct = np.empty(len(lines))
    for i, line in enumerate(lines):
        words = line.split()
        distinct[i] = len(set(words)) / len(words) if words else 1
        if words:
            again[i] = line in seen
            seen.add(line)
    last = b[np.maximum(ends - 1, 0)]
    own = np.empty((len(lines), OWN), np.float32)
    for i, c in enumerate(_CLASSES):
        own[:, i] = per_line(c[b]) / size
    k = len(_CLASSES)
    own[:, k] = np.log1p(length) / 6
    own[:, k + 1] = n_words / size * 4
    own[:, k + 2] = np.minimum(solid / np.maximum(n_words, 1), 20) / 10
    own[:, k + 3] = distinct
    own[:, k + 4] = again
    own[:, k + 5] = (length > 0) & np.isin(last, list(b".!?"))
    own[:, k + 6] = n_words < 4
    own[:, k + 7] = length == 0
    own[:, k + 8] = np.log1p(n_words) / 5
    none = np.zeros((1, OWN), np.float32)
    return np.concatenate([own, np.concatenate([none, own[:-1]]), np.concatenate([own[1:], none]), np.ones((len(lines), 1), np.float32)], axis=1), length


@dataclass
class Chain:
    """Emission weights of "good" over "bad", log transition weights [from, to], and the line that turns a mean marginal into a score."""

    emission: np.ndarray
    transition: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """The probability that each line is good. Messages are odds, so one number each is enough."""
        e = np.exp(np.clip(x @ self.emission, -25, 25)).tolist()
        (bb, bg), (gb, gg) = np.exp(self.transition).tolist()
        ahead, odds = [], 1.0
        for i, v in enumerate(e):
            odds = v if i == 0 else v * (bg + odds * gg) / (bb + odds * gb)
            ahead.append(odds)
        back, out = 1.0, [0.0] * len(e)
        for i in range(len(e) - 1, -1, -1):
            joint = ahead[i] * back
            out[i] = joint / (1 + joint)
            ev = e[i] * back
            back = (gb + ev * gg) / (bb + ev * bg)
        return np.array(out)

    def mean_good(self, text: bytes) -> float:
        x, length = line_features(text)
        return _mean(self.marginals(x), length)

    def score(self, text: bytes) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * _logit(self.mean_good(text)) + self.offset))))


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def _expectations(bad: np.ndarray, good: np.ndarray, tr: np.ndarray, mask: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The marginals of "good" (chains, lines), and weighted sums of the pair marginals, by forward-backward."""
    n, t = mask.shape
    ahead = np.zeros((t, n, 2))
    ahead[0] = np.stack([bad[:, 0], good[:, 0]], 1)
    for i in range(1, t):
        before = ahead[i - 1]
        new = np.stack([np.logaddexp(before[:, 0] + tr[0, s], before[:, 1] + tr[1, s]) for s in (0, 1)], 1)
        new[:, 0] += bad[:, i]
        new[:, 1] += good[:, i]
        ahead[i] = np.where(mask[:, i, None], new, before)
    total = np.logaddexp(ahead[-1, :, 0], ahead[-1, :, 1])
    back, marginal, pair = np.zeros((n, 2)), np.zeros((n, t)), np.zeros((2, 2))
    for i in range(t - 1, -1, -1):
        marginal[:, i] = np.exp(np.minimum(ahead[i, :, 1] + back[:, 1] - total, 0)) * mask[:, i]
        if i:
            here = np.stack([back[:, 0] + bad[:, i], back[:, 1] + good[:, i]], 1)
            on = mask[:, i]
            joint = np.exp(np.minimum(ahead[i - 1, :, :, None] + tr + here[:, None, :] - total[:, None, None], 0))
            pair += np.einsum("n,nab->ab", weight * on, joint)
            back = np.where(on[:, None], np.logaddexp(tr[None, :, 0] + here[:, 0, None], tr[None, :, 1] + here[:, 1, None]), back)
    return marginal, pair


def line_odds(own: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 12, ridge: float = 1e-3) -> np.ndarray:
    """Log odds that single lines (own features, their documents' labels and weights) stand in a good document: logistic
    regression by Newton steps."""
    x = np.concatenate([own, np.ones((len(own), 1))], axis=1).astype(float)
    beta, weight = np.zeros(x.shape[1]), weight / weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -15, 15)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        beta = beta - np.clip(np.linalg.solve(hessian, x.T @ (weight * (p - y)) + ridge * beta), -3, 3)
    return np.clip(x @ beta, -6, 6)


def fit_chain(x: np.ndarray, mask: np.ndarray, evidence: np.ndarray, weight: np.ndarray, *, steps: int = 50, rate: float = 0.2, ridge: float = 3e-3) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the likelihood of ``evidence``, log odds for each line to be good; x is (chains, lines, features), padded."""
    params = np.zeros(WIDTH + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    mask = mask > 0
    weight = weight / mask.sum(1)
    weight = weight / (weight @ mask.sum(1))
    zero = np.zeros(mask.shape)
    for step in range(1, steps + 1):
        e, tr = x @ params[:WIDTH], params[WIDTH:].reshape(2, 2)
        free, free_pair = _expectations(zero, e, tr, mask, weight)
        told, told_pair = _expectations(zero, e + evidence, tr, mask, weight)
        push = (told - free) * weight[:, None]
        grad = np.concatenate([np.tensordot(push, x, ([0, 1], [0, 1])), (told_pair - free_pair).ravel()]) - ridge * params
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[:WIDTH], params[WIDTH:].reshape(2, 2)


def _platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> tuple[float, float]:
    x, beta = np.stack([margin, np.ones_like(margin)]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -30, 30)))
        hessian = (x * (weight * p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(hessian, x @ (weight * (p - y)) + 1e-3 * (beta - [1.0, 0.0])), -2, 2)
    return float(beta[0]), float(beta[1])


def _mean(marginals: np.ndarray, length: np.ndarray) -> float:
    weight = length if length.any() else np.ones(len(length))
    return float(marginals @ weight / weight.sum())


def _parts(x: np.ndarray) -> list[np.ndarray]:
    """The chains that a document trains: all of it, or ``LINES`` lines evenly spread."""
    starts = list(range(0, len(x), CHAIN))
    if len(x) > LINES:
        starts = [starts[i * len(starts) // (LINES // CHAIN)] for i in range(LINES // CHAIN)]
    return [x[i:i + CHAIN] for i in starts]


def fit(docs: list[np.ndarray], y: np.ndarray) -> Chain:
    """A chain model from the lines' features of each document and the documents' labels; not calibrated."""
    chains, labels, weights = [], [], []
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for x, label, w in zip(docs, y, balance, strict=True):
        parts = _parts(x)
        chains += parts
        labels += [label] * len(parts)
        weights += [w / len(parts)] * len(parts)
    t = max(map(len, chains))
    padded, mask, evidence = np.zeros((len(chains), t, WIDTH), np.float32), np.zeros((len(chains), t)), np.zeros((len(chains), t))
    size = np.array(list(map(len, chains)))
    labels, weights = np.array(labels), np.array(weights)
    odds = line_odds(np.concatenate([c[:, :OWN] for c in chains]), np.repeat(labels, size), np.repeat(weights / size, size))
    for i, (c, own) in enumerate(zip(chains, np.split(odds, np.cumsum(size)[:-1]), strict=True)):
        padded[i, :len(c)], mask[i, :len(c)], evidence[i, :len(c)] = c, 1, own + DOCUMENT * (2 * labels[i] - 1)
    return Chain(*fit_chain(padded, mask, evidence, weights))


def _fit(job: int, pdf: pd.DataFrame) -> pd.DataFrame:
    """Job ``FOLDS``: the chain from all documents. Another: log odds of the mean marginals of that fold's, from the others' chain."""
    y, fold = pdf["label"].to_numpy(float), np.arange(len(pdf)) % FOLDS
    train, test = np.flatnonzero(fold != job), np.flatnonzero(fold == job)
    out = {"job": job, "emission": None, "transition": None, "good": y.mean(), "kinds": len(set(y)), "margin": np.zeros(len(test)).tobytes(), "y": y[test].tobytes()}
    if len(set(y[train])) == 2:
        docs = [np.frombuffer(x, np.float16).reshape(-1, WIDTH).astype(np.float32) for x in pdf["x"]]
        model = fit([docs[i] for i in train], y[train])
        lengths = [np.frombuffer(n, np.int32) for n in pdf["n"]]
        out["margin"] = np.array([_logit(_mean(model.marginals(docs[i]), lengths[i])) for i in test]).tobytes()
        if job == FOLDS:
            out |= {"emission": model.emission.tobytes(), "transition": model.transition.tobytes()}
    return pd.DataFrame([out])


def _training_lines(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features and lengths of the lines that a document trains with; the length of a chain's lines stays with them."""
    x, length = line_features(text)
    return np.concatenate(_parts(x)), np.concatenate(_parts(length))


def _sample_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_training_lines(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x.astype(np.float16).tobytes() for x, _ in rows], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in rows], pa.binary())], ["place", "label", "x", "n"])


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, **columns) -> Chain:
    """The chain model; one that scores every text alike if the sample lacks one of the labels."""
    chosen = labelled_sample(docs, labels, sample, **columns).select("place", "text", "label")
    rows = chosen.mapInArrow(_sample_lines, "place long, label int, x binary, n binary")
    got = fit_jobs(rows, _fit, "job int, emission binary, transition binary, good double, kinds int, margin binary, y binary")
    if not got or got[FOLDS]["kinds"] < 2:
        return Chain(np.zeros(WIDTH), np.zeros((2, 2)), 0.0, _logit(got[FOLDS]["good"]) if got else 0.0)
    margin, y = (np.concatenate([np.frombuffer(got[k][c]) for k in range(FOLDS)]) for c in ("margin", "y"))
    return Chain(np.frombuffer(got[FOLDS]["emission"]), np.frombuffer(got[FOLDS]["transition"]).reshape(2, 2), *_platt(margin, y, np.ones(len(y))))


def _score(model: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Chain, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): from 0 to 1, higher for texts likelier to be labelled good."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_score(model), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, score double")
