"""Quality classifier: naive Bayes support vectors.

Binary n-gram indicators are scaled by the log-count ratio of the two classes; a linear hinge-loss
model is then fitted by dual coordinate descent, and its margin is turned into a probability on a
part of the sample that the fit has not seen.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, map_texts, tune

BITS = 18
MASK = (1 << BITS) - 1
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: About so many labelled documents are drawn for the fit, whatever the size of the corpus.
SAMPLE = 6000


def shape(token: str) -> int:
    """Class of a token as a byte: words by case and length, numbers, punctuation by its first sign."""
    size = min(len(token), 15) >> 2
    if token.islower():
        return size
    first = token[0]
    if first.isalpha() or first == "_":
        return (8 if token.isupper() and len(token) > 1 else 4) + size
    if first.isdigit():
        return 12
    return 128 + ((ord(first) & 63) << 1) + (len(token) > 1)


def hashed(gram: str) -> int:
    return crc32(gram.encode("utf-8", "replace")) & MASK


def features(text: str) -> np.ndarray:
    """Sorted distinct hashed n-grams of a text: its words, and triples of token shapes."""
    tokens = TOKEN.findall(text)
    if not tokens:
        return np.array([hashed("empty")], np.int32)
    words = set(tokens)
    kinds = {t: shape(t) for t in words}
    shapes = np.frombuffer(bytes(map(kinds.__getitem__, tokens)), np.uint8)
    found = {crc32(t) & MASK for t in "\n".join(words).lower().encode("utf-8", "replace").split(b"\n")}
    x = shapes.astype(np.uint32)
    triples = np.unique((x[:-2] << 16) | (x[1:-1] << 8) | x[2:])
    mixed = ((triples * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)
    return np.unique(np.concatenate([np.fromiter(found, np.int32, len(found)), mixed]))


@dataclass
class Model:
    """Weights over hashed n-grams (already scaled by the ratios), bias, and the two numbers that
    turn a margin into a probability."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, text: str | None) -> float:
        x = features(text or "")
        z = self.slope * self.margin(x) + self.offset
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))

    def margin(self, x: np.ndarray) -> float:
        return float(self.weights[x].sum() / math.sqrt(len(x)) + self.bias)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p = np.full(1 << BITS, smooth)
    q = np.full(1 << BITS, smooth)
    for x, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows, values, y, cost: np.ndarray, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Hinge-loss linear model: one dual variable a row, kept in [0, cost], moved to its best value
    in turn while the primal weights follow. The bias is one more weight with the constant input 1."""
    w, bias = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x, v = rows[i], values[i]
            gradient = y[i] * (float(w[x] @ v) + bias) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[x] += step * v
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the margins, by damped Newton steps."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        d, h = p - target, p * (1 - p) + 1e-9
        grad = np.array([(d * margins).sum() + 1e-3 * a, d.sum()])
        hess = np.array([[(h * margins**2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return max(float(a), 1e-3), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0) -> Model:
    """Model of hashed n-gram rows and 0/1 labels. With one class only, every score is that class's
    smoothed share; with no rows it is 0.5."""
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    pos, neg = int((y > 0).sum()), int((y < 0).sum())
    if min(pos, neg) < 2:
        share = (pos + 1) / (pos + neg + 2)
        return Model(np.zeros(1 << BITS), 0.0, 1.0, math.log(share / (1 - share)))
    part = np.zeros(len(y), bool)  # every fifth row of each class is left for the curve
    for c in (1.0, -1.0):
        part[np.flatnonzero(y == c)[1::5]] = True
    own = np.flatnonzero(~part)
    ratio = log_count_ratios([rows[i] for i in own], y[own])
    values = [ratio[rows[i]] / math.sqrt(len(rows[i])) for i in own]
    weight = np.where(y[own] > 0, len(own) / (2 * (y[own] > 0).sum()), len(own) / (2 * (y[own] < 0).sum()))
    w, bias = dual_coordinate_descent([rows[i] for i in own], values, y[own], cost * weight)
    model = Model(w * ratio, bias, 1.0, 0.0)
    test = np.flatnonzero(part)
    model.slope, model.offset = platt(np.array([model.margin(rows[i]) for i in test]), y[test])
    return model


def train_quality(docs: DataFrame, labels: DataFrame, train: Column | None = None, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` labelled documents; only their hashed n-grams reach the driver."""
    tune(docs.sparkSession)
    picked = labelled_sample(docs, labels, label, sample, train)
    got = map_texts(picked, ["doc_id", "y"], "text", lambda: lambda ts: [[features(t or "") for t in ts]], "x array<int>")
    rows = sorted(got.collect(), key=lambda r: r["doc_id"])
    return fit([np.array(r["x"], np.int32) for r in rows], np.array([r["y"] for r in rows]))


def score_quality(docs: DataFrame, model: Model, keep: list[str], threshold: float = 0.3) -> DataFrame:
    """Add score (0 to 1) and predicted to each document in one narrow pass.

    Null and empty texts get the score of a text without tokens. Equal texts get equal scores; a kept
    column named score or predicted is replaced; an empty table gives an empty table.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = shared.value.score

        def run(texts: list) -> list:
            scores = [score(t) for t in texts]
            return [scores, [int(s >= threshold) for s in scores]]

        return run

    return map_texts(docs, keep, "text", make, "score double, predicted int")


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; rows with crc32 mod 5 = 0 teach nothing.
    A null doc_id counts as the empty text, rows that repeat are each returned, and without labels every
    score is 0.5. An empty table gives an empty table; other columns are not read."""
    model = train_quality(docs, labels, fold(F.col("doc_id"), 5) != 0)
    flagged = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return score_quality(flagged, model, ["doc_id", "held_out"])
