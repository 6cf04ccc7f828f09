"""Toxicity by the nearest labelled examples.

Documents and examples are TF-IDF vectors over all their terms. The nearest examples by exact cosine
are found in an inverted index whose postings are cut into blocks with their greatest weights, so that
blocks which cannot reach the nearest are never opened. The neighbours vote by nearness; a monotone
curve fitted on the examples, each left out in turn, makes the vote a probability. The neighbours are
the evidence.

The cosine of plain TF-IDF finds texts of like subject rather than of like tone, so a term's weight is
its TF-IDF times how unevenly the examples' classes use it. No term is left out: one that both classes
use alike, or that no example has, keeps the share EVEN.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fold, fresh, labelled_sample, map_texts, tune

TERM = re.compile(r"[^\W_]+")
#: About so many labelled documents are examples, half of them of each class where there are enough.
EXAMPLES = 6000
NEIGHBOURS, BLOCK = 15, 64
#: Terms of at least this share of the examples keep their postings as rows of whole blocks.
DENSE = 0.05
#: Blocks opened in the first round; each further round opens GROWTH times as many, until no bound reaches.
FIRST, GROWTH = 8, 4
#: Documents whose blocks are opened together.
TOGETHER = 64
#: Results that a task remembers, so that copies are searched once.
KNOWN = 1 << 13
#: Class weight of a term that tells nothing, and documents by which a term's class counts are smoothed.
EVEN, SMOOTH = 0.05, 20.0
#: Weights are whole multiples of 1 / GRAIN. Then each product of two is a multiple of 2^-50, each sum of them is below
#: 2 and so without rounding, and a cosine is the same number in whatever order it is summed: equal examples tie,
#: however many documents are searched together. Rounding a weight changes it by at most 2^-26.
GRAIN = 1 << 25


def vocabulary(sample: DataFrame) -> list[str]:
    """All terms of the sample's whole texts, in order."""
    spread = map_texts(sample, ["y"], "text", lambda: lambda ts: [[sorted(set(TERM.findall((t or "").lower()))) for t in ts]], "terms array<string>")
    return sorted(spread.select(F.explode("terms").alias("term")).distinct().toArrow().column(0).to_pylist())


def packed(terms: list[int], counts: list[int]) -> bytes:
    """Sorted term numbers, as steps, and their counts, in a few bytes each."""
    steps = np.diff(np.array(terms, np.int64), prepend=0)
    return zlib.compress(np.concatenate([steps, counts]).astype("<u4").tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


def term_counts(docs: DataFrame, keep: list[str], terms: list[str]) -> DataFrame:
    """Add x (numbers of the whole text's terms and their counts, packed) and rest (the sum of
    (1 + log n) squared over the text's terms that have no number) in one narrow pass."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def make():
        number = shared.value.get
        square = [0.0] + [(1 + math.log(n)) ** 2 for n in range(1, 64)]

        def run(texts: list) -> list:
            found, rests = [], []
            for text in texts:
                rows, rest = [], 0.0
                for word, n in Counter(TERM.findall((text or "").lower())).items():
                    i = number(word)
                    if i is None:
                        rest += square[n] if n < 64 else (1 + math.log(n)) ** 2
                    else:
                        rows.append((i, n))
                rows.sort()
                found.append(packed([i for i, _ in rows], [n for _, n in rows]))
                rests.append(rest)
            return [found, rests]

        return run

    return map_texts(docs, keep, "text", make, "x binary, rest double")


def inverse_frequencies(counted: DataFrame, size: int) -> tuple[np.ndarray, float]:
    """Inverse document frequency of each term over all rows of ``counted``, and that of a term which
    one document has. Each task adds up its rows; Spark adds up the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(size, np.int64), 0
        for b in batches:
            for data in b.column(0).to_pylist():
                seen[unpacked(data)[0]] += 1
            rows += b.num_rows
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(seen[used], rows))], names=["t", "n"])

    sums = counted.select("x").mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    t, n = (sums.column(i).to_numpy() for i in (0, 1))
    df, total = np.zeros(size), int(n[t < 0].sum())
    df[t[t >= 0]] = n[t >= 0]
    return np.log((1 + total) / (1 + df)) + 1, math.log((1 + total) / 2) + 1


def class_weights(y: np.ndarray, rows: list[tuple[list[int], list[int]]], size: int) -> np.ndarray:
    """EVEN plus the square of each term's smoothed log ratio of use in the two classes."""
    counts = np.zeros((2, size))
    for label, (t, _) in zip(y, rows, strict=True):
        counts[int(label > 0), t] += 1
    sizes = np.array([(y <= 0).sum(), (y > 0).sum()], np.float64)
    if not sizes.all():
        return np.full(size, 1.0)
    prior = SMOOTH * sizes / sizes.sum()
    share = (counts + prior[:, None]) / (sizes + prior)[:, None]
    return EVEN + np.log(share[1] / share[0]) ** 2


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all spans, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


@dataclass
class Index:
    """Examples as unit vectors in an inverted index. The postings of a rare term are its examples in
    order. A common term has a weight for every example of every block of BLOCK, zeros included, and its
    greatest weight of each block."""

    ids: list
    y: np.ndarray
    rate: np.ndarray
    scale: np.ndarray
    unseen: float = 0.0
    curve: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.full(1, 0.5))
    blank: float = 0.5
    opened: int = 0
    blocks: int = 0
    tie: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    parts: dict[str, np.ndarray] = field(default_factory=dict)

    def vector(self, t: list[int], n: list[int], rest: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a unit vector; ``rest`` lengthens it by the terms without a number."""
        terms = np.array(t, np.int64)
        w = (1 + np.log(np.array(n, np.float64))) * self.scale[terms]
        size = math.sqrt(math.fsum((w * w).tolist()) + rest * self.unseen**2) or 1.0
        return terms, np.rint(w / size * GRAIN) / GRAIN

    def build(self, rows: list[tuple[list[int], list[int]]]) -> None:
        self.blocks = -(-len(rows) // BLOCK)
        self.tie = np.arange(self.blocks * BLOCK + 1)
        self.tie[sorted(range(len(rows)), key=lambda e: self.ids[e])] = np.arange(len(rows))
        vectors = [self.vector(t, n) for t, n in rows]
        example = np.repeat(np.arange(len(rows), dtype=np.int32), [len(t) for t, _ in vectors])
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        del vectors
        order = np.argsort(term, kind="stable")  # examples stay in order within a term
        example, term, weight = example[order], term[order], weight[order]
        df = np.bincount(term, minlength=len(self.scale))
        common = np.flatnonzero(df >= max(BLOCK, DENSE * len(rows)))
        row_of = np.full(len(self.scale), -1)
        row_of[common] = np.arange(len(common))
        dense = np.zeros((self.blocks, len(common), BLOCK))
        at = row_of[term] >= 0
        dense[example[at] // BLOCK, row_of[term[at]], example[at] % BLOCK] = weight[at]
        example, term, weight = example[~at], term[~at], weight[~at]
        self.parts = {
            "row": row_of, "dense": dense, "most": dense.max(axis=2).T, "example": example, "weight": weight,
            "start": np.searchsorted(term, np.arange(len(self.scale) + 1)),
        }

    def nearest(self, t, n, k: int = NEIGHBOURS, without: int = -1, rest: float = 0.0) -> list[tuple[float, int]]:
        """The k examples of greatest positive cosine, ties by their ids; exact."""
        return self.nearest_of([(t, n, rest)], k, [without])[0]

    def nearest_of(self, rows: list[tuple], k: int = NEIGHBOURS, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """``nearest`` of several vectors (t, n, rest). What rare terms add is summed first. With the greatest
        weights of the common terms it bounds each block; each vector opens blocks in order of their bounds,
        and only while a bound reaches its k-th cosine of the round before. Those that open a block share
        the work."""
        p, docs, width = self.parts, len(rows), self.blocks * BLOCK
        vectors = [self.vector(*r) for r in rows]
        doc = np.repeat(np.arange(docs), [len(t) for t, _ in vectors])
        term, q = (np.concatenate([v[i] for v in vectors]) if docs else np.zeros(0, np.int64) for i in (0, 1))
        row = p["row"][term]
        often = row >= 0
        common = np.zeros((docs, p["dense"].shape[1]))
        common[doc[often], row[often]] = q[often]
        doc, term, q = doc[~often], term[~often], q[~often]
        lo = p["start"][term]
        sizes = p["start"][term + 1] - lo
        postings = spans(lo, sizes)
        rare = np.bincount(np.repeat(doc * width, sizes) + p["example"][postings], np.repeat(q, sizes) * p["weight"][postings], docs * width)
        rare = rare.reshape(docs, self.blocks, BLOCK)
        bounds = common @ p["most"] + rare.max(axis=2)
        order = np.argsort(-bounds, axis=1, kind="stable")
        falling = np.take_along_axis(bounds, order, 1)
        best, who = np.full((docs, k), -1.0), np.full((docs, k), width, np.int64)
        each = np.arange(docs)[:, None]
        at, step = 0, FIRST
        while at < self.blocks:
            now = order[:, at : at + step]
            ahead = falling[:, at : at + step]
            wanted = (ahead > 0) & (ahead * (1 + 1e-9) >= best[:, -1:])
            if not wanted.any():
                break  # bounds fall: no later block reaches either
            self.opened += int(wanted.sum())
            slot = np.full((docs, self.blocks), -1)
            slot[each, now] = np.where(wanted, np.arange(now.shape[1]), -1)
            score = np.full((docs, now.shape[1], BLOCK), -1.0)
            for b in np.flatnonzero((slot >= 0).any(axis=0)):
                mine = np.flatnonzero(slot[:, b] >= 0)
                score[mine, slot[mine, b]] = rare[mine, b] + common[mine] @ p["dense"][b]
            ids = (now[:, :, None] * BLOCK + np.arange(BLOCK)).reshape(docs, -1)
            flat = np.where(score > 0, score, -1.0).reshape(docs, -1)
            if without is not None:
                flat[ids == np.array(without)[:, None]] = -1.0
            best, who = self._first(np.concatenate([best, flat], axis=1), np.concatenate([who, ids], axis=1), k)
            at, step = at + step, GROWTH * step
        return [[(s, e) for s, e in zip(a, b, strict=True) if s > 0] for a, b in zip(best.tolist(), who.tolist(), strict=True)]

    def _first(self, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k greatest scores of each row and their examples, ties by the examples' ids, in order."""
        top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        least = np.take_along_axis(scores, top, 1).min(axis=1)
        for i in np.flatnonzero(((scores >= least[:, None]).sum(axis=1) > k) & (least > 0)):  # ties of the last place
            hit = np.flatnonzero(scores[i] >= least[i])
            top[i] = hit[np.lexsort((self.tie[ids[i, hit]], -scores[i, hit]))[:k]]
        s, w = np.take_along_axis(scores, top, 1), np.take_along_axis(ids, top, 1)
        order = np.lexsort((self.tie[w], -s), axis=1)
        return np.take_along_axis(s, order, 1), np.take_along_axis(w, order, 1)

    def vote(self, found: list[tuple[float, int]]) -> float:
        """Share of the toxic neighbours, weighted by nearness and by how thinly a class was drawn."""
        w = np.array([s / (1.05 - min(s, 1.0)) for s, _ in found]) / self.rate[[e for _, e in found]]
        return float((w * self.y[[e for _, e in found]]).sum() / w.sum())

    def scores(self, rows: list[tuple]) -> list[tuple[float, list]]:
        """(score, ids of the three nearest) of each (t, n, rest)."""
        out = []
        for i in range(0, len(rows), TOGETHER):
            for found in self.nearest_of(rows[i : i + TOGETHER]):
                out.append((float(np.interp(self.vote(found), *self.curve)), [self.ids[e] for _, e in found[:3]]) if found else (self.blank, []))
        return out


def rising(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted least-squares rising curve through the points: neighbours that fall are pooled."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for i in order:
        pools.append([x[i] * w[i], y[i] * w[i], w[i]])
        while len(pools) > 1 and (pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2] or pools[-2][0] / pools[-2][2] >= pools[-1][0] / pools[-1][2] - 1e-12):
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def make_index(ids: list, y: list[int], rate: list[float], rows: list[tuple[list[int], list[int]]], scale: np.ndarray, unseen: float = 0.0) -> Index:
    index = Index(ids, np.array(y, np.float64), np.array(rate, np.float64), scale, unseen)
    index.build(rows)
    weight = 1 / index.rate if len(ids) else np.zeros(0)
    votes, at = [], []
    for i in range(0, len(rows), TOGETHER):
        own = list(range(i, min(i + TOGETHER, len(rows))))
        for e, found in zip(own, index.nearest_of([(*rows[e], 0.0) for e in own], without=own), strict=True):
            if found:
                votes.append(index.vote(found))
                at.append(e)
    rest = np.setdiff1d(np.arange(len(ids)), at)
    index.blank = float(((weight * index.y)[rest].sum() + 0.1) / (weight[rest].sum() + 1)) if len(ids) else 0.5
    if at:
        xs, ys = rising(np.array(votes), index.y[at], weight[at])
        index.curve = (xs, (ys * 0.98 + 0.01))
    return index


def train_toxicity(docs: DataFrame, labels: DataFrame, train: Column | None = None, label: str = "toxic", examples: int = EXAMPLES) -> tuple[DataFrame, list[str]]:
    """(sample of labelled documents, all their terms)."""
    sample = checkpointed(labelled_sample(docs, labels, label, examples, train, balanced=True))
    return sample, vocabulary(sample)


def fit_index(counted: DataFrame, sample: DataFrame, terms: list[str]) -> Index:
    """The index of the sample, with document frequencies over all rows of ``counted``. Examples stand
    in order of their most frequent term and of the term that tells most, so that like ones share blocks."""
    own = sorted(term_counts(sample, ["doc_id", "y", "rate"], terms).collect(), key=lambda r: (bytes(r["x"]), str(r["doc_id"])))
    idf, once = inverse_frequencies(counted, len(terms))
    rows, y = [unpacked(r["x"]) for r in own], np.array([r["y"] for r in own])
    scale = idf * class_weights(y, rows, len(terms))
    place = [(int(t[np.argmax(n)]), int(label), int(t[np.argmax(scale[t])])) if len(t) else (-1, int(label), -1) for (t, n), label in zip(rows, y, strict=True)]
    order = sorted(range(len(own)), key=place.__getitem__)
    own, rows = [own[i] for i in order], [rows[i] for i in order]
    return make_index([r["doc_id"] for r in own], [r["y"] for r in own], [r["rate"] for r in own], rows, scale, once * EVEN)


def score_toxicity(docs: DataFrame, sample: DataFrame, terms: list[str], keep: list[str], threshold: float = 0.7) -> DataFrame:
    """Add score, predicted and evidence (ids of the three nearest examples) to each document.

    Texts are read once: the counts of the terms are written, give the document frequencies over all
    documents, and are scored. Null and empty texts, and texts without any term of an example, get the
    share of toxic examples among those without terms. Equal texts get equal scores; a kept column named
    like an added one is replaced; an empty table gives an empty table.
    """
    counted = checkpointed(term_counts(docs.select(F.struct(*keep).alias("row"), "text"), ["row"], terms))
    shared = docs.sparkSession.sparkContext.broadcast(fit_index(counted, sample, terms))

    def make():
        index = shared.value

        known: dict[tuple, tuple] = {}  # results of vectors seen in this task

        def run(rows: list) -> list:
            keys = [(bytes(r["x"]), r["rest"]) for r in rows]
            if len(known) > KNOWN:
                known.clear()
            new = [key for key in dict.fromkeys(keys) if key not in known]
            known.update(zip(new, index.scores([(*unpacked(x), rest) for x, rest in new]), strict=True))
            found = [known[key] for key in keys]
            return [[s for s, _ in found], [int(s >= threshold) for s, _ in found], [e for _, e in found]]

        return run

    x = fresh(docs, "x")
    ready = counted.select("row.*", F.struct("x", "rest").alias(x))
    return map_texts(ready, keep, x, make, f"score double, predicted int, evidence array<{sample.schema['doc_id'].dataType.simpleString()}>")


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every document; rows with crc32 mod 3 = 1 teach
    nothing. A null doc_id counts as the empty text, rows that repeat are each returned, without labels
    every score is 0.5, an empty table gives an empty table; equally near examples count by their ids."""
    sample, terms = train_toxicity(docs, labels, fold(F.col("doc_id"), 3) != 1)
    flagged = docs.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return score_toxicity(flagged, sample, terms, ["doc_id", "held_out"])
