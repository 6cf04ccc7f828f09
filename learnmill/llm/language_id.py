"""Language identification by rank-order profiles.

Each language's most frequent letter n-grams are put in order. A document's own most frequent n-grams
are compared with each profile: the out-of-place distance adds how far each n-gram's rank lies from
its rank in the profile. The nearest profile names the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, map_texts, tune

#: n-grams in a profile and in a document's list.
PROFILE, TOP = 400, 400
#: About so many labelled documents of each language make its profile.
SAMPLE = 1500
MAX_N = 3


def _letters() -> np.ndarray:
    """For each code point up to 0xFFFF: its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(1 << 16, np.uint16)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else i
    return out


class Grams:
    """Letter n-grams as integers of 16 bits a letter; in pairs and triples 1 stands for the edge of a word."""

    def __init__(self):
        self.table = _letters()

    def letters(self, text: str) -> np.ndarray:
        """Lower-case letters with one 0 between words and at both ends; empty if there is no letter."""
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        small = self.table[np.minimum(codes, 0xFFFF)]
        high = np.flatnonzero(codes > 0xFFFF)
        if len(high):  # letters beyond the table fold into the private area
            small[high] = [0xE000 + (ord(chr(c).lower()[0]) & 0x7FF) if chr(c).isalpha() else 0 for c in codes[high].tolist()]
        if not small.any():
            return small[:0]
        padded = np.concatenate([[0], small, [0]]).astype(np.uint64)
        return padded[np.concatenate([[True], (padded[1:] > 0) | (padded[:-1] > 0)])]

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams that do not cross words, and how often each occurs."""
        x = self.letters(text)
        if not len(x):
            return x.astype(np.uint64), np.zeros(0, np.int64)
        parts = [x[x > 0]]
        edged = np.maximum(x, np.uint64(1))  # the edge as 1, so that "e" and "e" at the end of a word differ
        pair = edged[:-1] | (edged[1:] << np.uint64(16))
        parts.append(pair[(x[:-1] > 0) | (x[1:] > 0)])
        parts.append((pair[:-1] | (edged[2:] << np.uint64(32)))[x[1:-1] > 0])
        return np.unique(np.concatenate(parts), return_counts=True)

    def top(self, text: str, k: int = TOP) -> np.ndarray:
        """The k most frequent n-grams, ties by value."""
        grams, n = self.counts(text)
        return grams[np.argsort(-n, kind="stable")[:k]]


@dataclass
class Profiles:
    """Languages in order, and for every n-gram of any profile its rank in each of them."""

    langs: list[str]
    grams: np.ndarray  # sorted
    ranks: np.ndarray  # gram x language; PROFILE where the profile lacks it

    def distances(self, top: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.full(len(self.langs), float(PROFILE * len(top)))
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        known = self.grams[at] == top
        own = np.arange(len(top))[known, None]
        away = np.abs(self.ranks[at[known]] - own)
        away[self.ranks[at[known]] == PROFILE] = PROFILE
        return away.sum(axis=0) + float(PROFILE * (~known).sum())

    def predict(self, top: np.ndarray) -> tuple[str, float]:
        """Nearest language and 1 less its share of the greatest possible distance."""
        if not len(top) or not self.langs:
            return "und", 0.0
        d = self.distances(top)
        best = int(d.argmin())
        return self.langs[best], float(1 - d[best] / (PROFILE * len(top)))


def profiles_of(rows: list[tuple[str, int, int]]) -> Profiles:
    """From (lang, gram, rank) rows."""
    langs = sorted({r[0] for r in rows})
    grams = np.array(sorted({r[1] for r in rows}), np.uint64)
    ranks = np.full((len(grams), len(langs)), PROFILE, np.int32)
    for lang, gram, rank in rows:
        ranks[np.searchsorted(grams, np.uint64(gram)), langs.index(lang)] = rank
    return Profiles(langs, grams, ranks)


def train_language_profiles(docs: DataFrame, train: Column | None = None, sample: int = SAMPLE) -> Profiles:
    """Profiles from about ``sample`` documents of each language, drawn by a hash of id and length.

    Each task counts its documents' n-grams; the sums and the ranks are made by Spark, and the first
    ``PROFILE`` n-grams of each language reach the driver.
    """
    tune(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & (F.lit(True) if train is None else train))
    sizes = rows.groupBy("lang").count().collect()
    parts = 1 << 20
    rates = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], int(parts * min(1.0, sample / r["count"])) + 1) for r in sizes], "lang string, rate long"))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.length("text"), F.lit(23)), F.lit(parts))
    picked = rows.select("doc_id", "lang", "text").join(rates, "lang").where(draw < F.col("rate")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in batches:
            by: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(grams.counts(text or ""))
            for lang, found in by.items():
                keys, inverse = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                sums = np.bincount(inverse, weights=np.concatenate([n for _, n in found]), minlength=len(keys))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(sums.astype(np.int64))], names=["lang", "gram", "n"])

    sums = picked.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = sums.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < PROFILE)
    return profiles_of([(r["lang"], r["gram"], r["rank"]) for r in top.collect()])


def identify_language(docs: DataFrame, profiles: Profiles, keep: list[str]) -> DataFrame:
    """Add lang_pred and score to each document in one narrow pass over whole texts.

    ``und`` with score 0 where the text is null or has no letter, or no language was learned. Equal
    distances go to the first language in order of names. Equal texts get equal rows; a kept column
    named lang_pred or score is replaced; an empty table gives an empty table.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def make():
        grams, known = Grams(), shared.value

        def run(texts: list) -> list:
            found = [known.predict(grams.top(t or "")) for t in texts]
            return [[f[0] for f in found], [f[1] for f in found]]

        return run

    return map_texts(docs, keep, "text", make, "lang_pred string, score double")


def keep_identified(docs: DataFrame, profiles: Profiles, min_score: float = 0.0) -> DataFrame:
    """The documents with a known language and at least ``min_score``, with their own columns only,
    whatever their names. Null and empty texts go; an empty table gives an empty table."""
    found = identify_language(docs.select(F.struct(*docs.columns).alias("row"), "text"), profiles, ["row"])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select("row.*")


def language_query(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; rows with crc32 mod 4 = 2 teach nothing.
    A null doc_id counts as the empty text; rows that repeat are each returned; null and empty texts are und; an
    empty table gives an empty table; other columns are not read."""
    profiles = train_language_profiles(docs, fold(F.col("doc_id"), 4) != 2)
    flagged = docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return identify_language(flagged, profiles, ["doc_id", "held_out"])
