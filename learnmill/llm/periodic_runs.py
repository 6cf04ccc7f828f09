"""Periodic runs of words, found on the diagonals of a text against itself.

A run of period q is a stretch in which each word equals the word q before it. In the square of a text
against itself such a stretch lies on the diagonal of lag q, and its length is the match length there plus
q. Only cells where a word has an earlier occurrence are looked at, and of those only the ones that a run
can go through: a run of period q with three periods has at least 2q matches on its diagonal, so an earlier
occurrence of a word counts at lag q only if the k words from it agree too, k being the power of two with
k / 2 < q <= k. Among those the nearest one decides: inside a run of smallest period q no stretch of k >= q
words comes again sooner than q words later, and where a smaller period rules, the diagonal of a multiple
gets no cell. So a word opens at most one cell for each k, where the plain form (every earlier occurrence of
every word) opens n * n / 2 for a text that repeats one word. A diagonal ends where the next word has
no cell of its lag, and emits its run there if it is long enough. Agreement of k words is kept as a number
for each place (pairs of the numbers of k / 2 words); places that are alone with theirs drop out, so ordinary
prose is done after a few doublings: n log n steps at most, whatever the text.

All texts of a piece of an Arrow batch are walked together; nothing is shuffled.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import fresh

#: What stands between words (RE2): space, and tab to carriage return.
GAP = r"[\x20\x09-\x0D]+"
MIN_WORDS, MIN_PERIODS = 24, 3
#: Bytes of text walked together.
PIECE = 8 << 20


class Words:
    """The words of some texts in one row: ``flat`` (strings), ``code`` (a number for each, equal for equal
    words), ``start`` and ``end`` of each text, ``doc`` of each word."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern_regex(pc.fill_null(texts.cast(pa.large_string()), ""), GAP)
        flat = lists.flatten()
        doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        real = pc.not_equal(flat, "")
        self.flat = flat.filter(real)
        self.doc = doc[real.to_numpy(zero_copy_only=False)]
        self.end = np.cumsum(np.bincount(self.doc, minlength=len(texts)))
        self.start = np.concatenate([[0], self.end[:-1]]).astype(np.int64)
        self.code = self.flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def reorder(self, place: np.ndarray) -> None:
        """Let the word at each place be that at ``place``, in the same text."""
        self.flat, self.code = self.flat.take(pa.array(place)), self.code[place]

    def joined(self, kept: np.ndarray) -> list[str]:
        """The kept words of each text, one space between them."""
        counts = np.bincount(self.doc[kept], minlength=len(self.start))
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), type=pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(offsets, self.flat.filter(pa.array(kept)).cast(pa.string())), " ").to_pylist()


def diagonals(words: Words, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """Rows (text, start, length, period) of every maximal run of its smallest period, at least
    ``min_words`` words and ``min_periods`` (3 or more) periods long, by text, start and period."""
    if min_periods < 3:
        raise ValueError("a diagonal of fewer than three periods may have no cell: min_periods is 3 or more")
    doc, total = words.doc, len(words.doc)
    longest = int((words.end - words.start).max(initial=0))
    place = np.arange(total)
    alike = doc * (int(words.code.max(initial=0)) + 1) + words.code  # equal words of one text
    found = [np.zeros((0, 4), np.int64)]
    k = 1
    while len(place) and min_periods * (k // 2 + 1) <= longest:
        order = np.argsort(alike, kind="stable")  # places in order within equal numbers
        at, sorted_alike = place[order], alike[order]
        again = sorted_alike[1:] == sorted_alike[:-1]
        here, lag = at[1:][again], (at[1:] - at[:-1])[again]
        cell = (lag > k // 2) & (lag <= k)
        found.append(ended(doc, here[cell], lag[cell], k, min_words, min_periods))
        twice = np.concatenate([again, [False]]) | np.concatenate([[False], again])
        number = np.concatenate([[0], np.cumsum(~again)])
        of = np.full(total, -1, np.int64)
        of[at[twice]] = number[twice]
        place = np.sort(at[twice])
        place = place[place + k < total]
        place = place[(of[place + k] >= 0) & (doc[place + k] == doc[place])]
        alike = of[place] * (total + 1) + of[place + k]
        k *= 2
    rows = np.concatenate(found)
    rows[:, 1] -= words.start[rows[:, 0]] if len(rows) else 0
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def ended(doc: np.ndarray, here: np.ndarray, lag: np.ndarray, k: int, min_words: int, min_periods: int) -> np.ndarray:
    """The runs (text, place, length, period) of the diagonals through the cells (``here``, ``lag``), at each of
    which k words match. A diagonal ends where the next place has no cell of its lag."""
    if not len(here):
        return np.zeros((0, 4), np.int64)
    order = np.lexsort((here, lag))
    here, lag = here[order], lag[order]
    new = np.concatenate([[True], (lag[1:] != lag[:-1]) | (here[1:] != here[:-1] + 1)])
    first = np.flatnonzero(new)
    matched = np.diff(np.append(first, len(here))) + k - 1
    period = lag[first]
    length = matched + period
    enough = (length >= min_words) & (length >= min_periods * period)
    start = here[first] - period
    return np.stack([doc[start], start, length, period], axis=1)[enough]


def dropped(words: Words, runs: np.ndarray) -> np.ndarray:
    """Whether each word stands in a run after that run's first period."""
    change = np.zeros(len(words.doc) + 1, np.int64)
    at = words.start[runs[:, 0]] + runs[:, 1]
    np.add.at(change, at + runs[:, 3], 1)
    np.add.at(change, at + runs[:, 2], -1)
    return np.cumsum(change[:-1]) > 0


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of the batch with about ``PIECE`` bytes each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + PIECE, side="right")))
        yield lo, hi
        lo = hi


def _walk(df: DataFrame, keep: list[str], used: list, make, added: str) -> DataFrame:
    """Columns ``keep`` and those of DDL ``added``: ``make(arrays of used)`` gives for a piece of a batch the row
    each result belongs to and the arrays of the added columns. A kept column named like an added one gives way."""
    extra = _parse_datatype_string(added)
    new = {f.name.lower() for f in extra.fields}
    keep = [c for c in keep if c.lower() not in new]
    out = StructType([df.schema[c] for c in keep] + extra.fields)
    names, inputs = out.names, len(used)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in _pieces(b.column(len(keep))):
                part = b.slice(lo, hi - lo)
                row, columns = make(*(part.column(len(keep) + i) for i in range(inputs)))
                whole = [part.column(i).take(pa.array(row)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(whole + columns, names=names)

    return df.select(*keep, *(c.alias(fresh(df, f"__used{i}")) for i, c in enumerate(used))).mapInArrow(run, out)


def find_runs(docs: DataFrame, keep: list[str] | None = None, text: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """One row (columns ``keep``, start, length, period) for each periodic run of column ``text``.

    Nulls, empty texts and texts without runs give no row, an empty table an empty table; rows that repeat
    give their runs each. ``keep``: all columns by default; one named like an added one gives way.
    """

    def make(texts: pa.Array):
        runs = diagonals(Words(texts), min_words, min_periods)
        return runs[:, 0], [pa.array(runs[:, i]) for i in (1, 2, 3)]

    return _walk(docs, docs.columns if keep is None else keep, [F.col(text)], make, "start long, length long, period long")


def collapse_runs(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """The documents with each run cut to its first period, and n_dropped, the number of words that went.

    The text comes back as its words with one space between them where something went, else unchanged.
    A null text stays null with 0 dropped; an empty table stays empty; equal rows get equal rows. Columns keep
    their names and places; one named ``n_dropped`` is replaced.
    """

    def make(texts: pa.Array):
        words = Words(texts)
        gone = dropped(words, diagonals(words, min_words, min_periods))
        count = np.bincount(words.doc[gone], minlength=len(texts))
        new = [old if not n else kept for old, kept, n in zip(texts.to_pylist(), words.joined(~gone), count, strict=True)]
        return np.arange(len(texts)), [pa.array(new, pa.string()), pa.array(count)]

    rest = [c for c in docs.columns if c != text]
    found = _walk(docs, rest, [F.col(text)], make, f"`{text}` string, n_dropped long")
    return found.select(*[c for c in docs.columns if c.lower() != "n_dropped"], "n_dropped")


def planted(words: Words, h: np.ndarray) -> np.ndarray:
    """The place of the original word that the contract's text has at each place: where h % 10 = 0, the words
    from a on repeat with a period drawn from h."""
    place = np.arange(len(words.doc))
    n = words.end - words.start
    for d in np.flatnonzero((h % 10 == 0) & (n > 0)):
        g = int(h[d]) // 10
        a = g % int(n[d])
        tail = int(n[d]) - a
        p = 1 + tail // (3 + g % 8)
        place[words.start[d] + a : words.end[d]] = words.start[d] + a + np.arange(tail) % p
    return place


def _before(x: np.ndarray, y: np.ndarray) -> int:
    """Order of runs (text, start, length, period): greatest length / period, then start, then period."""
    ratio = int(y[2]) * int(x[3]) - int(x[2]) * int(y[3])
    return ratio or int(x[1] - y[1]) or int(x[3] - y[3])


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


ADDED = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
KINDS = [pa.int64()] * 5 + [pa.string()] * 2


def runs_query(docs: DataFrame) -> DataFrame:
    """doc_id, the number of runs of each document, its run of greatest exponent and the digests of all runs
    and of the collapsed words, after the contract's repeats are put in.

    A null text has no words: no run, nulls, the digests of nothing. A null doc_id counts as the empty text in
    the hash. Rows that repeat are each returned; an empty table gives an empty table; extra columns are ignored.
    """

    def make(texts: pa.Array, h: pa.Array):
        words = Words(texts)
        words.reorder(planted(words, h.to_numpy(zero_copy_only=False)))
        runs = diagonals(words)
        kept = words.joined(~dropped(words, runs))
        bounds = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
        rows = []
        for d, text in enumerate(kept):
            own = runs[bounds[d] : bounds[d + 1]]
            best = [None] * 4
            if len(own):
                _, start, length, period = (int(v) for v in min(own, key=functools.cmp_to_key(_before)))
                best = [start, length, period, 1000 * length // period]
            rows.append((len(own), *best, sha("".join(f"{s},{n},{p}\n" for _, s, n, p in own.tolist())), sha(text or "")))
        columns = zip(*rows, strict=True) if rows else [[]] * len(KINDS)
        return np.arange(len(texts)), [pa.array(c, type=t) for c, t in zip(columns, KINDS, strict=True)]

    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return _walk(docs, ["doc_id"], [F.col("text"), h], make, ADDED)
