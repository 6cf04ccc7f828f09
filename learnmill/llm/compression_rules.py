"""Quality rules by compression bands.

A text is compressed with zstandard as a whole and in fixed chunks; the last chunk ends at the end of
the text, so each byte of a text longer than a chunk is in a tested one. Prose falls into a narrow band of
ratios that depends on the length; repetition lies above it, random or encoded data below it. The bands are
those measured on labelled texts; another corpus passes its own as ``bands`` and ``chunk_band``.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, tune

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")


@dataclass(frozen=True)
class Band:
    """Ratios (bytes over compressed bytes) allowed for texts of at least ``min_bytes``."""

    min_bytes: int
    low: float
    high: float


#: Limits in steps of half an octave. ``high`` lies between the ratios of good and of poor labelled texts
#: that pass the base rule (sf0.1, level 3): midway between the largest good and the least poor one where
#: they part (from 2896 bytes on), else just above the 99th percentile of the good ones. ``low`` lies
#: below the least ratio of good text (1.38 at 256 bytes, 2.05 in chunks of 4096) and above that of encoded data (1.33),
#: midway from 4096 bytes on.
BANDS = (
    Band(0, 0.0, 1.75),
    Band(256, 1.10, 1.75),
    Band(362, 1.15, 1.86),
    Band(512, 1.20, 1.90),
    Band(724, 1.28, 1.97),
    Band(1024, 1.35, 2.05),
    Band(1448, 1.38, 2.12),
    Band(2048, 1.40, 2.18),
    Band(2896, 1.42, 2.24),
    Band(4096, 1.69, 2.33),
    Band(5792, 1.69, 2.40),
    Band(8192, 1.69, 2.46),
    Band(11585, 1.69, 2.52),
    Band(16384, 1.69, 2.56),
    Band(23170, 1.69, 2.64),
    Band(32768, 1.69, 2.70),
    Band(65536, 1.69, 2.85),
    Band(131072, 1.69, 3.00),
)
CHUNK_BYTES = 4096
#: Of 2440 chunks of good texts that pass the base rule none is above 2.26 or below 2.07, of poor ones none below 2.32
#: (sf0.1); a text goes if more than a fifth of its chunks lie outside.
CHUNK_BAND = Band(CHUNK_BYTES, 1.69, 2.29)
MAX_BAD_CHUNKS = 0.2
LEVEL = 3
ADDED = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, ratio double, bad_chunks double, reason string, kept boolean"
)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = WORD.findall(text)
    seen: set[str] = set()
    dup_lines = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
        elif WORD.search(line):
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        reach = 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    return len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), dup_lines, repeated


def verdict(data: bytes, compress, bands=BANDS, chunk_band=CHUNK_BAND, max_bad=MAX_BAD_CHUNKS) -> tuple:
    """(ratio, share of chunks out of their band, reason or None) of one text's bytes."""
    band = [b for b in bands if b.min_bytes <= len(data)][-1]
    ratio = len(data) / len(compress(data)) if data else 0.0
    size = chunk_band.min_bytes
    chunks = [data[i : i + size] for i in (*range(0, len(data) - size, size), len(data) - size)] if len(data) > size else []
    out = sum(not chunk_band.low <= size / len(compress(c)) <= chunk_band.high for c in chunks)
    bad = out / len(chunks) if chunks else 0.0
    reason = None
    if data and ratio > band.high:
        reason = "repetitive"
    elif data and ratio < band.low:
        reason = "incompressible"
    elif bad > max_bad:
        reason = "chunks"
    return ratio, bad, reason


def score_quality_rules(docs: DataFrame, keep: list[str] | None = None, bands=BANDS, chunk_band=CHUNK_BAND) -> DataFrame:
    """Add the base counts, the compression ratio and the verdict to each document.

    ``keep``: the columns carried along (all by default; one named like an added column is replaced).
    Nulls and empty texts have no words, fail the base rule and are not kept. One narrow pass: equal
    rows get equal rows, an empty table gives an empty table.
    """
    tune(docs.sparkSession)

    def make():
        compress = zstandard.ZstdCompressor(level=LEVEL).compress

        def run(texts: list) -> list:
            rows = []
            for t in texts:
                t = t or ""
                n, chars, symbols, dups, repeats = base_counts(t)
                failed = n < 50 or 100 * repeats > 50 * n
                ratio, bad, reason = verdict(t.encode("utf-8", "replace"), compress, bands, chunk_band)
                rows.append((n, chars, symbols, dups, repeats, failed, ratio, bad, "base" if failed else reason, not failed and reason is None))
            return list(zip(*rows, strict=True)) if rows else [[] for _ in ADDED.split(", ")]

        return run

    return map_texts(docs, keep or docs.columns, "text", make, ADDED)


def apply_quality_rules(docs: DataFrame, bands=BANDS, chunk_band=CHUNK_BAND) -> DataFrame:
    """The documents that the rules keep, with their own columns only, whatever their names."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return score_quality_rules(whole, ["row"], bands, chunk_band).where("kept").select("row.*")
