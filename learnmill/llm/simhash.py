"""SimHash near-duplicates by Golay-code fuzzy hashing.

The 64 bits of a fingerprint are cut into segments of 23, 23 and 18 bits. Fingerprints with at most
two differing bits agree fully on at least one segment, and differ by at most two bits on the next.
The [23, 12, 7] Golay code is perfect: each 23-bit word lies within three bits of one codeword. Two
segments with at most two differing bits have a word in the middle, at most one bit from each; so
decoding a segment and all its one-bit neighbours gives each segment one to seven codeword indices,
at least one of which both share. A key is a full segment with one codeword index of the next.

Two bits are much narrower than a shingle similarity of 0.8, whose fingerprints differ by some ten
bits, beyond what Golay keys of 64 bits can hold. So ``drop_near_duplicates`` takes as candidates what the Golay
keys tie and what bands of least hashes add, turns away what outlines of the shingle sets rule out, and checks the
rest by the shingles themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import checkpointed, fresh, map_texts, sized_side, tune

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SHINGLE, SEED, DISTANCE = 3, 42, 2
#: (first bit, bits) of the segments.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Keys with more fingerprints than this go by shared neighbours instead of comparison.
DENSE = 128
#: Fixed value: the generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the Golay code.
GENERATOR = 0b110001110101
#: Near copies that ``drop_near_duplicates`` removes: words of a shingle, keys a text, least hashes a key.
COPY_SHINGLE, BANDS, BAND_ROWS = 5, 30, 5
#: Bits of the outline of a shingle set, which turns pairs away before their shingles are compared.
OUTLINE_BITS = 1024
#: Members of a key up to which all of them are compared with each other, by outlines in generated code.
CROWDED = 4096


def fingerprint(text: str | None) -> int:
    """64 bits as a signed integer; 0 for a text without words. Shingles are hashed in blocks."""
    words = WORD.findall((text or "").encode("utf-8", "replace").lower())
    n = len(words) - SHINGLE + 1
    if not words:
        return 0
    if n < 1:
        words, n = [b" ".join(words)], 1
        spans = iter(words)
    else:
        spans = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    ones = np.zeros(64, np.int64)
    left = n
    while left:
        size = min(left, 1 << 16)
        h = np.fromiter((xxh64_intdigest(next(spans), SEED) for _ in range(size)), np.uint64, size)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        left -= size
    return int(np.packbits(2 * ones > n).view(np.int64)[0])


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


class Golay:
    """Decoder by syndromes: the remainder of a word names its at most three wrong bits."""

    def __init__(self):
        self.low = np.array([_remainder(i) for i in range(1 << 12)], np.uint32)
        self.high = np.array([_remainder(i << 12) for i in range(1 << 11)], np.uint32)
        self.errors = np.zeros(1 << 11, np.uint32)
        single = [_remainder(1 << b) for b in range(23)]
        for weight in (1, 2, 3):
            for bits in combinations(range(23), weight):
                at = 0
                for b in bits:
                    at ^= single[b]
                self.errors[at] = sum(1 << b for b in bits)

    def index(self, words: np.ndarray) -> np.ndarray:
        """The 12 information bits of the nearest codeword of each 23-bit word."""
        syndrome = self.low[words & 0xFFF] ^ self.high[words >> 12]
        return (words ^ self.errors[syndrome]) >> 11

    def indices(self, words: np.ndarray, bits: int) -> np.ndarray:
        """Sorted codeword indices of each word and its neighbours in the first ``bits`` bits."""
        flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.uint32)
        return np.sort(self.index(words[:, None] ^ flips), axis=1)

    def keys(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, row) of each fingerprint, each key once a row."""
        bits = prints.view(np.uint64)
        parts = [((bits >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.uint32) for at, n in SEGMENTS]
        keys, rows = [], []
        for i in range(3):
            nxt = (i + 1) % 3
            codes = self.indices(parts[nxt], SEGMENTS[nxt][1])
            first = np.ones(codes.shape, bool)
            first[:, 1:] = codes[:, 1:] != codes[:, :-1]
            row, col = np.nonzero(first)
            keys.append((np.int64(i) << 35) | (parts[i][row].astype(np.int64) << 12) | codes[row, col].astype(np.int64))
            rows.append(row)
        return np.concatenate(keys), np.concatenate(rows)


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Add ``fp`` (long) to each document, in one narrow pass. Null, empty and blank texts have fp 0; equal rows get
    equal rows; an empty table gives an empty table; a kept column named fp gives way."""
    tune(docs.sparkSession)
    return map_texts(docs, keep, "text", lambda: lambda texts: [[fingerprint(t) for t in texts]], "fp long")


def _spread_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = Golay()
    for b in batches:
        prints = b.column(0).to_numpy(zero_copy_only=False)
        if len(prints):
            keys, rows = code.keys(prints)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[rows])], names=["key", "fp"])


def link_runs(keys: np.ndarray, prints: np.ndarray, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From rows sorted by key, with whole runs: (fp, smaller fp it is linked to) as a star for each
    linked set of a run, and the fingerprints of runs longer than ``dense``, which are not compared."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    size, left = np.repeat(sizes, sizes), np.repeat(starts + sizes, sizes) - np.arange(len(keys))
    label = np.arange(len(keys))
    a_all, b_all = [], []
    rows = np.flatnonzero((size > 1) & (size <= dense) & (left > 1))
    step = 1
    while len(rows):
        near = np.bitwise_count(prints[rows].view(np.uint64) ^ prints[rows + step].view(np.uint64)) <= DISTANCE
        a_all.append(rows[near])
        b_all.append(rows[near] + step)
        step += 1
        rows = rows[left[rows] > step]
    if a_all:
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        while True:
            low = np.minimum(label[a], label[b])
            if (label[a] == low).all() and (label[b] == low).all():
                break
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
    tied = np.flatnonzero(label != np.arange(len(keys)))
    return prints[tied], prints[label[tied]], prints[size > dense]


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys in sorted batches. A run longer than DENSE is passed on as it comes, so
    that a task never holds more than a batch and the start of a run."""
    keys, prints = np.zeros(0, np.int64), np.zeros(0, np.int64)
    last_dense = None

    def rows(a, b, dense) -> pa.RecordBatch:
        mark = np.concatenate([np.zeros(len(a), bool), np.ones(len(dense), bool)])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, dense])), pa.array(np.concatenate([b, dense])), pa.array(mark)], names=["a", "b", "dense"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
        prints = np.concatenate([prints, batch.column(1).to_numpy(zero_copy_only=False)])
        if not len(keys):
            continue
        if last_dense is not None:  # the rest of a run that was found to be dense
            end = int(np.searchsorted(keys, last_dense, "right"))
            if end:
                yield rows(prints[:0], prints[:0], prints[:end])
                keys, prints = keys[end:], prints[end:]
            if len(keys):
                last_dense = None
            else:
                continue
        tail = int(np.searchsorted(keys, keys[-1]))
        if tail:
            yield rows(*link_runs(keys[:tail], prints[:tail]))
            keys, prints = keys[tail:], prints[tail:]
        if len(keys) > DENSE:
            last_dense = keys[0]
            yield rows(prints[:0], prints[:0], prints)
            keys, prints = keys[:0], prints[:0]
    if len(keys):
        yield rows(*link_runs(keys, prints))


def links(prints: DataFrame) -> DataFrame:
    """(a, b) links between distinct fingerprints ``fp`` whose closure is that of all pairs with at
    most two differing bits.

    Within a key at most DENSE fingerprints are compared. Those of larger keys go by neighbours: each
    fingerprint is dealt to itself and its 64 one-bit neighbours, two fingerprints meet at one of
    them if and only if they differ by at most two bits, and at most 65 ever meet at one. So no key,
    however hot, gives all its pairs, and none is dropped.
    """
    tune(prints.sparkSession)
    keyed = prints.select("fp").mapInArrow(_spread_keys, "key long, fp long")
    found = checkpointed(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_scan_runs, "a long, b long, dense boolean"))
    dense = found.where("dense").select(F.col("a").alias("fp")).distinct()
    spread = dense.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), x -> fp ^ shiftleft(1L, x)))")).alias("at"))
    met = spread.groupBy("at").agg(F.array_sort(F.collect_set("fp")).alias("s")).where(F.size("s") > 1)
    stars = met.select(F.explode(F.expr("slice(s, 2, size(s) - 1)")).alias("a"), F.col("s")[0].alias("b"))
    return found.where("not dense").select("a", "b").unionByName(stars).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the least node of its component.

    Large-star and small-star rounds until nothing changes, however many that takes. The least-neighbour tables are written
    before each join, so that Spark can split the rows of a hub among tasks.
    """
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            break
        before = mark
        ends = now.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(now.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = checkpointed(ends.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("m")).where("m < n"))
        large = now.join(least, now["lo"] == least["n"], "left").select("hi", F.coalesce("m", "lo").alias("lo"))
        large = checkpointed(large.distinct())
        own = checkpointed(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(own, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = checkpointed(small.unionByName(own.select("hi", F.col("m").alias("lo"))).distinct())
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def components(rows: DataFrame) -> DataFrame:
    """From (doc_id, fp): (fp, component_id), the smallest doc_id reachable over links; written."""
    each = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = checkpointed(connected(links(each)))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    lowest = roots.join(each, roots["node"] == each["fp"]).groupBy("root").agg(F.min("first").alias("low"))
    named = roots.join(checkpointed(lowest), "root").select(F.col("node").alias("fp"), "low")
    return checkpointed(each.join(named, "fp", "left").select("fp", F.coalesce("low", "first").alias("component_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Null and empty texts have fingerprint 0, linked like any other. Rows that repeat an id are each
    returned; null ids are never a component's id unless it has no other. An empty table gives an
    empty table. Only ids and fingerprints are shuffled; texts are read once.
    """
    rows = checkpointed(fingerprints(docs, ["doc_id"]))
    named = components(rows)
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(named, "fp").select("doc_id", shown, "component_id")


def shingle_set(text: str | None) -> np.ndarray:
    """The hashes of a text's distinct five-word shingles, sorted; of all its words if they are fewer."""
    words = WORD.findall((text or "").encode("utf-8", "replace").lower())
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - COPY_SHINGLE + 1)
    spans = map(b" ".join, zip(*(words[i:] for i in range(COPY_SHINGLE)), strict=False)) if len(words) >= COPY_SHINGLE else iter([b" ".join(words)])
    return np.unique(np.fromiter((xxh64_intdigest(x, SEED) for x in spans), np.uint64, n))


def sketch(shingles: np.ndarray, factors: np.ndarray) -> tuple[int, list[int]]:
    """A hash of the whole set and the keys of its bands; sets without shingles have no keys."""
    whole = _signed(xxh64_intdigest(shingles.tobytes(), SEED))
    if not len(shingles):
        return whole, []
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(least, np.multiply.outer(shingles[i : i + 2048], factors).min(axis=0), out=least)
    bands = least.reshape(BANDS, BAND_ROWS)
    return whole, [_signed(xxh64_intdigest(b.tobytes(), i)) for i, b in enumerate(bands)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sketches(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Add ``s``, the hash of the shingle set, ``bands`` and the fingerprint ``fp`` to each document, in one narrow pass. Null, empty and blank
    texts share one ``s`` and have no bands; equal texts get equal ones; an empty table gives an empty table; kept
    columns named s, bands or fp give way."""
    tune(docs.sparkSession)

    def make():
        factors = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
        return lambda texts: list(zip(*((*sketch(shingle_set(t), factors), fingerprint(t)) for t in texts), strict=True)) if texts else [[], [], []]

    return map_texts(docs, keep, "text", make, "s long, bands array<long>, fp long")


def _follow_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, s) sorted by both: (key, s, first of the run, the one before) of each but the
    first of a run. Only the last row and the first of its run are held from batch to batch."""
    held = np.zeros((0, 3), np.int64)
    for batch in batches:
        keys, sets = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(keys):
            continue
        keys, sets = np.concatenate([held[:, 0], keys]), np.concatenate([held[:, 1], sets])
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        starts = np.flatnonzero(new)
        firsts = sets[starts]
        if len(held):
            firsts[0] = held[0, 2]
        first = firsts[np.cumsum(new) - 1]
        rest = np.flatnonzero(~new)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[rest], sets[rest], first[rest], sets[rest - 1])], names=["key", "s", "first", "prior"])
        held = np.array([[keys[-1], sets[-1], first[-1]]], np.int64)


def outline(shingles: np.ndarray) -> np.ndarray:
    """OUTLINE_BITS bits, each the parity of the shingles that fall on it. The bits in which two outlines
    differ are at most the shingles in which the sets differ."""
    odd = np.bincount((shingles >> np.uint64(20)) % np.uint64(OUTLINE_BITS), minlength=OUTLINE_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_sets(texts: list) -> list:
    found = [shingle_set(t) for t in texts]
    return [[x.view(np.int64) for x in found], [len(x) for x in found], [outline(x) for x in found]]


def _near(a: str, b: str) -> Column:
    """Whether outlines and sizes of two sets allow a Jaccard similarity of 4/5: sets that similar differ
    in at most a ninth of their added sizes. Exact in that it turns away no such pair."""
    both = F.col(f"{a}.size") + F.col(f"{b}.size")
    apart = F.lit(0)
    for i in range(OUTLINE_BITS // 64):
        apart = apart + F.bit_count(F.col(f"{a}.outline")[i].bitwiseXOR(F.col(f"{b}.outline")[i]))
    return (5 * F.least(f"{a}.size", f"{b}.size") >= 4 * F.greatest(f"{a}.size", f"{b}.size")) & (9 * apart <= both)


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least 4/5, counted exactly."""
    x, y = sets.select(F.col("s").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("s").alias("b"), F.col("shingles").alias("y"))
    near = 9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))
    return checkpointed(pairs.join(x, "a").join(y, "b").where(near).select("a", "b"))


def golay_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): pairs of sets of ``rows`` (s, fp) whose fingerprints ``links`` ties, and each set with the first of its
    own fingerprint. A set whose texts have several fingerprints goes by the least."""
    prints = checkpointed(rows.groupBy("s").agg(F.min("fp").alias("fp")))
    heads = checkpointed(prints.groupBy("fp").agg(F.min("s").alias("head")))
    same = prints.join(heads, "fp").where("head <> s").select(F.col("head").alias("a"), F.col("s").alias("b"))
    near = links(heads)
    for end in "ab":
        near = near.join(heads.select(F.col("fp").alias(end), F.col("head").alias(f"of_{end}")), end)
    return checkpointed(same.unionByName(near.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))).distinct())


def copy_links(hashed: DataFrame, rows: DataFrame, own: tuple[str, str]) -> DataFrame:
    """(a, b) links between shingle sets of ``rows`` (doc_id, key, s, bands, fp), whose closure is that of
    all pairs that share a band and have a Jaccard similarity of at least 4/5. ``own`` names the columns
    of ``hashed`` that ``doc_id`` and ``key`` stand for.

    First come the pairs that the Golay keys of their fingerprints tie. They and each set with the first and the one before
    it of each of its keys are compared. What this links
    need not be compared again. Of the pairs of a key that are still apart, those come out of the join
    whose outlines allow the similarity, and only they are counted by their shingles: no pair is left
    out, and a key full of texts that are not alike gives no rows.
    """
    distinct = rows.where(F.size("bands") > 0).select("s", "bands").dropDuplicates(["s"])
    keyed = distinct.select(F.explode("bands").alias("key"), "s")
    runs = checkpointed(keyed.repartition("key").sortWithinPartitions("key", "s").mapInArrow(_follow_runs, "key long, s long, first long, prior long"))
    members = checkpointed(runs.select("key", "s").unionByName(runs.select("key", F.col("first").alias("s")).distinct()))
    golay = golay_pairs(rows.where(F.size("bands") > 0))
    judged = members.select("s").unionByName(golay.select(F.col("a").alias("s"))).unionByName(golay.select(F.col("b").alias("s"))).distinct()
    home = rows.join(judged, "s", "left_semi").groupBy("s").agg(F.min(F.struct("doc_id", "key")).alias("at"))
    home = sized_side(home.select("s", F.col("at.doc_id").alias("__id"), F.col("at.key").alias("__key")))
    met = hashed.select(F.col(own[0]).alias("doc_id"), F.col(own[1]).alias("key"), "text").join(home, (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    full = map_texts(met, ["s"], "text", lambda: shingle_sets, "shingles array<long>, size int, outline array<long>")
    sets = checkpointed(full.dropDuplicates(["s"]))
    facts = sets.select("s", F.struct("size", "outline").alias("f"))

    def with_facts(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.join(facts.select(F.col("s").alias(column), F.col("f").alias(name)), column)

    tried = runs.select(F.col("first").alias("a"), F.col("s").alias("b")).unionByName(runs.select(F.col("prior").alias("a"), F.col("s").alias("b"))).unionByName(golay).distinct()
    likely = with_facts(with_facts(tried, "a", "fa"), "b", "fb").where(_near("fa", "fb")).select("a", "b")
    linked = _alike(likely, sets)
    roots = checkpointed(connected(linked))
    named = checkpointed(members.join(roots.withColumnRenamed("node", "s"), "s", "left").select("key", "s", F.coalesce("root", "s").alias("root")))
    mixed = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    apart = checkpointed(with_facts(named.join(mixed, "key", "left_semi"), "s", "f"))
    sizes = apart.groupBy("key").agg(F.count("*").alias("n"))
    crowded = checkpointed(sizes.where(F.col("n") > CROWDED).select("key"))
    few = apart.join(crowded, "key", "left_anti")
    left, right = (few.select("key", F.col("s").alias(n), F.col("root").alias(f"of_{n}"), F.col("f").alias(f"f{n}")) for n in "ab")
    others = left.join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & (F.col("of_a") != F.col("of_b")) & _near("fa", "fb")).select("a", "b")
    if not crowded.isEmpty():
        many = apart.join(crowded, "key", "left_semi").select("s", "root", "f").dropDuplicates(["s"])
        others = others.unionByName(crowded_pairs(many, sets))
    return linked.unionByName(_alike(others.distinct(), sets))


def crowded_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): candidates for a similarity of 4/5 among ``members`` (s, root, f), whatever their keys, without looking at
    all pairs; no pair of different roots that is so similar is left out.

    The shingles of each set are put in order of rarity among the members. Two sets that similar share 8/9 of
    the smaller one and 4/5 of the larger one, so the first ninth of the smaller one's shingles and the first fifth
    of the larger one's meet, up to one. Texts that share a passage but not enough of the rest have only shingles
    of their own there, and those meet nobody.
    """
    own = members.join(sets.select("s", "shingles"), "s").select("s", "root", "f", F.explode("shingles").alias("t"))
    often = own.groupBy("t").agg(F.count("*").alias("n")).where("n > 1")
    # shingles of one member only stand first and meet nobody: only how many they are matters
    shared = own.select("s", "t").join(often, "t").groupBy("s").agg(F.sort_array(F.collect_list(F.struct("n", "t"))).alias("x"))
    size = F.col("f.size")
    alone = size - F.size("x")
    ahead = lambda share: F.slice("x", F.lit(1), F.greatest(size - F.ceil(size * share - 1e-9).cast("int") + 1 - alone, F.lit(0)))
    ranked = checkpointed(members.join(shared, "s").select("s", "root", "f", ahead(8 / 9).alias("ninth"), ahead(4 / 5).alias("fifth")))
    left = ranked.select(F.col("s").alias("a"), F.col("root").alias("of_a"), F.col("f").alias("fa"), F.explode("ninth.t").alias("t"))
    right = ranked.select(F.col("s").alias("b"), F.col("root").alias("of_b"), F.col("f").alias("fb"), F.explode("fifth.t").alias("t"))
    smaller = F.struct(F.col("fa.size"), F.col("a").alias("s")) < F.struct(F.col("fb.size"), F.col("b").alias("s"))
    return left.join(right, "t").where(smaller & (F.col("of_a") != F.col("of_b")) & _near("fa", "fb")).select("a", "b").distinct()


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component of near copies: of those with the least doc_id, the one with the
    least hash of its text; equal rows count once.

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.
    Candidates share one of BANDS keys of BAND_ROWS least hashes each: a pair at just 0.8 shares none
    once in 150,000 times. Every candidate link is checked exactly. Null, empty and blank texts have no
    shingles and are alike; a null doc_id comes after the others; other columns are kept as they are,
    whatever their names; an empty table gives an empty table.

    Ids and hashes decide which rows go. Texts are shuffled only where the keys to drop are too many
    to broadcast, and for rows that repeat both id and text.
    """
    tune(docs.sparkSession)
    own = fresh(docs, "__hash")
    hashed = docs.withColumn(own, F.xxhash64("text"))
    rows = checkpointed(sketches(hashed.select("doc_id", F.col(own).alias("key"), "text"), ["doc_id", "key"]))
    roots = checkpointed(connected(copy_links(hashed, rows, ("doc_id", own))))
    named = rows.join(roots, rows["s"] == roots["node"], "left").select("doc_id", "key", F.coalesce("root", "s").alias("component_id"))
    each = checkpointed(named.groupBy("component_id", "doc_id", "key").agg(F.count("*").alias("n")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = checkpointed(each.groupBy("component_id").agg(F.min(order).alias("first")))
    judged = each.join(first, F.col("first.key").eqNullSafe(F.col("key")) & F.col("first.doc_id").eqNullSafe(F.col("doc_id")), "left")
    ident, mark = fresh(docs, "__id"), fresh(docs, "__key")
    marked = judged.select(F.col("doc_id").alias(ident), F.col("key").alias(mark), F.col("first").isNull().alias("other"), "n")
    same = (F.col(own) == F.col(mark)) & F.col("doc_id").eqNullSafe(F.col(ident))
    kept = hashed.join(sized_side(marked.where("other or n > 1").select(ident, mark)), same, "left_anti")
    again = checkpointed(marked.where("not other and n > 1").select(ident, mark))
    if not again.isEmpty():
        kept = kept.unionByName(hashed.join(again, same, "left_semi").dropDuplicates(["doc_id", own]))
    return kept.drop(own)
