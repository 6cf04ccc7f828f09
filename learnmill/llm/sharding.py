"""Shards of near-equal bytes by sampled splitters, in DataFrame functions alone.

Records stand in the order of a hash of their text, then of their id. A sample drawn by size gives
the quantiles of that order, the splitters of a few hundred ranges; exact totals of the ranges show
the overfull ones, which are split again from a sample of their own. With the totals, the place of
each record among all bytes follows from its place in its range, and with it its shard.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, numbered_copies

RANGES = 1024
#: Expected sample rows for each range; the driver holds RANGES times this many keys.
PER_RANGE = 8
ORDER = ("key", "id")


def records(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key, id, copies): equal rows are one record with copies. Key and id are
    hashes of the text and of the doc_id, of whatever type."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"))
    rows = rows.groupBy("doc_id", "size", "text_crc32", "key").agg(F.count("*").alias("copies"))
    return rows.withColumn("id", F.xxhash64("doc_id"))


def range_of(bounds: list[tuple[int, int]]) -> Column:
    """Number of bounds at or below (key, id), by binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    keys, ids = F.lit([k for k, _ in bounds]), F.lit([i for _, i in bounds])
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        at = F.least(mid, F.lit(len(bounds) - 1))
        below = (keys[at] < F.col("key")) | ((keys[at] == F.col("key")) & (ids[at] <= F.col("id")))
        done = a["lo"] >= a["hi"]
        lo = F.when(done | ~below, a["lo"]).otherwise(mid + 1)
        hi = F.when(done | below, a["hi"]).otherwise(mid)
        return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    return F.aggregate(steps, start, halve, lambda a: a["lo"])


def quantiles(sample: list[tuple[int, int, float]], parts: int) -> list[tuple[int, int]]:
    """At most parts - 1 keys that cut a weighted sample into parts of near-equal weight."""
    rows = sorted(sample)
    total, done, out = sum(w for *_, w in rows), 0.0, []
    for key, ident, w in rows:
        done += w
        if done * parts >= (len(out) + 1) * total and len(out) < parts - 1 and (not out or (key, ident) > out[-1]):
            out.append((key, ident))
    return out


def drawn(rows: DataFrame, rate: float, salt: int) -> list[tuple[int, int, float]]:
    """A sample in which a record of weight w (bytes of its copies) comes with chance min(1, w rate)."""
    weight = F.col("size") * F.col("copies")
    chance = F.pmod(F.xxhash64("key", "id", "size", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    got = rows.where(chance < weight * rate).select("key", "id", weight.alias("w")).collect()
    return [(r["key"], r["id"], max(float(r["w"]), 1 / rate)) for r in got]


def splitters(rows: DataFrame, total: int, ranges: int = RANGES) -> tuple[list[tuple[int, int]], dict[int, tuple[int, int]]]:
    """Bounds of ranges, and (bytes, records with copies) of each range that has any. Overfull ranges are
    split until none is left, or the rest hold one record that is larger by itself."""
    bounds = quantiles(drawn(rows, ranges * PER_RANGE / total, 0), ranges)
    for again in count(1):
        number = range_of(bounds).alias("range")
        sums = rows.select(number, (F.col("size") * F.col("copies")).alias("w"), "copies").groupBy("range")
        totals = {r["range"]: (r["w"], r["n"]) for r in sums.agg(F.sum("w").alias("w"), F.sum("copies").alias("n")).collect()}
        full = {k: w for k, (w, _) in totals.items() if w > 2 * total / ranges}
        if not full:
            break
        more = drawn(rows.where(number.isin(list(full))), ranges * PER_RANGE / total, again)
        by: dict[int, list] = {}
        for row in more:
            by.setdefault(bisect_right(bounds, row[:2]), []).append(row)
        new = {b for k, part in by.items() for b in quantiles(part, -(-full[k] * ranges // total))}
        if new <= set(bounds):
            break
        bounds = sorted({*bounds, *new})
    return bounds, totals


def assign_shards(docs: DataFrame, shards: int = 16, ranges: int = RANGES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    The law is ``bytes``: a shard holds the records whose middle lies in its part of all bytes, so
    that sizes differ by at most twice the largest record. Equal texts stand side by side; those that
    together are no larger than the largest record share a shard, larger groups may be parted at a
    boundary. Null texts count as empty; rows equal in id and
    text take places side by side; an empty table gives an empty table. Only ids, sizes and hashes
    are shuffled; no range, and so no task, gathers more than about two parts in ``ranges``.
    """
    rows = checkpointed(records(docs))
    total = rows.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 1
    bounds, totals = splitters(rows, total, ranges)
    byte0, row0, done, seen = [], [], 0, 0
    for k in range(len(bounds) + 1):
        byte0.append(done)
        row0.append(seen)
        w, n = totals.get(k, (0, 0))
        done, seen = done + w, seen + n
    numbered = rows.withColumn("range", range_of(bounds))
    before = Window.partitionBy("range").orderBy(*ORDER, "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    at = F.lit(byte0)[F.col("range")] + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(before), F.lit(0))
    nth = F.lit(row0)[F.col("range")] + F.coalesce(F.sum("copies").over(before), F.lit(0))
    placed = checkpointed(numbered.select("doc_id", "size", "text_crc32", "key", "copies", at.cast("long").alias("at"), nth.cast("long").alias("nth")))
    # a group of equal texts no larger than the largest record goes as one; its middle decides
    same = ["key", "size", "text_crc32"]
    largest = rows.agg(F.max("size")).first()[0] or 1
    groups = placed.groupBy(*same).agg(F.min("at").alias("start"), F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.count("*").alias("n"))
    groups = groups.where((F.col("bytes") <= largest) & ((F.col("n") > 1) | (F.col("bytes") > F.col("size")))).drop("n")
    placed = placed.join(groups, same, "left")
    each = numbered_copies(placed, "copies", "j")
    middle = F.coalesce(2 * F.col("start") + F.col("bytes"), 2 * (F.col("at") + F.col("j") * F.col("size")) + F.col("size"))
    each = each.select("doc_id", "size", "text_crc32", middle.alias("middle"), (F.col("nth") + F.col("j")).alias("nth"))
    shard = F.least(F.lit(shards - 1), F.expr(f"cast((middle * {shards}L) div {2 * total}L as int)"))
    each = checkpointed(each.withColumn("shard", shard).drop("middle"))
    first = {r["shard"]: r["n"] for r in each.groupBy("shard").agg(F.min("nth").alias("n")).collect()}
    starts = F.lit([first.get(s, 0) for s in range(shards)])
    return each.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") - starts[F.col("shard")]).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, ranges: int = RANGES) -> list[tuple[int, int]]:
    """Write the whole documents under ``path`` in folders shard=N and return the splitters.

    The splitters are the quantiles of the exact range totals, so shards are equal to about one part
    in ``ranges``; rows equal in id and text stay together. A task of the scan writes its part of every
    shard; no text is shuffled. Columns named key, id or shard are refused. A null text has size 1, a null id is an
    id like any other; rows that repeat are all written; an empty table writes nothing and gives the splitters of
    no rows.
    """
    taken = {"key", "id", "shard"} & set(docs.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are taken")
    rows = checkpointed(records(docs))
    total = rows.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 1
    bounds, totals = splitters(rows, total, ranges)
    cuts, done = [], 0
    for k, bound in enumerate(bounds):
        done += totals.get(k, (0, 0))[0]
        if done * shards >= (len(cuts) + 1) * total and len(cuts) < shards - 1:
            cuts.append(bound)
    keyed = docs.withColumns({"key": F.xxhash64(F.coalesce("text", F.lit(""))), "id": F.xxhash64("doc_id")})
    keyed.withColumn("shard", range_of(cuts)).drop("key", "id").write.partitionBy("shard").parquet(path)
    return cuts
