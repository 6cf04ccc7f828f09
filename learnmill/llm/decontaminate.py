"""Benchmark decontamination in DataFrame functions alone.

The test items' word n-grams form a broadcast hash set. Every window of a document's words is hashed
in generated code and looked up there; the words of a hit are compared, so that equal hashes decide
nothing. Only hits leave the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, checkpointed, fresh, numbered_copies, sized_side

N = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z is lower-cased, each with what stands before it.
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TAIL = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$"
#: Windows of one length are broadcast up to so many; more are joined with the documents' windows by Spark.
BROADCAST_WINDOWS = 1_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, n: int = N) -> tuple[DataFrame, DataFrame]:
    """(k, gram, gid), the distinct windows with numbers, and (gid, item_id), the items they stand in;
    both written. Items shorter than ``n`` words are one window; those without words or without an id
    have none."""
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", words_of(F.col("text")).alias("w"))
    items = items.withColumn("k", F.least(F.size("w"), F.lit(n))).where("k > 0")
    spread = items.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("k"))))
    each = checkpointed(spread.select("item_id", "k", F.slice("w", F.col("i") + 1, F.col("k")).alias("gram")).distinct())
    grams = checkpointed(each.select("k", "gram").distinct().withColumn("gid", F.monotonically_increasing_id()))
    return grams, checkpointed(each.join(grams, ["k", "gram"]).select("gid", "item_id"))


def window_hash(w: str, i, k: int) -> Column:
    return F.xxhash64(*[F.get(w, i + j) for j in range(k)])


def scan_hits(rows: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """One pass over (doc_id, text_hash, w): copies and hits of each distinct document, over the windows
    of few enough grams to be broadcast. Every window is hashed and looked up in generated code."""
    rows = rows.withColumn("n_words", F.size("w"))
    # position -1 stands for the document itself, so that one scan gives counts and hits
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(-1), F.col("n_words") - 1)))
    for k in lengths:
        side = grams.where(F.col("k") == k).select(window_hash("gram", F.lit(0), k).alias(f"h{k}"), F.col("gram").alias(f"gram{k}"), F.col("gid").alias(f"gid{k}"))
        inside = (F.col("i") >= 0) & (F.col("i") + k <= F.col("n_words"))
        rows = rows.withColumn("own", F.when(inside, window_hash("w", F.col("i"), k)))
        # equal by two orderings: no join key, so that the hash alone is looked up, and generated code
        words, gram = F.slice("w", F.col("i") + 1, F.lit(k)), F.col(f"gram{k}")
        same = (F.col("own") == F.col(f"h{k}")) & (words <= gram) & (words >= gram)
        rows = rows.join(F.broadcast(side), same, "left").drop("own", f"h{k}", f"gram{k}")
    any_hit = F.lit(False)
    for k in lengths:
        any_hit = any_hit | F.col(f"gid{k}").isNotNull()
    rows = rows.where((F.col("i") == -1) | any_hit)
    spans = [F.when(F.col(f"gid{k}").isNotNull(), F.struct("i", F.lit(k).alias("k"), F.col(f"gid{k}").alias("gid"))) for k in lengths]
    found = F.array_compact(F.array(*spans)) if spans else F.array().cast(HITS)
    rows = rows.select("doc_id", "text_hash", "n_words", (F.col("i") == -1).cast("long").alias("self"), found.alias("spans"))
    got = rows.groupBy("doc_id", "text_hash", "n_words").agg(F.sum("self").alias("copies"), F.collect_set(F.when(F.size("spans") > 0, F.col("spans"))).alias("spans"))
    return got.select("doc_id", "text_hash", "n_words", "copies", F.flatten("spans").alias("hits"))


def join_hits(docs: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, text_hash, more): hits over grams too many to broadcast. Of every window of a document
    only its hash, the text's hash and the place are shuffled; the texts with equal hashes are then read
    again and their words compared."""
    found = None
    for k in lengths:
        rows = docs.select(F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("w")).where(F.size("w") >= k)
        rows = rows.select("text_hash", "w", F.explode(F.sequence(F.lit(0), F.size("w") - k)).alias("i")).select(window_hash("w", F.col("i"), k).alias("h"), "text_hash", "i")
        side = grams.where(F.col("k") == k).select(window_hash("gram", F.lit(0), k).alias("h"), "k", "gid", "gram")
        met = rows.join(side, "h").select("text_hash", F.struct("i", "k", "gid", "gram").alias("at"))
        found = met if found is None else found.unionByName(met)
    likely = sized_side(found.groupBy("text_hash").agg(F.collect_set("at").alias("at")))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(likely, "text_hash").select("doc_id", "text_hash", words_of(F.col("text")).alias("w"), "at")
    true = F.filter("at", lambda x: F.slice("w", x["i"] + 1, x["k"]) == x["gram"])
    rows = rows.select("doc_id", "text_hash", F.transform(true, lambda x: F.struct(x["i"].alias("i"), x["k"].alias("k"), x["gid"].alias("gid"))).alias("at"))
    return rows.where(F.size("at") > 0).groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("more"))


HITS = "array<struct<i:int,k:int,gid:bigint>>"


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = N, bound: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One row for each distinct (doc_id, text): doc_id, text_hash, n_words, copies, hits; written. And
    (gid, item_id) of the windows.

    ``hits`` is the sorted array of (i, k, gid): k words from word i on are window gid of the benchmark.
    ``copies`` counts equal rows. Windows of a length of which there are at most ``bound`` are broadcast:
    one scan, out of which a row for each document and hit is shuffled. Those of other lengths are joined.
    """
    bound = BROADCAST_WINDOWS if bound is None else bound
    grams, holders = benchmark_windows(benchmark, n)
    sizes = {r["k"]: r["count"] for r in grams.groupBy("k").count().collect()}
    few, many = (sorted(k for k, size in sizes.items() if (size <= bound) == small) for small in (True, False))
    got = scan_hits(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("w")), grams, few)
    if many:
        more = join_hits(docs, grams, many).withColumnsRenamed({"doc_id": "id", "text_hash": "hash"})
        got = got.join(more, (F.col("text_hash") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
        got = got.withColumn("hits", F.concat("hits", F.coalesce("more", F.array().cast(HITS)))).drop("id", "hash", "more")
    return checkpointed(got.withColumn("hits", F.array_sort("hits"))), holders


def covered(hits: Column) -> Column:
    """Words inside any of the sorted spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(a: Column, x: Column) -> Column:
        end = x["i"] + x["k"]
        return F.struct((a["n"] + F.greatest(F.lit(0), end - F.greatest(a["end"], x["i"]))).alias("n"), F.greatest(a["end"], end).alias("end"))

    return F.aggregate(hits, start, add, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, bound: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every document.

    Null and empty texts have no words and no hits; equal rows give equal rows; without benchmark
    windows nothing is hit; an empty table gives an empty table. Other columns of ``docs`` are not read.
    Items are gathered for each document from its distinct windows.
    """
    got, holders = find_hits(docs, benchmark, n, bound)
    each = got.where(F.size("hits") > 0).select("doc_id", "text_hash", F.explode(F.array_distinct(F.transform("hits", lambda x: x["gid"]))).alias("gid"))
    each = each.join(holders, "gid").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.col("item_id").cast("string").alias("item"))
    items = each.groupBy("id", "hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = got.join(items, (F.col("text_hash") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    out = rows.select(
        "doc_id", F.col("n_words").cast("long"), covered(F.col("hits")).cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), "copies",
    )
    return numbered_copies(out, "copies", "copy").drop("copies", "copy")


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", n: int = N, bound: int | None = None) -> DataFrame:
    """Remove contaminated documents, or (``mode="span"``) the hit words with what stands before each.

    Documents without hits come back as they are, with all their columns, whatever their names; null
    and empty texts have no hits. Rows are matched by id and text; the keys of few hit documents are
    broadcast, else Spark shuffles. Equal rows share their fate; an empty table gives an empty table.
    """
    if mode not in ("document", "span"):
        raise ValueError(mode)
    ident, mark, spans = (fresh(docs, name) for name in ("__id", "__hash", "__hits"))
    hits = find_hits(docs, benchmark, n, bound)[0].where(F.size("hits") > 0)
    hits = hits.select(F.col("doc_id").alias(ident), F.col("text_hash").alias(mark), F.col("hits").alias(spans))
    same = (F.xxhash64("text") == F.col(mark)) & F.col("doc_id").eqNullSafe(F.col(ident))
    if mode == "document":
        return docs.join(sized_side(hits.drop(spans)), same, "left_anti")
    joined = docs.join(hits, same, "left")
    pieces = F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))
    kept = F.filter(pieces, lambda _, i: ~F.exists(spans, lambda h: (i >= h["i"]) & (i < h["i"] + h["k"])))
    cleaned = F.concat(F.array_join(kept, ""), F.regexp_extract("text", TAIL, 0))
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(cleaned).alias("text")
    return joined.select([text if c == "text" else F.col(c) for c in docs.columns])


_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
ORACLE_SQL = rf"""
with dw as (
  select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (
  select item_id, w, least(10, len(w)) as k
  from (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null)
  where len(w) > 0),
grams as (
  select distinct item_id, k, array_to_string(w[i + 1 : i + k], ' ') as g
  from (select item_id, w, k, unnest(range(0, len(w) - k + 1)) as i from bw)),
spread as (
  select r, i, k, array_to_string(w[i + 1 : i + k], ' ') as g
  from (select r, w, k, unnest(range(0, len(w) - k + 1)) as i from dw, (select distinct k from grams) where len(w) >= k)),
hits as (select r, i, k, item_id from spread join grams using (k, g)),
hit_words as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from hits) group by r),
hit_items as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as names
  from (select distinct r, item_id::varchar as item from hits) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join hit_words using (r) left join hit_items using (r)
"""
