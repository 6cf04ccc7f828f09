"""Keyed merges without a table format: full outer join, then a swap of what is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def merge(target: DataFrame, source: DataFrame, keys: list[str], update: list[str], stamp: Column | None = None, order: str | None = None) -> DataFrame:
    """``target`` with ``source`` merged in: rows of a known key take the source's values of the
    columns ``update``, others are added. Of source rows that share a key the last by ``order`` counts.
    ``stamp`` is put into ``updated_at`` of every row that the source touches. One shuffle by key of
    each side.
    """
    rest = [c for c in source.columns if c not in keys]
    if order is not None:
        last = source.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("s"))
        source = last.select(*keys, *[F.col(f"s.{c}").alias(c) for c in rest])
    t, s = target.withColumn("__t", F.lit(True)).alias("t"), source.withColumn("__s", F.lit(True)).alias("s")
    on = None
    for k in keys:
        same = F.col(f"t.{k}") == F.col(f"s.{k}")
        on = same if on is None else on & same
    joined = t.join(s, on, "full")
    old, new = F.col("t.__t").isNotNull(), F.col("s.__s").isNotNull()
    out = []
    for c in target.columns:
        if c in keys:
            v = F.coalesce(f"t.{c}", f"s.{c}")
        elif c == "updated_at" and stamp is not None:
            v = F.when(new, stamp).otherwise(F.col(f"t.{c}"))
        elif c in source.columns:
            taken = F.when(old & ~new, F.col(f"t.{c}")).otherwise(F.col(f"s.{c}"))
            v = taken if c in update else F.when(old, F.col(f"t.{c}")).otherwise(F.col(f"s.{c}"))
        else:
            v = F.col(f"t.{c}")
        out.append(v.alias(c))
    return joined.select(*out)


def insert_or_ignore(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows of unknown keys added; of those that share a key one."""
    return target.unionByName(source.join(target, keys, "left_anti").dropDuplicates(keys), allowMissingColumns=True)


def _places(spark: SparkSession, path: str):
    """The store, and the paths of a swapped table: itself, the one being written, the one that was."""
    base = path.rstrip("/")
    at = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base + end) for end in ("", ".new", ".old")]
    return at[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), *at


def _move(store, a, b) -> None:
    if not store.rename(a, b):
        raise OSError(f"could not rename {a} to {b}")


def recover(spark: SparkSession, path: str) -> bool:
    """Put a swapped table right that a crash has left half swapped; whether there is one then.

    Without a table in place, rows that were written to the end take it, else the rows that were there before.
    With one, what lies beside it is of no use: the new rows are not whole or would be merged again, and the
    old ones have been replaced.
    """
    store, here, new, old = _places(spark, path)
    if not store.exists(here):
        whole = store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new, "_SUCCESS"))
        if whole or store.exists(old):
            _move(store, new if whole else old, here)
    for beside in (new, old):
        if store.exists(beside):
            store.delete(beside, True)
    return store.exists(here)


def read_swapped(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a table kept by ``write_swapped``, after recovery; None if there has never been one."""
    return spark.read.parquet(path) if recover(spark, path) else None


def write_swapped(df: DataFrame, path: str, *partition_by: str) -> None:
    """Write beside ``path`` and put it in place by two renames. Readers see old or new rows, never a mix, but
    between the renames no table, so they go through ``read_swapped``. The old rows go only when the new ones
    are in place; after a crash at any step ``recover`` finds one of the two whole. One writer at a time: what another
    one has begun is taken for the rest of a crash. ``df`` may read the table at ``path``."""
    spark = df.sparkSession
    store, here, new, old = _places(spark, path)
    there = store.exists(here)
    if not there and store.exists(old):
        raise RuntimeError(f"{path} is half swapped: read it with read_swapped first")
    writer = df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(new.toString())
    store.delete(old, True)
    if there:
        _move(store, here, old)
    _move(store, new, here)
    store.delete(old, True)


#: Columns that change when a known key comes again.
QUESTION_UPDATE = ["question_text", "embedding"]
CONCEPT_UPDATE = ["description", "chunk_ids", "definition", "metadata"]
RELATIONSHIP_UPDATE = ["strength", "metadata"]
CHUNK_UPDATE = ["embedding", "word_count", "key_concepts", "definitions"]


def upsert_questions(target: DataFrame, source: DataFrame, stamp: Column | None = None) -> DataFrame:
    return merge(target, source, ["question_id", "source"], QUESTION_UPDATE, stamp)


def upsert_concepts(target: DataFrame, source: DataFrame) -> DataFrame:
    return merge(target, source, ["concept_id"], CONCEPT_UPDATE)


def upsert_relationships(target: DataFrame, source: DataFrame) -> DataFrame:
    return merge(target, source, ["source_id", "target_id", "relationship_type"], RELATIONSHIP_UPDATE)


def upsert_chunks(target: DataFrame, source: DataFrame, replace: bool = False) -> DataFrame:
    return merge(target, source, ["chunk_id"], [c for c in source.columns if c != "chunk_id"] if replace else CHUNK_UPDATE)


def upsert_graph_rows(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Seed rows by (graph_name, key); a null key is a hash of the label, the same on every run."""
    ident = F.coalesce(F.col(key), F.pmod(F.xxhash64("label"), F.lit(1 << 31))) if "label" in source.columns else F.col(key)
    return merge(target, source.withColumn(key, ident), ["graph_name", key], [c for c in source.columns if c not in ("graph_name", key)])
