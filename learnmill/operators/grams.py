"""Substring search by posting lists of trigrams, with hits verified in the texts.

The index has a row for each distinct trigram of a lowered text; a trigram is a number of three code points. A text that contains a query has all the
query's trigrams; the rarest few of them give candidates, and only those texts are read and compared. The index is
sorted by trigram, so a search reads the row groups that hold its trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnmill.session import bound_batches

from .questions import search

#: Trigrams of a query whose lists are intersected: the rarest ones.
RAREST = 3


def trigrams(text: str | None) -> np.ndarray:
    """The stretches of three characters, one after the other, 21 bits a character; none for shorter texts."""
    c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, key) of each distinct trigram of the texts behind each key."""
    for b in batches:
        found = [np.unique(np.concatenate([trigrams(t) for t in texts])) for texts in zip(*[c.to_pylist() for c in b.columns[1:]])]
        if found:
            rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), b.column(0).take(pa.array(rows))], names=["gram", "key"])


def write_grams(df: DataFrame, path: str, key: str, columns: list[str]) -> None:
    """Write the posting lists (gram, key) of the lowered ``columns``."""
    bound_batches(df.sparkSession)
    texts = df.select(F.col(key).alias("key"), *[F.lower(c).alias(f"text_{i}") for i, c in enumerate(columns)])
    rows = texts.mapInArrow(_postings, f"gram long, key {df.schema[key].dataType.simpleString()}")
    rows.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.mode("overwrite").parquet(path)


def candidates(spark: SparkSession, path: str, query: str, rarest: int = RAREST) -> DataFrame | None:
    """The keys whose texts have the rarest trigrams of the query; None for a query too short to have any."""
    wanted = np.unique(trigrams(query.lower())).tolist()
    if not wanted:
        return None
    lists = spark.read.parquet(path)
    sizes = {r["gram"]: r["count"] for r in lists.where(F.col("gram").isin(wanted)).groupBy("gram").count().collect()}  # a row a trigram of the query
    rare = sorted(wanted, key=lambda g: (sizes.get(g, 0), g))[:rarest]
    return lists.where(F.col("gram").isin(rare)).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).select("key")


def search_grams(df: DataFrame, path: str, key: str, query: str, columns: list[str], limit: int = 20, order: str | None = None) -> DataFrame:
    """``questions.search`` of the candidates only: the same rows. Queries of fewer than three characters read all texts."""
    found = candidates(df.sparkSession, path, query)
    rows = df if found is None else df.join(found, df[key] == found["key"], "left_semi")
    return search(rows, query, columns, limit, order or key)
