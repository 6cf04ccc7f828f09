"""Approximate nearest rows by product-quantised codes, with exact similarities for what they find.

A unit vector is cut into parts and each part replaced by the number of its nearest centre in that part's book, so
a vector of 64 floats becomes 16 bytes. A search reads the codes only: the inner products of a query with all
centres, added up by the codes, rank the rows, and the best ``rerank`` of them for each query are read as
vectors and compared exactly. The vectors lie in a folder for each coarse cell, and the join with the found rows
lets Spark skip the folders that none of them is in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnmill.functions.scalar import cosine

from .graph import pinned
from .vectors import QUERY_BLOCK, BlockTop, _matrix, _unit, rank_hits

PARTS, CENTRES, CELLS = 16, 256, 64
#: Rows that books and cells are fitted on, at most.
SAMPLE = 20_000
#: Codes ranked together, and queries whose tables are added up together.
ROWS, TOGETHER = 8192, 128


@dataclass
class Books:
    """Centres of the coarse cells, and for each part of a vector its centres."""

    cells: np.ndarray
    parts: list[np.ndarray]

    def cut(self, vectors: np.ndarray) -> list[np.ndarray]:
        return np.array_split(vectors, len(self.parts), axis=1)

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """A byte for each part of each vector."""
        return np.stack([nearest(x, c) for x, c in zip(self.cut(vectors), self.parts, strict=True)], axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """For each part the inner products of the queries with its centres."""
        return [x @ c.T for x, c in zip(self.cut(queries), self.parts, strict=True)]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def centres_of(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means of a sample that fits in memory."""
    k = max(1, min(k, len(x)))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy() if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(rounds if len(x) else 0):
        own = nearest(x, centres)
        sizes = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def fit_books(df: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = PARTS, centres: int = CENTRES, cells: int = CELLS, sample: int = SAMPLE, seed: int = 1) -> Books:
    """Books and cells from the ``sample`` rows of least hash; no more of them reach the driver."""
    rows = df.where(F.col(vector).isNotNull()).select(F.xxhash64(F.col(key), F.lit(seed)).alias("h"), F.col(vector).alias("v")).orderBy("h", "v").limit(sample)
    drawn = np.array([r["v"] for r in rows.collect()], np.float64)
    drawn = _unit(drawn) if drawn.size else np.zeros((0, parts))
    whole = Books(centres_of(drawn, cells, seed), [np.zeros(0)] * parts)
    return Books(whole.cells, [centres_of(x, min(centres, 256), seed + i) for i, x in enumerate(whole.cut(drawn))])


def write_codes(df: DataFrame, path: str, books: Books, vector: str = "embedding", key: str = "vec_id") -> None:
    """Write the index: codes (key, cell, code), and the vectors (key, vector) in a folder for each cell. Rows without a
    vector are left out. One narrow pass each."""
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<float>").alias("vector"))
    shared = df.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            if b.num_rows:
                unit = _unit(_matrix(b.column(1)))
                codes = [c.tobytes() for c in own.encode(unit)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nearest(unit, own.cells).astype(np.int32)), pa.array(codes, pa.binary()), b.column(1)], names=["key", "cell", "code", "vector"])

    coded = pinned(rows.mapInArrow(run, "key long, cell int, code binary, vector array<float>"))
    coded.select("key", "cell", "code").write.mode("overwrite").parquet(f"{path}/codes")
    coded.select("key", "vector", "cell").repartition("cell", F.pmod(F.xxhash64("key"), F.lit(16))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")


def search_codes(spark: SparkSession, path: str, books: Books, queries: DataFrame, k: int = 10, rerank: int | None = None) -> DataFrame:
    """(query_id, key, similarity, rank): for each query (query_id, query) the k nearest of the ``rerank`` rows (20 k by
    default) that its codes rank first, with their exact cosines. At most QUERY_BLOCK queries at a time, whose tables go to
    every task; a query without a vector has no hits."""
    rerank = rerank or 20 * k
    asked = queries.where(F.col("query").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query"))
    got = asked.limit(QUERY_BLOCK + 1).collect()
    if len(got) > QUERY_BLOCK:
        raise ValueError(f"at most {QUERY_BLOCK} queries at a time")
    matrix = _unit(np.array([r["query"] for r in got], np.float64)) if got else np.zeros((0, books.cells.shape[1]))
    shared = spark.sparkContext.broadcast((np.array([r["query_id"] for r in got], np.int64), matrix, books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, own = shared.value
        tops = [(Ranked(ids[i : i + TOGETHER], rerank), own.tables(matrix[i : i + TOGETHER])) for i in range(0, len(ids), TOGETHER)]
        for b in batches:
            codes = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, len(own.parts))
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(keys), ROWS):
                for top, tables in tops:
                    top.put(keys[i : i + ROWS], sum(t[:, codes[i : i + ROWS, p]] for p, t in enumerate(tables)))
        for top, _ in tops:
            yield top.rows()

    coded = spark.read.parquet(f"{path}/codes")
    likely = rank_hits(coded.select("key", "code").mapInArrow(run, "query_id long, key long, similarity double"), rerank).select("query_id", "key")
    likely = pinned(likely.join(coded.select("key", "cell"), "key"))  # queries x rerank rows, a bounded number
    vectors = spark.read.parquet(f"{path}/vectors")
    met = vectors.join(F.broadcast(likely), ["cell", "key"]).join(F.broadcast(asked), "query_id")
    return rank_hits(met.select("query_id", "key", cosine("vector", "query").alias("similarity")), k)


class Ranked(BlockTop):
    """The best rows so far of each query of a block, by scores that are given."""

    def __init__(self, ids: np.ndarray, k: int):
        super().__init__(ids, np.zeros((len(ids), 1)), k, None)

    def put(self, keys: np.ndarray, scores: np.ndarray) -> None:
        self.merge(keys, scores)
