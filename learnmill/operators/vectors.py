"""Vector search with filters: exact for one query, exact for many by blocks, and by cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from learnmill.functions.scalar import cosine

from .graph import pinned
from .questions import where_equal

#: Up to so many queries go to every task; more are dealt in blocks of about this size.
QUERY_BLOCK = 4096
#: Rows of a part that meets a block of queries in one task.
PART_ROWS = 20_000
#: Cosines that a task holds at a time; queries and rows are multiplied in tiles of so many.
TILE = 1 << 21
#: Threshold and filter of each retrieval profile.
PROFILES = {"facts": (0.7, {"chunk_type": "fact"}), "concepts": (0.5, {"chunk_type": "concept"}), "hybrid": (None, {})}


def top_k(df: DataFrame, query: list[float], k: int = 10, threshold: float | None = None, inclusive: bool = True, vector: str = "embedding", key: str = "chunk_id", **filters) -> DataFrame:
    """The k rows of greatest cosine, ties by key. Filters reach the scan; null vectors are left out;
    the order and limit are one distributed top-n."""
    rows = where_equal(df, **filters).where(F.col(vector).isNotNull()).withColumn("similarity", cosine(vector, F.lit([float(x) for x in query])))
    if threshold is not None:
        rows = rows.where(F.col("similarity") >= threshold if inclusive else F.col("similarity") > threshold)
    return rows.orderBy(F.desc("similarity"), key).limit(k)


def search_chunks(df: DataFrame, query, grade_level=None, subject=None, k: int = 10, threshold: float = 0.7) -> DataFrame:
    return top_k(df, query, k, threshold, grade_level=grade_level, subject=subject)


def search_questions(df: DataFrame, query, subject=None, topic=None, difficulty=None, source=None, k: int = 10, threshold: float = 0.6) -> DataFrame:
    return top_k(df, query, k, threshold, key="question_id", subject=subject, topic=topic, difficulty=difficulty, source=source)


def search_book(df: DataFrame, query, book_id=None, k: int = 5) -> DataFrame:
    return top_k(df, query, k, book_id=book_id)


def search_strict(df: DataFrame, query, book_id=None, content_type=None, k: int = 5, threshold: float = 0.5) -> DataFrame:
    return top_k(df, query, k, threshold, inclusive=False, book_id=book_id, content_type=content_type)


def retrieve(df: DataFrame, query, profile: str = "hybrid", k: int = 5, key: str = "chunk_id") -> DataFrame:
    threshold, filters = PROFILES[profile]
    return top_k(df, query, k, threshold, key=key, **filters)


def normalised(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Unit vectors in double, computed once; zero vectors stay zero."""
    n = F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return df.withColumn(vector, F.transform(vector, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0)))


class BlockTop:
    """The k nearest of the vectors seen so far for each query of a block."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, threshold: float | None):
        self.ids, self.k, self.threshold = ids, k, threshold
        self.matrix = _unit(matrix)
        self.best = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
        self.floor: np.ndarray | None = None

    def add(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        """Take rows in tiles, so that memory does not grow with queries times rows of a batch."""
        size = max(1, TILE // max(1, len(self.ids)))
        for at in range(0, len(keys), size):
            self.merge(keys[at : at + size], self.matrix @ _unit(vectors[at : at + size]).T)

    def merge(self, keys: np.ndarray, scores: np.ndarray) -> None:
        """Take the rows with these keys and scores, a row of them for each query."""
        if scores.shape[1] > self.k:  # what may be among the first k, ties of the last place included
            least = np.partition(scores, -self.k, axis=1)[:, -self.k]
        else:
            least = np.full(len(self.ids), -np.inf)
        if self.floor is not None:  # rows below the k-th of those seen so far come no more
            least = np.maximum(least, self.floor)
        for i in np.flatnonzero(scores.max(axis=1, initial=-np.inf) >= least):
            row = scores[i]
            hit = np.flatnonzero(row >= least[i])
            s, ks = np.concatenate([self.best[i][0], row[hit]]), np.concatenate([self.best[i][1], keys[hit]])
            top = np.lexsort((ks, -s))[: self.k]
            self.best[i] = s[top], ks[top]
        self.floor = np.array([b[0][-1] if len(b[0]) == self.k else -np.inf for b in self.best])

    def rows(self) -> pa.RecordBatch:
        s = np.concatenate([b[0] for b in self.best]) if self.best else np.zeros(0)
        ks = np.concatenate([b[1] for b in self.best]) if self.best else np.zeros(0, np.int64)
        q = np.repeat(self.ids, [len(b[0]) for b in self.best])
        keep = np.ones(len(q), bool) if self.threshold is None else s >= self.threshold
        return pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(ks[keep]), pa.array(s[keep])], names=["query_id", "key", "similarity"])


def _unit(matrix: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, n, out=np.zeros_like(matrix), where=n > 0)


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


HIT = "query_id long, key long, similarity double"


def many_top_k(df: DataFrame, queries: DataFrame, k: int = 10, threshold: float | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query_id, key, similarity, rank) of the k nearest rows of each query, exact.

    Up to QUERY_BLOCK queries (query_id, query) go to the tasks: each multiplies its batches with them and
    keeps k rows a query, so that only those are shuffled. More queries are dealt into blocks and the rows
    into parts, and each part meets each block in one task; no query passes through the driver. A query
    without a vector has no hits.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
    asked = queries.where(F.col("query").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), "query")
    n = asked.count()
    if n <= QUERY_BLOCK:
        got = [(r["query_id"], list(r["query"])) for r in asked.collect()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = BlockTop(np.array([q for q, _ in got], np.int64), np.array([v for _, v in got], np.float64).reshape(len(got), -1), k, threshold)
            for b in batches:
                if b.num_rows and len(got):
                    top.add(b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1)))
            yield top.rows()

        return rank_hits(rows.mapInArrow(run, HIT), k)
    blocks, parts = -(-n // QUERY_BLOCK), max(1, -(-rows.count() // PART_ROWS))
    dealt = rows.select(F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "key", "vector")
    spread = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "query_id", "query")

    return rank_hits(dealt.groupBy("part", "block").cogroup(spread.groupBy("part", "block")).applyInArrow(_meeting(k, threshold), HIT), k)


def _meeting(k: int, threshold: float | None) -> Callable:
    """The k nearest of some rows (key, vector) for each of some queries (query_id, query), met in one task."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        top = BlockTop(right["query_id"].to_numpy(), _matrix(right["query"]), k, threshold)
        top.add(left["key"].to_numpy(), _matrix(left["vector"]))
        return pa.Table.from_batches([top.rows()])

    return meet


def rank_hits(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "key")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def joined_top_k(df: DataFrame, queries: DataFrame, k: int = 10, threshold: float | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The same, with the queries of one block as a broadcast variable: a task multiplies its rows with it in tiles
    and gives k rows a query, so that a pair is no row of its own. More queries than a block are ``many_top_k``."""
    if queries.count() > QUERY_BLOCK:
        return many_top_k(df, queries, k, threshold, vector, key)
    asked = queries.where(F.col("query").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), "query")
    got = asked.toArrow()
    sent = df.sparkSession.sparkContext.broadcast((got["query_id"].to_numpy(), _matrix(got["query"]) if got.num_rows else np.zeros((0, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = sent.value
        top = BlockTop(ids, matrix, k, threshold)
        for b in batches:
            if b.num_rows and len(ids):
                top.add(b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1)))
        yield top.rows()

    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
    return rank_hits(rows.mapInArrow(run, HIT), k)


def build_cells(df: DataFrame, lists: int = 100, sample: int = 100_000, seed: int = 1, vector: str = "embedding", key: str = "vec_id"):
    """(rows with their cell, k-means model on unit vectors). The model is fitted on about ``sample``
    rows; every row gets a cell. Write the rows partitioned by cell and a probe reads its cells only."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = normalised(df.where(F.col(vector).isNotNull()), vector).withColumn("features", array_to_vector(vector))
    n = rows.count()
    drawn = rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(1, n))) + 1)
    model = KMeans(k=min(lists, max(2, n)), seed=seed, maxIter=15, featuresCol="features", predictionCol="cell").fit(drawn)
    return model.transform(rows).drop("features"), model


def probe_cells(cells: DataFrame, model, queries: DataFrame, k: int = 10, nprobe: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Nearest rows of each query among its ``nprobe`` nearest cells. The cells of the queries are found in
    the tasks; queries and rows meet by cell."""
    centres = np.array(model.clusterCenters())

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = _unit(_matrix(b.column(1)))
                near = np.argsort(((q[:, None, :] - centres[None]) ** 2).sum(axis=2), axis=1)[:, :nprobe]
                each = near.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), each)), pa.array(near.ravel().astype(np.int32)), pa.array(list(np.repeat(q, each, axis=0)), pa.list_(pa.float64()))],
                    names=["query_id", "cell", "query"],
                )

    asked = queries.where(F.col("query").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), "query").mapInArrow(nearest, "query_id long, cell int, query array<double>")
    # each cell is cut into parts of about PART_ROWS rows, and its queries go to each part in blocks
    rows = cells.select(F.col("cell").cast("int").alias("cell"), F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
    rows, asked = pinned(rows), pinned(asked)
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")).join(asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks")), "cell")
    sizes = F.broadcast(pinned(sizes))  # a row a cell
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = rows.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).select("cell", "part", every("blocks").alias("block"), "key", "vector")
    spread = asked.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).select("cell", every("parts").alias("part"), "block", "query_id", "query")
    on = ["cell", "part", "block"]
    return rank_hits(dealt.groupBy(*on).cogroup(spread.groupBy(*on)).applyInArrow(_meeting(k, None), HIT), k)


def with_fallback(found: DataFrame, other: DataFrame, key: str = "query_id") -> DataFrame:
    """The hits, and for queries without any those of the other profile."""
    return found.withColumn("fallback", F.lit(False)).unionByName(other.join(found.select(key).distinct(), key, "left_anti").withColumn("fallback", F.lit(True)))


def context_summary(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("similarity").alias("avg_score"))


def embed(df: DataFrame, function: Callable | None = None, text: str = "content", title: str | None = None, size: int = 256, limit: int | None = None) -> DataFrame:
    """Add ``embedding``: by a user's function from a list of texts to a list of vectors, run on Arrow
    batches of distinct texts, or by hashed TF-IDF. Whole texts by default; ``limit`` cuts them to so many
    characters first (100,000 in a store whose model takes no more)."""
    whole = F.concat_ws("\n\n", title, text) if title else F.col(text)
    whole = whole if limit is None else F.substring(whole, 1, limit)
    if function is not None:
        @F.pandas_udf("array<float>")
        def vectors(t: pd.Series) -> pd.Series:
            return pd.Series(list(function(t.tolist())))

        distinct = df.select(whole.alias("__text")).distinct().withColumn("embedding", vectors("__text"))
        return df.withColumn("__text", whole).join(distinct, "__text", "left").drop("__text")
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = df.withColumn("__words", F.filter(F.split(F.lower(F.coalesce(whole, F.lit(""))), r"\W+"), lambda w: w != ""))
    # written once: the frequencies of all documents are read from it, and then the documents themselves
    tf = pinned(HashingTF(numFeatures=size, inputCol="__words", outputCol="__tf").transform(words).drop("__words"))
    weighted = IDF(inputCol="__tf", outputCol="__idf").fit(tf).transform(tf)
    out = Normalizer(inputCol="__idf", outputCol="__v").transform(weighted)
    return out.withColumn("embedding", vector_to_array("__v", "float32")).drop("__tf", "__idf", "__v")
