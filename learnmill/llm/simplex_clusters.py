"""Clustering around centroids in integers, with centroids filtered by n-simplex projection.

Distances to a few pivots place each vector as the apex of a simplex over them: all coordinates but the last
lie in the space of the pivots, the last is the height above it. Between two apexes the Euclidean distance is
never more than the true distance (lower bound), and with one height turned over never less (upper bound). A
vector's pivot distances do not change, so its apex is computed once and kept beside it; a round places only
the centroids anew. A centroid whose lower bound lies above the least upper bound cannot be the nearest; the
others are compared exactly, in integers.

Each round is one pass that sends a row for each centroid, component and task; what reaches the driver is
the centroids, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import checkpointed

DIMENSIONS, SCALE = 64, 256
CENTROIDS, ROUNDS = 40, 5
#: Pivots taken from the first centroids; fewer where those lie in a smaller space.
PIVOTS = 12
#: Integer components are below this, so that sums over components fit 64 bits.
LARGEST = 1 << 27
#: Below this integer products and their sums are exact in float64.
EXACT = 1 << 22
#: Room for rounding in the bounds, as a share of the squared distances they come from.
SLACK = 1e-6
ROWS = 4096


def whole_components(vector: Column, scale: int, dimensions: int | None = None) -> Column:
    """floor(scale * x) of each component as long, or null for a null vector, one with a component that is null,
    nan or infinite, or one of other than ``dimensions`` components. A product of 2^27 or more is an error."""
    usable = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if dimensions is not None:
        usable = usable & (F.size(vector) == dimensions)
    product = lambda x: F.lit(scale) * x.cast("double")
    fits = ~F.exists(vector, lambda x: F.abs(product(x)) >= LARGEST)
    whole = F.transform(vector, lambda x: F.floor(product(x)))
    return F.when(usable, F.when(fits, whole).otherwise(F.raise_error(F.lit(f"a component times {scale} is 2^27 or more"))))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of two integer matrices, exact."""
    kind = np.float64 if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < EXACT else np.int64
    x, y = a.astype(kind), b.astype(kind)
    return ((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)).astype(np.int64)


@dataclass
class Simplex:
    """Pivots and the coordinates of their simplex: row j holds pivot j, the first at the origin."""

    pivots: np.ndarray
    base: np.ndarray

    @classmethod
    def over(cls, points: np.ndarray, most: int = PIVOTS) -> Simplex:
        """Pivots among ``points``: the first one, then always the one highest above the simplex so far; a point
        that hardly rises above it would make the coordinates unsteady and ends the choice."""
        chosen = [0]
        own = points.astype(np.float64)
        simplex = cls(points[:1], np.zeros((1, 0)))
        size = float(squared(points, points[:1]).max(initial=0))
        while len(chosen) < min(most, len(points)):
            apex = simplex.apexes(squared(own.astype(np.int64), simplex.pivots))
            highest = int(np.argmax(apex[:, -1]))
            if apex[highest, -1] ** 2 <= 1e-3 * size:
                break
            chosen.append(highest)
            base = np.zeros((len(chosen), len(chosen) - 1))
            base[:-1, :-1] = simplex.base
            base[-1] = apex[highest]
            simplex = cls(points[chosen], base)
        return simplex

    def apexes(self, distances: np.ndarray) -> np.ndarray:
        """Apex coordinates from squared distances to the pivots: the height comes last."""
        across = np.zeros((len(distances), self.base.shape[1]))
        for j in range(1, len(self.base)):
            row = self.base[j]
            known = across[:, : j - 1] @ row[: j - 1]
            across[:, j - 1] = ((distances[:, 0] + row @ row - distances[:, j]) / 2 - known) / row[j - 1]
        height = np.sqrt(np.maximum(distances[:, 0] - (across * across).sum(axis=1), 0.0))
        return np.column_stack([across, height])


def nearest(vectors: np.ndarray, apex: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, int]:
    """For each vector the number of its nearest centroid (ties: the smaller), the squared distance, and in all
    how many exact comparisons were made."""
    placed = simplex.apexes(squared(centroids, simplex.pivots))
    flat = (apex[:, :-1] ** 2).sum(axis=1)[:, None] + (placed[:, :-1] ** 2).sum(axis=1) - 2 * apex[:, :-1] @ placed[:, :-1].T
    above, below = apex[:, -1:], placed[:, -1]
    room = SLACK * ((apex**2).sum(axis=1)[:, None] + (placed**2).sum(axis=1) + 1)
    low = flat + (above - below) ** 2 - room
    high = flat + (above + below) ** 2 + room
    left = low <= high.min(axis=1, keepdims=True)
    row, centroid = np.nonzero(left)
    kind = np.float64 if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT else np.int64
    own, other = vectors.astype(kind), centroids.astype(kind)
    exact = np.empty(len(row), np.int64)
    for i in range(0, len(row), 1 << 15):
        difference = own[row[i : i + (1 << 15)]] - other[centroid[i : i + (1 << 15)]]
        exact[i : i + (1 << 15)] = np.einsum("ij,ij->i", difference, difference)
    distance = np.full(left.shape, np.iinfo(np.int64).max)
    distance[row, centroid] = exact
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(best)), best], len(row)


def with_apexes(vectors: DataFrame, simplex: Simplex, dimensions: int) -> DataFrame:
    """(row, v, apex) of the vectors (row, v), computed once."""
    out = StructType(list(vectors.schema.fields) + _parse_datatype_string("apex array<double>").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            apex = simplex.apexes(squared(matrix(b.column(1), dimensions), simplex.pivots))
            offsets = pa.array(np.arange(len(apex) + 1) * apex.shape[1], type=pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, pa.array(apex.ravel()))], names=out.names)

    return vectors.mapInArrow(run, out)


def _assigned(b: pa.RecordBatch, centroids: np.ndarray, simplex: Simplex) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(first row, vectors, cluster, distance, comparisons) of pieces of a batch."""
    vectors, apex = matrix(b.column("v"), centroids.shape[1]), matrix(b.column("apex"), len(simplex.base))
    for i in range(0, len(vectors), ROWS):
        own = vectors[i : i + ROWS]
        yield i, own, *nearest(own, apex[i : i + ROWS], centroids, simplex)


def sums(placed: DataFrame, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of one assignment: components summed, vectors and distances of each centroid, comparisons in all."""
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dimensions + 3), np.int64)
        for b in batches:
            for _, own, cluster, distance, compared in _assigned(b, centroids, simplex):
                which = np.eye(k, dtype=np.int64)[cluster]
                for part in np.unique(cluster):
                    total[part, :dimensions] += own[cluster == part].sum(axis=0)
                total[:, dimensions] += which.sum(axis=0)
                np.add.at(total[:, dimensions + 1], cluster, distance)
                total[0, dimensions + 2] += compared
        there = np.flatnonzero(total.any(axis=1))
        cells = np.indices((len(there), dimensions + 3))
        yield pa.RecordBatch.from_arrays([pa.array(there[cells[0].ravel()]), pa.array(cells[1].ravel()), pa.array(total[there].ravel())], names=["cluster", "part", "total"])

    rows = placed.select("v", "apex").mapInArrow(run, "cluster long, part long, total long").groupBy("cluster", "part").agg(F.sum("total").alias("total"))
    out = np.zeros((k, dimensions + 3), np.int64)
    for r in rows.collect():  # centroids x components
        out[r["cluster"], r["part"]] = r["total"]
    return out[:, :dimensions], out[:, dimensions], out[:, dimensions + 1], int(out[0, -1])


def first_centroids(vectors: DataFrame, vec_id: Column, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors with the least sha256 of ``<salt>:<id>``, in that order; equal ids by their components."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(vec_id.cast("string"), F.lit(""))), 256)
    rows = vectors.select("v", key.alias("key")).orderBy("key", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, keep: list[str] | None = None, salt: str = "2") -> DataFrame:
    """Columns ``keep`` (the id by default) and cluster, distance, cluster_inertia, inertia, centroid_sha256, compared
    of every vector of exactly ``dimensions`` finite components; others give no row.

    ``compared`` is the mean number of centroids that were compared exactly for a vector of the last assignment.
    Fewer than ``k`` vectors start as many clusters; an empty table gives an empty table. A null id counts as the
    empty text in the draw of the first centroids; rows that repeat are points each; of equal distances the
    smaller number wins. A kept column named like an added one gives way. Components of 2^27 / scale or more
    are an error, since squared distances would not fit a long.
    """
    added = _parse_datatype_string("cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, compared double")
    keep = [c for c in (keep or [vec_id]) if c.lower() not in {f.name.lower() for f in added.fields}]
    whole = vectors.select(F.struct(*keep).alias("row"), F.col(vec_id).alias("id"), whole_components(F.col(vector), scale, dimensions).alias("v")).where(F.col("v").isNotNull())
    centroids = first_centroids(whole, F.col("id"), k, salt)
    out = StructType([vectors.schema[c] for c in keep] + added.fields)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], out)
    simplex = Simplex.over(centroids)
    placed = checkpointed(with_apexes(whole.select("row", "v"), simplex, dimensions))
    for _ in range(rounds):
        total, count, _, _ = sums(placed, centroids, simplex)
        centroids = np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], centroids)
    _, count, inertia, compared = sums(placed, centroids, simplex)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    share = compared / max(int(count.sum()), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = b.column("row")
            for i, _, best, distance, _ in _assigned(b, centroids, simplex):
                part = whole.slice(i, len(best))
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.flatten(), pa.array(best, type=pa.int32()), pa.array(distance), pa.array(inertia[best]), pa.array(np.full(len(best), inertia.sum())),
                        pa.array([digests[c] for c in best], type=pa.string()), pa.array(np.full(len(best), share)),
                    ],
                    names=out.names,
                )

    return placed.mapInArrow(run, out)


def _rounds_sql() -> str:
    """The same rounds as DuckDB SQL: a CTE for each assignment and each set of centroids."""
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
        WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM
        (SELECT v, sha256('2:' || vec_id::VARCHAR) AS h FROM v ORDER BY h LIMIT {CENTROIDS}))""",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min_by(c, d * 1000 + c) AS c, min(d) AS d FROM
        (SELECT vec_id, v.v, c, (list_sum(list_transform(range(1, {DIMENSIONS} + 1), lambda j: (v.v[j] - k.v[j]) * (v.v[j] - k.v[j]))))::BIGINT AS d FROM v, c{i} k) GROUP BY vec_id)""")
        if i < ROUNDS:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT k.c, coalesce(n.v, k.v) AS v FROM c{i} k LEFT JOIN
            (SELECT c, list(m ORDER BY j) AS v FROM (SELECT c, j, floor(sum(v[j]) / count(*)) AS m FROM a{i}, range(1, {DIMENSIONS} + 1) AS r(j) GROUP BY c, j) GROUP BY c) n ON n.c = k.c)""")
    return f"""WITH {", ".join(parts)}
    SELECT vec_id, a.c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
    sha256(array_to_string(list_transform(k.v, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} k ON a.c = k.c"""


ORACLE_SQL = _rounds_sql()


def clusters_query(embeddings: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector, as ``cluster``."""
    return cluster(embeddings).drop("compared")
