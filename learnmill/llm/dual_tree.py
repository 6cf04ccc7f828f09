"""Exact top-k by inner product: a cover tree of the queries against cover trees of the data.

The data are dealt by their nearest landmark into blocks, each written once with its cover tree; the queries
likewise into groups. A node stands for the points within its covering radius r of its centre c, so no inner
product of a query node (a, s) and a data node (c, r) is greater than either of

    <a, c> + r |a| + s |c| + r s        and        (A² + C² - max(0, |a - c| - r - s)²) / 2

with A and C the greatest norms below the two nodes. A pair of nodes whose bound is below the worst k-th
score among the queries of the node cannot change any list and is left out, first for whole (group, block)
pairs, then within the trees. Each group searches the block nearest in direction first, which gives it k-th
scores to prune the others with. Bounds carry room for rounding; scores are integers, compared exactly.

Equal vectors stand in order of their ids, so of those that meet in a task only the k + 1 least ids can be
in any list (one more than k, for the query itself); the others are not indexed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed
from .simplex_clusters import whole_components

SCALE, TOP, EVERY = 1024, 10, 100
#: Vectors of a block and of a group of queries, of a leaf of their trees, and the ratio of a node's radius to its children's.
BLOCK, GROUP, LEAF, QUERY_LEAF, BASE = 2048, 256, 24, 4, 1.3
#: Landmarks, and vectors they are chosen from for each of them.
LANDMARKS, DRAWN = 1024, 8
#: Summaries that are compared together.
PACK = 512
NONE, ROOM = -(1 << 62), 1e-9
FIELDS = 7  # of a node: centre, first and end of its points, radius, greatest norm, first child, children


@dataclass
class Tree:
    """Points in the order of the tree and its nodes; node 0 is the root, children stand together."""

    points: np.ndarray
    ids: np.ndarray
    nodes: np.ndarray

    def __post_init__(self):
        self.real = self.points.astype(np.float64)
        self.center, self.lo, self.hi = (self.nodes[:, i].astype(np.int64) for i in range(3))
        self.radius, self.most = self.nodes[:, 3], self.nodes[:, 4]
        self.child, self.children = self.nodes[:, 5].astype(np.int64), self.nodes[:, 6].astype(np.int64)
        self.centers = self.real[self.center]
        self.size = np.sqrt((self.centers**2).sum(axis=1))


def cover_tree(points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> Tree:
    """The cover tree of the points: a node's children lie within its radius over ``BASE`` of their own centres, one
    of which is the node's, and their centres further than that from each other. A node whose points do not
    gather around centres (as where all are about equally far apart) stays a leaf of any size."""
    real = points.astype(np.float64)
    norms = (real**2).sum(axis=1)
    order = np.arange(len(points))
    nodes = [[0.0] * FIELDS]
    away = np.sqrt(np.maximum(norms + norms[0] - 2 * real @ real[0], 0)) if len(points) else np.zeros(0)
    todo = [(0, 0, len(points), 0, away)]
    while todo:
        node, lo, hi, center, away = todo.pop()
        mine = order[lo:hi]
        radius = float(away.max(initial=0.0))
        nodes[node][:5] = [center, lo, hi, radius * (1 + ROOM), float(np.sqrt(norms[mine].max(initial=0.0)))]
        if len(mine) <= leaf or radius == 0:
            continue
        reach = radius / BASE
        near = away <= reach
        parts = [(center, mine[near], away[near])]
        rest, far = mine[~near], away[~near]
        while len(rest):
            if len(parts) > 8 and sum(len(p[1]) for p in parts[1:]) < 2 * (len(parts) - 1):
                parts = []
                break
            at = int(far.argmax())
            own = np.sqrt(np.maximum(norms[rest] + norms[rest[at]] - 2 * real[rest] @ real[rest[at]], 0))
            own[at] = 0.0
            near = own <= reach
            parts.append((int(rest[at]), rest[near], own[near]))
            rest, far = rest[~near], far[~near]
        if not parts:
            continue
        nodes[node][5:] = [len(nodes), len(parts)]
        for c, members, distance in parts:
            order[lo : lo + len(members)] = members
            todo.append((len(nodes), lo, lo + len(members), c, distance))
            nodes.append([0.0] * FIELDS)
            lo += len(members)
    table = np.array(nodes)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    if len(order):
        table[:, 0] = place[table[:, 0].astype(np.int64)]
    return Tree(points[order], ids[order], table)


def bounds(a: np.ndarray, s, most_a, c: np.ndarray, r, most_c) -> np.ndarray:
    """No inner product below the nodes (centres, radii, greatest norms) is greater; a row for each of the first."""
    product = a @ c.T
    size_a, size_c = (np.sqrt((x**2).sum(axis=1)) for x in (a, c))
    apart = np.sqrt(np.maximum(size_a[:, None] ** 2 + size_c**2 - 2 * product, 0))
    s, most_a = np.asarray(s)[:, None], np.asarray(most_a)[:, None]
    room = ROOM * (1 + (most_a + s) * (np.asarray(most_c) + r)) + 1e-6
    # the root of a rounded difference may be too long by the root of the rounding
    apart = np.maximum(apart - 1e-7 * (size_a[:, None] + size_c) - r - s, 0)
    return np.minimum(product + r * size_a[:, None] + s * size_c + r * s, (most_a**2 + np.asarray(most_c) ** 2 - apart**2) / 2) + room


class Search:
    """The k best (score, id) of each query of a tree, from one data tree after another. ``floor``: for each query a
    score that k others reach already."""

    def __init__(self, queries: Tree, k: int, floor: np.ndarray | None = None):
        self.q, self.k, self.compared = queries, k, 0
        n = len(queries.points)
        self.score, self.id, self.own = np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max), np.zeros((n, k), bool)
        self.floor = np.full(n, NONE) if floor is None else floor

    def add(self, data: Tree) -> None:
        """Walk the pairs of nodes, the best bound first among the children of one node. Queries are split first, so
        that each part of them comes to its own best nodes early."""
        q, p = self.q, data
        if not len(q.points) or not len(p.points):
            return
        self.exact = np.float64 if float(np.abs(q.points).max()) * float(np.abs(p.points).max()) * q.points.shape[1] < 2**53 else np.int64
        todo = [(0, 0, np.inf)]
        while todo:
            a, c, bound = todo.pop()
            if bound < self.floor[q.lo[a] : q.hi[a]].min():
                continue
            if not q.children[a] and not p.children[c]:
                self.leaves(a, c, p)
            elif not p.children[c] or (q.children[a] and 2 * q.radius[a] > p.radius[c]):
                below = np.arange(q.child[a], q.child[a] + q.children[a])
                bound = bounds(q.centers[below], q.radius[below], q.most[below], p.centers[c : c + 1], p.radius[c : c + 1], p.most[c : c + 1])[:, 0]
                todo += [(int(below[i]), c, bound[i]) for i in np.argsort(bound)]
            else:
                below = np.arange(p.child[c], p.child[c] + p.children[c])
                bound = bounds(q.centers[a : a + 1], q.radius[a : a + 1], q.most[a : a + 1], p.centers[below], p.radius[below], p.most[below])[0]
                todo += [(a, int(below[i]), bound[i]) for i in np.argsort(bound)]

    def leaves(self, a: int, c: int, p: Tree) -> None:
        """Score two leaves against each other and put what reaches a list into it."""
        q, k = self.q, self.k
        rows, cols = slice(q.lo[a], q.hi[a]), slice(p.lo[c], p.hi[c])
        score = (q.points[rows].astype(self.exact) @ p.points[cols].astype(self.exact).T).astype(np.int64)
        self.compared += score.size
        least = self.floor[rows]
        if score.shape[1] > k:
            least = np.maximum(least, np.partition(score, score.shape[1] - k, axis=1)[:, -k])
        row, col = np.nonzero(score >= least[:, None])
        old_row, old_col = np.nonzero(self.score[rows] > NONE)
        ids = p.ids[cols][col]
        own = ids == q.ids[rows][row]
        own[own] = (q.points[rows][row[own]] == p.points[cols][col[own]]).all(axis=1)
        who = np.concatenate([old_row, row])
        value = np.concatenate([self.score[rows][old_row, old_col], score[row, col]])
        ids = np.concatenate([self.id[rows][old_row, old_col], ids])
        own = np.concatenate([self.own[rows][old_row, old_col], own])
        order = np.lexsort((~own, ids, -value, who))
        who = who[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        order, who, place = order[place < k], who[place < k], place[place < k]
        for table, new in ((self.score, value), (self.id, ids), (self.own, own)):
            table[rows][who, place] = new[order]
        self.floor[rows] = np.maximum(self.floor[rows], self.score[rows, -1])


def landmarks(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of the vectors, each the furthest from those before it."""
    if not len(sample):
        return sample
    real = sample.astype(np.float64)
    chosen, away = [0], ((real - real[0]) ** 2).sum(axis=1)
    while len(chosen) < most and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((real - real[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def dealt(vectors: DataFrame, marks: np.ndarray) -> DataFrame:
    """(id, v) in sorted partitions, vectors of one landmark and then of one second landmark together. A
    frequent vector is dealt on by its ids, so that no task gets all its copies."""
    width = marks.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        real = marks.astype(np.float64)
        for b in batches:
            own = rows_of(b.column(1), width).astype(np.float64)
            away = (real**2).sum(axis=1) - 2 * own @ real.T
            first = away.argmin(axis=1)
            away[np.arange(len(own)), first] = np.inf
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first.astype(np.int32)), pa.array(away.argmin(axis=1).astype(np.int32))], names=["id", "v", "mark", "second"])

    near = vectors.select("id", "v").mapInArrow(run, "id long, v array<int>, mark int, second int").withColumn("h", F.xxhash64("v"))
    order = ["mark", "second", "h", "id"]
    return near.repartitionByRange(*order).sortWithinPartitions(*order)


def trees(vectors: DataFrame, width: int, size: int, leaf: int, copies: int | None = None) -> DataFrame:
    """(tree, ids, points, nodes, center, radius, most) of each block of up to ``size`` vectors of a landmark, in the
    order they come; with ``copies`` no more than so many of equal vectors in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last, same = 0, None, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def cut(points: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            t = cover_tree(points, ids, leaf)
            number += 1
            name = (TaskContext.get().partitionId() << 32) + number
            values = [[name], [t.ids], [t.points.ravel()], [t.nodes.ravel()], [t.points[int(t.nodes[0, 0])].astype(np.float64)], [t.nodes[0, 3]], [t.nodes[0, 4]]]
            return pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(values, TREE_KINDS, strict=True)], names=TREE_NAMES)

        def full(end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            points, ids, marks = (np.concatenate(x) for x in zip(*held, strict=True))
            lo = 0
            while lo < len(ids):
                hi = lo + int(np.searchsorted(marks[lo : lo + size], marks[lo], side="right"))
                if hi == len(ids) and hi - lo < size and not end:
                    break
                yield cut(points[lo:hi], ids[lo:hi])
                lo = hi
            held = [(points[lo:], ids[lo:], marks[lo:])] if lo < len(ids) else []

        for b in batches:
            points, ids = rows_of(b.column("v"), width), b.column("id").to_numpy()
            marks = b.column("mark").to_numpy()
            if copies is not None and len(ids):
                new = np.concatenate([[last is None or (points[0] != last).any()], (points[1:] != points[:-1]).any(axis=1)])
                first = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -same))
                place = np.arange(len(ids)) - first
                last, same = points[-1].copy(), int(place[-1]) + 1
                points, ids, marks = points[place < copies], ids[place < copies], marks[place < copies]
            if len(ids):
                held.append((points, ids, marks))
            if sum(len(x[1]) for x in held) >= 4 * size:
                yield from full(False)
        if held:
            yield from full(True)

    return vectors.mapInArrow(run, "tree long, ids array<long>, points array<int>, nodes array<double>, center array<double>, radius double, most double")


TREE_NAMES = ["tree", "ids", "points", "nodes", "center", "radius", "most"]
TREE_KINDS = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64()]


def packs(summaries: DataFrame, count: int, name: str) -> DataFrame:
    """(pack, list): the summaries in lists of about ``PACK``."""
    pack = F.pmod(F.xxhash64("tree"), F.lit(max(1, -(-count // PACK)))).cast("int")
    fields = [c for c in ("tree", "center", "radius", "most", "worst") if c in summaries.columns]
    return summaries.groupBy(pack.alias("pack")).agg(F.collect_list(F.struct(*fields)).alias(name))


def compare(groups: DataFrame, blocks: DataFrame, sizes: tuple[int, int], choose: Callable, schema: str) -> DataFrame:
    """What ``choose(groups' fields, blocks' fields)`` gives for each pair of a pack of groups and one of blocks."""
    count = max(1, -(-sizes[0] // PACK))
    left, right = packs(groups, sizes[0], "groups"), packs(blocks, sizes[1], "blocks").withColumnRenamed("pack", "other")
    right = right.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))

    def fields(s: pa.StructArray) -> dict[str, np.ndarray]:
        out = {f.name: s.field(i) for i, f in enumerate(s.type)}
        return {k: rows_of(v, len(v.flatten()) // max(len(v), 1)) if k == "center" else v.to_numpy(zero_copy_only=False) for k, v in out.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                mine, theirs = (fields(b.column(c).slice(i, 1).flatten()) for c in ("groups", "blocks"))
                yield pa.RecordBatch.from_pydict(choose(mine, theirs))

    return right.join(left, "pack").select("groups", "blocks").mapInArrow(run, schema)


def searched(pairs: DataFrame, groups: DataFrame, blocks: DataFrame, width: int, k: int) -> DataFrame:
    """(group, slot, query_id, vec_id, score, own): up to k rows of each query for each (group, block) pair that can
    reach its list. ``groups`` may hold ``floor``, pairs (slot, score)."""
    floor = F.col("floor") if "floor" in groups.columns else F.array().cast("array<struct<slot:int,kth:bigint>>").alias("floor")
    mine = groups.select(F.col("tree").alias("group"), F.struct("ids", "points", "nodes").alias("q"), floor)
    theirs = blocks.select(F.col("tree").alias("block"), F.struct("ids", "points", "nodes").alias("p"))
    both = pairs.join(mine, "group").join(theirs, "block").select("group", "q", "p", "floor")

    def tree(s: pa.StructScalar) -> Tree:
        ids, points, nodes = (s[n].values.to_numpy(zero_copy_only=False) for n in ("ids", "points", "nodes"))
        return Tree(points.reshape(-1, width), ids, nodes.reshape(-1, FIELDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                queries, given = tree(b.column("q")[i]), b.column("floor")[i].as_py()
                least = np.full(len(queries.ids), NONE)
                for f in given:
                    least[f["slot"]] = f["kth"]
                search = Search(queries, k, least)
                search.add(tree(b.column("p")[i]))
                row, col = np.nonzero(search.score > NONE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), b.column("group")[i].as_py(), np.int64)), pa.array(row.astype(np.int32)), pa.array(queries.ids[row]), pa.array(search.id[row, col]), pa.array(search.score[row, col]), pa.array(search.own[row, col])],
                    names=["group", "slot", "query_id", "vec_id", "score", "own"],
                )

    return both.mapInArrow(run, "group long, slot int, query_id long, vec_id long, score long, own boolean")


def first_block(mine: dict, theirs: dict) -> dict:
    """For each group the block whose centre has the greatest inner product with its own."""
    product = mine["center"] @ theirs["center"].T
    best = product.argmax(axis=1)
    return {"group": mine["tree"], "block": theirs["tree"][best], "product": product[np.arange(len(best)), best]}


def open_pairs(mine: dict, theirs: dict) -> dict:
    """The (group, block) pairs whose bound reaches the group's worst k-th score."""
    row, col = np.nonzero(bounds(mine["center"], mine["radius"], mine["most"], theirs["center"], theirs["radius"], theirs["most"]) >= mine["worst"][:, None])
    return {"group": mine["tree"][row], "block": theirs["tree"][col]}


def top_products(vectors: DataFrame, is_query, k: int = TOP, vector: str = "embedding", vec_id: str = "vec_id", scale: int = SCALE, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``is_query`` (a column of the id) holds, the k rows of
    greatest inner product of floor(scale * x), ties to the smaller id, all but the query's own row.

    Null vectors, vectors with null or non-finite components and rows with a null id take no part; shorter vectors
    count as filled up with zeros. Rows that repeat are candidates each, and queries each. Fewer candidates give
    fewer rows; an empty table or no query gives no row. Other columns are not read. Components of 2^27 / scale
    or more are an error.
    """
    spark, need = vectors.sparkSession, k + 1
    whole = vectors.select(F.col(vec_id).cast("long").alias("id"), whole_components(F.col(vector), scale).cast("array<int>").alias("v")).where(F.col("v").isNotNull() & F.col("id").isNotNull())
    found = whole.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = found["n"], found["width"] or 0
    schema = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], schema)
    width = max(width, 1)
    whole = whole.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), F.lit(width) - F.size("v"))))
    most = min(LANDMARKS, -(-n // block))
    drawn = whole.select("v", F.xxhash64("v", "id").alias("h")).orderBy("h", "v").limit(DRAWN * most).collect()  # at most LANDMARKS x DRAWN
    marks = landmarks(np.array([r["v"] for r in drawn], np.int64), most)
    blocks = checkpointed(trees(dealt(whole, marks), width, block, LEAF, need))
    groups = checkpointed(trees(dealt(whole.where(is_query), marks), width, group, QUERY_LEAF))
    sizes = (groups.count(), blocks.count())
    if not sizes[0]:
        return spark.createDataFrame([], schema)

    first = compare(groups, blocks, sizes, first_block, "group long, block long, product double")
    first = checkpointed(first.groupBy("group").agg(F.max_by("block", F.struct("product", "block")).alias("block")))
    begun = checkpointed(searched(first, groups, blocks, width, need))
    kth = begun.groupBy("group", "slot").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == need)
    floor = kth.groupBy(F.col("group").alias("tree")).agg(F.collect_list(F.struct("slot", "kth")).alias("floor"), F.min("kth").alias("least"))
    groups = groups.join(floor, "tree", "left")
    worst = F.when(F.size("floor") == F.size("ids"), F.col("least").cast("double")).otherwise(F.lit(float("-inf")))
    groups = checkpointed(groups.withColumn("worst", worst).withColumn("floor", F.coalesce("floor", F.array())))

    pairs = compare(groups, blocks, sizes, open_pairs, "group long, block long").join(first, ["group", "block"], "left_anti")
    hits = begun.unionByName(searched(pairs, groups, blocks, width, need))
    lists = Window.partitionBy("group", "slot").orderBy(F.desc("score"), "vec_id", F.desc("own"))
    best = hits.withColumn("place", F.row_number().over(lists)).where(F.col("place") <= need)
    met = F.sum(F.col("own").cast("int")).over(lists.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    best = best.withColumn("met", met).where(~(F.col("own") & (F.col("met") == 1)))
    return best.withColumn("rank", F.col("place") - F.least("met", F.lit(1)).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: Ids are unique in the test tables, where the SQL is compared.
ORACLE_SQL = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
    SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM
    (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q, v c WHERE q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id))
    WHERE rank <= {TOP}"""


def top_query(embeddings: DataFrame) -> DataFrame:
    """The contract's lists: queries are the rows whose id is divisible by 100; all else as ``top_products``."""
    return top_products(embeddings, F.col("id") % EVERY == 0)
