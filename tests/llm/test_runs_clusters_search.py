"""Periodic runs, simplex clusters and dual-tree search against plain loops, and their edge cases."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from learnmill.llm import dual_tree, periodic_runs, simplex_clusters
from pyspark.sql import functions as F

WORD = __import__("re").compile(r"[^\x20\x09-\x0D]+")
EMPTY = hashlib.sha256(b"").hexdigest()


def plain_runs(words, min_words=24, min_periods=3):
    """All runs by trying every period."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x = np.array([number[w] for w in words], np.int64)
    found = []
    for q in range(1, len(x) // min_periods + 1):
        same = np.concatenate([[0], (x[q:] == x[:-q]).astype(int), [0]])
        for lo, hi in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1), strict=True):
            start, length = int(lo), int(hi - lo) + q
            stretch = x[start : start + length]
            if length >= max(min_words, min_periods * q) and not any((stretch[p:] == stretch[:-p]).all() for p in range(1, q)):
                found.append((start, length, q))
    return sorted(found)


def random_texts(seed, count):
    r = random.Random(seed)
    texts = []
    for _ in range(count):
        letters = "abcdefgh"[: r.choice([1, 2, 2, 3, 5, 8])]
        words = [r.choice(letters) for _ in range(r.randint(0, 90))]
        while r.random() < 0.7:
            block = [r.choice(letters + "z") for _ in range(r.randint(1, 12))]
            at, size = r.randint(0, len(words)), r.randint(2 * len(block), 6 * len(block) + 10)
            words[at:at] = (block * (size // len(block) + 1))[:size]
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("limits", [(24, 3), (1, 3), (6, 3), (10, 4)])
def test_diagonals_are_all_runs(limits):
    texts = random_texts(5, 500)
    rows = periodic_runs.diagonals(periodic_runs.Words(pa.array(texts)), *limits)
    for d, text in enumerate(texts):
        assert [tuple(r[1:]) for r in rows[rows[:, 0] == d].tolist()] == plain_runs(text.split(), *limits)


def test_long_repetitions_are_quick():
    r = random.Random(1)
    texts = ["a " * 200_000, " ".join(str(i % 997) for i in range(200_000)), " ".join(r.choice("abcdefghij") for _ in range(200_000))]
    assert periodic_runs.diagonals(periodic_runs.Words(pa.array(texts))).tolist() == [[0, 0, 200_000, 1], [1, 0, 200_000, 997]]
    with pytest.raises(ValueError):
        periodic_runs.diagonals(periodic_runs.Words(pa.array(texts)), 24, 2)


def contract(doc_id, text):
    """The row of the query by plain loops."""
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone))]
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digest)


def as_rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


RUN_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_query_is_the_plain_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.length("text") < 20_000).select("doc_id", "text")
    want = [contract(*r) for r in docs.collect()]
    assert len(want) > 900 and sum(r[1] > 0 for r in want) > 50
    assert as_rows(periodic_runs.runs_query(docs.repartition(3)), RUN_COLUMNS) == sorted(want, key=repr)


def test_runs_edges(spark):
    rows = [(1, None), (2, ""), (None, "a b " * 40), (4, " \n\t"), (5, "x y z " * 20 + "end"), (5, "x y z " * 20 + "end"), (6, "é ß 你 " * 9), (7, "a b " * 30)]
    docs = spark.createDataFrame([(*r, 9, "kept") for r in rows], "doc_id long, text string, n_runs int, period string")
    got = periodic_runs.runs_query(docs)
    assert got.columns == RUN_COLUMNS
    assert as_rows(got, RUN_COLUMNS) == sorted((contract(*r) for r in rows), key=repr)
    found = periodic_runs.find_runs(docs, ["doc_id", "n_runs", "period"])
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period"]
    assert sorted(map(repr, found.collect())) == sorted(map(repr, periodic_runs.find_runs(docs.select("doc_id", "text", "n_runs"), ["doc_id", "n_runs"]).collect()))
    cut = {(r["doc_id"], r["text"], r["n_dropped"]) for r in periodic_runs.collapse_runs(docs).collect()}
    assert {(1, None, 0), (2, "", 0), (None, "a b", 78), (4, " \n\t", 0), (5, "x y z end", 57), (6, "é ß 你", 24), (7, "a b", 29)} == cut
    none = docs.limit(0)
    assert not periodic_runs.runs_query(none).count() and not periodic_runs.find_runs(none).count() and not periodic_runs.collapse_runs(none).count()


def clustered(seed, n, groups=12, spread=0.02):
    r = np.random.default_rng(seed)
    return (r.normal(size=(groups, 64))[r.integers(0, groups, n)] + r.normal(size=(n, 64)) * spread).astype(np.float32)


def plain_clusters(rows, k=40, rounds=5):
    """(vec_id, cluster, distance, cluster inertia, inertia, digest) by plain integers."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]
    points = np.array([v for _, v in kept], np.int64).reshape(-1, 64)

    def assign():
        c = np.array(centroids, np.int64)
        d = ((points[:, None, :] - c) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds if kept else 0):
        best, _ = assign()
        centroids = [[int(s) // int((best == j).sum()) for s in points[best == j].sum(axis=0)] if (best == j).any() else c for j, c in enumerate(centroids)]
    if not kept:
        return []
    best, distance = assign()
    return [
        (i, int(b), int(d), int(distance[best == b].sum()), int(distance.sum()), hashlib.sha256(",".join(map(str, centroids[b])).encode()).hexdigest())
        for (i, _), b, d in zip(kept, best, distance, strict=True)
    ]


CLUSTER_COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
VECTORS = "vec_id long, embedding array<float>"


def test_clusters_are_the_plain_ones_and_bounds_filter(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(3, 900))]
    found = simplex_clusters.cluster(spark.createDataFrame(rows, VECTORS).repartition(5))
    assert as_rows(found, CLUSTER_COLUMNS) == sorted(plain_clusters(rows), key=repr)
    assert found.first()["compared"] < 10  # of 40


def test_clusters_edges(spark):
    v = clustered(4, 30).tolist()
    rows = [(i, x) for i, x in enumerate(v)] + [
        (30, None), (31, []), (32, v[0][:63]), (33, [*v[0][:63], None]), (34, [*v[0][:63], float("nan")]), (35, [*v[0][:63], float("inf")]),
        (36, v[0] + [0.0]), (3, v[3]), (3, v[3]), (3, v[4]), (None, v[5]), (37, [0.0] * 64), (38, [-0.001] * 64),
    ]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS + ", cluster int, inertia string")
    got = simplex_clusters.clusters_query(table)
    assert got.columns == CLUSTER_COLUMNS
    assert as_rows(got, CLUSTER_COLUMNS) == sorted(plain_clusters(rows), key=repr)
    assert simplex_clusters.clusters_query(table.limit(0)).columns == CLUSTER_COLUMNS and not simplex_clusters.clusters_query(table.where("vec_id in (30, 31)")).count()
    copies = spark.createDataFrame([(i, v[0]) for i in range(500)], VECTORS)
    assert as_rows(simplex_clusters.clusters_query(copies), CLUSTER_COLUMNS) == sorted(plain_clusters([(i, v[0]) for i in range(500)]), key=repr)
    with pytest.raises(Exception, match="2\\^27"):
        simplex_clusters.clusters_query(spark.createDataFrame([(1, [1e9] * 64)], VECTORS)).count()


def test_simplex_bounds_hold():
    r = np.random.default_rng(2)
    points = r.integers(-300, 300, size=(300, 64))
    s = simplex_clusters.Simplex.over(points[:40])
    apex = s.apexes(simplex_clusters.squared(points, s.pivots))
    true = np.sqrt(simplex_clusters.squared(points, points).astype(float))
    flat = ((apex[:, None, :-1] - apex[None, :, :-1]) ** 2).sum(axis=2)
    assert (np.sqrt(flat + (apex[:, None, -1] - apex[None, :, -1]) ** 2) <= true + 1e-4).all()
    assert (np.sqrt(flat + (apex[:, None, -1] + apex[None, :, -1]) ** 2) >= true - 1e-4).all()


def plain_top(rows, every=100, k=10):
    usable = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(usable):
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for other, (j, v) in enumerate(usable) if other != at)
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return out


TOP_COLUMNS = ["query_id", "rank", "vec_id", "score"]


@pytest.mark.parametrize("shape", ["clusters", "uniform", "hot"])
def test_search_is_the_plain_one(spark, shape):
    r = np.random.default_rng(8)
    v = {"clusters": clustered(1, 700), "uniform": r.normal(size=(700, 64)).astype(np.float32), "hot": clustered(2, 700)}[shape]
    if shape == "hot":
        v[:260] = v[0]
        v[300:310] = -v[0]
    rows = [(int(i), x.tolist()) for i, x in zip(r.permutation(2000), v, strict=False)]
    table = spark.createDataFrame(rows, VECTORS).repartition(4)
    want = sorted(plain_top(rows, 20), key=repr)
    for block, group in ((64, 8), (2048, 256)):
        got = dual_tree.top_products(table, F.col("id") % 20 == 0, block=block, group=group)
        assert as_rows(got, TOP_COLUMNS) == want


def test_trees_cover_and_prune():
    v = np.floor(clustered(6, 3000, 30) * 1024).astype(np.int32)
    tree = dual_tree.cover_tree(v, np.arange(3000))
    for i in range(len(tree.nodes)):
        away = np.sqrt(((tree.real[tree.lo[i] : tree.hi[i]] - tree.centers[i]) ** 2).sum(axis=1))
        assert away.max() <= tree.radius[i] + 1e-6
        below = tree.centers[tree.child[i] : tree.child[i] + tree.children[i]]
        apart = np.sqrt(((below[:, None] - below) ** 2).sum(axis=2)) + np.eye(len(below)) * 1e9
        assert not len(below) or apart.min() > tree.radius[i] / dual_tree.BASE * (1 - 1e-6)
    queries = dual_tree.cover_tree(v[:100], np.arange(100), dual_tree.QUERY_LEAF)
    search = dual_tree.Search(queries, 11)
    search.add(tree)
    assert search.compared < 0.5 * 100 * 3000
    exact = queries.points.astype(np.int64) @ v.astype(np.int64).T
    for row in range(100):
        best = np.lexsort((np.arange(3000), -exact[row]))[:11]
        assert search.id[row].tolist() == best.tolist() and search.score[row].tolist() == exact[row][best].tolist()


def test_search_edges(spark):
    v = clustered(4, 6).tolist()
    rows = [
        (0, v[0]), (100, v[1]), (100, v[1]), (100, v[2]), (1, v[0]), (2, v[0]), (None, v[0]), (3, None), (200, None), (4, [*v[0][:63], None]),
        (300, [*v[0][:63], float("nan")]), (5, [float("inf")] * 64), (6, []), (400, []), (7, v[3][:10]), (-100, v[4]), (8, [1e4] * 64),
    ]
    table = spark.createDataFrame([(*r, 5, "q") for r in rows], VECTORS + ", rank int, score string")
    got = dual_tree.top_query(table)
    assert got.columns == TOP_COLUMNS and as_rows(got, TOP_COLUMNS) == sorted(plain_top(rows), key=repr)
    assert not dual_tree.top_query(table.limit(0)).count() and not dual_tree.top_query(table.where("vec_id = 1")).count()
    assert not dual_tree.top_query(table.where("vec_id = 0")).count()
    assert as_rows(dual_tree.top_query(table.where("vec_id in (0, 1)")), TOP_COLUMNS) == sorted(plain_top([rows[0], rows[4]]), key=repr)


def test_copies_are_numbered_whole(spark, monkeypatch):
    from learnmill.llm import common

    monkeypatch.setattr(common, "COPIES", 3)
    rows = spark.createDataFrame([("a", 1), ("b", 3), ("c", 10)], "x string, copies long")
    got = sorted((r["x"], r["j"]) for r in common.numbered_copies(rows, "copies", "j").collect())
    assert got == [("a", 0)] + [("b", j) for j in range(3)] + [("c", j) for j in range(10)]
