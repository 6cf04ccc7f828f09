"""Nothing is lost beyond a bound: long chains and paths, long names, many queries, hot keys."""

from learnmill.operators import graph as G
from learnmill.operators import mastery as M
from learnmill.operators import seed, vectors
from learnmill.plans import fixtures as V
from pyspark.sql import functions as F

EDGE = "start_node_id long, end_node_id long, edge_label string"


def chain(spark, n, back=False):
    rows = [(i, i + 1, "NEXT") for i in range(n)] + ([(n, 0, "NEXT")] if back else [])
    return spark.createDataFrame(rows, EDGE), spark.range(n + 1).select(F.col("id").alias("node_id"))


def test_weak_component_of_a_long_chain(spark):
    edges, nodes = chain(spark, 300)
    lone = nodes.unionByName(spark.createDataFrame([(1000,)], "node_id long"))
    got = {r["node"]: r["label"] for r in G.weak_components(lone.select(F.col("node_id").alias("node")), edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000}


def test_least_labels_and_reach_have_no_round_limit(spark):
    edges, nodes = chain(spark, 102)
    steps = G.arrows(edges)
    assert {r["label"] for r in G.least_labels(nodes.select(F.col("node_id").alias("node")), steps).collect()} == {0}
    seeds = spark.createDataFrame([(70,)], "seed long")
    assert G.bfs(seeds, steps).agg(F.max("depth")).first()[0] == 32
    assert G.bfs(seeds, steps, 3).count() == 3


def test_strong_component_of_a_ring(spark):
    edges, nodes = chain(spark, 20, back=True)
    assert G.strong_components(nodes, edges).select("component").distinct().count() == 1
    row = G.statistics(nodes, edges).first()
    assert row["weakly_connected"] and row["strong_components"] == 1


def test_a_path_of_twelve_hops(spark):
    edges, _ = chain(spark, 12)
    pairs = spark.createDataFrame([(0, 12), (12, 0), (5, 5)], "a long, b long")
    got = {(r["a"], r["b"]): list(r["path"]) for r in G.learning_paths(edges, pairs).collect()}
    assert got == {(0, 12): list(range(13)), (5, 5): [5]}
    assert G.learning_paths(edges, pairs, 11).where("a = 0").count() == 0


def test_paths_are_shortest_and_least(spark, sf_dir):
    """A plain breadth-first search over the whole graph, the least path among equals."""
    edges = V.edges(spark, sf_dir)
    out = {}
    for r in edges.collect():
        out.setdefault(r["start_node_id"], set()).add(r["end_node_id"])
    starts = sorted(s for s in out if s % 50 == 0)
    got = {r["a"]: list(r["path"]) for r in G.learning_paths(edges, spark.createDataFrame([(s, s + 1) for s in starts], "a long, b long")).collect()}
    for s in starts:
        layer, seen = {s: [s]}, {s}
        while layer and s + 1 not in layer:
            nxt = {}
            for n, path in layer.items():
                for m in out.get(n, ()):
                    if m not in seen and (m not in nxt or path + [m] < nxt[m]):
                        nxt[m] = path + [m]
            seen |= set(nxt)
            layer = nxt
        assert got.get(s) == layer.get(s + 1)


def test_names_of_any_length_are_found(spark):
    messages = spark.createDataFrame([(1, "Tell me of the Law of Conservation of Mass, please."), (2, "mass of law"), (3, None), (4, "")], "message_id long, message string")
    names = spark.createDataFrame([("Law of conservation of mass",), ("mass",), ("",), (None,)], "label string")
    got = {(r["message_id"], r["concept"]) for r in G.concepts_in_text(messages, names).collect()}
    assert got == {(1, "Law of conservation of mass"), (1, "mass"), (2, "mass")}
    assert G.concepts_in_text(messages, names.where("false")).count() == 0


def test_more_queries_than_a_block(spark, sf_dir, monkeypatch):
    e, q = V.table(spark, sf_dir, "embeddings"), V.query_vectors(spark, sf_dir)
    row = lambda r: (r["query_id"], r["key"], round(r["similarity"], 9), r["rank"])
    want = sorted(map(row, vectors.many_top_k(e, q, 5).collect()))
    limited = sorted(map(row, vectors.many_top_k(e, q, 5, 0.3).collect()))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vectors, "PART_ROWS", 100)
    assert sorted(map(row, vectors.many_top_k(e, q, 5).collect())) == want
    assert sorted(map(row, vectors.many_top_k(e, q, 5, 0.3).collect())) == limited
    assert sorted(map(row, vectors.joined_top_k(e, q, 5).collect())) == want


def test_states_of_one_hot_key(spark):
    """Fifty thousand answers of one pupil in one skill, dealt out of order, beside a few of others."""
    n = F.col("id")
    rows = spark.range(50_000).select(n.alias("event_id"), F.lit("a").alias("user_id"), F.lit("s").alias("skill_id"), (n % 3 != 0).alias("is_correct"), F.lit(1).alias("attempts"), F.timestamp_seconds((n * 7919) % 50_000).alias("timestamp"))
    rows = rows.unionByName(rows.where("event_id < 5").withColumn("user_id", F.lit("b")))
    got = {r["user_id"]: r for r in M.rule_states(rows).collect()}
    p, right = 0.5, 0
    for t in sorted(range(50_000), key=lambda i: (i * 7919) % 50_000):
        hit = t % 3 != 0
        p, right = (min(1.0, p + 0.1), right + 1) if hit else (max(0.0, p - 0.05), right)
    assert (got["a"]["probability_mastery"], got["a"]["correct_attempts"], got["a"]["total_attempts"]) == (p, right, 50_000)
    assert got["b"]["total_attempts"] == 5 and M.rule_states(rows.where("false")).count() == 0


def test_seed_rows_have_their_descriptions(spark):
    nodes, edges = seed.seed_nodes(spark), seed.seed_edges(spark)
    assert (nodes.count(), edges.count()) == (44, 56)
    one = nodes.where("label = 'Glucose'").select(F.get_json_object("properties", "$.description"), G.domain()).first()
    assert tuple(one) == ("Sugar produced during photosynthesis", "Biology")
    assert edges.where(F.get_json_object("properties", "$.importance") == "high").count() == 5


def test_trigrams_find_the_same_rows(spark, sf_dir, tmp_path):
    """For every kind of query the rows of a full search, and few candidates for a rare one."""
    from learnmill.operators import grams
    from learnmill.operators import questions as Q

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text", "source")
    rows = rows.unionByName(spark.createDataFrame([(10_001, None, None), (10_002, "xy", "s"), (10_003, "Ünïcode Öffnung 100% a_b", "s")], rows.schema))
    path = str(tmp_path / "grams")
    grams.write_grams(rows, path, "id", ["text", "source"])
    for query in ("tion", "Öffn", "100%", "a_b", "xy", "zzzzqqq", "src1", "e a"):
        got = [r["id"] for r in grams.search_grams(rows, path, "id", query, ["text", "source"], 5000).collect()]
        assert got == [r["id"] for r in Q.search(rows, query, ["text", "source"], 5000, "id").collect()], query
    assert grams.candidates(spark, path, "öffnung").count() == 1
