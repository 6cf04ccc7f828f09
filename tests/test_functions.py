import pytest
from learnmill.functions import scalar as X
from learnmill.functions import sql
from learnmill.operators import graph as G
from learnmill.operators import grounding as K
from learnmill.operators import mastery as M
from learnmill.operators import quality
from learnmill.operators import text as T
from learnmill.operators.seed import seed_edges, seed_nodes
from learnmill.plans import fixtures as V
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_strings(spark):
    assert one(spark, X.safe_title(F.lit("Über: Cells & more,  a-b " + "x" * 60))) == ("Über_Cells_more_a-b_" + "x" * 60)[:50]
    assert [one(spark, X.chapter_number(F.lit(x))) for x in ("book-Chapter12-1", "chapter", "")] == [12, 0, 0]
    assert [one(spark, X.book_subject(F.lit(x))) for x in ("American-Government-3e", "biology-2e", "prealgebra", "art")] == ["government", "biology", "mathematics", "general"]
    assert one(spark, X.concept_id(F.lit("b"), F.lit(" Cell\nWall "))) == "b_cell_wall"
    assert one(spark, X.truncate(F.lit("abcdef"), 3)) == "abc..." and one(spark, X.truncate(F.lit("abc"), 3)) == "abc"


def test_full_text(spark):
    sub = F.array(F.struct(F.lit("s1").alias("title"), F.lit("c1").alias("content")))
    sections = F.array(F.struct(F.lit("S").alias("title"), F.lit("C").alias("content"), sub.alias("subsections")))
    assert one(spark, T.full_text(F.lit("body"), sections)) == "body\n\nS\nC\n\ns1\nc1"


def test_sql_functions(spark, sf_dir):
    sql.register(spark)
    row = spark.sql("select mastery_status(0.5D, 4) a, mastery_status(0.95D, 1) b, mastery_prediction(0.826087D) p, needs_intervention(0.5D, 4, 2) n, mask_student_id('student-uuid-001', 'external') m, cosine_similarity(array(1D, 0D), array(0D, 0D)) z, cosine_similarity(array(3D, 4D), array(3D, 4D)) o").first()
    assert (row["a"], row["b"], row["n"], row["m"], row["z"], row["o"]) == ("STRUGGLING", "MASTERED", True, "student-...", 0.0, 1.0)
    assert row["p"] == pytest.approx(0.819565, abs=1e-6)
    states = M.rule_states(V.learning_events(spark, sf_dir))
    states.createOrReplaceTempView("student_skills")
    V.skills(spark, sf_dir).createOrReplaceTempView("skills_registry")
    name = sql.register_student_report(spark)
    assert spark.sql(f"select * from {name}('3')").count() == states.where("user_id = 3").count() > 0


def test_searches_from_vectors_into_the_graph(spark):
    nodes, edges = seed_nodes(spark), seed_edges(spark)
    chunks = spark.createDataFrame([(1, ["Cell", "Energy"]), (2, ["Photosynthesis", "Atom"]), (3, [])], "chunk_id long, key_concepts array<string>")
    hits = spark.createDataFrame([(9, 1, 1, 0.9), (9, 2, 2, 0.8), (9, 3, 3, 0.7)], "query_id long, key long, rank int, similarity double")
    near = K.graph_search(hits, chunks, nodes, edges, 3).collect()
    assert [r["node"] for r in sorted(near, key=lambda r: (-r["score"], r["node"]))] == [2, 3, 4]
    paths = {r["key"]: r["names"] for r in K.path_search(hits, chunks, nodes, edges).collect()}
    assert paths == {1: ["Cell", "Chloroplast", "Photosynthesis", "Energy"], 2: ["Photosynthesis", "Molecule", "Atom"]}
    rich = {r["key"]: r["neighbours"] for r in K.enriched_hits(hits, chunks, nodes, edges).collect()}
    assert len(rich[1]) == 4 and rich[3] is None


def test_next_steps_and_chapter_edges(spark):
    states = spark.createDataFrame([("u", "a", 0.95), ("u", "b", 0.5)], "user_id string, skill_id string, probability_mastery double")
    of = spark.createDataFrame([("a", 20), ("b", 1)], "skill_id string, node long")
    assert {r["node"] for r in G.next_steps(states, of, seed_edges(spark)).collect()} == {22, 23}
    rows = spark.createDataFrame([("b", "x", 1), ("b", "y", 2), ("b", "x", 2), ("b", "z", 4)], "book_id string, concept_id string, chapter int")
    assert {(r["source_id"], r["target_id"]) for r in G.chapter_prerequisites(rows).collect()} == {("x", "y"), ("y", "z")}


def test_rules(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 1.5), (2, None)], "i int, probability_mastery double").withColumns({"total_attempts": F.lit(3), "correct_attempts": F.lit(2)})
    good, bad = quality.split_by_rules(df, quality.state_rules())
    assert good.count() == 1 and {tuple(r["reasons"]) for r in bad.collect()} == {("probability_mastery",)}
    assert quality.duplicate_keys(df, ["i"]).first()["n"] == 2
    a, b = quality.with_references(df, "i", spark.createDataFrame([(1,)], "id int"), "id")
    assert (a.count(), b.count()) == (1, 2)
