"""Work that grows no faster than the input: what meets, what is kept, what a task holds."""

import numpy as np
from learnmill.operators import graph as G
from learnmill.operators import grounding as K
from learnmill.operators import mastery as M
from learnmill.operators import vectors
from learnmill.plans import fixtures as V
from pyspark.sql import functions as F

EDGE = "start_node_id long, end_node_id long, edge_label string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_queries_meet_the_first_names_of_a_word_only(spark, monkeypatch):
    """40 queries of two words that all of 300 names have: a few rows a query, not 600."""
    nodes = spark.createDataFrame([(i, f"Bright thing {i // 2}") for i in range(300)], "node_id long, label string")
    edges = spark.createDataFrame([(i, (i * 7 + j) % 300, "X") for i in range(300) for j in range(9)], EDGE)
    asked = spark.createDataFrame([(i, "explain bright thing") for i in range(40)], "message_id long, message string")
    met, inner = [], G.best_of_seeds

    def spy(rows, k, key="message_id", **more):
        if key == "message_id":
            met.append(rows.count())
        return inner(rows, k, key, **more)

    monkeypatch.setattr(G, "best_of_seeds", spy)
    got = K.search_concepts_of_query(asked, nodes, edges).collect()
    assert max(met) <= 40 * 2 * 3
    assert {(r["concept"], r["rank"]) for r in got} == {("Bright thing 0", 1), ("Bright thing 1", 2), ("Bright thing 2", 3)}
    assert len(got) == 40 * 3 * 5 and {r["nth"] for r in got} == {1, 2, 3, 4, 5}


def test_paths_keep_two_balls_of_half_the_distance(spark, monkeypatch):
    rng = np.random.default_rng(3)
    steps = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 4000, (12_000, 2))], "src long, dst long")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, 400, 20)], "a long, b long")
    kept, grow = [], G.Layers.grow

    def spy(self, keys):
        out = grow(self, keys)
        kept.append(self.rows)
        return out

    monkeypatch.setattr(G.Layers, "grow", spy)
    got = {(r["a"], r["b"]): len(r["path"]) - 1 for r in G.paths(pairs, steps).collect()}
    assert 0 < len(got) <= 20 and sum(kept) < 20 * 4000 / 4


def test_paths_need_no_second_walk_and_sides_are_chosen_by_open_pairs(spark, monkeypatch):
    """A pair without a path ends on its short side, whatever a pair that has met left there; a round writes three tables."""
    rows = [(i, i + 1) for i in range(0, 60, 2)] + [(i, i + 3) for i in range(0, 60, 2)] + [(i + 1, i + 2) for i in range(0, 60, 2)] + [(i + 1, i + 3) for i in range(0, 60, 2)]
    rows += [(1000 + i, 1001 + i) for i in range(3)]
    rows += [(2000, 2001 + i) for i in range(2)] + [(2001 + i, 2100) for i in range(50)] + [(2500, 2001 + i) for i in range(50)] + [(2100, 2101), (2000, 1500)]
    steps = spark.createDataFrame(rows, "src long, dst long")
    grown, written = [], []
    grow, write = G.Layers.grow, G.Shelf.write
    monkeypatch.setattr(G.Layers, "grow", lambda self, keys: grown.append(1) or grow(self, keys))
    monkeypatch.setattr(G.Shelf, "write", lambda self, df: written.append(1) or write(self, df))
    pairs = spark.createDataFrame([(0, 1003), (2000, 2101)], "a long, b long")
    assert [tuple(r) for r in G.paths(pairs, steps).collect()] == [(2000, 2101, [2000, 2001, 2100, 2101])]
    assert len(grown) <= 10 and len(written) <= 5 + 3 * len(grown)


def test_cosines_are_held_in_tiles(spark, sf_dir, monkeypatch):
    e, q = V.table(spark, sf_dir, "embeddings"), V.query_vectors(spark, sf_dir)
    row = lambda r: (r["query_id"], r["key"], round(r["similarity"], 9), r["rank"])
    want = sorted(map(row, vectors.many_top_k(e, q, 5).collect()))
    ids = np.arange(4096)
    rng = np.random.default_rng(1)
    matrix, rows = rng.normal(size=(4096, 8)), rng.normal(size=(3000, 8))
    held, inner = [], vectors.BlockTop.merge
    monkeypatch.setattr(vectors.BlockTop, "merge", lambda self, keys, scores: held.append(scores.size) or inner(self, keys, scores))
    top = vectors.BlockTop(ids, matrix, 3, None)
    top.add(np.arange(3000), rows)
    assert max(held) <= 1 << 21
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    best = np.argsort(-(unit(matrix) @ unit(rows).T), axis=1)[:, :3]
    assert all(list(top.best[i][1]) == list(best[i]) for i in range(4096))
    monkeypatch.setattr(vectors.BlockTop, "merge", inner)
    joined = vectors.joined_top_k(e, q, 5)
    assert sorted(map(row, joined.collect())) == want
    assert "NestedLoop" not in plan(joined) and "Cartesian" not in plan(joined)


def test_cells_meet_their_queries_in_blocks(spark, sf_dir, monkeypatch):
    e, q = V.table(spark, sf_dir, "embeddings"), V.query_vectors(spark, sf_dir)
    cells, model = vectors.build_cells(e, 4)
    row = lambda r: (r["query_id"], r["key"], round(r["similarity"], 9), r["rank"])
    exact = sorted(map(row, vectors.many_top_k(e, q, 5).collect()))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vectors, "PART_ROWS", 40)
    found = vectors.probe_cells(cells, model, q, 5, 4)
    assert sorted(map(row, found.collect())) == exact
    assert "CoGroup" in plan(found)


def test_next_steps_join_learners_last(spark):
    """The rows of a plain division for each user, and no shuffle of a row for each user and node."""
    rng = np.random.default_rng(5)
    edges = spark.createDataFrame([(int(a), int(b), "X") for a, b in rng.integers(0, 60, (90, 2))], EDGE)
    states = spark.createDataFrame([(u, f"s{k}", float(rng.choice([0.5, 0.95]))) for u in range(30) for k in range(5)], "user_id long, skill_id string, probability_mastery double")
    concepts = spark.createDataFrame([(f"s{n % 5}", n) for n in range(50)] + [("s1", n) for n in range(0, 50, 7)], "skill_id string, node long")
    known = states.where("probability_mastery > 0.9").join(concepts, "skill_id").select(F.col("user_id").alias("learner"), "node")
    want = sorted(map(tuple, G.knowledge_gaps(edges, known).collect()))
    got = G.next_steps(states, concepts, edges)
    assert sorted(map(tuple, got.collect())) == want and want
    assert "hashpartitioning" not in plan(got)


def shuffled(spark, run):
    """Rows that ``run`` writes to shuffles."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def written():
        context.listenerBus().waitUntilEmpty()
        lists = gateway.jvm.java.util.ArrayList
        stages = context.statusStore().stageList(lists(), False, False, gateway.new_array(gateway.jvm.double, 0), lists())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    run()
    return written() - before


def test_next_steps_of_more_learners_than_a_broadcast_holds(spark, monkeypatch):
    """Lists of learners and of nodes are shuffled, not a row for each node and set of skills; no row is lost or doubled."""
    edges = spark.createDataFrame([(n % 6, n, "X") for n in range(10, 3010)], EDGE)
    states = spark.createDataFrame([(u, f"s{k}", 0.95) for u in range(630) for k in range(6) if (u % 63 + 1) >> k & 1], "user_id long, skill_id string, probability_mastery double")
    concepts = spark.createDataFrame([(f"s{n}", n) for n in range(6)], "skill_id string, node long")
    want = sorted((u, n) for u in range(630) for n in range(10, 3010) if (u % 63 + 1) >> n % 6 & 1)
    monkeypatch.setattr(G, "BROADCAST_LEARNERS", 0)
    monkeypatch.setattr(G, "LIST_IDS", 64, raising=False)
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = G.next_steps(states, concepts, edges)
        assert shuffled(spark, lambda: got.write.format("noop").mode("overwrite").save()) < 10_000
        assert sorted(map(tuple, got.collect())) == want
        assert "Coalesce" in plan(got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)


def test_limits_are_laid_on_rounded_means(spark):
    """Means of 0.55 and 0.85 whose sums in doubles are a little off."""
    rows = [("a", x) for x in (0.4, 0.55, 0.7)] + [("b", x) for x in (0.7, 0.8500000000000001, 1.0)]
    rows = [(u, f"s{i}", p, 9, 1) for i, (u, p) in enumerate(rows)]
    states = spark.createDataFrame(rows, "user_id string, skill_id string, probability_mastery double, total_attempts long, last_attempt_us long")
    cards = {r["user_id"]: r for r in M.class_mastery(states).collect()}
    assert (cards["a"]["avg_mastery"], cards["b"]["avg_mastery"]) == (0.55, 0.85)
    assert cards["b"]["overall_status"] == "LEARNING"
    assert [r["user_id"] for r in M.class_mastery(states, True, 0.55).collect()] == ["a"]
    assert M.class_totals(M.class_mastery(states)).first()["ready"] == 0


def test_components_of_a_graph_that_hangs_together_need_few_rounds(spark, monkeypatch):
    """Labels walk only what is left beside the large component, and the edges are read once."""
    from collections import defaultdict

    rng = np.random.default_rng(7)
    pairs = [(int(a) + off, int(b) + off) for off in (0, 1000) for a, b in rng.integers(0, 300, (700, 2))] + [(2000, 2001), (2001, 2002), (2002, 2000)]
    nodes = spark.createDataFrame([(i,) for i in [*range(300), *range(1000, 1300), *range(2000, 2004)]], "node_id long")
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([(a, b, "X") for a, b in pairs], EDGE).mapInArrow(counted, EDGE)
    sizes, inner = [], G.least_labels
    monkeypatch.setattr(G, "least_labels", lambda ids, steps: sizes.append(ids.count()) or inner(ids, steps))
    row = G.statistics(nodes, edges).first()
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)

    def seen(a):
        got, todo = {a}, [a]
        while todo:
            for b in out[todo.pop()] - got:
                got.add(b)
                todo.append(b)
        return got

    ids = [r["node_id"] for r in nodes.collect()]
    far = {a: seen(a) for a in ids}
    assert row["strong_components"] == len({min(b for b in far[a] if a in far[b]) for a in ids})
    assert (row["nodes"], row["relationships"], row["weakly_connected"]) == (604, len(pairs), False)
    assert reads.value == len(pairs) and sum(sizes) < 60


def test_trigrams_are_numbers_of_whole_characters(spark, tmp_path):
    from learnmill.operators import grams

    texts = ["Banana\n\x00a", "😀b😀b", None, "ab", "ÄÖÜ ana"]
    rows = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "id int, text string, again string")
    grams.write_grams(rows, str(tmp_path / "g"), "id", ["text", "again"])
    lists = spark.read.parquet(str(tmp_path / "g"))
    sign = lambda n: "".join(chr(n >> s & 0x1FFFFF) for s in (42, 21, 0))
    want = sorted({(t.lower()[i : i + 3], k) for k, t in enumerate(texts) if t for i in range(len(t) - 2)})
    assert sorted((sign(r["gram"]), r["key"]) for r in lists.collect()) == want
    assert [r["key"] for r in grams.candidates(spark, str(tmp_path / "g"), "ANA").orderBy("key").collect()] == [0, 4]
    assert lists.schema["key"].dataType.simpleString() == "int"


class Value:
    """A state value that counts its calls."""

    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.value, self.calls = value, self.calls + 1

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.state, self.timers = Value(), []

    def getValueState(self, *_):
        return self.state

    def registerTimer(self, at):
        self.timers.append(at)


def test_a_user_reads_and_writes_one_value_a_batch():
    import pandas as pd
    from learnmill.streaming import stateful as T

    handle, cards = Handle(), T.LiveCards()
    cards.init(handle)
    rows = pd.DataFrame({"us": range(40), "event_id": range(40), "skill_id": [f"s{i % 8}" for i in range(40)], "is_correct": [True] * 40, "attempts": [1] * 40})
    first = pd.concat(cards.handleInputRows(("u",), iter([rows]), None))
    again = pd.concat(cards.handleInputRows(("u",), iter([rows]), None))
    assert handle.state.calls == 4 and list(first["sign"]) == [1] and list(again["sign"]) == [-1, 1]
    assert again.iloc[0].drop("sign").tolist() == first.iloc[0].drop("sign").tolist()
    handle, batches = Handle(), T.ClickBatches(3, 10)
    batches.init(handle)
    list(batches.handleInputRows(("u",), iter([rows[["us", "event_id"]]]), None))
    assert handle.state.calls == 2 and len(handle.timers) == 1


def test_the_mastery_stream_is_dealt_by_user(spark, sf_dir):
    from learnmill.plans import queries as base
    from learnmill.streaming import streams as S

    text = S.mastery_stream(base.event_stream(spark, sf_dir))._jdf.queryExecution().analyzed().toString()
    line = next(x for x in text.split("\n") if "WithState" in x)
    assert "user_id" in line.split("walk")[0] + line and "[skill_id" not in line and S.STATE.startswith("skills array")


def test_topics_of_two_subjects_are_one_scan(spark, sf_dir):
    from learnmill.operators import questions as Q
    from learnmill.plans.queries import QUERIES

    assert plan(QUERIES["a9_topics"](spark, sf_dir)).count("FileScan") == 1
    rows = spark.createDataFrame([("An ATOM and a gene of a cell",), ("nothing",), (None,)], "t string")
    got = rows.select(Q.subject_by_votes(F.col("t")).alias("s"), Q.topic(F.col("t")).alias("x")).collect()
    assert [tuple(r) for r in got] == [("Biology", "Genetics"), ("Biology", None), ("Physics", None)]


def test_chunking_bounds_its_batches(spark):
    from learnmill.operators import text

    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch",)}
    for k in before:
        spark.conf.unset(k)
    text.chunk_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).count()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_patterns_and_their_sql_know_words_digits_and_spaces_of_unicode(spark, tmp_path):
    from learnmill.plans.queries import ORACLES, QUERIES

    from .oracle import differences

    texts = ["+1 (467) 555-3280 zuch stöbe", "3280 zuch st.", "éab@cd.ef é_ab@cd.ef", "٣٤٥-67-8901 é123-45-6789", "555 123 4567 5551234567é", "12 main drıve, 1 maın ſt", "foo saidbar said foé said @usKr", "a‍b@cd.ef 12́ elm st 1.2.3.4́", "", None]
    folder = str(tmp_path)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    got = QUERIES["a21_pattern_counts"](spark, folder)
    assert differences(got, ORACLES["a21_pattern_counts"], folder) == ""
    assert [r["address"] for r in got.orderBy("doc_id").collect()] == [0, 1, 0, 0, 0, 2, 0, 0, 0, 0]
