"""Concept graph: nodes (graph_name, node_id, label, properties) and edges (start_node_id,
end_node_id, edge_label). Traversals run as frontier joins; each round is checkpointed."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from learnmill.functions.scalar import concept_id


def shared_root(spark: SparkSession) -> str:
    """The session's shared checkpoint folder. Where none is set, a local session makes one of its own; on
    a cluster that is an error, since executors and driver share no other folder."""
    context = spark.sparkContext
    made = context._jsc.sc().getCheckpointDir()
    root = spark.conf.get("spark.checkpoint.dir", None) or (made.get() if made.isDefined() else None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not made.isDefined():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def pinned(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and cut from its lineage."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def domain(properties: str = "properties"):
    return F.get_json_object(properties, "$.domain")


def nodes_in_domain(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(domain() == name)


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, edge_label, direction): every edge from either end."""
    out = edges.select(F.col("start_node_id").alias("src"), F.col("end_node_id").alias("dst"), "edge_label", F.lit("outgoing").alias("direction"))
    back = edges.select(F.col("end_node_id").alias("src"), F.col("start_node_id").alias("dst"), "edge_label", F.lit("incoming").alias("direction"))
    return out.unionByName(back)


def arrows(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("start_node_id").alias("src"), F.col("end_node_id").alias("dst")).distinct()


def labelled_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each edge with the labels and domains of both ends, within its graph."""
    a = nodes.select("graph_name", F.col("node_id").alias("start_node_id"), F.col("label").alias("start_label"), domain().alias("start_domain"))
    b = nodes.select("graph_name", F.col("node_id").alias("end_node_id"), F.col("label").alias("end_label"), domain().alias("end_domain"))
    return edges.join(a, ["graph_name", "start_node_id"]).join(b, ["graph_name", "end_node_id"])


def concept_context(nodes: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """Neighbours of a concept: the other end, the type, the direction."""
    rows = labelled_edges(nodes, edges)
    out = rows.where(F.col("start_label") == label).select(F.col("end_label").alias("related_concept"), F.col("edge_label").alias("relationship_type"), F.lit("outgoing").alias("direction"))
    back = rows.where((F.col("end_label") == label) & (F.col("start_label") != label)).select(F.col("start_label").alias("related_concept"), F.col("edge_label").alias("relationship_type"), F.lit("incoming").alias("direction"))
    return out.unionByName(back)


def relationships(nodes: DataFrame, edges: DataFrame, label: str, limit: int = 20) -> DataFrame:
    return concept_context(nodes, edges, label).select("related_concept", "relationship_type").orderBy("related_concept", "relationship_type").limit(limit)


def cross_domain(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    rows = labelled_edges(nodes, edges).where("start_domain <> end_domain")
    return rows.select("start_label", "start_domain", "edge_label", "end_label", "end_domain").distinct()


def bfs(seeds: DataFrame, steps: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(seed, node, depth) of what each seed reaches over ``steps`` (src, dst), least depth, without
    the seed itself; to any depth if none is given. ``seeds`` has column ``seed``. What is kept has a row
    for each seed and node reached: bound the seeds or the depth on graphs that hang together."""
    start = seeds.select("seed").distinct()
    seen = pinned(start.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")))
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        nxt = frontier.join(steps, frontier["node"] == steps["src"]).select("seed", F.col("dst").alias("node")).distinct()
        nxt = nxt.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth))
        frontier = pinned(nxt)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % 8 == 0:  # one table again, so that the plan stays short
            seen = pinned(seen)
    return seen.where("depth > 0")


def prerequisites(edges: DataFrame, seeds: DataFrame, depth: int = 3, kind: str | None = None) -> DataFrame:
    """(seed, node, depth) over incoming edges, of one type or all."""
    kept = edges if kind is None else edges.where(F.col("edge_label") == kind)
    return bfs(seeds, kept.select(F.col("end_node_id").alias("src"), F.col("start_node_id").alias("dst")).distinct(), depth)


def prerequisites_by_grade(nodes: DataFrame, edges: DataFrame, label: str, kind: str = "PREREQUISITE") -> DataFrame:
    grade = F.get_json_object("properties", "$.grade_level").cast("int")
    rows = labelled_edges(nodes, edges.where(F.col("edge_label") == kind)).where(F.col("end_label") == label)
    return rows.join(nodes.select("graph_name", F.col("node_id").alias("start_node_id"), grade.alias("grade_level")), ["graph_name", "start_node_id"]).select("start_node_id", "start_label", "grade_level").orderBy("grade_level", "start_node_id")


def related(edges: DataFrame, seeds: DataFrame, max_distance: int = 2, kind: str | None = None) -> DataFrame:
    """(seed, node, depth, score = 1 / (1 + depth)) over outgoing edges. With a type, direct
    neighbours stay only over an edge of it; farther ones are not tested."""
    found = bfs(seeds, arrows(edges), max_distance).withColumn("score", 1.0 / (1 + F.col("depth")))
    if kind is None:
        return found
    typed = edges.where(F.col("edge_label") == kind).select(F.col("start_node_id").alias("seed"), F.col("end_node_id").alias("node")).distinct().withColumn("typed", F.lit(True))
    return found.join(typed, ["seed", "node"], "left").where((F.col("depth") > 1) | F.col("typed")).drop("typed")


class Shelf:
    """A folder of the shared root for tables that one search writes and reads again, removed with it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{shared_root(spark)}/shelf-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        """``df`` written in columns, which take a small part of what a checkpoint takes."""
        return self.read(df.schema, self.write(df))

    def write(self, df: DataFrame) -> str:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return path

    def read(self, schema, *paths: str) -> DataFrame:
        """Tables of one schema in a single scan, so that a plan does not grow with their number."""
        return self.spark.read.schema(schema).parquet(*paths)

    def clear(self) -> None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Layers:
    """What lies 0, 1, 2 ... hops from each key: tables (key, node, path), a key's node in the first of them only, with the
    least of its shortest paths: from the key on, or to the key where layers grow ``backward``."""

    def __init__(self, shelf: Shelf, steps: DataFrame, keys: DataFrame, backward: bool = False):
        self.shelf, self.steps, self.backward = shelf, steps, backward
        first = keys.select("key").distinct().select("key", F.col("key").alias("node"), F.array("key").alias("path"))
        self.schema, self.paths = first.schema, [shelf.write(first)]
        self.rows = self[0].count()

    def __getitem__(self, hop: int) -> DataFrame:
        return self.shelf.read(self.schema, self.paths[hop])

    @property
    def hops(self) -> int:
        return len(self.paths) - 1

    def grow(self, keys: DataFrame) -> DataFrame:
        """One hop on, for ``keys`` only."""
        keys = keys.distinct()
        grown = self[-1].join(keys, "key", "left_semi").join(self.steps, F.col("node") == F.col("src")).select("key", F.col("dst").alias("node"), "path")
        seen = self.shelf.read(self.schema, *self.paths).select("key", "node").join(keys, "key", "left_semi")
        fresh = grown.join(seen, ["key", "node"], "left_anti").groupBy("key", "node").agg(F.min("path").alias("path"))
        longer = F.concat(F.array("node"), "path") if self.backward else F.concat("path", F.array("node"))
        self.paths.append(self.shelf.write(fresh.select("key", "node", longer.alias("path"))))
        self.rows = self[-1].count()
        return self[-1]


def paths(pairs: DataFrame, steps: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(a, b, path) of least hops, among equal ones the least sequence of ids; a = b is the path of
    itself; pairs without a path, or without one of ``max_hops`` if that is given, are left out.

    Layers grow from the starts along the steps and from the goals against them, each time on the side whose last
    layers have fewer rows for the pairs that are open. A pair whose two last layers share a node has met, at the sum of their hops; one whose
    start or goal has no new nodes has no path; neither grows on. So what is kept for a pair is two balls of half the
    distance, not all that its goal can be reached from. Each node of a layer has the least of its shortest paths, so
    the path of a pair is the least of those through the nodes where it met, and nothing is walked again.
    """
    pairs = pairs.select("a", "b").distinct()
    shelf = Shelf(pairs.sparkSession)
    steps = shelf.put(steps.select("src", "dst").distinct())
    back = steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    pairs = shelf.put(pairs)
    found = pairs.where("a = b").select("a", "b", F.array("a").alias("path"))
    # a start without a way out and a goal without a way in have no path
    open_ = pairs.where("a <> b").join(steps.select(F.col("src").alias("a")), "a", "left_semi").join(steps.select(F.col("dst").alias("b")), "b", "left_semi")
    open_ = shelf.put(open_)
    sides = {"a": Layers(shelf, steps, open_.select(F.col("a").alias("key"))), "b": Layers(shelf, back, open_.select(F.col("b").alias("key")), backward=True)}
    meets: list[str] = []
    left = open_.count()
    while left and (max_hops is None or sides["a"].hops + sides["b"].hops < max_hops):
        rows = {end: side[-1].join(open_.select(F.col(end).alias("key")), "key", "left_semi").count() for end, side in sides.items()}
        end = min(rows, key=lambda end: (rows[end], sides[end].hops))
        fresh = sides[end].grow(open_.select(F.col(end).alias("key")))
        fore = sides["a"][-1].select(F.col("key").alias("a"), "node", F.col("path").alias("fore"))
        rear = sides["b"][-1].select(F.col("key").alias("b"), "node", F.col("path").alias("rear"))
        through = open_.join(fore, "a").join(rear, ["b", "node"]).groupBy("a", "b").agg(F.min(F.struct("fore", "rear")).alias("least"))
        meets.append(shelf.write(through.select("a", "b", F.concat("least.fore", F.expr("slice(least.rear, 2, size(least.rear))")).alias("path"))))
        open_ = open_.join(fresh.select(F.col("key").alias(end)), end, "left_semi").select("a", "b").join(shelf.read(found.schema, meets[-1]), ["a", "b"], "left_anti")
        open_ = shelf.put(open_)
        left = open_.count()
    if meets:
        found = found.unionByName(shelf.read(found.schema, *meets))
    found = pinned(found)
    shelf.clear()
    return found


def learning_paths(edges: DataFrame, pairs: DataFrame, max_hops: int | None = None) -> DataFrame:
    return paths(pairs, arrows(edges), max_hops)


def undirected_paths(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, max_hops: int = 5) -> DataFrame:
    """(a, b, path, names, types): shortest paths over edges taken either way."""
    ways = both_ways(edges)
    got = paths(pairs, ways.select("src", "dst").distinct(), max_hops)
    types = ways.groupBy("src", "dst").agg(F.min("edge_label").alias("t"))
    legs = got.select("a", "b", F.posexplode("path").alias("i", "node"), F.col("path"))
    legs = legs.select("a", "b", "path", "i", "node", F.get("path", F.col("i") + 1).alias("next"))
    legs = legs.join(nodes.select(F.col("node_id").alias("node"), "label"), "node", "left").join(types, (legs["node"] == types["src"]) & (legs["next"] == types["dst"]), "left")
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", F.col(c).alias("v")))), lambda x: x["v"])
    return legs.groupBy("a", "b", "path").agg(order("label").alias("names"), F.array_compact(order("t")).alias("types"))


def knowledge_gaps(edges: DataFrame, learned: DataFrame) -> DataFrame:
    """(learner, node): successors of what a learner knows, not known, all of whose prerequisites are.

    ``learned`` has (learner, node). Relational division by counts, without collecting a set.
    """
    e = arrows(edges)
    known = learned.select("learner", "node").distinct()
    met = known.join(e, known["node"] == e["src"]).groupBy("learner", F.col("dst").alias("node")).agg(F.count("*").alias("met"))
    need = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("need"))
    return met.join(need, "node").where("met = need").join(known, ["learner", "node"], "left_anti").select("learner", "node")


def gaps_by_name(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """``knowledge_gaps`` for (learner, name), matched without regard to case; labels of the gaps."""
    ids = nodes.select("node_id", F.lower("label").alias("key"), "label")
    learned = names.join(ids, F.lower(F.trim("name")) == F.col("key")).select("learner", F.col("node_id").alias("node"))
    return knowledge_gaps(edges, learned).join(ids, F.col("node") == F.col("node_id")).select("learner", "node", "label")


#: Learners, packed in lists of ids, and rows (lists, pairs of sets) that the joins of ``next_steps`` broadcast; more go by shuffle.
BROADCAST_LEARNERS, BROADCAST_ROWS = 4_000_000, 500_000
#: About as many ids stand in a list of learners or nodes; a task holds a list of learners for each of a list of nodes.
LIST_IDS = 2048


def listed(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): lists of the values of a key, several where it has more than ``LIST_IDS``."""
    parts = rows.groupBy(key).agg(F.ceil(F.count("*") / LIST_IDS).alias("parts"))
    dealt = rows.join(parts, key).withColumn("part", F.pmod(F.xxhash64(value), "parts"))
    return dealt.groupBy(key, "part").agg(F.collect_list(value).alias(f"{value}s")).drop("part")


def numbered(shelf: Shelf, rows: DataFrame, name: str) -> DataFrame:
    """The distinct ``rows``, each with a number."""
    return shelf.put(rows.distinct().withColumn(name, F.monotonically_increasing_id()))


def next_steps(states: DataFrame, concept_of: DataFrame, edges: DataFrame) -> DataFrame:
    """(learner, node): gaps after the skills that a user has mastered; ``concept_of`` has (skill_id, node).

    A node is known by a set of mastered skills or not, whoever has it. So users with the same set are one
    learner of ``knowledge_gaps``, and nodes are one node if they have the same skills and the same sets of
    skills before them. The sets go by numbers. Users and nodes meet only in the rows of the result: each node,
    or where there are too many learners to broadcast each list of nodes, meets lists of learners, so that
    nothing of the result's size, nor of nodes times sets, is shuffled. Null users and nodes take no part.
    """
    spark = states.sparkSession
    shelf, tasks = Shelf(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    mastered = states.where("probability_mastery > 0.9 and user_id is not null")
    kits = shelf.put(mastered.groupBy(F.col("user_id").alias("learner")).agg(F.array_sort(F.collect_set("skill_id")).alias("skills")))
    kit_skills = numbered(shelf, kits.select("skills"), "kit")
    owned = shelf.put(concept_of.groupBy("node").agg(F.array_sort(F.collect_set("skill_id")).alias("skills")).where(F.size("skills") > 0))
    set_skills = numbered(shelf, owned.select("skills"), "own")
    owned = owned.join(set_skills, "skills").select("node", "own")
    # -1 stands for a node without skills, which nobody knows; what it is before is nobody's next step
    ways = arrows(edges).where("dst is not null").join(owned.withColumnRenamed("node", "src"), "src", "left")
    before = ways.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set(F.coalesce("own", F.lit(-1)))).alias("before")).where(F.col("before")[0] >= 0)
    nodes = shelf.put(before.join(owned, "node", "left").select("node", F.coalesce("own", F.lit(-1)).alias("own"), "before"))
    kinds = numbered(shelf, nodes.select("own", "before"), "kind")
    # what a set of skills knows: the sets of nodes' skills that it meets
    met = kit_skills.select("kit", F.explode("skills").alias("skill")).join(set_skills.select("own", F.explode("skills").alias("skill")), "skill")
    knows = shelf.put(met.select("kit", "own").distinct())
    need = kinds.select("kind", F.size("before").alias("need"), F.explode("before").alias("one"))
    full = need.join(knows.select("kit", F.col("own").alias("one")), "one").groupBy("kit", "kind", "need").agg(F.count("*").alias("met")).where("met = need")
    gaps = pinned(full.join(kinds.select("kind", "own"), "kind").join(knows, ["kit", "own"], "left_anti").select("kit", "kind"))
    learners = pinned(listed(kits.join(kit_skills, "skills").select("kit", "learner"), "kit", "learner"))
    nodes = nodes.join(kinds, ["own", "before"]).select("node", "kind")
    if kits.count() <= BROADCAST_LEARNERS and max(gaps.count(), learners.count()) <= BROADCAST_ROWS:
        nodes = pinned(nodes.repartition(tasks, "node"))
        met = nodes.join(F.broadcast(gaps), "kind").join(F.broadcast(learners), "kit")
    else:
        tiles = gaps.join(learners, "kit").join(pinned(listed(nodes, "kind", "node")), "kind").select("nodes", "learners")
        met = tiles.repartition(tasks).select("learners", F.explode("nodes").alias("node"))
    shelf.clear()
    # generated code holds all rows that come of one row; it ends at a coalesce, which here changes no partition,
    # so that a task holds the rows of one list, not of all the learners of a node
    return met.select("learners", "node").coalesce(tasks).select(F.explode("learners").alias("learner"), "node")


def concepts_from_chunks(chunks: DataFrame) -> DataFrame:
    """One row a concept from (book_id, chunk_id, seq, key_concepts, definitions): names of at least
    three letters, chunk ids merged, the first name and the first definition kept."""
    each = chunks.select("book_id", "chunk_id", "seq", "definitions", F.posexplode("key_concepts").alias("pos", "raw"))
    name = F.trim(F.regexp_replace("raw", "\n", " "))
    rows = each.withColumn("name", name).where(F.length("name") >= 3).withColumn("definition", F.coalesce(F.element_at("definitions", F.col("raw")), F.element_at("definitions", F.col("name"))))
    at = F.struct("seq", "pos")
    return rows.groupBy(concept_id("book_id", "name").alias("concept_id"), "book_id").agg(
        F.min_by("name", at).alias("name"), F.min_by("definition", F.when(F.col("definition").isNotNull(), at)).alias("definition"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids")
    )


def cooccurrences(chunks: DataFrame, kind: str = "RELATED_TO", strength: float = 0.8) -> DataFrame:
    """(source_id, target_id, relationship_type, strength, chunk_id): pairs i < j of one chunk's
    concepts, each once, from the first chunk that has it. A chunk of n concepts has n squared pairs by
    definition; chunks are bounded by their words (``text.MAX_WORDS``), and so are their concepts."""
    each = chunks.select("chunk_id", "seq", "book_id", F.posexplode("key_concepts").alias("pos", "raw")).where(F.length(F.trim("raw")) >= 3)
    ids = each.select("chunk_id", "seq", "pos", concept_id("book_id", F.regexp_replace("raw", "\n", " ")).alias("id"))
    a, b = ids.select("chunk_id", "seq", F.col("pos").alias("i"), F.col("id").alias("source_id")), ids.select("chunk_id", F.col("pos").alias("j"), F.col("id").alias("target_id"))
    pairs = a.join(b, "chunk_id").where("i < j and source_id <> target_id")
    first = pairs.groupBy("source_id", "target_id").agg(F.min_by("chunk_id", F.struct("seq", "i", "j")).alias("chunk_id"))
    return first.select("source_id", "target_id", F.lit(kind).alias("relationship_type"), F.lit(strength).alias("strength"), "chunk_id")


def chapter_prerequisites(concepts: DataFrame) -> DataFrame:
    """Edges from the concepts of one chapter to those of the next one of its book, by the chapter in
    which each first occurs; (concept_id, book_id, chapter). Not made unless asked for."""
    first = concepts.groupBy("book_id", "concept_id").agg(F.min("chapter").alias("chapter"))
    order = first.select("book_id", "chapter").distinct().withColumn("next", F.lead("chapter").over(Window.partitionBy("book_id").orderBy("chapter")))
    a = first.join(order, ["book_id", "chapter"]).select("book_id", F.col("concept_id").alias("source_id"), F.col("next").alias("chapter"))
    b = first.select("book_id", F.col("concept_id").alias("target_id"), "chapter")
    return a.join(b, ["book_id", "chapter"]).select("source_id", "target_id", F.lit("PREREQUISITE").alias("relationship_type"))


def add_relationships(nodes: DataFrame, new: DataFrame, key: str = "concept_id") -> tuple[DataFrame, DataFrame]:
    """(relationships both of whose ends exist, each once; the others)."""
    ids = nodes.select(key).distinct()
    has_a, has_b = ids.select(F.col(key).alias("source_id")), ids.select(F.col(key).alias("target_id"))
    good = new.join(has_a, "source_id", "left_semi").join(has_b, "target_id", "left_semi").select(new.columns)
    return good.dropDuplicates(["source_id", "target_id", "relationship_type"]), new.join(has_a, "source_id", "left_anti").unionByName(new.join(has_a, "source_id", "left_semi").join(has_b, "target_id", "left_anti").select(new.columns))


def least_labels(ids: DataFrame, steps: DataFrame) -> DataFrame:
    """(node, label): the least id that reaches each node over ``steps``, itself included. Only nodes whose
    label has changed send it on."""
    shelf = Shelf(ids.sparkSession)
    steps = shelf.put(steps.select("src", "dst"))
    now = shelf.put(ids.select("node", F.col("node").alias("label"), F.lit(True).alias("moved")))
    while not now.where("moved").isEmpty():
        sent = steps.join(now.where("moved"), F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("got"))
        less = F.coalesce(F.col("got") < F.col("label"), F.lit(False))
        now = shelf.put(now.join(sent, "node", "left").select("node", F.when(less, F.col("got")).otherwise(F.col("label")).alias("label"), less.alias("moved")))
    now = pinned(now.select("node", "label"))
    shelf.clear()
    return now


def reach(start: DataFrame, steps: DataFrame) -> DataFrame:
    """(part, node) of all that ``start`` (part, node) reaches over ``steps`` (part, src, dst), itself included."""
    shelf = Shelf(start.sparkSession)
    steps, start = shelf.put(steps.select("part", "src", "dst")), start.select("part", "node").distinct()
    paths = [shelf.write(start)]
    while not shelf.read(start.schema, paths[-1]).isEmpty():
        ahead = shelf.read(start.schema, paths[-1]).join(steps.withColumnRenamed("src", "node"), ["part", "node"]).select("part", F.col("dst").alias("node")).distinct()
        paths.append(shelf.write(ahead.join(shelf.read(start.schema, *paths), ["part", "node"], "left_anti")))
        if len(paths) % 16 == 0:  # few files again, the last layer by itself
            paths = [shelf.write(shelf.read(start.schema, *paths[:-1])), paths[-1]]
    found = pinned(shelf.read(start.schema, *paths))
    shelf.clear()
    return found


def weak_components(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the least id of each node's weak component. Each round ties every node to the least
    neighbour of its neighbours, so that a chain halves; rounds go on until nothing changes."""
    e = edges.select(F.greatest("start_node_id", "end_node_id").alias("hi"), F.least("start_node_id", "end_node_id").alias("lo")).where("hi <> lo")
    e, mark = pinned(e.distinct()), None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        if now == mark:
            break
        mark = now
        ends = e.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(e.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = pinned(ends.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("m")))
        # the larger ends move to the least neighbour of the lower end, then all ends of a node to its least one
        far = pinned(e.join(least, e["lo"] == least["n"]).select("hi", F.col("m").alias("lo")).distinct())
        own = pinned(far.groupBy("hi").agg(F.min("lo").alias("m")))
        rest = far.join(own, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = pinned(rest.unionByName(own.select("hi", F.col("m").alias("lo"))).where("hi <> lo").distinct())
    return ids.select("node").join(e, F.col("node") == F.col("hi"), "left").select("node", F.coalesce("lo", "node").alias("label"))


def pivot_components(e: DataFrame, weak: DataFrame) -> DataFrame:
    """(node, component) for the strong component of one node of each weak component, that with most ways through
    it: what it reaches and what reaches it, both searched at once."""
    ways = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out")).join(e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in")), "node")
    ways = pinned(ways.join(weak, "node").select("node", "label", (F.col("out") * F.col("in")).alias("ways")))
    pivots = pinned(ways.groupBy("label").agg(F.max_by("node", F.struct("ways", "node")).alias("node")))
    core = ways.select("node")
    inner = e.join(core.withColumnRenamed("node", "src"), "src", "left_semi").join(core.withColumnRenamed("node", "dst"), "dst", "left_semi")
    steps = inner.select(F.lit(0).alias("part"), "src", "dst").unionByName(inner.select(F.lit(1).alias("part"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    got = reach(pivots.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("part"), "node"), steps)
    both = got.groupBy("node").agg(F.count("*").alias("n")).where("n = 2").select("node").join(weak, "node")
    return pinned(both.join(pivots.withColumnRenamed("node", "component"), "label").select("node", "component"))


def strong_components(nodes: DataFrame, edges: DataFrame, weak: DataFrame | None = None) -> DataFrame:
    """(node, component). First one strong component of each weak one (``weak``: node, label; found if not given),
    which takes most nodes of a graph that hangs together. The others by forward colours and backward reach, after
    nodes without edges in or out are taken off; each round settles the component of every colour, until no node is left."""
    left, e = pinned(nodes.select(F.col("node_id").alias("node")).distinct()), pinned(arrows(edges).where("src <> dst"))
    done = settled = pivot_components(e, weak_components(left, edges) if weak is None else weak)
    while True:
        left = pinned(left.join(settled.select("node"), "node", "left_anti"))
        if left.isEmpty():
            return done
        e = pinned(e.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi"))
        ends = e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")).distinct(), "node")
        core = pinned(left.join(ends, "node"))
        alone = left.join(core, "node", "left_anti").select("node", F.col("node").alias("component"))
        colour = least_labels(core, e.join(core.withColumnRenamed("node", "src"), "src").join(core.withColumnRenamed("node", "dst"), "dst"))
        inside = e.join(colour.select(F.col("node").alias("src"), F.col("label").alias("part")), "src").join(colour.select(F.col("node").alias("dst"), F.col("label").alias("part")), ["dst", "part"])
        back = reach(colour.where("node = label").select(F.col("label").alias("part"), "node"), inside.select("part", F.col("dst").alias("src"), F.col("src").alias("dst")))
        settled = pinned(alone.unionByName(back.select("node", F.col("part").alias("component"))))
        done = done.unionByName(settled)


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, relationships, density over distinct pairs, weak and strong components."""
    ids = pinned(nodes.select(F.col("node_id").alias("node")).distinct())
    pairs = pinned(edges.groupBy("start_node_id", "end_node_id").agg(F.count("*").alias("n")))  # read once; all else needs the pairs only
    n, (m, distinct) = ids.count(), pairs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    weak = pinned(weak_components(ids, pairs))
    parts = weak.select("label").distinct().count()
    strong = strong_components(nodes, pairs, weak).select("component").distinct().count() if n else 0
    row = (n, m, distinct / (n * (n - 1)) if n > 1 else 0.0, parts == 1, strong)
    return nodes.sparkSession.createDataFrame([row], "nodes long, relationships long, density double, weakly_connected boolean, strong_components long")


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per graph: nodes, edges, distinct labels."""
    a = nodes.groupBy("graph_name").agg(F.count_distinct("node_id").alias("node_count"), F.count_distinct("label").alias("label_count"))
    return a.join(edges.groupBy("graph_name").agg(F.count_distinct("edge_id").alias("edge_count")), "graph_name", "left").select("graph_name", "node_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"), "label_count")


def domain_statistics(nodes: DataFrame, edges: DataFrame, labels: bool = True) -> DataFrame:
    """Per domain: nodes, edges at any of them, labels. The edge meets its ends by two equi joins."""
    ends = edges.select("edge_id", F.explode(F.array("start_node_id", "end_node_id")).alias("node_id"))
    rows = nodes.withColumn("domain", domain()).join(ends, "node_id", "left").groupBy("domain")
    counts = [F.count_distinct("node_id").alias("concept_count"), F.count_distinct("edge_id").alias("relationship_count")]
    return rows.agg(*counts, F.array_sort(F.collect_set("label")).alias("sample_concepts")) if labels else rows.agg(*counts)


def chunk_concepts(chunks: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each chunk with the sorted array of its concepts; empty where it has none."""
    rows = chunks.select("chunk_id").join(links, "chunk_id", "left").join(nodes.select("node_id", "label"), "node_id", "left")
    one = F.when(F.col("label").isNotNull(), F.struct("node_id", "label", "relevance"))
    return rows.groupBy("chunk_id").agg(F.array_sort(F.collect_list(one)).alias("related_concepts"))


def word_groups(n: int):
    """The groups of n neighbouring words of the array ``w``."""
    return F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.array_join(F.slice("w", i + 1, n), " "))


def concepts_in_text(messages: DataFrame, concepts: DataFrame, ident: str = "message_id", text: str = "message", name: str = "label") -> DataFrame:
    """(message, concept) pairs where the concept's name stands in the message as whole words. Messages
    are spread to word groups as long as the longest name and joined with the names; no row meets every
    other."""
    cut = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    names = concepts.select(cut(F.col(name)).alias("w"), F.col(name).alias("concept")).where(F.size("w") > 0)
    sizes = [r[0] for r in names.select(F.size("w")).distinct().collect()]
    rows = messages.select(ident, cut(F.col(text)).alias("w"))
    groups = [F.when(F.size("w") >= n, word_groups(n)).otherwise(F.array().cast("array<string>")) for n in sorted(sizes) or [1]]
    spread = rows.select(ident, F.explode(F.array_distinct(F.concat(*groups))).alias("key"))
    return spread.join(names.select(F.array_join("w", " ").alias("key"), "concept").distinct(), "key").select(ident, "concept").distinct()


def best_of_seeds(rows: DataFrame, k: int, key: str = "message_id", name: str = "name", order=("seed_rank", "place")) -> DataFrame:
    """The first k distinct names of each message, each where it is first seen."""
    first = rows.groupBy(key, name).agg(F.min(F.struct(*order)).alias("at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("at", name))).where(F.col("rank") <= k).select(key, name, "rank")
