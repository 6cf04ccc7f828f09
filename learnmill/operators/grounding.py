"""Citation checks, and the batch message pipeline from masking to answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from learnmill.functions.scalar import col

from . import classify, graph, privacy, vectors

# Phrases that call for a source, and the form of a source id.
CLAIMS = (r"(?i)\b(is|are|was|were)\b", r"(?i)\b(according to|research shows|studies indicate)\b", r"(?i)\b(causes|leads to|results in)\b", r"(?i)\b(important|significant|critical)\b")
SOURCE = r"^[\w\-\.]+\-chapter[\-0-9\.]+(\-para[\-0-9]+)?$"
DISCLAIMER = "AI generated. Always verify with source text."


def claim_count(text: Column | str) -> Column:
    """How many of the claim patterns occur."""
    total = F.lit(0)
    for p in CLAIMS:
        total = total + F.coalesce(col(text).rlike(p), F.lit(False)).cast("int")
    return total


def source_id(book: Column | str, chapter: Column | str, section: Column | str | None = None) -> Column:
    return F.concat_ws("-", col(book), col(chapter), *([col(section)] if section is not None else []))


def validate(df: DataFrame, response: str = "response", sources: str = "sources", context: str = "context", minimum: int = 1) -> DataFrame:
    """Add has_citations, citation_count, is_valid and warnings; ``context`` is an array."""
    text, s = F.coalesce(response, F.lit("")), F.coalesce(sources, F.array().cast("array<string>"))
    n, empty = F.size(s), F.trim(text) == ""
    bad = F.filter(s, lambda x: ~x.rlike(SOURCE))
    grounded = F.coalesce(F.size(F.coalesce(context, F.array().cast("array<string>"))) > 0, F.lit(False))
    claims = claim_count(text)
    shown = n.cast("string")
    notes = F.concat(
        F.array_compact(F.array(F.when(n < minimum, F.concat(F.lit("Response has "), shown, F.lit(f" citations, minimum is {minimum}"))))), F.transform(bad, lambda x: F.concat(F.lit("Invalid source ID format: "), x)),
        F.array_compact(F.array(F.when(~grounded, "No retrieval context provided - response may be ungrounded"), F.when((claims > 3) & (n == 0), F.concat(F.lit("Response contains "), claims.cast("string"), F.lit(" claim patterns but no citations"))))),
    )
    return df.withColumns({
        "has_citations": ~empty & (n > 0), "citation_count": F.when(empty, 0).otherwise(n), "is_valid": ~empty & (n >= minimum) & (n > 0) & (F.size(bad) == 0) & grounded,
        "warnings": F.when(empty, F.array(F.lit("Empty response"))).otherwise(notes),
    })


def parse_citation(source: Column | str) -> Column:
    """Struct of source_id, chapter and paragraph, by the parts of the id."""
    parts = F.split(col(source), "-")
    at = lambda name: F.array_position(parts, F.lit(name)).cast("int")
    part = lambda name: F.when(at(name) > 0, F.get(parts, at(name)))
    return F.struct(col(source).alias("source_id"), part("chapter").alias("chapter"), part("para").try_cast("int").alias("paragraph"))


def lock(df: DataFrame, allow_uncited: bool = False, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(accepted with citations and disclaimer, rejected with warnings)."""
    checked = validate(df, **columns)
    sources = columns.get("sources", "sources")
    out = checked.withColumn("citations", F.transform(sources, parse_citation)).withColumn("disclaimer", F.lit(DISCLAIMER))
    return (out, out.where(F.lit(False))) if allow_uncited else (out.where("is_valid"), out.where(~F.col("is_valid")))


def template_answer(kind: Column, n: Column, score: Column, results: Column, sources: Column, concepts: Column, needs: Column, path: Column, mood: Column) -> Column:
    """Answer text from the context, what the graph adds, and the mood."""
    first = F.substring(F.get(results, F.lit(0)), 1, 200)
    two = F.format_string("%.2f", score)
    fact = kind == "fact"
    found = F.when(fact, F.concat(F.lit("Based on my knowledge base, I found "), n.cast("string"), F.lit(" relevant fact(s) for your query (relevance: "), two, F.lit("). Here's what I found: "), first, F.lit("...")))
    found = found.otherwise(F.concat(F.lit("I've analyzed "), n.cast("string"), F.lit(" related concepts from my knowledge base (relevance: "), two, F.lit("). Key concept: "), first, F.lit("...")))
    cited = F.concat(found, F.when(F.size(sources) > 0, F.concat(F.lit("\n\nSources: "), F.array_join(F.slice(sources, 1, 3), ", "))).otherwise(""))
    nothing = F.when(fact, "I couldn't find specific facts matching your query in my knowledge base. This might be new information that needs to be added.")
    nothing = nothing.otherwise("I don't have conceptual information about this topic in my knowledge base yet. Consider adding this concept for future reference.")
    body = F.when(n > 0, cited).otherwise(nothing)
    more = lambda a, k, head, sep: F.when(F.size(a) > 0, F.concat(F.lit(head), F.array_join(F.slice(a, 1, k), sep))).otherwise("")
    body = F.concat(body, more(concepts, 5, "\n\n**Related Concepts:** ", ", "), more(needs, 1000, "\n\n**Prerequisites:** You may want to review: ", ", "), more(path, 1000, "\n\n**Learning Path:** ", " → "))
    return F.when(mood == "negative", F.concat(F.lit("I understand this might be frustrating. "), body)).when(mood == "positive", F.concat(F.lit("Great question! "), body)).otherwise(body)


def retrieved(messages: DataFrame, chunks: DataFrame, k: int = 5, thresholds=(("fact", 0.7), ("concept", 0.5))) -> DataFrame:
    """Per message (message_id, retrieval_type, query) its context, sources and mean score."""
    hits = vectors.many_top_k(chunks, messages.select(F.col("message_id").alias("query_id"), "query"), k, key="chunk_id")
    least = F.coalesce(*[F.when(F.col("retrieval_type") == kind, t) for kind, t in thresholds], F.lit(-1.0))
    rows = hits.join(messages.select(F.col("message_id").alias("query_id"), "retrieval_type"), "query_id").where(F.col("similarity") >= least)
    rows = rows.join(chunks.select(F.col("chunk_id").cast("long").alias("key"), "content", source_id("book_id", "chapter_id").alias("source")), "key")
    order = F.array_sort(F.collect_list(F.struct("rank", "content", "source")))
    got = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("similarity").alias("avg_score"), order.alias("h"))
    return got.select(F.col("query_id").alias("message_id"), "n", "avg_score", F.transform("h", lambda x: x["content"]).alias("context"), F.array_distinct(F.transform("h", lambda x: x["source"])).alias("sources"))


def graph_context(messages: DataFrame, nodes: DataFrame, edges: DataFrame, seeds: int = 3, top: int = 5, needs: int = 3) -> DataFrame:
    """Per message the concepts named in it, the best related ones, and prerequisites not among them."""
    named = graph.concepts_in_text(messages, nodes).join(nodes.select(F.col("label").alias("concept"), "node_id"), "concept")
    ranked = graph.best_of_seeds(named.select("message_id", F.col("concept").alias("name"), F.lit(0).alias("seed_rank"), F.col("node_id").alias("place")), seeds)
    seed = ranked.join(nodes.select(F.col("label").alias("name"), F.col("node_id").alias("seed")), "name").select("message_id", "seed", F.col("rank").alias("seed_rank"))
    labels = nodes.select(F.col("node_id").alias("node"), F.col("label").alias("name"))
    near = graph.related(edges, seed).join(seed, "seed").join(labels, "node").select("message_id", "name", "seed_rank", F.struct("depth", "node").alias("place"))
    best = graph.best_of_seeds(near, top)
    before = graph.prerequisites(edges, seed, 1).join(seed, "seed").join(labels, "node").select("message_id", "name", "seed_rank", F.struct("depth", "node").alias("place"))
    before = graph.best_of_seeds(before.join(best.select("message_id", "name"), ["message_id", "name"], "left_anti"), needs)
    gather = lambda df, c: df.groupBy("message_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias(c))
    return gather(ranked, "concepts").join(gather(best, "related"), "message_id", "left").join(gather(before, "prerequisites"), "message_id", "left")


def enriched_hits(hits: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, concepts: int = 3, neighbours: int = 2) -> DataFrame:
    """Each hit (query_id, key) with the top neighbours of the first concepts of its chunk (chunk_id,
    key_concepts)."""
    named = hits.join(chunks.select(F.col("chunk_id").alias("key"), F.posexplode(F.slice("key_concepts", 1, concepts)).alias("pos", "concept")), "key")
    seeds = named.join(nodes.select(F.lower("label").alias("low"), F.col("node_id").alias("seed")), F.lower("concept") == F.col("low")).select("query_id", "key", "pos", "seed")
    near = seeds.join(graph.related(edges, seeds, 1), "seed").join(nodes.select(F.col("node_id").alias("node"), "label"), "node")
    rows = near.select(F.struct("query_id", "key", "seed").alias("hit"), F.col("label").alias("name"), F.col("pos").alias("seed_rank"), F.col("node").alias("place"))
    best = graph.best_of_seeds(rows, neighbours, key="hit")
    return hits.join(best.groupBy("hit.query_id", "hit.key").agg(F.array_sort(F.collect_set("name")).alias("neighbours")), ["query_id", "key"], "left")


def graph_search(hits: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 5) -> DataFrame:
    """Concepts related to the first concept of each query's best chunk: query_id, node, label, score.

    ``hits`` has (query_id, key, rank), ``chunks`` (chunk_id, key_concepts)."""
    first = hits.where("rank = 1").join(chunks.select(F.col("chunk_id").alias("key"), F.get("key_concepts", F.lit(0)).alias("concept")), "key")
    seeds = first.join(nodes.select(F.lower("label").alias("low"), F.col("node_id").alias("seed")), F.lower("concept") == F.col("low")).select("query_id", "seed")
    rows = seeds.join(graph.related(edges, seeds, 2), "seed").join(nodes.select(F.col("node_id").alias("node"), "label"), "node")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit).select("query_id", "node", "label", "score")


def path_search(hits: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, best: int = 2) -> DataFrame:
    """Learning paths between the first two concepts of each query's best chunks: query_id, key, names."""
    two = hits.where(F.col("rank") <= best).join(chunks.select(F.col("chunk_id").alias("key"), F.get("key_concepts", F.lit(0)).alias("x"), F.get("key_concepts", F.lit(1)).alias("y")), "key")
    ids = nodes.select(F.lower("label").alias("low"), "node_id", "label")
    asked = two.join(ids.select(F.col("low").alias("lx"), F.col("node_id").alias("a")), F.lower("x") == F.col("lx")).join(ids.select(F.col("low").alias("ly"), F.col("node_id").alias("b")), F.lower("y") == F.col("ly")).select("query_id", "key", "a", "b")
    legs = graph.learning_paths(edges, asked).select("a", "b", F.posexplode("path").alias("i", "node_id")).join(ids, "node_id")
    named = legs.groupBy("a", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "label"))), lambda s: s["label"]).alias("names"))
    return asked.join(named, ["a", "b"]).select("query_id", "key", "names")


def answer_messages(messages: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, embedder=None, signals: DataFrame | None = None, thresholds=(("fact", 0.7), ("concept", 0.5))) -> DataFrame:
    """The whole pipeline over (message_id, user_id, message[, query]): mask, mood, route, retrieve,
    graph, mode, answer, citations. Each step adds columns to one table."""
    safe = privacy.anonymise(messages, "message").withColumnRenamed("anonymized_text", "message")
    mood = safe.withColumns({"sentiment_score": classify.sentiment_score("message"), "sentiment": classify.sentiment_label("message"), "retrieval_type": classify.retrieval_type("message"), "routing_reason": classify.routing_reason("message")})
    if "query" not in mood.columns:
        mood = vectors.embed(mood, embedder, "message").withColumnRenamed("embedding", "query")
    mood = graph.pinned(mood)
    got = mood.join(retrieved(mood, chunks, thresholds=thresholds), "message_id", "left")
    extra = graph_context(mood.where("retrieval_type = 'hybrid'"), nodes, edges)
    rows = got.join(extra, "message_id", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("context", "sources", "concepts", "related", "prerequisites")}).withColumns({"n": F.coalesce("n", F.lit(0)), "avg_score": F.coalesce("avg_score", F.lit(0.0))})
    if signals is not None:
        rows = rows.join(signals.select("user_id", F.col("suggested_mode").alias("behaviour_mode")), "user_id", "left")
    mode = classify.suggested_mode("message", F.col("retrieval_type"))
    rows = rows.withColumn("mode", F.coalesce("behaviour_mode", mode) if signals is not None else mode)
    answer = template_answer(F.col("retrieval_type"), F.col("n"), F.col("avg_score"), F.col("context"), F.col("sources"), F.col("related"), F.col("prerequisites"), none, F.col("sentiment"))
    return validate(rows.withColumn("response", answer).drop("query"))


def grounding_report(answers: DataFrame) -> DataFrame:
    """Share of answers without context, and of answers that are not validly cited."""
    return answers.agg(F.count("*").alias("messages"), F.avg((F.col("n") == 0).cast("double")).alias("unanswered_share"), F.avg((~F.col("is_valid")).cast("double")).alias("unsupported_share"))


def search_concepts_of_query(queries: DataFrame, nodes: DataFrame, edges: DataFrame, top: int = 3, each: int = 5) -> DataFrame:
    """Relationships of the best concepts for a query's terms (message_id, message): terms are joined
    with the words of the concepts' names; ``top`` concepts, ``each`` relationships a concept.

    A name among the first ``top`` of a query is among the first ``top`` of the term that places it, so only those
    of each word meet the queries; and a concept's first relationships are the same for all queries."""
    terms = queries.select("message_id", F.posexplode(classify.query_terms("message")).alias("term_rank", "term"))
    words = nodes.select("node_id", "label", F.explode(F.array_distinct(F.split(F.lower("label"), r"[^\p{L}\p{N}]+"))).alias("term"))
    words = words.join(terms.select("term").distinct(), "term", "left_semi").select("term", F.col("label").alias("name"), F.lit(0).alias("seed_rank"), F.col("node_id").alias("place"))
    first = graph.best_of_seeds(words, top, key="term").select("term", "name")
    # the place of a name is that of its least node with the word, which all nodes of the name have
    first = first.join(words.groupBy("term", "name").agg(F.min("place").alias("place")), ["term", "name"])
    hits = terms.join(first, "term").select("message_id", "name", F.col("term_rank").alias("seed_rank"), "place")
    best = graph.pinned(graph.best_of_seeds(hits, top))
    asked = nodes.select(F.col("label").alias("name"), F.col("node_id").alias("src")).join(best.select("name").distinct(), "name", "left_semi")
    ways = graph.both_ways(edges).join(asked, "src").join(nodes.select(F.col("node_id").alias("dst"), F.col("label").alias("other")), "dst")
    ways = ways.select(F.col("name").alias("concept"), "other", "edge_label").distinct()
    w = Window.partitionBy("concept").orderBy("other", "edge_label")
    ways = ways.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= each)
    return best.select("message_id", F.col("name").alias("concept"), "rank").join(ways, "concept").select("message_id", "concept", "rank", "other", "edge_label", "nth")
