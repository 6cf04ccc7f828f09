"""Registered queries of chapters, tables, citations, graph searches, files and streams, each beside its
DuckDB SQL where SQL can say it. ``queries`` imports this module last."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnmill.functions import sql as functions
from learnmill.operators import classify as C
from learnmill.operators import graph as G
from learnmill.operators import grounding as K
from learnmill.operators import mastery as M
from learnmill.operators import merge as U
from learnmill.operators import privacy as P
from learnmill.operators import questions as Q
from learnmill.operators import text, vectors
from learnmill.sources import io
from learnmill.streaming import stateful as T
from learnmill.streaming import streams as S

from . import fixtures as V
from . import queries as base
from .registry import query, rounded


def place(spark, name: str) -> str:
    """A new folder among the shared ones."""
    return f"{G.shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def documents(spark, d) -> DataFrame:
    return V.table(spark, d, "documents")


# personal data: no SQL has the places of matches; tests compare with plain loops ----------------------


@query()
def p1_p2_p3_entities(spark, d):
    return documents(spark, d).select("doc_id", F.explode(P.entities("text")).alias("e")).select("doc_id", "e.start", "e.end", "e.type", "e.confidence", "e.label", "e.text")


@query()
def p4_masked_signs(spark, d):
    rows = documents(spark, d).select("doc_id", "text").withColumn("found", P.entities("text"))
    return rows.select("doc_id", P.mask("text", "found", labels=False).alias("masked"))


@query()
def p6_merged_entities(spark, d):
    """Entities found without names, merged with those found with names."""
    rows = documents(spark, d).select("doc_id", P.entities("text", False).alias("a"), P.entities("text").alias("b"))
    merged = rows.select("doc_id", P.merge_entities(F.col("a"), F.col("b")).alias("m"))
    return merged.select("doc_id", F.size("m").alias("n"), F.array_join(F.transform("m", lambda e: e["type"]), ",").alias("types"))


# chapters -------------------------------------------------------------------------------------------


def block():
    """A book is a block of a hundred documents of a source; every third page begins a chapter."""
    return F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 100).cast("string"))


def pages(spark, d) -> DataFrame:
    head = F.concat(F.lit("Chapter "), (F.col("doc_id") % 7 + 1).cast("string"), F.lit(": "), "source", F.lit("\n"), "text")
    return documents(spark, d).select(block().alias("book_id"), F.col("doc_id").alias("page_number"), F.when(F.col("doc_id") % 3 == 0, head).otherwise(F.col("text")).alias("text"))


def chapters(spark, d) -> DataFrame:
    last = pages(spark, d).groupBy("book_id").agg(F.max("page_number").alias("total_pages"))
    return text.end_pages(text.chapters_from_text(pages(spark, d)), last)


CHAPTERS = """select book_id, (row_number() over w)::int as seq, page_number % 7 + 1 as chapter_number, source as title, page_number as start_page,
    case when lead(page_number) over w is null then total when lead(page_number) over w > 1 then lead(page_number) over w - 1 end as end_page
  from (select source || '-' || (doc_id // 100) as book_id, doc_id as page_number, source, max(doc_id) over (partition by source || '-' || (doc_id // 100)) as total from documents)
  where page_number % 3 = 0 window w as (partition by book_id order by page_number)"""


@query(CHAPTERS)
def t1_t3_w9_chapters(spark, d):
    return chapters(spark, d)


@query(f"select p.book_id, page_number, chapter_number from (select source || '-' || (doc_id // 100) as book_id, doc_id as page_number from documents) p join ({CHAPTERS}) c on p.book_id = c.book_id and page_number between start_page and end_page")
def t4_pages_of_chapters(spark, d):
    return text.pages_of_chapters(pages(spark, d).select("book_id", "page_number"), chapters(spark, d)).select("book_id", "page_number", "chapter_number")


@query("select doc_id, doc_id % 4 in (0, 2) as heading, case when doc_id % 4 <> 3 then doc_id::int end as number from documents where source is not null")
def t2_chapter_headings(spark, d):
    i, n = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    title = F.when(i == 0, F.concat(F.lit(" Chapter "), n)).when(i == 1, F.concat(F.lit("Index of chapter "), n)).when(i == 2, F.concat(F.lit("CH "), n, F.lit(" in "), "source")).otherwise(F.col("source"))
    rows = documents(spark, d).where("source is not null").withColumn("title", title)
    return rows.select("doc_id", text.is_chapter_heading("title").alias("heading"), text.title_number("title").alias("number"))


@query("""select chapter_id || '_section_' || row_number() over (partition by chapter_id order by doc_id) as section_id, (doc_id % 5) || '.' || (doc_id % 3) || ' ' || source as title, doc_id as page_number
  from (select *, source || '-' || (doc_id // 100) as chapter_id from documents)""")
def t6_section_headings(spark, d):
    i = F.col("doc_id")
    head = F.concat((i % 5).cast("string"), F.lit("."), (i % 3).cast("string"), F.lit(" "), "source", F.lit("\n"), "text")
    rows = documents(spark, d).select(F.lit("b").alias("book_id"), block().alias("chapter_id"), i.alias("page_number"), head.alias("text"))
    return text.section_headings(rows).select("section_id", "title", "page_number")


@query(r"""select 'c' || r_regionkey || '_table_' || (r_regionkey + 1) as chunk_id, 'c' || r_regionkey as chapter_id, r_regionkey + 1 as chunk_number, 'Table: ' || caption as title, 'table' as content_type,
    'Table: ' || caption || chr(10) || chr(10) || '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || rows as content, 'Chapter ' || r_regionkey || ', page ' || (r_regionkey + 10) as source_location
  from (select r_regionkey, case when r_regionkey % 2 = 0 then r_name else 'Data Table' end as caption, string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) order by n_nationkey) as rows
    from region join nation on n_regionkey = r_regionkey group by all)""")
def t7_t11_table_chunks(spark, d):
    cells = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))
    rows = V.table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(cells.alias("rows")).join(V.table(spark, d, "region"), "r_regionkey")
    k = F.col("r_regionkey")
    return text.table_chunks(rows.select(
        F.concat(F.lit("c"), k.cast("string")).alias("chapter_id"), k.alias("chapter_number"), (k + 10).alias("page_number"), (k + 1).alias("chunk_number"),
        F.when(k % 2 == 0, F.col("r_name")).alias("caption"), F.array(F.lit("key"), F.lit("name")).alias("headers"), "rows",
    ))


@query(f"select doc_id::varchar as chapter_id, chunk_number::int as chunk_number, word_count from ({base.CHUNKING}) join documents using (doc_id) where length(text) > 100")
def t10_chapter_chunks(spark, d):
    docs = documents(spark, d).select(F.col("doc_id").cast("string").alias("chapter_id"), F.col("source").alias("title"), "text")
    sections = spark.createDataFrame([], "chapter_id string, section_number int, title string, content string")
    tables = spark.createDataFrame([], "chapter_id string, table_number int, title string, content string")
    return text.chapter_chunks(docs, sections, tables, "\n").select("chapter_id", "chunk_number", "word_count")


def _defined() -> str:
    found = [f"list_zip(list_transform(regexp_extract_all(text, '(?im){p}([^.]*)\\.', 1), lambda x: trim(x)), list_transform(regexp_extract_all(text, '(?im){p}([^.]*)\\.', 2), lambda x: trim(x)))" for p in text.DEFINITION]
    return f"list_concat(list_concat({found[0]}, {found[1]}), {found[2]})"


@query(f"""select doc_id, len(k)::int as n, array_to_string(list_sort(k), '|') as terms from (
  select doc_id, list_distinct(list_transform(list_filter({_defined()}, lambda p: p[1] <> '' and p[2] <> ''), lambda p: p[1])) as k from documents)""")
def t13_definitions(spark, d):
    keys = F.map_keys(text.definitions("text"))
    return documents(spark, d).select("doc_id", F.size(keys).alias("n"), F.array_join(F.array_sort(keys), "|").alias("terms"))


@query("select doc_id, coalesce(text, '') || coalesce(chr(10) || chr(10) || source || chr(10) || lang || chr(10) || chr(10) || lang || chr(10) || source, '') as whole from documents")
def t17_full_text(spark, d):
    inner = F.array(F.struct(F.col("lang").alias("title"), F.col("source").alias("content")))
    rows = documents(spark, d).withColumn("sections", F.array(F.struct(F.col("source").alias("title"), F.col("lang").alias("content"), inner.alias("subsections"))))
    return rows.select("doc_id", text.full_text("text", "sections").alias("whole"))


# citations and answers ------------------------------------------------------------------------------

CLAIMS = r"""(regexp_matches(message, '(?i)\b(is|are|was|were)\b')::int + regexp_matches(message, '(?i)\b(according to|research shows|studies indicate)\b')::int + regexp_matches(message, '(?i)\b(causes|leads to|results in)\b')::int + regexp_matches(message, '(?i)\b(important|significant|critical)\b')::int)"""


@query(f"""select message_id, not empty and n > 0 as has_citations, case when empty then 0 else n end as citation_count, not empty and n > 0 and k <> 2 and grounded as is_valid,
  case when empty then ['Empty response'] else list_filter([case when n < 1 then 'Response has 0 citations, minimum is 1' end, case when k = 2 then 'Invalid source ID format: bad id' end,
    case when not grounded then 'No retrieval context provided - response may be ungrounded' end, case when {CLAIMS} > 3 and n = 0 then 'Response contains ' || {CLAIMS} || ' claim patterns but no citations' end], lambda x: x is not null) end as warnings
  from (select *, trim(message) = '' as empty, message_id % 4 as k, case message_id % 4 when 0 then 0 when 3 then 2 else 1 end as n, message_id % 5 <> 0 as grounded from messages)""")
def q1_validate(spark, d):
    i = F.col("message_id") % 4
    good, other, none = F.lit("src1-chapter-3"), F.lit("src2-chapter-1.4-para-7"), F.array().cast("array<string>")
    sources = F.when(i == 0, none).when(i == 1, F.array(good)).when(i == 2, F.array(F.lit("bad id"))).otherwise(F.array(good, other))
    rows = V.messages(spark, d).withColumns({"response": F.col("message"), "sources": sources, "context": F.when(F.col("message_id") % 5 == 0, none).otherwise(F.array("message"))})
    return K.validate(rows).select("message_id", "has_citations", "citation_count", "is_valid", "warnings")


@query("select chunk_id, book_id || '-' || chapter_id || '-para-' || (chunk_id % 20) as source_id, (chunk_id % 10)::varchar as chapter, (chunk_id % 20)::int as paragraph from chunks")
def q3_citations(spark, d):
    source = F.concat("book_id", F.lit("-"), "chapter_id", F.lit("-para-"), (F.col("chunk_id") % 20).cast("string"))
    return V.chunks(spark, d).select("chunk_id", K.parse_citation(source).alias("c")).select("chunk_id", "c.source_id", "c.chapter", "c.paragraph")


KIND = f"case when r like 'hybrid%' or r = 'complex_query' then 'hybrid' when r like 'concept%' or r = 'long_query' then 'concept' else 'fact' end"
ASKED = f"""(select message_id, message, {KIND} as kind, embedding as query from (select *, {base._REASON} as r from messages) join embeddings on vec_id = (message_id // 1000 * 31 + message_id % 1000 * 7) % (select count(*) from embeddings))"""


@query(f"""select message_id, count(*) as n, round(avg(s), 5) as avg_score, count(distinct source)::int as n_sources from (
  select message_id, kind, book_id || '-' || chapter_id as source, {base.COS} as s from vectored, {ASKED} qualify row_number() over (partition by message_id order by s desc, chunk_id) <= 5)
  where s >= case when kind = 'hybrid' then -1 else 0.2 end group by message_id""")
def q6_retrieved(spark, d):
    asked = base.asked_messages(spark, d).withColumn("retrieval_type", C.retrieval_type("message"))
    got = K.retrieved(asked, V.vectored(spark, d), thresholds=(("fact", 0.2), ("concept", 0.2)))
    return got.select("message_id", "n", F.round("avg_score", 5).alias("avg_score"), F.size("sources").alias("n_sources"))


@query(f"""select message_id, case when mood = 'negative' then 'I understand this might be frustrating. ' when mood = 'positive' then 'Great question! ' else '' end
    || case when n = 0 then case when kind = 'fact' then 'I couldn''t find specific facts matching your query in my knowledge base. This might be new information that needs to be added.' else 'I don''t have conceptual information about this topic in my knowledge base yet. Consider adding this concept for future reference.' end
      else case when kind = 'fact' then 'Based on my knowledge base, I found ' || n || ' relevant fact(s) for your query (relevance: ' || printf('%.2f', score) || '). Here''s what I found: ' || left(message, 200) || '...'
        else 'I''ve analyzed ' || n || ' related concepts from my knowledge base (relevance: ' || printf('%.2f', score) || '). Key concept: ' || left(message, 200) || '...' end || chr(10) || chr(10) || 'Sources: ' || case n when 1 then 'a' else 'a, b' end end
    || case when message_id % 2 = 0 then chr(10) || chr(10) || '**Related Concepts:** x, y' else '' end || case when message_id % 5 = 0 then chr(10) || chr(10) || '**Prerequisites:** You may want to review: z' else '' end
    || case when message_id % 7 = 0 then chr(10) || chr(10) || '**Learning Path:** p → q' else '' end as answer
  from (select *, {KIND} as kind, message_id % 3 as n, (message_id % 4) / 4.0::double as score, case when {base._P} > {base._N} then 'positive' when {base._N} > {base._P} then 'negative' else 'neutral' end as mood from (select *, {base._REASON} as r from messages))""")
def q8_template_answers(spark, d):
    m, none = F.col("message_id"), F.array().cast("array<string>")
    n = m % 3
    some = lambda hit, *words: F.when(hit, F.array(*map(F.lit, words))).otherwise(none)
    answer = K.template_answer(C.retrieval_type("message"), n, (m % 4) / 4.0, F.array("message"), F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), n.cast("int")), some(m % 2 == 0, "x", "y"), some(m % 5 == 0, "z"), some(m % 7 == 0, "p", "q"), C.sentiment_label("message"))
    return V.messages(spark, d).select("message_id", answer.alias("answer"))


HOP = "hop(seed, node, depth) as (select seed, seed, 0 from (select distinct seed from asked) union select seed, end_node_id, depth + 1 from hop join edges on node = start_node_id where depth < {most})"


@query(f"""with recursive asked as (select node_id as m, node_id as seed, 1 as sr from nodes where node_id % 50 = 0 union all select a.node_id, b.node_id, 2 from nodes a join nodes b on b.node_id = a.node_id + 1 where a.node_id % 50 = 0),
  {HOP.format(most=2)},
  near as (select m, node, min((sr, depth)) as spot from asked join (select seed, node, min(depth) as depth from hop where node <> seed group by all) using (seed) group by m, node),
  best as (select m, node, row_number() over (partition by m order by spot, node) as rank from near qualify rank <= 5),
  before as (select m, start_node_id as node, min(sr) as sr from asked join edges on end_node_id = seed where start_node_id <> seed group by all),
  need as (select m, node, row_number() over (partition by m order by sr, node) as rank from before anti join best using (m, node) qualify rank <= 3)
  select m as message_id, (select string_agg('part_' || seed, ',' order by sr) from asked a where a.m = x.m) as concepts, coalesce((select string_agg('part_' || node, ',' order by rank) from best b where b.m = x.m), '') as related,
    coalesce((select string_agg('part_' || node, ',' order by rank) from need n where n.m = x.m), '') as prerequisites from (select distinct m from asked) x""")
def q7_graph_context(spark, d):
    n = V.nodes(spark, d)
    asked = n.where("node_id % 50 = 0").select(F.col("node_id").alias("message_id"), F.concat(F.lit("What is "), "label", F.lit(" and Part_"), (F.col("node_id") + 1).cast("string"), F.lit("?")).alias("message"))
    got = K.graph_context(asked, n, V.edges(spark, d))
    return got.select("message_id", *[F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) for c in ("concepts", "related", "prerequisites")])


# searches from vectors into the graph -----------------------------------------------------------------

HITS = f"(select query_id, vec_id as key, s, row_number() over (partition by query_id order by s desc, vec_id) as rank from (select query_id, vec_id, {base.COS} as s from embeddings, qv))"


@query(f"""with recursive asked as (select query_id, min(node_id) as seed from {HITS} join links on chunk_id = key where rank = 1 group by query_id),
  {HOP.format(most=2)}
  select query_id, node, 'part_' || node as label, round(1.0 / (1 + depth), 9)::double as score from asked join (select seed, node, min(depth) as depth from hop where node <> seed group by all) using (seed)
  qualify row_number() over (partition by query_id order by depth, node) <= 5""")
def g13_graph_search(spark, d):
    return rounded(K.graph_search(base.few_hits(spark, d, 1), base.linked_chunks(spark, d), V.nodes(spark, d), V.edges(spark, d)), "score")


@query(f"""with top as (select * from {HITS} where rank <= 5),
  near as (select query_id, key, node_id as seed, end_node_id as node from top join links on chunk_id = key join edges on start_node_id = node_id where end_node_id <> node_id),
  two as (select distinct query_id, key, node from (select *, row_number() over (partition by query_id, key, seed order by node) as nth from near) where nth <= 2)
  select query_id, key, round(s, 6) as similarity, rank::int as rank, (select list_sort(list('part_' || node)) from two where two.query_id = top.query_id and two.key = top.key) as neighbours from top""")
def g15_hybrid_search(spark, d):
    return rounded(K.enriched_hits(base.few_hits(spark, d, 5), base.linked_chunks(spark, d), V.nodes(spark, d), V.edges(spark, d)), "similarity", places=6)


@query(f"""with recursive two as (select query_id, key, min(node_id) as a, max(node_id) as b from {HITS} join links on chunk_id = key where rank <= 2 group by all having count(*) > 1), asked as (select distinct a as seed from two),
  {HOP.format(most=64)}
  select query_id, key, min(depth)::int as hops from two join hop on seed = a and node = b group by all""")
def g14_path_search(spark, d):
    got = K.path_search(base.few_hits(spark, d, 2), base.linked_chunks(spark, d), V.nodes(spark, d), V.edges(spark, d))
    return got.select("query_id", "key", (F.size("names") - 1).alias("hops"))


GAPS = """e as (select distinct start_node_id as s, end_node_id as t from edges)
  select c.learner, c.node{more} from (select distinct learner, t as node from known join e on node = s) c {join}
  where not exists (select 1 from known k where k.learner = c.learner and k.node = c.node) and not exists (select 1 from e where e.t = c.node and not exists (select 1 from known k where k.learner = c.learner and k.node = e.s))"""


@query("with known as (select distinct user_id as learner, node_id as node from st join nodes on skill_id = 'skill_' || (node_id % 8) where probability_mastery > 0.9), " + GAPS.format(more="", join=""))
def m12_next_steps(spark, d):
    concepts = V.nodes(spark, d).select(F.concat(F.lit("skill_"), (F.col("node_id") % 8).cast("string")).alias("skill_id"), F.col("node_id").alias("node"))
    return G.next_steps(base.states(spark, d), concepts, V.edges(spark, d))


@query("with known as (select distinct start_node_id % 5 as learner, start_node_id as node from edges), " + GAPS.format(more=", label", join="join nodes on nodes.node_id = c.node"))
def g16_gaps_by_name(spark, d):
    names = V.edges(spark, d).select((F.col("start_node_id") % 5).alias("learner"), F.concat(F.lit(" PART_"), F.col("start_node_id").cast("string")).alias("name")).distinct()
    return G.gaps_by_name(V.nodes(spark, d), V.edges(spark, d), names)


@query(rf"""with named as (select p_partkey as node_id, p_name || ' ' || p_partkey as label, list_distinct(string_split_regex(lower(p_name || ' ' || p_partkey), '[^\p{{L}}\p{{N}}]+')) as w from part),
  terms as (select message_id, unnest(t) as term, generate_subscripts(t, 1) as pos from (select p_partkey as message_id, (list_filter(string_split_regex(lower(trim('explain ' || p_name)), '\s+'), lambda w: length(w) > 3 and w not in ({base._STOP})))[1:5] as t from part where p_partkey % 50 = 0)),
  hits as (select message_id, node_id, label, min(pos) as pos from terms join (select node_id, label, unnest(w) as term from named) using (term) group by all),
  best as (select message_id, node_id, label as concept, row_number() over (partition by message_id order by pos, node_id) as rank from hits qualify rank <= 3),
  ways as (select start_node_id as src, end_node_id as dst, edge_label from edges union all select end_node_id, start_node_id, edge_label from edges)
  select *, (row_number() over (partition by message_id, concept order by other, edge_label))::int as nth from (select distinct message_id, concept, rank::int as rank, named.label as other, edge_label from best join ways on src = best.node_id join named on named.node_id = dst) qualify nth <= 5""")
def g17_concepts_of_query(spark, d):
    part = V.table(spark, d, "part")
    named = part.select(F.col("p_partkey").alias("node_id"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("label"))
    asked = part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("message_id"), F.concat(F.lit("explain "), "p_name").alias("message"))
    return K.search_concepts_of_query(asked, named, V.edges(spark, d))


@query("select chunk_id as message_id, label as name, (row_number() over (partition by chunk_id order by node_id % 3, node_id, label))::int as rank from links join nodes using (node_id) qualify rank <= 2")
def l6_best_of_seeds(spark, d):
    rows = V.links(spark, d).join(V.nodes(spark, d), "node_id").select(F.col("chunk_id").alias("message_id"), F.col("label").alias("name"), (F.col("node_id") % 3).alias("seed_rank"), F.col("node_id").alias("place"))
    return G.best_of_seeds(rows, 2)


OTHERS = f"(select query_id, vec_id as key, {base.COS} as s from embeddings, qv where vec_id % 50 <> 0)"


@query(f"""with found as (select query_id, key, s, row_number() over (partition by query_id order by s desc, key) as rank, false as fallback from {OTHERS} where s >= 0.32 qualify rank <= 3),
  other as (select query_id, key, s, row_number() over (partition by query_id order by s desc, key) as rank, true as fallback from {OTHERS} qualify rank <= 2)
  select query_id, key, round(s, 6) as similarity, rank::int as rank, fallback from (select * from found union all select * from other where query_id not in (select query_id from found))""")
def v9_with_fallback(spark, d):
    e, q = V.table(spark, d, "embeddings").where("vec_id % 50 <> 0"), V.query_vectors(spark, d)
    return rounded(vectors.with_fallback(vectors.many_top_k(e, q, 3, 0.32), vectors.many_top_k(e, q, 2)), "similarity", places=6)


# classifiers, merges, summaries -------------------------------------------------------------------------

CATEGORIES = ("BIO", "chem lab", "Physics", "Earth and space", "MATH", "astro", "about energy", "general", "cs", "other", "")


def _standard() -> str:
    exact = " ".join(f"when upper(trim(c)) = '{code}' then '{name}'" for code, name in Q.SUBJECT_CODES)
    inside = " ".join(f"when contains(upper(c), '{code}') then '{name}'" for code, name in Q.SUBJECT_CODES)
    short = " ".join(f"when contains(lower(c), '{s.lower()}') then '{name}'" for s, name in Q.SHORT_SUBJECTS)
    return f"case when c is null or c = '' then 'General Science' {exact} {inside} {short} else 'General Science' end"


@query(f"select doc_id, {_standard()} as subject from (select doc_id, {list(CATEGORIES)}[doc_id % 12 + 1] || case when doc_id % 2 = 0 then '' else ' ' || source end as c from documents)")
def c8_standard_subject(spark, d):
    base_name = F.get(F.array(*map(F.lit, CATEGORIES)), (F.col("doc_id") % 12).cast("int"))
    category = F.concat(base_name, F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit(" "), "source")))
    return documents(spark, d).select("doc_id", Q.standard_subject(category).alias("subject"))


@query("select message_id, case when contains(m, 'que') then 'Que' when contains(m, 'der') then 'der' when contains(m, 'the') then 'THE' else 'Que' end as label, case when contains(m, 'que') or contains(m, 'der') or contains(m, 'the') then 0.8 else 0.3 end::double as confidence from (select message_id, lower(trim(message)) as m from messages)")
def c9_label_in_text(spark, d):
    return V.messages(spark, d).select("message_id", C.label_in_text("message", ("Que", "der", "THE")).alias("x")).select("message_id", "x.label", "x.confidence")


@query("select node_id, case when node_id % 3 = 0 then upper(label) else label end as label from nodes where node_id % 2 = 0 or node_id % 3 = 0")
def s17_upsert_graph_rows(spark, d):
    n = V.nodes(spark, d)
    return U.upsert_graph_rows(n.where("node_id % 2 = 0"), n.where("node_id % 3 = 0").withColumn("label", F.upper("label")), "node_id").select("node_id", "label")


@query("select source as file, count(*) filter (quality = 1) as imported, count(*) filter (quality <> 1) as failed, count(*) as total from documents join labels using (doc_id) group by source")
def a14_import_progress(spark, d):
    rows = documents(spark, d).join(V.table(spark, d, "labels"), "doc_id").select(F.col("source").alias("file"), (F.col("quality") == 1).alias("ok"))
    return io.import_progress(rows)


@query("""select count(*) filter (ok) as successes, count(*) filter (not ok) as failures, round(sum(seconds), 3) as seconds, sum(a)::bigint as chunks, sum(b)::bigint as concepts, sum(c)::bigint as definitions, round(avg(seconds) filter (ok), 6) as mean_seconds
  from (select doc_id % 5 <> 0 as ok, n_chars / 1000.0::double as seconds, case when doc_id % 5 <> 0 then doc_id % 4 end as a, case when doc_id % 5 <> 0 then doc_id % 6 end as b, case when doc_id % 5 <> 0 then doc_id % 3 end as c from documents)""")
def a17_run_summary(spark, d):
    i = F.col("doc_id")
    got = io.run_summary(documents(spark, d).select(i.alias("chapter_id"), (i % 5 != 0).alias("success"), (F.col("n_chars") / 1000.0).alias("seconds"), (i % 4).alias("chunks"), (i % 6).alias("concepts"), (i % 3).alias("definitions")))
    return got.withColumns({"seconds": F.round("seconds", 3), "mean_seconds": F.round("mean_seconds", 6)})


@query("select doc_id % 4 + 1 as batch_size, round(avg((doc_id % 3 <> 0)::int), 9) as success_rate, round(avg(n_chars / 1000.0::double) filter (doc_id % 3 <> 0), 6) as seconds_per_chunk from documents group by 1")
def a18_batch_rates(spark, d):
    i = F.col("doc_id")
    got = io.batch_rates(documents(spark, d).select((i % 4 + 1).alias("batch_size"), (i % 3 != 0).alias("ok"), (F.col("n_chars") / 1000.0).alias("seconds")))
    return got.withColumns({"success_rate": F.round("success_rate", 9), "seconds_per_chunk": F.round("seconds_per_chunk", 6)})


@query("select event_id, event_id % 17 <> 0 and event_id % 19 <> 0 as recorded from le")
def m10_record_batch(spark, d):
    i = F.col("event_id")
    rows = V.learning_events(spark, d).withColumns({"is_correct": F.when(i % 17 != 0, F.col("is_correct")), "attempts": F.when(i % 19 == 0, 0).otherwise(F.col("attempts"))})
    good, bad = M.record_batch(rows)
    return good.select("event_id", F.lit(True).alias("recorded")).unionByName(bad.select("event_id", F.lit(False).alias("recorded")))


@query("select question_id, difficulty from (select * from q0 order by question_id limit 50) where difficulty = 'easy'")
def f14_capped(spark, d):
    return Q.capped(V.questions(spark, d), 50, "question_id", difficulty="easy").select("question_id", "difficulty")


@query(f"select skill_id, skill_name, probability_mastery, {base.STATUS} as status from st join skills using (skill_id) where user_id = 3")
def u1_u2_student_mastery(spark, d):
    base.states(spark, d).createOrReplaceTempView("student_skills")
    V.skills(spark, d).createOrReplaceTempView("skills_registry")
    functions.register(spark)
    return spark.sql(f"select * from {functions.register_student_report(spark)}('3')")


@query(f"""select chunk_id as key, round(similarity, 6) as similarity from (select chunk_id, subject, {base.COS} as similarity from vectored, (select query from qv where query_id = 0))
    where similarity >= 0.1 qualify row_number() over (partition by subject order by similarity desc, chunk_id) <= 5""")
def u1_similar_rows(spark, d):
    """The five nearest chunks of each subject, by a table function that SQL calls with a table."""
    functions.register_similar_rows(spark)
    rows = V.vectored(spark, d).select(F.col("chunk_id").alias("key"), "subject", "embedding")
    first = V.query_vectors(spark, d).where("query_id = 0")
    found = spark.sql("select * from similar_rows(TABLE({t}) PARTITION BY (subject), (select query from {q}), 0.1D, 5)", t=rows, q=first)
    return rounded(found, "similarity", places=6)


# files: what a query reads is written by Spark from the tables -------------------------------------------


def as_files(df: DataFrame, group, whole) -> str:
    """JSON text of ``whole`` over the rows of each group, a file each; the folder."""
    path = place(df.sparkSession, "files")
    df.groupBy(group.alias("g")).agg(F.to_json(whole).alias("value")).write.partitionBy("g").text(path)
    return path


def hundred():
    return F.floor(F.col("doc_id") / 100)


@query("select doc_id::varchar as id, source as subject, case when doc_id % 2 = 0 then 'easy' else 'hard' end as difficulty, text as stem, lang as correct_answer from documents where doc_id % 10 <> 0 and text is not null and source is not null and lang is not null")
def s1_read_bank(spark, d):
    q = F.struct(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("subject"), F.when(F.col("doc_id") % 2 == 0, "easy").otherwise("hard").alias("difficulty"),
        F.col("text").alias("stem"), F.when(F.col("doc_id") % 10 != 0, F.col("lang")).alias("correct_answer"),
    )
    path = as_files(documents(spark, d), hundred(), F.struct(F.collect_list(q).alias("questions")))
    return io.read_bank(spark, path)[0].select("id", "subject", "difficulty", "stem", "correct_answer")


@query("select doc_id::varchar as id, 'science' as subject, 'medium' as difficulty, text as stem, lang as correct_answer, source as chapter_ref from documents where text is not null and lang is not null")
def s2_import_test_bank(spark, d):
    q = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("question"), F.col("lang").alias("answer"), F.col("source").alias("chapter"))
    path = as_files(documents(spark, d), hundred(), F.collect_list(q))
    return io.import_test_bank(spark, path, "science")[0].select("id", "subject", "difficulty", "stem", "correct_answer", "chapter_ref")


@query("select doc_id::varchar as id, text as stem from documents")
def s3_export_bank(spark, d):
    path = place(spark, "bank")
    io.export_bank(documents(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("stem")), path)
    return spark.read.schema("id string, stem string").json(path)


@query("select text as question, lang as correct_answer, source as distractor1, null::varchar as support from documents")
def s4_read_science_parquet(spark, d):
    path = place(spark, "science")
    documents(spark, d).select(F.col("text").alias("question"), F.col("lang").alias("correct_answer"), F.col("source").alias("distractor1")).write.parquet(path)
    return io.read_science_parquet(spark, path).select("question", "correct_answer", "distractor1", "support")


@query("select text as question, lang as correct_answer, source as support from documents where text is not null")
def s5_read_science_jsonl(spark, d):
    path = place(spark, "science")
    documents(spark, d).select(F.col("text").alias("question"), F.col("lang").alias("correct_answer"), F.col("source").alias("support")).write.json(path)
    return io.read_science_jsonl(spark, path).select("question", "correct_answer", "support")


@query("select text as question_text, lang as correct_answer, source as category, 'easy' as difficulty from documents where text <> '' and lang <> ''")
def s6_read_competition(spark, d):
    q = F.struct(F.col("text"), F.col("lang").alias("answer"), F.col("source").alias("category"))
    path = as_files(documents(spark, d), hundred(), F.collect_list(q))
    return io.read_competition(spark, path, "middle_school").select("question_text", "correct_answer", "category", "difficulty")


@query("select text as question_text, lang as correct_answer, [source] as distractors, 'Science: ' || source as category, 'Science' as category_key from documents")
def s7_trivia_questions(spark, d):
    rows = documents(spark, d).select(F.col("text").alias("question"), F.col("lang").alias("correct_answer"), F.array("source").alias("incorrect_answers"), F.lit("easy").alias("difficulty"), F.lit("multiple").alias("type"), F.concat(F.lit("Science: "), "source").alias("category"))
    return io.trivia_questions(rows).select("question_text", "correct_answer", "distractors", "category", "category_key")


@query("select 'sciq_' || (row_number() over (order by question) - 1) as question_id, question as question_text, [lang] as distractors from (select doc_id || ' ' || text as question, lang from documents where text is not null and lang is not null)")
def s8_unified_science(spark, d):
    rows = documents(spark, d).where("text is not null and lang is not null").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(" "), "text").alias("question"), F.col("source").alias("correct_answer"), F.col("lang").alias("distractor1"), F.lit(None).cast("string").alias("distractor2"), F.lit(None).cast("string").alias("distractor3"), F.col("source").alias("support"),
    )
    return io.unified_science(rows).select("question_id", "question_text", "distractors")


@query("select chunk_id::varchar as chunk_id, content, len(embedding)::int as size, round(list_sum(embedding::double[]), 4) as total from vectored where chunk_id % 3 <> 0")
def s9_read_embedding_pair(spark, d):
    rows = V.vectored(spark, d).withColumn("doc_id", F.col("chunk_id"))
    ident = F.col("chunk_id").cast("string").alias("chunk_id")
    metadata = as_files(rows, hundred(), F.struct(F.collect_list(F.struct(ident, "chapter_id", "book_id", "content")).alias("chunks")))
    found = as_files(rows.where("chunk_id % 3 <> 0"), hundred(), F.struct(F.collect_list(F.struct(ident, "embedding")).alias("embeddings")))
    joined = io.join_vectors(*io.read_embedding_pair(spark, metadata, found))[0]
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return joined.select("chunk_id", "content", F.size("embedding").alias("size"), F.round(total, 4).alias("total"))


@query("select chunk_id, case when length(content) > 500 then left(content, 500) || '...' else content end as content from chunks")
def s10_write_chunk_review(spark, d):
    path = place(spark, "review")
    io.write_chunk_review(V.chunks(spark, d).select("chapter_id", "chunk_id", "content"), path)
    return spark.read.schema("chunk_id long, content string, chapter_id string").json(path).select("chunk_id", "content")


@query("select chunk_id, 5 as shown, len(embedding)::int as size, left(content, 1000) as content from vectored")
def s11_write_embeddings(spark, d):
    a, b = place(spark, "metadata"), place(spark, "vectors")
    io.write_embeddings(V.vectored(spark, d).select("chunk_id", "content", "embedding"), a, b)
    head = spark.read.schema("chunk_id long, embedding_preview array<float>, embedding_size int").json(a)
    whole = spark.read.schema("chunk_id long, content string").json(b)
    return head.join(whole, "chunk_id").select("chunk_id", F.size("embedding_preview").alias("shown"), F.col("embedding_size").alias("size"), "content")


@query("select count(*) filter (doc_id % 5 <> 0) as successes, count(*) filter (doc_id % 5 = 0) as failures from documents")
def s12_write_progress(spark, d):
    path, i = place(spark, "progress"), F.col("doc_id")
    io.write_progress(documents(spark, d).select(i.alias("chapter_id"), (i % 5 != 0).alias("success"), F.col("n_chars").cast("double").alias("seconds"), (i % 4).alias("chunks"), (i % 6).alias("concepts"), (i % 3).alias("definitions")), path)
    return spark.read.schema("successes long, failures long").json(path)


LOG_CASES = " union all ".join(f"select '{name}' as type, line from logs where regexp_matches(line, '(?i){pattern}')" for name, pattern in io.LOG_PATTERNS.items())


@query(f"""with logs as (select unnest(string_split(text, chr(10))) as line from documents where text is not null and source is not null
  union all select 'student ' || user_id || ' answered ' || event_id from events union all select 'actual name: ' || p_name || ' seen' from part where p_name is not null)
  select type, count(*) as n, sum(length(line))::bigint as characters from ({LOG_CASES}) group by type""")
def s19_scan_logs(spark, d):
    """Personal data on the lines of every document, event and part, written as logs and read in splits; a test
    compares files, line numbers and previews with a plain loop."""
    path = place(spark, "logs")
    lines = documents(spark, d).where("text is not null and source is not null").select("source", "text")
    lines = lines.unionByName(V.table(spark, d, "events").select(F.lit("events").alias("source"), F.concat(F.lit("student "), "user_id", F.lit(" answered "), "event_id").alias("text")))
    lines = lines.unionByName(V.table(spark, d, "part").where("p_name is not null").select(F.lit("parts").alias("source"), F.concat(F.lit("actual name: "), "p_name", F.lit(" seen")).alias("text")))
    lines.write.partitionBy("source").text(path)
    found = io.scan_logs(spark, path)
    whole = io.log_lines(spark, path)
    return found.join(whole, ["file", "line_number"]).groupBy("type").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("characters"))


@query("select user_id::varchar as user_id, user_id % 13 / 10.0::double as initial_skill_level from (select distinct user_id from events) where user_id % 13 <= 10")
def s20_read_students(spark, d):
    path = place(spark, "students")
    V.table(spark, d, "events").select("user_id").distinct().select("user_id", (F.col("user_id") % 13 / 10.0).alias("initial_skill_level")).write.option("header", True).csv(path)
    return io.read_students(spark, path)[0]


# streams --------------------------------------------------------------------------------------------------


def drained(stream: DataFrame, put, path: str) -> DataFrame:
    """Run a stream over all there is through a batch function, and read the table it keeps."""
    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}-marks").trigger(availableNow=True)
    writer.start().awaitTermination()
    return stream.sparkSession.read.parquet(path)


@query(base.BAYES + " select user_id::varchar as user_id, skill_id, event_id, round(p, 6) as probability_mastery, n as total_attempts from bt qualify row_number() over (partition by user_id, skill_id order by rn desc) = 1")
def r2_states_table(spark, d):
    path = place(spark, "states")
    moves = S.mastery_stream(base.event_stream(spark, d))
    keys = ["user_id", "skill_id"]
    got = drained(moves, S.into_table(path, keys, [c for c in moves.columns if c not in keys]), path)
    return rounded(got.select("user_id", "skill_id", "event_id", "probability_mastery", "total_attempts"), "probability_mastery", places=6)


@query("select event_id, user_id from le order by us desc, event_id desc limit 20")
def r3_newest_table(spark, d):
    path = place(spark, "newest")
    return drained(base.event_stream(spark, d), S.newest_into(path, 20), path).select("event_id", "user_id")


@query("select user_id::varchar as user_id, max(us) as last_seen_us from le group by user_id having max(us) // 1000 + 300000 <= (select max(us) // 1000 - 60000 from le)")
def r4_inactive_users(spark, d):
    return S.run_to_table(S.inactivity(base.event_stream(spark, d)), "silent")


@query("select event_id, user_id from clicks where ((us // 3600000000) + 1) * 3600000 > (select max(us) // 1000 - 60000 from clicks)")
def r6_open_windows(spark, d):
    """Clicks of the windows that a stream has not closed, by a batch run over everything."""
    rows = M.with_time(V.clicks(spark, d)).withColumn("hour", F.floor(F.col("us") / 3600000000).cast("long"))
    closed = base.r6_clicks_by_window(spark, d).select("user_id", "hour")
    return S.late_rows(rows, rows.join(closed, ["user_id", "hour"], "left_semi"), ["event_id"]).select("event_id", "user_id")


def in_stretches(rows: DataFrame, stretch, count: int, run) -> None:
    """Let a stream see ``rows`` stretch by stretch: each is added to the folder that the stream reads, and the stream
    is started again from its checkpoint. ``run(stream, checkpoint)`` runs it to the end."""
    spark, path = rows.sparkSession, place(rows.sparkSession, "arrivals")
    for i in range(count):
        rows.where(stretch == i).write.mode("append").parquet(f"{path}/rows")
        run(spark.readStream.schema(rows.schema).parquet(f"{path}/rows"), f"{path}/marks")


CLICK_SPAN = 3 * 86400


@query(f"""select user_id::varchar as user_id, w as window_us, number, case when n = 3 then 'full' else 'time' end as reason, n, first_us, last_us, event_ids from (
    select user_id, w, k as number, count(*) as n, min(us) as first_us, max(us) as last_us, list(event_id order by us, event_id) as event_ids from (
      select *, us // {CLICK_SPAN}000000 * {CLICK_SPAN}000000 as w, (row_number() over (partition by user_id, us // {CLICK_SPAN}000000 order by us, event_id) - 1) // 3 as k from clicks) group by user_id, w, k)
    where n = 3 or (w + {CLICK_SPAN}000000) // 1000 <= (select max(us) // 1000 - 60000 from clicks)""")
def r5_click_batches(spark, d):
    """Batches of three clicks or three days: the test tables have no users with 50 clicks in 5 seconds."""
    clicks = base.event_stream(spark, d).where("event_type = 'click'")
    return S.run_to_table(T.click_batches(clicks, 3, CLICK_SPAN, "1 minute"), "click-batches", start=T.begin)


@lru_cache(maxsize=4)
def dashboard(spark, d) -> str:
    """The folder of a dashboard that a stream has kept over three stretches of time, started again for each."""
    rows, path = V.learning_events(spark, d), place(spark, "dashboard")
    third = F.when(F.col("timestamp") < "2024-01-11", 0).when(F.col("timestamp") < "2024-01-21", 1).otherwise(2)

    def run(stream, marks):
        writer = T.card_changes(stream).writeStream.outputMode("update").foreachBatch(T.dashboard_into(path))
        T.begin(writer.option("checkpointLocation", marks).trigger(availableNow=True)).awaitTermination()

    in_stretches(rows, third, 3, run)
    return path


@query(base.CARDS.replace("select *", "select * replace (user_id::varchar as user_id)", 1))
def r2_live_cards(spark, d):
    return rounded(T.live_cards(spark, dashboard(spark, d)), "avg_mastery")


@query(base.TOTALS)
def r2_live_totals(spark, d):
    return T.live_totals(spark, dashboard(spark, d))


LATE_SECONDS = 5 * 86400
ARRIVAL = "(event_id * 1103515245 + 12345) % 2147483648"


@query(f"""select event_id, user_id::varchar as user_id, behind_us from (select *, max(us) over (partition by user_id order by arrival, event_id rows between unbounded preceding and 1 preceding) - {LATE_SECONDS}000000 - us as behind_us
    from (select *, {ARRIVAL} as arrival from le)) where behind_us > 0""")
def r9_late_rows(spark, d):
    """The events that come more than five days behind their user's newest one, in an order of arrival that mixes
    the times, by a stream that is started four times."""
    path = place(spark, "late")
    rows = V.learning_events(spark, d).withColumn("arrival", F.expr(ARRIVAL))

    def run(stream, marks):
        writer = T.lateness(stream, LATE_SECONDS, "arrival").writeStream.format("parquet").option("checkpointLocation", marks)
        T.begin(writer.trigger(availableNow=True), path).awaitTermination()

    in_stretches(rows, F.floor(F.col("arrival") / 2**29), 4, run)
    return spark.read.parquet(path).where("late").select("event_id", "user_id", "behind_us")
