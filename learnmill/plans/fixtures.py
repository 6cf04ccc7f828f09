"""Views over the test tables, each one projection, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnmill.operators import questions as Q


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def learning_events(spark: SparkSession, d: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    return table(spark, d, "events").select(
        "event_id", "user_id", F.concat(F.lit("skill_"), (k % 8).cast("string")).alias("skill_id"), (~F.col("event_type").isin("error", "signup")).alias("is_correct"),
        (F.col("event_id") % 3 + 1).alias("attempts"), F.floor("value").cast("long").alias("time_spent_seconds"), F.col("ts").alias("timestamp"),
        F.when(F.col("event_type") == "signup", "AGENT_ACTION").otherwise("STUDENT_ACTION").alias("event_type"), F.when(F.col("event_type") == "signup", F.col("props")).alias("source_text"),
    )


def skills(spark: SparkSession, d: str) -> DataFrame:
    """The skills named in the events' props, one of which no answer has."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long") % 9
    return table(spark, d, "events").select(k.alias("k")).where("k is not null").distinct().select(
        F.concat(F.lit("skill_"), F.col("k").cast("string")).alias("skill_id"), F.concat(F.lit("Skill "), F.col("k").cast("string")).alias("skill_name"),
        F.when(F.col("k") % 2 == 0, "biology").otherwise("physics").alias("subject"), (F.col("k") % 4 + 6).alias("grade_level"),
    )


def clicks(spark: SparkSession, d: str) -> DataFrame:
    element = F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("el_"), (F.col("event_id") % 7).cast("string")))
    return table(spark, d, "events").where("event_type = 'click'").select("event_id", "user_id", element.alias("element_id"), (F.col("event_id") % 1000).alias("x"), (F.col("event_id") % 700).alias("y"), F.col("ts").alias("timestamp"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every document, with the vector of its number where there is one."""
    docs, vecs = table(spark, d, "documents"), table(spark, d, "embeddings")
    return docs.join(vecs, docs["doc_id"] == vecs["vec_id"], "left").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("book_id"), F.concat("source", F.lit("-chapter-"), (F.col("doc_id") % 10).cast("string")).alias("chapter_id"),
        F.col("text").alias("content"), F.col("label").cast("string").alias("subject"), (F.col("doc_id") % 4 + 6).alias("grade_level"), "embedding",
    )


def vectored(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that have a vector, which a vector search can find."""
    return chunks(spark, d).where("embedding is not null")


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    i, text = F.col("doc_id"), F.col("text")
    source = F.when(i % 3 == 0, "sciq").when(i % 3 == 1, "science_bowl").otherwise("opentdb")
    level = F.when(i % 4 == 0, "easy").when(i % 4 == 2, "hard").otherwise("medium")
    return table(spark, d, "documents").select(i.alias("question_id"), text.alias("question_text"), source.alias("source"), level.alias("difficulty"), Q.subject_by_votes(text).alias("subject"), Q.topic(text).alias("topic"))


def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), F.col("conv_id").alias("user_id"), F.col("text").alias("message"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.lit("parts").alias("graph_name"), F.col("p_partkey").alias("node_id"), F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("label"),
        F.to_json(F.struct(F.col("p_brand").alias("domain"))).alias("properties"),
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    one = lines.where("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("a"))
    two = lines.where("l_linenumber = 2").select("l_orderkey", F.col("l_partkey").alias("b"))
    pairs = one.join(two, "l_orderkey").where("a <> b").select("a", "b").distinct()
    return pairs.select(
        F.lit("parts").alias("graph_name"), (F.col("a") * 1000000 + F.col("b")).alias("edge_id"), F.col("a").alias("start_node_id"), F.col("b").alias("end_node_id"),
        F.when(F.col("a") < F.col("b"), "RELATED_TO").otherwise("PREREQUISITE").alias("edge_label"),
    )


def links(spark: SparkSession, d: str) -> DataFrame:
    ids = chunks(spark, d).select("chunk_id").where("chunk_id % 7 <> 0")
    low = ids.select("chunk_id", (F.col("chunk_id") % 50).alias("node_id"))
    high = ids.select("chunk_id", (F.col("chunk_id") % 30 + 50).alias("node_id"))
    return low.unionByName(high).withColumn("relevance", 1.0 / (1 + F.col("node_id") % 4))


def contains_any(column: str, words) -> str:
    return "(" + " or ".join(f"contains({column}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def votes(column: str, words) -> str:
    return "(" + " + ".join(f"contains({column}, '{w}')::int" for w in words) + ")"


def ladder(column: str, rules, default: str) -> str:
    cases = " ".join(f"when {contains_any(column, (parts,) if isinstance(parts, str) else parts)} then '{str(v).replace(chr(39), chr(39) * 2)}'" for parts, v in rules)
    return f"case {cases} else {default} end"


_BIO, _CHEM, _PHYS = (votes("lower(question_text)", w) for w in (Q.BIOLOGY, Q.CHEMISTRY, Q.PHYSICS))

#: The same views as DuckDB common table expressions; each may use those before it.
CTES = {
    "le": """select event_id, user_id, 'skill_' || (k % 8) as skill_id, event_type not in ('error', 'signup') as is_correct, 1 + event_id % 3 as attempts,
        floor(value)::bigint as time_spent_seconds, ts as timestamp, epoch_us(ts) as us
      from (select *, regexp_extract(props, '([0-9]+)', 1)::bigint as k from events)""",
    "skills": """select 'skill_' || k as skill_id, 'Skill ' || k as skill_name, case when k % 2 = 0 then 'biology' else 'physics' end as subject, 6 + k % 4 as grade_level
      from (select distinct regexp_extract(props, '([0-9]+)', 1)::bigint % 9 as k from events) where k is not null""",
    "seq": "select *, row_number() over (partition by user_id, skill_id order by us, event_id) as rn from le",
    "fold(user_id, skill_id, rn, p, n, ok, r, w, us)": """
      select user_id, skill_id, rn, case when is_correct then 0.5::double + 0.1::double else 0.5::double - 0.05::double end, attempts::bigint, is_correct::bigint, is_correct::bigint, (not is_correct)::bigint, us from seq where rn = 1
      union all
      select s.user_id, s.skill_id, s.rn, case when s.is_correct then least(1::double, f.p + 0.1::double) else greatest(0::double, f.p - 0.05::double) end, f.n + s.attempts, f.ok + s.is_correct::bigint,
        case when s.is_correct then f.r + 1 else 0 end, case when s.is_correct then 0 else f.w + 1 end, s.us
      from fold f join seq s on s.user_id = f.user_id and s.skill_id = f.skill_id and s.rn = f.rn + 1""",
    "st": """select user_id, skill_id, p as probability_mastery, n as total_attempts, ok as correct_attempts, r as consecutive_correct, w as consecutive_incorrect, us as last_attempt_us
      from fold qualify row_number() over (partition by user_id, skill_id order by rn desc) = 1""",
    "clicks": """select event_id, user_id, case when event_id % 11 <> 0 then 'el_' || (event_id % 7) end as element_id, ts as timestamp, epoch_us(ts) as us from events where event_type = 'click'""",
    "chunks": """select doc_id as chunk_id, source as book_id, source || '-chapter-' || (doc_id % 10) as chapter_id, text as content, label::varchar as subject, 6 + doc_id % 4 as grade_level, embedding
      from documents left join embeddings on doc_id = vec_id""",
    "vectored": "select * from chunks where embedding is not null",
    "qv": "select vec_id as query_id, embedding as query from embeddings where vec_id % 50 = 0",
    "q0": """select doc_id as question_id, text as question_text, case doc_id % 3 when 0 then 'sciq' when 1 then 'science_bowl' else 'opentdb' end as source,
      case doc_id % 4 when 0 then 'easy' when 2 then 'hard' else 'medium' end as difficulty from documents""",
    "questions": f"""select *, case when {_BIO} >= {_CHEM} and {_BIO} >= {_PHYS} then 'Biology' when {_CHEM} >= {_PHYS} then 'Chemistry' else 'Physics' end as subject,
      {ladder("lower(question_text)", Q.TOPICS, "null")} as topic from q0""",
    "messages": "select conv_id * 1000 + turn as message_id, conv_id as user_id, text as message from conversations where role = 'user'",
    "nodes": "select 'parts' as graph_name, p_partkey as node_id, 'part_' || p_partkey as label, p_brand as domain from part",
    "edges": """select 'parts' as graph_name, a * 1000000 + b as edge_id, a as start_node_id, b as end_node_id, case when a < b then 'RELATED_TO' else 'PREREQUISITE' end as edge_label
      from (select distinct x.l_partkey as a, y.l_partkey as b from lineitem x join lineitem y on x.l_orderkey = y.l_orderkey and x.l_linenumber = 1 and y.l_linenumber = 2) where a <> b""",
    "links": """select chunk_id, node_id, 1.0::double / (1 + node_id % 4) as relevance from (
      select chunk_id, chunk_id % 50 as node_id from chunks where chunk_id % 7 <> 0 union all select chunk_id, chunk_id % 30 + 50 from chunks where chunk_id % 7 <> 0)""",
}


def sql(body: str) -> str:
    """``body`` behind the common table expressions that it uses, directly or through others."""
    import re

    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name, view in CTES.items():
            if name not in needed and re.search(rf"\b{name.split('(')[0]}\b", text):
                needed.add(name)
                todo.append(view)
    heads = [f"{name} as ({CTES[name]})" for name in CTES if name in needed]
    body = body.strip()
    if not heads:
        return body
    if body.lower().startswith("with "):
        body = body[5:]
        return "with recursive " + ",\n".join(heads) + ",\n" + (body[10:] if body.lower().startswith("recursive ") else body)
    return "with recursive " + ",\n".join(heads) + "\n" + body
