"""Readers and writers of questions, chunks, embeddings, logs and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from learnmill.functions.scalar import truncate
from learnmill.operators import questions as Q
from learnmill.schemas import BANK_QUESTION

ANY_QUESTION = (
    "id string, question_id string, type string, subject string, difficulty string, stem string, question string, text string, options array<string>, "
    "correct_answer string, answer string, explanation string, chapter_ref string, chapter string, section_ref string, section string, tags array<string>, "
    "category string, round string, number string, incorrect_answers array<string>, distractor1 string, distractor2 string, distractor3 string, support string"
)
BANK_REQUIRED = ("id", "subject", "difficulty", "stem", "correct_answer")


def whole_files(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def objects(spark: SparkSession, path, schema: str = ANY_QUESTION) -> DataFrame:
    """(file, q) of JSON files that hold a list, an object with ``questions``, or one object."""
    files = whole_files(spark, path)
    first = F.substring(F.trim(F.regexp_replace("value", r"^\s+", "")), 1, 1)
    listed = F.from_json("value", f"array<struct<{_fields(schema)}>>")
    held = F.from_json("value", f"struct<questions:array<struct<{_fields(schema)}>>>")["questions"]
    single = F.array(F.from_json("value", f"struct<{_fields(schema)}>"))
    rows = files.select("file", F.when(first == "[", listed).otherwise(F.coalesce(held, single)).alias("qs"))
    return rows.select("file", F.posexplode("qs").alias("nth", "q"))


def _fields(schema: str) -> str:
    return ", ".join(f"{a}:{b}" for a, b in (x.strip().split(" ", 1) for x in schema.split(", ")))


def read_bank(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(valid questions, others) of ``{"questions": […]}`` files."""
    rows = objects(spark, path, BANK_QUESTION).select("file", "nth", "q.*")
    whole = F.lit(True)
    for c in BANK_REQUIRED:
        whole = whole & F.col(c).isNotNull()
    return rows.where(whole), rows.where(~whole)


def import_test_bank(spark: SparkSession, path, subject: str) -> tuple[DataFrame, DataFrame]:
    """(questions in the bank's schema, progress by file); either spelling of a field counts."""
    rows = objects(spark, path).select("file", "nth", "q.*")
    stem, answer = F.coalesce("stem", "question"), F.coalesce("correct_answer", "answer")
    out = rows.select(
        "file", F.coalesce("id", F.concat_ws("_", F.lit(subject), (F.col("nth") + 1).cast("string"))).alias("id"), F.coalesce("type", F.lit("multiple_choice")).alias("type"), F.coalesce("subject", F.lit(subject)).alias("subject"),
        F.coalesce("difficulty", F.lit("medium")).alias("difficulty"), stem.alias("stem"), F.coalesce("options", F.array().cast("array<string>")).alias("options"), answer.alias("correct_answer"), F.coalesce("explanation", F.lit("")).alias("explanation"),
        F.coalesce("chapter_ref", "chapter").alias("chapter_ref"), F.coalesce("section_ref", "section").alias("section_ref"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )
    good = F.col("stem").isNotNull() & F.col("correct_answer").isNotNull()
    return out.where(good).drop("file"), import_progress(out.withColumn("ok", good))


def import_progress(rows: DataFrame) -> DataFrame:
    """Imported, failed and total per file of (file, ok)."""
    return rows.groupBy("file").agg(F.count_if("ok").alias("imported"), F.count_if(~F.col("ok")).alias("failed"), F.count("*").alias("total"))


def export_bank(bank: DataFrame, path: str) -> None:
    bank.write.mode("overwrite").json(path)


def read_science_parquet(spark: SparkSession, paths) -> DataFrame:
    """Splits of science questions; optional columns that are absent are null."""
    rows = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return with_columns(rows, {"question": "string", "correct_answer": "string", "distractor1": "string", "distractor2": "string", "distractor3": "string", "support": "string"})


def read_science_jsonl(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema("question string, correct_answer string, distractor1 string, distractor2 string, distractor3 string, support string").json(path).where("question is not null")


def with_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in wanted.items()])


def read_competition(spark: SparkSession, path, level: str = "high_school") -> DataFrame:
    """Competition questions of any of the three shapes; those without text or answer are left out."""
    rows = objects(spark, path).select("file", "nth", "q.*")
    filled = lambda *cs: F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in cs])
    category = F.coalesce(filled("category", "subject"), F.lit(""))
    out = rows.select(filled("question", "text").alias("question_text"), filled("answer", "correct_answer").alias("correct_answer"), Q.standard_subject(category).alias("subject"), category.alias("category"), F.lit("easy" if level == "middle_school" else "medium").alias("difficulty"), F.lit(level).alias("level"), F.col("round").alias("round_number"), F.col("number").alias("question_number"), "file", "nth")
    return out.where("question_text is not null and correct_answer is not null")


def trivia_questions(rows: DataFrame) -> DataFrame:
    """Trivia records to the common shape; the part of the category before the colon is its key."""
    return rows.select(
        F.col("question").alias("question_text"), "correct_answer", F.col("incorrect_answers").alias("distractors"), "difficulty", F.col("type").alias("question_type"), "category", F.trim(F.split("category", ":")[0]).alias("category_key"),
    )


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Add ``__nr``, 0 and up in order, without one task for all rows: the rows are range-partitioned,
    written, and each partition starts where the counts of those before it end."""
    from learnmill.operators.graph import pinned

    rows = pinned(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, within = F.shiftright("__at", 33).cast("int"), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = {r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, done = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append(done)
        done += counts.get(p, 0)
    return rows.withColumn("__nr", F.lit(starts or [0])[part] + within).drop("__at")


def unified_science(rows: DataFrame, order: str = "question") -> DataFrame:
    """Science questions in the one schema, numbered in order."""
    rows, i = numbered(rows, order), F.col("__nr")
    return rows.select(
        F.concat(F.lit("sciq_"), i.cast("string")).alias("question_id"), F.lit("sciq").alias("source"), F.col("question").alias("question_text"), "correct_answer", F.array_compact(F.array("distractor1", "distractor2", "distractor3")).alias("distractors"),
        Q.subject_by_votes(F.col("question")).alias("subject"), Q.topic(F.col("question")).alias("topic"), F.lit("medium").alias("difficulty"), F.lit(8).alias("grade_level"), F.col("support").alias("explanation"),
    )


def unified_competition(rows: DataFrame) -> DataFrame:
    rows, i = numbered(rows, "file", "nth"), F.col("__nr")
    return rows.select(
        F.concat(F.lit("science_bowl_"), i.cast("string")).alias("question_id"), F.lit("science_bowl").alias("source"), "question_text", "correct_answer", "subject", Q.topic(F.col("question_text"), Q.COMPETITION_TOPICS).alias("topic"), "difficulty",
        F.when(F.col("level") == "high_school", 9).otherwise(6).alias("grade_level"), F.create_map(F.lit("category"), "category", F.lit("level"), "level").alias("metadata"),
    )


def union_sources(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


CHUNK_JSON = "chunk_id string, chapter_id string, book_id string, title string, content string, content_type string, key_concepts array<string>, definitions map<string,string>, word_count int"


def read_embedding_pair(spark: SparkSession, metadata, vectors) -> tuple[DataFrame, DataFrame]:
    """Chunk metadata ``{"chunks": […]}`` and vectors ``{"embeddings": […]}``, or lists of either."""
    def rows(path, name: str, schema: str) -> DataFrame:
        kind = f"struct<{_fields(schema)}>"
        files = whole_files(spark, path)
        held = F.coalesce(F.from_json("value", f"struct<{name}:array<{kind}>>")[name], F.from_json("value", f"array<{kind}>"))
        return files.select(F.explode(held).alias("r")).select("r.*")

    return rows(metadata, "chunks", CHUNK_JSON), rows(vectors, "embeddings", "chunk_id string, embedding array<float>")


def join_vectors(chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks with their vector, chunks without one)."""
    return chunks.join(vectors.select("chunk_id", "embedding"), "chunk_id"), chunks.join(vectors, "chunk_id", "left_anti")


def write_chunk_review(chunks: DataFrame, path: str) -> None:
    chunks.withColumn("content", truncate("content", 500)).write.mode("overwrite").partitionBy("chapter_id").json(path)


def write_embeddings(chunks: DataFrame, metadata: str, vectors: str) -> None:
    """Metadata with the first five values of each vector, and whole vectors with cut content."""
    preview = chunks.withColumn("embedding_preview", F.slice("embedding", 1, 5)).withColumn("embedding_size", F.size("embedding"))
    preview.drop("embedding").write.mode("overwrite").json(metadata)
    chunks.withColumn("content", F.substring("content", 1, 1000)).write.mode("overwrite").json(vectors)


def run_summary(results: DataFrame) -> DataFrame:
    """One row from (chapter_id, success, seconds, chunks, concepts, definitions)."""
    ok = F.col("success")
    return results.agg(
        F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), F.sum("seconds").alias("seconds"), F.sum(F.when(ok, F.col("chunks"))).alias("chunks"), F.sum(F.when(ok, F.col("concepts"))).alias("concepts"),
        F.sum(F.when(ok, F.col("definitions"))).alias("definitions"), F.avg(F.when(ok, F.col("seconds"))).alias("mean_seconds"),
    )


def write_progress(results: DataFrame, path: str) -> None:
    run_summary(results).write.mode("overwrite").json(path)


def batch_rates(results: DataFrame) -> DataFrame:
    """Success rate and mean seconds a chunk by batch size of (batch_size, ok, seconds)."""
    return results.groupBy("batch_size").agg(F.avg(F.col("ok").cast("double")).alias("success_rate"), F.avg(F.when(F.col("ok"), F.col("seconds"))).alias("seconds_per_chunk"))


def log_lines(spark: SparkSession, path) -> DataFrame:
    """(file, line_number from 1, line) of text files, which are read in splits: a line's number is its place in
    its split and the lines of the splits before it. Lines are counted in a pass of their own, a row a split."""
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # in the task, whose splits come one after the other
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"), place.alias("place"))
    splits = rows.groupBy("file", "start").agg(F.count("*").alias("lines"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(splits.withColumn("before", before), ["file", "start"]).select("file", (F.col("before") + F.col("place") - F.col("first") + 1).alias("line_number"), "line")


#: What a log line may not hold. Case does not matter.
LOG_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"\b\d{3}-\d{3}-\d{4}\b",
    "credit_card": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    "student_id": r"\b(SID|Student|student)[-_\s]?(ID|id)?[-_\s]?\d+\b",
    "real_name_context": r"(real|actual|true)[-_\s]?(name|Name)[-_\s]?[:is]\s+[A-Z][a-z]+\s+[A-Z][a-z]+",
}


def scan_logs(spark: SparkSession, path, patterns: dict[str, str] = LOG_PATTERNS) -> DataFrame:
    """(file, line_number, type, preview) of each kind of personal data on each line; the preview is the first 100
    characters of the stripped line. Lines without a find do not leave the scan."""
    found = F.array_compact(F.array(*[F.when(F.col("line").rlike(f"(?iU){p}"), F.lit(name)) for name, p in patterns.items()]))
    rows = log_lines(spark, path).withColumn("types", found).where(F.size("types") > 0)
    preview = F.substring(F.regexp_replace("line", r"(?U)^\s+|\s+$", ""), 1, 100)
    return rows.select("file", "line_number", F.explode("types").alias("type"), preview.alias("preview"))


def read_students(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(students, rejects) of CSV files ``user_id,initial_skill_level``; levels lie in [0, 1]."""
    rows = spark.read.schema("user_id string, initial_skill_level double").csv(path, header=True)
    good: Column = F.col("user_id").isNotNull() & F.coalesce(F.col("initial_skill_level").between(0, 1), F.lit(False))
    return rows.where(good), rows.where(~good)


def content_totals(**tables: DataFrame) -> DataFrame:
    """(table_name, n) of each table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    return union_sources(*parts)


def chunk_statistics(chunks: DataFrame, words: Column) -> DataFrame:
    kind = F.col("content_type")
    return chunks.agg(F.count("*").alias("chunks"), *[F.count_if(kind == k).alias(k) for k in ("definition", "example", "summary", "narrative")], F.count_distinct("book_id").alias("books"), F.round(F.avg(words), 1).alias("mean_words"))
