"""Pages to chapters, chapters to chunks, chunks to concepts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from learnmill.functions.scalar import col, truncate, word_count
from learnmill.session import bound_batches

MAX_WORDS, OVERLAP = 800, 2
# How a chapter, a section, a kind of content begins.
CHAPTER = (r"^Chapter\s+(\d+)[\s:]+(.+)", r"^Chapter\s+(\d+)$", r"^Part\s+[IVX]+[\s:]+(.+)", r"^Section\s+(\d+)[\s:]+(.+)", r"^(Appendix|Glossary|Index|References)[\s:]*")
SKIP_WORDS = ("appendix", "glossary", "index", "references", "bibliography", "contents", "preface", "introduction")
SECTION = (r"^\d+\.\d+\s+\S+", r"^\d+\s+[A-Z][A-Z\s]+$")
DEFINITION = (r"^(.+) is (?:defined as|a|an) ", r"^definition:?\s*(.+)", r"^(.+) - (?:defined as|means?) ")
EXAMPLE = (r"^for example", r"^for instance", r"^example", r"^(e\.g\.|eg)")
SUMMARY = r"^(summary|key terms|review|chapter review)"


def page_lines(pages: DataFrame) -> DataFrame:
    """(book_id, page_number, line_number, line) of (book_id, page_number, text)."""
    return pages.select("book_id", "page_number", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_number", "line"))


def chapters_from_text(pages: DataFrame) -> DataFrame:
    """Chapter headings in order: book_id, seq, chapter_number, title, start_page. A heading without a
    number gets the count of such headings of its book so far."""
    rows = page_lines(pages)
    number = F.when(F.col("line").rlike(CHAPTER[0]), F.regexp_extract("line", CHAPTER[0], 1)).when(F.col("line").rlike(CHAPTER[1]), F.regexp_extract("line", CHAPTER[1], 1)).when(F.col("line").rlike(CHAPTER[3]), F.regexp_extract("line", CHAPTER[3], 1))
    title = (
        F.when(F.col("line").rlike(CHAPTER[0]), F.regexp_extract("line", CHAPTER[0], 2)).when(F.col("line").rlike(CHAPTER[1]), F.col("line")).when(F.col("line").rlike(CHAPTER[2]), F.regexp_extract("line", CHAPTER[2], 1))
        .when(F.col("line").rlike(CHAPTER[3]), F.regexp_extract("line", CHAPTER[3], 2)).when(F.col("line").rlike(CHAPTER[4]), F.regexp_extract("line", CHAPTER[4], 1))
    )
    found = rows.select("book_id", "page_number", "line_number", number.cast("int").alias("number"), F.trim(title).alias("title")).where("title is not null")
    w = Window.partitionBy("book_id").orderBy("page_number", "line_number")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return found.select("book_id", F.row_number().over(w).alias("seq"), F.coalesce("number", F.sum(F.col("number").isNull().cast("int")).over(upto)).alias("chapter_number"), "title", F.col("page_number").alias("start_page"))


def is_chapter_heading(title: Column | str) -> Column:
    low = F.lower(F.trim(col(title)))
    skip = F.lit(False)
    for w in SKIP_WORDS:
        skip = skip | low.contains(w)
    return F.coalesce((low != "") & ~skip & (low.contains("chapter") | low.contains("ch ")), F.lit(False))


def title_number(title: Column | str) -> Column:
    found = F.regexp_extract(col(title), r"\b(\d+)\b", 1)
    return F.when(found != "", found.cast("int"))


def end_pages(chapters: DataFrame, total_pages: DataFrame) -> DataFrame:
    """Add end_page: one before the next chapter's start (null if that is null or 1), the last page of
    the book for its last chapter. ``total_pages`` has (book_id, total_pages)."""
    w = Window.partitionBy("book_id").orderBy("seq")
    last = F.lead("seq").over(w).isNull()
    nxt = F.lead("start_page").over(w)
    rows = chapters.join(total_pages, "book_id", "left").withColumn("end_page", F.when(last, F.col("total_pages")).when(nxt > 1, nxt - 1))
    return rows.drop("total_pages")


def pages_of_chapters(pages: DataFrame, chapters: DataFrame) -> DataFrame:
    """Each page with its chapters: a chapter is spread to its pages, so the range join is an equi join."""
    whole = chapters.where("start_page is not null and end_page >= start_page")
    spread = whole.select("book_id", "chapter_number", "title", F.explode(F.sequence("start_page", "end_page")).alias("page_number"))
    return pages.join(spread, ["book_id", "page_number"])


def chapter_texts(pages: DataFrame) -> DataFrame:
    """Texts of (book_id, chapter_id, page_number, text) in order of pages, with a blank line between."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy("book_id", "chapter_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))


def section_headings(pages: DataFrame) -> DataFrame:
    """Headings of chapters' pages (book_id, chapter_id, page_number, text) with a running id."""
    lines = pages.select("book_id", "chapter_id", "page_number", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_number", "line"))
    lines = lines.withColumn("title", F.trim("line")).where(F.col("title").rlike(SECTION[0]) | F.col("title").rlike(SECTION[1]))
    n = F.row_number().over(Window.partitionBy("chapter_id").orderBy("page_number", "line_number"))
    return lines.select("book_id", "chapter_id", F.concat("chapter_id", F.lit("_section_"), n.cast("string")).alias("section_id"), "title", F.lit(2).alias("level"), "page_number")


def table_markdown(headers: Column | str, rows: Column | str) -> Column:
    """Markdown of an array of headers and an array of rows of cells."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))
    rule = F.transform(col(headers), lambda _: F.lit("---"))
    return F.array_join(F.concat(F.array(line(col(headers)), line(rule)), F.transform(col(rows), line)), "\n")


def paragraphs(text: Column | str, separator: str = r"\n\n+") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), separator), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def chunk_paragraphs(parts: Column, max_words: int = MAX_WORDS, overlap: int = OVERLAP, joiner: str = "\n\n") -> Column:
    """Array of chunk texts of an array of paragraphs, by one fold that carries indices only.

    A chunk is closed before a paragraph that would take it over ``max_words``; the next one begins
    with its last ``overlap`` paragraphs if it has more. The fold keeps (first, words); the chunks'
    bounds are gathered and the texts cut from the paragraphs at the end.
    """
    sizes = F.transform(parts, lambda p: word_count(p))
    zero = F.struct(F.lit(0).alias("first"), F.lit(0).alias("words"), F.lit(0).alias("i"), F.array().cast("array<struct<a:int,n:int>>").alias("out"), F.array().cast("array<int>").alias("tail"))

    def step(s: Column, n: Column) -> Column:
        held = s["i"] - s["first"]
        full = (s["words"] + n > max_words) & (held > 0)
        carry = F.when(held > overlap, F.lit(overlap)).otherwise(0)
        tail_sum = F.aggregate(F.slice(s["tail"], -overlap, overlap), F.lit(0), lambda a, x: a + x)
        kept = F.when(held > overlap, tail_sum).otherwise(0)
        tail = F.concat(F.when(F.size(s["tail"]) >= overlap, F.slice(s["tail"], -(overlap - 1), overlap - 1) if overlap > 1 else F.array().cast("array<int>")).otherwise(s["tail"]), F.array(n))
        return F.struct(
            F.when(full, s["i"] - carry).otherwise(s["first"]).alias("first"), (F.when(full, kept).otherwise(s["words"]) + n).alias("words"), (s["i"] + 1).alias("i"),
            F.when(full, F.concat(s["out"], F.array(F.struct(s["first"].alias("a"), held.alias("n"))))).otherwise(s["out"]).alias("out"), tail.alias("tail"),
        )

    last = lambda s: F.when(s["i"] > 0, F.concat(s["out"], F.array(F.struct(s["first"].alias("a"), (s["i"] - s["first"]).alias("n"))))).otherwise(s["out"])
    return F.transform(F.aggregate(sizes, zero, step, last), lambda b: F.array_join(F.slice(parts, b["a"] + 1, b["n"]), joiner))


def pack(sizes: list[int], max_words: int, overlap: int) -> list[tuple[int, int]]:
    """(first, end) of each chunk of paragraphs of these sizes."""
    out, first, words = [], 0, 0
    for i, n in enumerate(sizes):
        if words + n > max_words and i > first:
            out.append((first, i))
            first = i - overlap if i - first > overlap else i
            words = sum(sizes[first:i])
        words += n
    return out + [(first, len(sizes))] if sizes else out


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", separator: str = r"\n\n+", max_words: int = MAX_WORDS, overlap: int = OVERLAP, joiner: str = "\n\n") -> DataFrame:
    """(key, chunk_number, content, word_count) of long documents too: Arrow batches of documents, bounded in rows and
    bytes, a plain walk over each one's paragraphs."""
    import re

    bound_batches(docs.sparkSession)
    cut = re.compile(separator)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, numbers, contents, words = [], [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts = [p.strip() for p in cut.split(t or "") if p.strip()]
                sizes = [len(p.split()) for p in parts]
                for n, (a, e) in enumerate(pack(sizes, max_words, overlap), 1):
                    keys.append(k)
                    numbers.append(n)
                    contents.append(joiner.join(parts[a:e]))
                    words.append(sum(sizes[a:e]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.types[0]), pa.array(numbers, pa.int32()), pa.array(contents, pa.string()), pa.array(words, pa.int32())], names=[key, "chunk_number", "content", "word_count"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, chunk_number int, content string, word_count int")


def content_type(text: Column | str) -> Column:
    low = F.lower(F.trim(col(text)))
    return F.when(_any(low, DEFINITION), "definition").when(_any(low, EXAMPLE), "example").when(low.rlike(SUMMARY), "summary").otherwise("narrative")


def _any(text: Column, patterns) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | text.rlike(p)
    return hit


def definitions(text: Column | str) -> Column:
    """Map of term to definition: the text from a defining phrase up to the next period; the first of
    a term's definitions counts. Empty definitions do not."""
    found = []
    for pattern in DEFINITION:
        spot = f"(?im){pattern}([^.]*)\\."
        group = 2
        terms, bodies = F.regexp_extract_all(col(text), F.lit(spot), F.lit(1)), F.regexp_extract_all(col(text), F.lit(spot), F.lit(group))
        found.append(F.arrays_zip(F.transform(terms, F.trim).alias("k"), F.transform(bodies, F.trim).alias("v")))
    pairs = F.filter(F.concat(*found), lambda p: (p["k"] != "") & (p["v"] != ""))
    keys = F.transform(pairs, lambda p: p["k"])
    once = F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1)
    return F.map_from_entries(F.transform(once, lambda p: F.struct(p["k"], p["v"])))


def capital_terms(text: Column | str) -> Column:
    """Sorted distinct capitalised words that do not begin a sentence, have over three letters, and
    end in s, are all capitals or hold an underscore."""
    sentences = F.split(col(text), r"[.!?]")
    words = F.flatten(F.transform(sentences, _after_first))
    good = F.filter(words, lambda w: w.rlike(r"^\p{Lu}") & (F.length(w) > 3) & (w.endswith("s") | ((F.upper(w) == w) & (F.lower(w) != w)) | w.contains("_")))
    return F.array_sort(F.array_distinct(good))


def _after_first(sentence: Column) -> Column:
    words = F.filter(F.split(sentence, r"\s+"), lambda w: w != "")
    return F.filter(words, lambda _, i: i > 0)


def chunk_metadata(content: Column | str, title: Column | str) -> list[Column]:
    return [word_count(content).alias("word_count"), F.length(col(content)).alias("char_count"), F.substring(col(title), 1, 100).alias("title"), content_type(content).alias("content_type")]


def table_chunks(tables: DataFrame) -> DataFrame:
    """Chunks of (chapter_id, chapter_number, page_number, chunk_number, caption, headers, rows)."""
    caption = F.concat(F.lit("Table: "), F.coalesce(F.when(F.col("caption") != "", F.col("caption")), F.lit("Data Table")))
    return tables.select(
        F.concat("chapter_id", F.lit("_table_"), F.col("chunk_number").cast("string")).alias("chunk_id"), "chapter_id", "chunk_number", caption.alias("title"),
        F.concat(caption, F.lit("\n\n"), table_markdown("headers", "rows")).alias("content"), F.lit("table").alias("content_type"),
        F.concat(F.lit("Chapter "), F.col("chapter_number").cast("string"), F.lit(", page "), F.col("page_number").cast("string")).alias("source_location"),
    )


def full_text(body: Column | str, sections: Column | str) -> Column:
    """A chapter's text, then the title and text of each section and its subsections, in order."""
    piece = lambda s: F.concat(F.lit("\n\n"), s["title"], F.lit("\n"), s["content"])
    whole = lambda s: F.concat(piece(s), F.array_join(F.transform(s["subsections"], piece), ""))
    return F.concat(F.coalesce(col(body), F.lit("")), F.coalesce(F.array_join(F.transform(col(sections), whole), ""), F.lit("")))


def chapter_chunks(chapters: DataFrame, sections: DataFrame, tables: DataFrame, separator: str = r"\n\n+") -> DataFrame:
    """Chunks of chapters (chapter_id, title, text): those of their text over 100 signs, of sections
    (chapter_id, section_number, title, content) over 50 signs, of tables (chapter_id, title, content)
    over ten words; numbered through each chapter in that order."""
    def chunked(df: DataFrame, least: int, rank: int) -> DataFrame:
        rows = chunk_documents(df.where(F.length("text") > least).select(F.struct("chapter_id", "title", "nth").alias("at"), "text"), "at", separator=separator)
        return rows.select("at.*", (F.col("chunk_number") - 1).alias("k"), "content", F.lit(rank).alias("rank"))

    a = chunked(chapters.select("chapter_id", "title", F.lit(0).alias("nth"), "text"), 100, 0)
    b = chunked(sections.select("chapter_id", "title", F.col("section_number").alias("nth"), F.col("content").alias("text")), 50, 1)
    c = tables.where(word_count("content") > 10).select("chapter_id", "title", F.col("table_number").alias("nth"), F.lit(0).alias("k"), "content", F.lit(2).alias("rank"))
    rows = a.unionByName(b).unionByName(c)
    n = F.row_number().over(Window.partitionBy("chapter_id").orderBy("rank", "nth", "k"))
    rows = rows.withColumn("chunk_number", n)
    kind = F.when(F.col("rank") == 2, "table").otherwise(content_type("content"))
    return rows.select(
        F.concat("chapter_id", F.when(F.col("rank") == 2, "_table_").otherwise("_chunk_"), F.col("chunk_number").cast("string")).alias("chunk_id"), "chapter_id", "chunk_number", F.substring("title", 1, 100).alias("title"), "content",
        kind.alias("content_type"), word_count("content").alias("word_count"), F.length("content").alias("char_count"), definitions("content").alias("definitions"), capital_terms("content").alias("key_concepts"),
    )


def process_chapters(chapters: DataFrame, sections: DataFrame, tables: DataFrame, done: DataFrame | None = None, embedder=None) -> tuple[DataFrame, DataFrame]:
    """(chunks with embeddings, chapters that failed, with the reason); chapters in ``done`` are skipped."""
    from .vectors import embed

    todo = chapters if done is None else chapters.join(done.select("chapter_id").distinct(), "chapter_id", "left_anti")
    reason = F.when(F.col("text").isNull(), "no text").when(F.trim("text") == "", "empty text")
    bad = todo.withColumn("reason", reason).where("reason is not null").select("chapter_id", "reason")
    good = todo.where(reason.isNull())
    chunks = chapter_chunks(good, sections.join(good, "chapter_id", "left_semi"), tables.join(good, "chapter_id", "left_semi"))
    return embed(chunks, embedder), bad


def chunk_preview(chunks: DataFrame, size: int = 500) -> DataFrame:
    return chunks.withColumn("content", truncate("content", size))
