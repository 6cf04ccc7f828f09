import re

from hypothesis import given, settings
from hypothesis import strategies as st
from learnmill.functions import scalar as X
from learnmill.operators import privacy as P
from learnmill.operators import text as T
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_paragraphs_and_words(spark):
    assert one(spark, T.paragraphs(F.lit(" a b \n\n\n\n c \n\n"))) == ["a b", "c"]
    assert one(spark, T.paragraphs(F.lit(None).cast("string"))) == []
    assert one(spark, X.word_count(F.lit("  a\tb\n c "))) == 3 and one(spark, X.word_count(F.lit(""))) == 0


def slow_chunks(sizes, most, overlap):
    out, held, words = [], [], 0
    for i, n in enumerate(sizes):
        if held and words + n > most:
            out.append(list(held))
            held = held[-overlap:] if len(held) > overlap else []
            words = sum(sizes[k] for k in held)
        held.append(i)
        words += n
    return out + ([held] if held else [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=40))
def test_pack_is_the_plain_walk(sizes):
    assert [list(range(a, e)) for a, e in T.pack(sizes, 20, 2)] == slow_chunks(sizes, 20, 2)


def test_chunk_fold_is_pack(spark):
    import random

    rnd = random.Random(4)
    docs = [(i, "\n\n".join(" ".join(["w"] * rnd.randint(1, 12)) for _ in range(rnd.randint(0, 30)))) for i in range(40)]
    df = spark.createDataFrame([*docs, (99, None)], "doc_id int, text string")
    a = {r["doc_id"]: r["c"] for r in df.select("doc_id", T.chunk_paragraphs(T.paragraphs("text"), 20).alias("c")).collect()}
    b = {}
    for r in T.chunk_documents(df, max_words=20).orderBy("doc_id", "chunk_number").collect():
        b.setdefault(r["doc_id"], []).append(r["content"])
    assert {k: v for k, v in a.items() if v} == b


def test_content_types_and_terms(spark):
    assert one(spark, T.content_type(F.lit("A cell is a unit of life"))) == "definition"
    assert one(spark, T.content_type(F.lit("For example, water"))) == "example"
    assert one(spark, T.content_type(F.lit("Key Terms and more"))) == "summary"
    assert one(spark, T.content_type(F.lit("Once upon"))) == "narrative"
    text = "Osmosis is defined as movement of water. The Membranes and DNA strands. Then NASA flew with Cells"
    assert one(spark, T.definitions(F.lit(text))) == {"Osmosis": "movement of water"}
    assert one(spark, T.capital_terms(F.lit(text))) == ["Cells", "Membranes", "NASA"]


def test_chapters(spark):
    rows = [("b", 1, "Contents\nx"), ("b", 2, "Chapter 1: Whole Numbers\n1.1 Introduction here\n12 ALL CAPS"), ("b", 5, "Chapter 2\ntext\nAppendix")]
    pages = spark.createDataFrame(rows, "book_id string, page_number int, text string")
    found = T.chapters_from_text(pages)
    assert [(r["chapter_number"], r["title"], r["start_page"]) for r in found.orderBy("seq").collect()] == [(1, "Whole Numbers", 2), (2, "Chapter 2", 5), (1, "Appendix", 5)]
    two = found.where("title <> 'Appendix'")
    ends = T.end_pages(two, spark.createDataFrame([("b", 9)], "book_id string, total_pages int"))
    assert [r["end_page"] for r in ends.orderBy("seq").collect()] == [4, 9]
    assert [r["chapter_number"] for r in T.pages_of_chapters(pages, ends).orderBy("page_number").collect()] == [1, 2]
    heads = T.section_headings(pages.withColumn("chapter_id", F.lit("c1")))
    assert [(r["section_id"], r["title"]) for r in heads.orderBy("section_id").collect()] == [("c1_section_1", "1.1 Introduction here"), ("c1_section_2", "12 ALL CAPS")]
    assert one(spark, T.is_chapter_heading(F.lit("Chapter 3 Graphs"))) and not one(spark, T.is_chapter_heading(F.lit("1.1 Introduction")))
    assert one(spark, T.title_number(F.lit("Chapter 3 Graphs"))) == 3


def test_tables_and_plans(spark):
    md = one(spark, T.table_markdown(F.array(F.lit("a"), F.lit("b")), F.array(F.array(F.lit("1"), F.lit("2")))))
    assert md == "| a | b |\n| --- | --- |\n| 1 | 2 |"
    tables = spark.createDataFrame([("c", 1, 4, 7, None, ["h"], [["x"]])], "chapter_id string, chapter_number int, page_number int, chunk_number int, caption string, headers array<string>, rows array<array<string>>")
    row = T.table_chunks(tables).first()
    assert (row["chunk_id"], row["title"], row["source_location"]) == ("c_table_7", "Table: Data Table", "Chapter 1, page 4")
    chapters = spark.createDataFrame([("c", "T", "word " * 60), ("d", "T", "short")], "chapter_id string, title string, text string")
    sections = spark.createDataFrame([("c", 1, "S", "more words here " * 10)], "chapter_id string, section_number int, title string, content string")
    plan = T.chapter_chunks(chapters, sections, spark.createDataFrame([("c", 1, "X", "t " * 12)], "chapter_id string, table_number int, title string, content string"))
    assert [r["chunk_id"] for r in plan.orderBy("chunk_number").collect()] == ["c_chunk_1", "c_chunk_2", "c_table_3"]


def anonymised(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    return P.anonymise(df).orderBy("id").collect()


def test_masking(spark):
    rows = anonymised(spark, "Email me at test@example.com", "Call (123) 456-7890 now", "SSN 123-45-6789, host 192.168.1.1", "my name is John, hi", "plain words", None, "born 01/02/1990 https://www.example.com/a")
    assert rows[0]["anonymized_text"] == "Email me at [EMAIL]" and not rows[0]["safe_for_cloud"]
    assert rows[1]["anonymized_text"] == "Call [PHONE] now"
    assert rows[2]["anonymized_text"] == "SSN [SSN], host [IP]" and rows[2]["pii_count"] == 2
    assert rows[3]["anonymized_text"] == "my name is [NAME], hi" and rows[3]["safe_for_cloud"]
    assert (rows[4]["anonymized_text"], rows[4]["has_pii"]) == ("plain words", False)
    assert rows[5]["anonymized_text"] == "" and rows[5]["pii_count"] == 0
    assert rows[6]["anonymized_text"] == "born [DATE] [URL]"


def test_mask_with_signs_and_idempotence(spark):
    df = spark.createDataFrame([("a test@example.com b 123-45-6789",)], "text string")
    row = P.anonymise(df, labels=False).first()
    assert row["anonymized_text"] == "a " + "*" * 16 + " b " + "*" * 11
    again = P.anonymise(P.anonymise(df).select(F.col("anonymized_text").alias("text"))).first()
    assert again["anonymized_text"] == "a [EMAIL] b [SSN]" and again["pii_count"] == 0


def test_native_overlaps_are_the_plain_ones(spark):
    lists = [[(0, 5, "a", 0.5, "", ""), (3, 8, "b", 0.9, "", ""), (7, 9, "c", 0.1, "", ""), (9, 10, "d", 0.2, "", "")], []]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], f"i int, e {P.ENTITY}")
    got = {r["i"]: [tuple(x) for x in r["v"]] for r in df.select("i", P.resolve(F.col("e")).alias("v")).collect()}
    assert got == {i: P.kept(x) for i, x in enumerate(lists)}


def test_gate_roles_and_ids(spark):
    df = P.anonymise(spark.createDataFrame([("mail a@bc.de",), ("none",)], "text string"))
    good, bad = P.privacy_gate(df)
    assert (good.count(), bad.count()) == (2, 0)
    assert one(spark, P.masked_student(F.lit("student-uuid-001"), F.lit("researcher"))) == "student-..."
    assert one(spark, P.masked_student(F.lit("student-uuid-001"), F.lit("teacher"))) == "student-uuid-001"
    assert re.fullmatch("user-[0-9a-f]{16}", one(spark, P.masked_user(F.lit("x"), "salt")))
    users = spark.createDataFrame([("a",), ("b",)], "user_id string")
    assert [P.apply_policy(users, t, r, "a").count() for t, r in (("student_skills", "admin"), ("student_skills", "student"), ("questions", "guest"), ("skills_registry", "guest"))] == [2, 1, 0, 2]
    assert P.apply_policy(users, "questions", "instructor", action="delete").count() == 0
