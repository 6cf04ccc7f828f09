"""The queries on personal data, and others that SQL cannot say, against plain loops over the same table."""

import re

import pytest
from learnmill.operators import privacy as P
from learnmill.operators import vectors
from learnmill.plans import fixtures as V
from learnmill.plans.queries import QUERIES


def plain_entities(text, names=True):
    """All matches by start; one that overlaps the last kept takes its place if it is surer."""
    found = []
    for kind, sure, label, patterns in P.RULES:
        for p in patterns:
            found += [(m.start(), m.end(), kind, sure, label, m.group()) for m in re.finditer(p, text)]
    for p in P.NAME_CONTEXT if names else ():
        found += [(m.start(2), m.end(2), "name", 0.50, "[NAME]", m[2]) for m in re.finditer(p, text) if m[2].lower() in P.FIRST_NAMES]
    kept = []
    for e in sorted(found, key=lambda e: e[0]):
        if kept and e[0] < kept[-1][1]:
            if e[3] > kept[-1][3]:
                kept[-1] = e
        else:
            kept.append(e)
    return kept


def replaced(text, found, put):
    out, at = "", 0
    for start, end, *rest in found:
        out, at = out + text[at:start] + put(start, end, rest), end
    return out + text[at:]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in V.table(spark, sf_dir, "documents").collect()}


@pytest.fixture(scope="module")
def found(texts):
    return {i: plain_entities(t) for i, t in texts.items()}


def test_entities(spark, sf_dir, found):
    got = sorted(map(tuple, QUERIES["p1_p2_p3_entities"](spark, sf_dir).collect()))
    assert got == sorted((i, *e) for i, es in found.items() for e in es) and got


def test_masks(spark, sf_dir, texts, found):
    signs = {r["doc_id"]: r["masked"] for r in QUERIES["p4_masked_signs"](spark, sf_dir).collect()}
    assert signs == {i: replaced(t, found[i], lambda a, b, _: "*" * (b - a)) for i, t in texts.items()}
    labels = {r["doc_id"]: r for r in QUERIES["p5_anonymise"](spark, sf_dir).collect()}
    for i, t in texts.items():
        r, es = labels[i], found[i]
        assert r["anonymized_text"] == replaced(t, es, lambda a, b, rest: rest[2])
        assert (r["has_pii"], r["pii_count"], list(r["pii_types"])) == (bool(es), len(es), sorted(e[2] for e in es))
        assert r["safe_for_cloud"] == all(e[3] < 0.7 for e in es)


def test_merged_report_and_gate(spark, sf_dir, texts, found):
    merged = {r["doc_id"]: (r["n"], r["types"]) for r in QUERIES["p6_merged_entities"](spark, sf_dir).collect()}
    for i, t in texts.items():
        both = sorted(plain_entities(t, False) + found[i], key=lambda e: e[0])
        kept = []
        for e in both:
            if kept and e[0] < kept[-1][1]:
                if e[3] > kept[-1][3]:
                    kept[-1] = e
            else:
                kept.append(e)
        assert merged[i] == (len(kept), ",".join(e[2] for e in kept))
    kinds = [e[2] for es in found.values() for e in es]
    assert {r["type"]: r["n"] for r in QUERIES["p9_report"](spark, sf_dir).collect()} == {k: kinds.count(k) for k in set(kinds)}
    clean = {i for i, t in texts.items() if not plain_entities(replaced(t, found[i], lambda a, b, rest: rest[2]))}
    assert {r["doc_id"] for r in QUERIES["p10_gate"](spark, sf_dir).collect()} == clean


#: Lines and the types that they are found to hold.
LOG_LINES = [
    ("mail to ann.lee@school.org now", {"email"}), ("ssn 123-45-6789", {"ssn"}), ("call 555-123-4567 x", {"phone"}), ("card 4111 1111 1111 1111", {"credit_card"}), ("card 4111111111111111", {"credit_card"}),
    ("student 42 logged in", {"student_id"}), ("SID-7 and nothing", {"student_id"}), ("StudentID_99", {"student_id"}), ("the real name: Ann Lee", {"real_name_context"}), ("ACTUAL-NAMES  bob jones", {"real_name_context"}),
    ("true name Ann", set()), ("students 42", set()), ("(555) 123-4567", set()), ("10.0.0.1", set()), ("", set()), ("  padded SID 5 ann@b.co  ", {"student_id", "email"}),
]


def test_log_types():
    from learnmill.sources import io

    for line, want in LOG_LINES:
        assert {kind for kind, p in io.LOG_PATTERNS.items() if re.search(p, line, re.IGNORECASE)} == want, line


def test_log_scan(spark, texts, tmp_path):
    """Files, line numbers, types and previews of logs that are read in many splits, against a plain loop; line ends of
    three kinds."""
    from learnmill.sources import io

    lines = [line for line, _ in LOG_LINES] + [x for t in list(texts.values())[:300] for x in t.split("\n")]
    lines = [x.replace("\r", " ") for x in lines]
    files = {"a.log": lines[: len(lines) // 2], "b.log": lines[len(lines) // 2 :]}
    for (name, own), end in zip(files.items(), ("\n", "\r\n"), strict=True):
        (tmp_path / name).write_bytes((end.join(own) + end).encode())
    want = sorted((name, n, kind, x.strip()[:100]) for name, own in files.items() for n, x in enumerate(own, 1) for kind, p in io.LOG_PATTERNS.items() if re.search(p, x, re.IGNORECASE))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "20000")
    spark.conf.set(names[1], "0")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 6
        got = sorted((r["file"].rsplit("/", 1)[1], r["line_number"], r["type"], r["preview"]) for r in io.scan_logs(spark, str(tmp_path)).collect())
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    assert got == want and {x[2] for x in want} == set(io.LOG_PATTERNS)


def test_masking_stream_is_the_batch(spark, sf_dir):
    batch = P.anonymise(V.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text")
    columns = ["conv_id", "turn", "anonymized_text", "pii_count"]
    assert sorted(map(tuple, QUERIES["r8_masking_stream"](spark, sf_dir).select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))


def test_unicode_digits_count_alike(spark):
    rows = spark.createDataFrame([(1, "call ١٢٣-٤٥-٦٧٨٩ or é123-45-6789 or 123-45-6789")], "id long, text string")
    assert P.pattern_counts(rows, "id").first()["ssn"] == sum(e[2] == "ssn" for e in plain_entities(rows.first()["text"]))


def test_cells_find_nearly_all(spark, sf_dir):
    exact = vectors.many_top_k(V.table(spark, sf_dir, "embeddings"), V.query_vectors(spark, sf_dir), 5)
    want = {(r["query_id"], r["key"]) for r in exact.collect()}
    got = {(r["query_id"], r["key"]) for r in QUERIES["v7_cells"](spark, sf_dir).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_random_questions_repeat_with_their_seed(spark, sf_dir):
    a, b = (sorted(map(tuple, QUERIES["l3_random_questions"](spark, sf_dir).collect())) for _ in range(2))
    assert a == b and len(a) == 10 and {r[2] for r in a} == {"easy"}


def test_answers_are_grounded_as_reported(spark, sf_dir):
    rows = QUERIES["q9_answers"](spark, sf_dir).collect()
    report = QUERIES["q10_grounding_report"](spark, sf_dir).first()
    assert report["messages"] == len(rows)
    assert report["unsupported_share"] == pytest.approx(sum(not r["is_valid"] for r in rows) / len(rows))
    locked = {r["message_id"] for r in QUERIES["q5_locked_answers"](spark, sf_dir).collect()}
    assert locked == {r["message_id"] for r in rows if r["is_valid"]} and locked
    assert all(r["citation_count"] == len(r["sources"]) for r in rows)
