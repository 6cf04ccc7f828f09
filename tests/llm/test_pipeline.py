"""Each stage of the pipeline against plain loops over its own input."""

import re

import numpy as np
import xxhash

from pyspark.sql import functions as F

import corpus_pipeline as P
from learnmill.llm import bpe, compression_rules, decontaminate, language_id, quality_nbsvm, simhash


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = {r["doc_id"]: r for r in out.collect()}
        assert set(rows) <= set(before)
        if name != "encode":
            assert out.columns == columns
            assert all(rows[i] == before[i] for i in rows)
        gone = set(before) - set(rows)
        if name == "language_id":
            assert len(gone) < 0.02 * len(before)
        elif name == "quality_rules":
            import zstandard

            compress = zstandard.ZstdCompressor(level=3).compress
            for i, r in before.items():
                n, *_, repeats = compression_rules.base_counts(r["text"])
                bad = n < 50 or 100 * repeats > 50 * n or compression_rules.verdict(r["text"].encode(), compress)[2]
                assert (i in gone) == bool(bad)
        elif name == "near_duplicates":
            want, _ = brute_survivors({i: r["text"] for i, r in before.items()})
            assert set(rows) == want and gone
        elif name == "decontaminate":
            word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
            low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
            grams = set()
            for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
                w = word.findall(low(r["text"]))
                grams |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} - {()}
            sizes = {len(g) for g in grams}
            for i, r in before.items():
                w = word.findall(low(r["text"]))
                assert (i in gone) == any(tuple(w[j : j + k]) in grams for k in sizes for j in range(len(w) - k + 1))
            assert gone
        else:
            assert not gone and all(r["n_tokens"] == len(r["ids"]) for r in rows.values())
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}-{xxhash.xxh64_hexdigest(name)}"
        out.write.mode("overwrite").parquet(path)
        docs, before = spark.read.parquet(path), rows


def brute_survivors(rows):
    """Least ids of the components of texts whose five-word shingle sets have Jaccard >= 0.8: all pairs
    that share a shingle are counted."""
    sets, holders = {}, {}
    for i, text in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset([()])
        for x in sets[i]:
            holders.setdefault(x, []).append(i)
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = 0
    for i in sorted(rows):
        common = {}
        for x in sets[i]:
            for j in holders[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if 9 * n >= 4 * (len(sets[i]) + len(sets[j])):
                pairs += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in rows if find(i) == i}, pairs


def test_near_copies_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want, pairs = brute_survivors({r["doc_id"]: r["text"] for r in docs.collect()})
    got = [r["doc_id"] for r in simhash.drop_near_duplicates(docs).select("doc_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want and pairs


def test_crowded_keys_of_near_copies(spark):
    """One base with copies of 0 to 14 changed words of 400, so that some pairs lie beside 0.8."""
    rng = np.random.default_rng(4)
    rows = {}
    for base in range(2):
        words = [f"w{x}" for x in rng.integers(0, 5000, 400)]
        for n in range(300):
            mine = list(words)
            for at in rng.integers(0, 400, n % 15):
                mine[at] = f"x{rng.integers(0, 10**9)}"
            rows[len(rows) * 7 % 601] = " ".join(mine)
    want, pairs = brute_survivors(rows)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()} == want and pairs > 1000


def test_a_changed_word_is_a_near_copy(spark):
    """One changed word of 80 leaves 71 of 81 shingles; two apart ones leave 66 of 86, below 0.8."""
    words = [f"w{i}" for i in range(80)]
    one, two = list(words), list(words)
    one[40], two[20], two[60] = "other", "new", "newer"
    rows = [(i, " ".join(w)) for i, w in enumerate((words, one, two))]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {0, 2}


def test_unlike_texts_of_a_crowded_key_give_no_pairs():
    """Outlines rule out every pair below 0.8 here, and no pair at 0.8 or more."""
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in range(150)]
    sets = []
    for n in range(120):
        mine = list(base)
        for at in rng.choice(150, n % 9, replace=False):
            mine[at] = f"x{rng.integers(0, 10**9)}"
        sets.append(simhash.shingle_set(" ".join(mine)))
    lines = [simhash.outline(x).view(np.uint64) for x in sets]
    for i, x in enumerate(sets):
        for j in range(i):
            common = len(np.intersect1d(x, sets[j]))
            apart = int(np.bitwise_count(lines[i] ^ lines[j]).sum())
            assert apart <= len(x) + len(sets[j]) - 2 * common
            if 9 * common >= 4 * (len(x) + len(sets[j])):
                assert 9 * apart <= len(x) + len(sets[j])


def test_components_of_a_long_chain(spark):
    """300 nodes in a row, and a ring: one root each, however many rounds it takes."""
    rows = [(i, i + 1) for i in range(1000, 1300)] + [(i, i + 1) for i in range(50)] + [(50, 0)]
    got = {r["node"]: r["root"] for r in simhash.connected(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {i: 1000 for i in range(1001, 1301)}


def test_clashing_columns_are_kept(spark):
    """Columns named like those that the stages use inside come back untouched."""
    text = " ".join("".join(x) for x in np.random.default_rng(8).choice(list("etaoinshrdlu"), (90, 6)))
    row = {"doc_id": 1, "text": text, "__hash": "h", "__row": "r", "row": "q", "__text": "t", "kept": "k", "score": "s", "lang": "en", "key": "y", "s": "z"}
    docs = spark.createDataFrame([row, {**row, "doc_id": 2, "text": text + " more"}])
    for out in (
        simhash.drop_near_duplicates(docs), compression_rules.apply_quality_rules(docs), language_id.keep_identified(docs, language_id.train_language_profiles(docs)),
        decontaminate.decontaminate(docs, spark.createDataFrame([(1, "none of these words stands there")], "item_id long, text string")),
    ):
        assert out.columns == docs.columns
        first = {r["doc_id"]: r.asDict() for r in out.collect()}[1]
        assert first == docs.where(F.col("doc_id") == 1).first().asDict()
    scored = quality_nbsvm.score_quality(docs, quality_nbsvm.fit([], np.array([])), docs.columns)
    assert scored.columns.count("score") == 1 and "s" in scored.columns
    assert bpe.encode_documents(docs.withColumn("n_tokens", F.lit("x")), ["doc_id", "n_tokens"]).first()["n_tokens"] > 0


def test_a_passage_shared_by_many_gives_few_pairs(spark, monkeypatch):
    """1500 texts share 400 words and have 60 of their own (similarity 0.75 or so), 60 of them have near copies: the
    candidates are the near copies and hardly more, and the result is that of brute force."""
    rng = np.random.default_rng(12)
    shared = [f"s{x}" for x in range(400)]
    rows = {}
    for i in range(1500):
        own = [f"o{i}-{x}" for x in range(60)]
        rows[2 * i] = " ".join(shared + own)
        if i % 25 == 0:
            own[int(rng.integers(60))] = f"c{i}"
            rows[2 * i + 1] = " ".join(shared + own)
    tried = []
    monkeypatch.setattr(simhash, "CROWDED", 64)
    inner = simhash.crowded_pairs
    monkeypatch.setattr(simhash, "crowded_pairs", lambda *a: tried.append(inner(*a)) or tried[-1])
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == {2 * i for i in range(1500)}
    assert tried and tried[0].count() < 500
