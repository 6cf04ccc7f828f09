"""Corpus queries that SQL cannot express, against plain loops over the same table."""

import binascii
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

from learnmill.llm import bpe, compression_rules, decontaminate, language_id, quality_nbsvm, simhash, toxicity
from learnmill.llm.queries import QUERIES, table


def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}


def test_base_counts_of_quality_rules(spark, sf_dir):
    docs = texts(spark, sf_dir)
    for r in QUERIES["op2_compression_bands"](spark, sf_dir).collect():
        t = docs[r["doc_id"]]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        found = Counter(zip(w, w[1:], w[2:]))
        hit = {i + j for i in range(len(w) - 2) if found[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(hit))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])


def test_compression_verdict_of_every_document(spark, sf_dir):
    """Ratio, share of bad chunks and verdict by a plain loop; poor texts go far more often than good ones."""
    import zstandard

    def ratio(data):
        return len(data) / len(zstandard.ZstdCompressor(level=3).compress(data))

    docs = texts(spark, sf_dir)
    quality = {r["doc_id"]: r["quality"] for r in table(spark, sf_dir, "labels").collect()}
    seen = defaultdict(Counter)
    for r in QUERIES["op2_compression_bands"](spark, sf_dir).collect():
        data = docs[r["doc_id"]].encode()
        low, high = max((b.min_bytes, b.low, b.high) for b in compression_rules.BANDS if b.min_bytes <= len(data))[1:]
        ends = sorted({*range(4096, len(data) + 1, 4096), len(data)}) if len(data) > 4096 else []
        parts = [ratio(data[e - 4096 : e]) for e in ends]
        bad = sum(not 1.35 <= x <= 2.30 for x in parts) / len(parts) if parts else 0.0
        good = bool(data) and low <= ratio(data) <= high and bad <= 0.25
        assert (r["ratio"], r["bad_chunks"]) == (ratio(data) if data else 0.0, bad)
        assert r["kept"] == (good and not r["base_failed"])
        if not r["base_failed"]:
            seen[quality.get(r["doc_id"])][good] += 1
    assert seen[0][False] > 2 * seen[0][True]
    assert seen[1][False] <= 0.01 * seen[1][True]


def test_bpe_is_that_of_the_library(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = texts(spark, sf_dir)
    for r in QUERIES["op5_chunked_bpe"](spark, sf_dir).collect():
        ids = t.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_simhash_components(spark, sf_dir):
    docs = texts(spark, sf_dir)
    prints = {}
    for k, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    got = {r["doc_id"]: r for r in QUERIES["op7_simhash_golay"](spark, sf_dir).collect()}
    assert {k: format(v, "016x") for k, v in prints.items()} == {k: r["fingerprint"] for k, r in got.items()}
    ids = sorted(prints)
    bits = np.array([prints[i] for i in ids], np.uint64)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(bits ^ bits[n]) <= 2).tolist():
            a, b = find(i), find(ids[j])
            root[max(a, b)] = min(a, b)
    assert {i: find(i) for i in ids} == {k: r["component_id"] for k, r in got.items()}


def test_golay_keys_lose_no_near_fingerprint():
    rng = np.random.default_rng(5)
    code = simhash.Golay()
    a = rng.integers(-(2**63), 2**63 - 1, 3000)
    flips = [sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for n in rng.integers(0, 3, 3000)]
    b = (a.view(np.uint64) ^ np.array(flips, np.uint64)).view(np.int64)
    sets = []
    for x in (a, b):
        keys, rows = code.keys(x)
        by = defaultdict(set)
        for k, r in zip(keys.tolist(), rows.tolist()):
            by[r].add(k)
        sets.append(by)
    assert all(sets[0][i] & sets[1][i] for i in range(3000))


def test_shards(spark, sf_dir):
    docs = texts(spark, sf_dir)
    rows = QUERIES["op9_sampled_splitters"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    sums, slots = Counter(), defaultdict(list)
    for r in rows:
        data = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, binascii.crc32(data), "bytes")
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    largest = max(r["size"] for r in rows)
    assert set(sums) == set(range(16))
    assert max(sums.values()) - min(sums.values()) <= 2 * largest
    groups = defaultdict(list)
    for r in rows:
        groups[docs[r["doc_id"]]].append(r)
    small = [g for g in groups.values() if len(g) > 1 and sum(r["size"] for r in g) <= largest]
    assert small and all(len({r["shard"] for r in g}) == 1 for g in small)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_compression_verdicts():
    import random

    import zstandard

    compress = zstandard.ZstdCompressor(level=3).compress
    rnd = random.Random(1)
    noise = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(6000))
    assert compression_rules.verdict(noise.encode(), compress)[2] == "incompressible"
    assert compression_rules.verdict(b"the same words again " * 300, compress)[2] == "repetitive"
    assert compression_rules.verdict(b"", compress) == (0.0, 0.0, None)


def test_compression_chunks_reach_the_end(spark, sf_dir):
    """Prose with junk behind the last full chunk: its second half is tested too."""
    import base64
    import random

    import zstandard

    compress = zstandard.ZstdCompressor(level=3).compress
    rnd = random.Random(1)
    docs = texts(spark, sf_dir)
    prose = next(p for _, t in sorted(docs.items()) if len(p := t.encode()[:4100]) == 4100 and not compression_rules.verdict(p, compress)[2])
    junk = b" ".join(base64.b64encode(rnd.randbytes(9)) for _ in range(400))[:4030]
    ratio, bad, reason = compression_rules.verdict(prose + junk, compress)
    assert (bad, reason) == (0.5, "incompressible")  # the whole is below its lower limit too
    upper = [compression_rules.Band(b.min_bytes, 0.0, b.high) for b in compression_rules.BANDS]
    assert compression_rules.verdict(prose + junk, compress, upper)[1:] == (0.5, "chunks")
    assert compression_rules.verdict(prose * 2, lambda c: bytes(len(c) // 2)) == (2.0, 0.0, None)
    seen = []
    compression_rules.verdict(prose + junk, lambda c: seen.append(c) or compress(c))
    assert seen[1:] == [(prose + junk)[:4096], (prose + junk)[-4096:]]


def test_chunk_joins_agree_with_the_whole_text():
    import random

    import public_tokenizers

    model = bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoder = bpe.ChunkEncoder(model, cache_bytes=200_000)
    rnd = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "'", "re", "'l", "é", "中", "<|endoftext|>", "<|", "endoftext", "|>", "12", "!", "😀", " ", "\x1c", "\x85", "\x00"]
    shared = "".join(rnd.choice(parts) for _ in range(4000))
    for i in range(300):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 900))) + shared[: rnd.randint(0, 9000)]
        assert encoder.encode(t) == model.encode(t)
        assert bpe.cut_points(t)[-1:] == ([len(t)] if t else [])
    assert encoder.hits > encoder.misses / 4
    assert encoder.held <= 200_000 or len(encoder.cache) == 1


def test_windows_beyond_the_broadcast_bound(spark, sf_dir):
    """With a bound of 0 every window is joined by shuffle: the same rows, below four times the text."""
    docs, benchmark = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    want = decontaminate.contamination(docs, benchmark).collect()
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        got = decontaminate.contamination(docs, benchmark, bound=0).collect()
        size = sum(len((r["text"] or "").encode()) for r in docs.collect())
        assert shuffled(spark) - before < 4 * size
        kept = decontaminate.decontaminate(docs, benchmark, bound=0).select("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and any(r["contaminated"] for r in got)
    assert sorted(r[0] for r in kept) == sorted(r["doc_id"] for r in want if not r["contaminated"])


def shuffled(spark) -> int:
    """Bytes that the session's stages have written to shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def tokens_of(pattern, text):
    return Counter(re.findall(pattern, (text or "").lower()))


def test_toxicity_against_plain_cosine(spark, sf_dir):
    """Every document's score from dense vectors over whole texts, a sorted list of all cosines, and a vote;
    and fewer blocks are opened than there are."""
    docs = texts(spark, sf_dir)
    labels = {}
    for r in table(spark, sf_dir, "labels").collect():
        if r["toxic"] is not None:
            labels[r["doc_id"]] = max(labels.get(r["doc_id"], 0), int(r["toxic"] > 0))
    train = sorted(i for i in labels if i in docs and binascii.crc32(str(i).encode()) % 3 != 1)
    counts = {i: tokens_of(r"[^\W_]+", t) for i, t in docs.items()}
    df = Counter(w for c in counts.values() for w in c)
    by = {y: [i for i in train if labels[i] == y] for y in (0, 1)}
    used = {y: Counter(w for i in ids for w in counts[i]) for y, ids in by.items()}
    known = set(used[0]) | set(used[1])
    prior = {y: 20 * len(by[y]) / len(train) for y in by}

    def weight(w, n):
        if w not in known:
            return (1 + np.log(n)) * (np.log((1 + len(docs)) / 2) + 1) * 0.05
        share = [(used[y][w] + prior[y]) / (len(by[y]) + prior[y]) for y in (0, 1)]
        return (1 + np.log(n)) * (np.log((1 + len(docs)) / (1 + df[w])) + 1) * (0.05 + np.log(share[1] / share[0]) ** 2)

    vectors = {}
    for i, c in counts.items():
        v = {w: weight(w, n) for w, n in c.items()}
        size = np.sqrt(sum(x * x for x in v.values())) or 1.0
        vectors[i] = {w: np.rint(x / size * 2**25) / 2**25 for w, x in v.items()}
    column = {w: j for j, w in enumerate(sorted(known))}
    dense = np.zeros((len(train), len(column)))
    for e, i in enumerate(train):
        for w, x in vectors[i].items():
            dense[e, column[w]] = x
    y = np.array([labels[i] for i in train], float)

    def vote(v, without=None):
        own = [(column[w], x) for w, x in v.items() if w in column]
        s = dense[:, [j for j, _ in own]] @ np.array([x for _, x in own]) if own else np.zeros(len(train))
        if without is not None:
            s[without] = 0
        top = sorted(((-x, train[e], e) for e, x in enumerate(s) if x > 0))[:15]
        w = np.array([-x / (1.05 - min(-x, 1.0)) for x, _, _ in top])
        return ((w * y[[e for _, _, e in top]]).sum() / w.sum() if top else None), [i for _, i, _ in top[:3]]

    left = [(vote(vectors[i], e)[0], y[e]) for e, i in enumerate(train)]
    points = [(v, x) for v, x in left if v is not None]
    curve = toxicity.rising(np.array([v for v, _ in points]), np.array([x for _, x in points]), np.ones(len(points)))
    got = {r["doc_id"]: r for r in QUERIES["op8_toxicity_neighbours"](spark, sf_dir).collect()}
    assert set(got) == set(docs)
    voted = 0
    for i in docs:
        v, evidence = vote(vectors[i])
        assert got[i]["evidence"] == evidence
        if v is not None:
            voted += 1
            assert abs(got[i]["score"] - float(np.interp(v, curve[0], curve[1] * 0.98 + 0.01))) < 1e-9
    assert voted > 900
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


def test_toxicity_does_not_depend_on_batches():
    """Examples of which many are equal: the same bits and the same order, one document at a time or 64 together,
    and by plain sums in another order."""
    rng = np.random.default_rng(4)
    kinds = [(sorted(rng.choice(300, rng.integers(3, 40), replace=False).tolist()), None) for _ in range(150)]
    rows = [(t, (1 + rng.integers(0, 5, len(t)) // 4).tolist()) for t, _ in (kinds[i] for i in rng.integers(0, 150, 900))]
    rows += rows[:300]
    ids = rng.permutation(len(rows)).tolist()
    index = toxicity.make_index(ids, rng.integers(0, 2, len(rows)).tolist(), [1.0] * len(rows), rows, rng.random(300) + 0.1, 0.3)
    asked = [(*r, float(x)) for r, x in zip(rows[::3], rng.random(400), strict=False)]
    together = [found for i in range(0, len(asked), 64) for found in index.nearest_of(asked[i : i + 64])]
    assert together == [index.nearest_of([r])[0] for r in asked]
    dense = np.zeros((len(rows), 300))
    for e, r in enumerate(rows):
        t, w = index.vector(*r)
        dense[e, t] = w
    for r, found in zip(asked, together, strict=True):
        t, w = index.vector(*r)
        s = sum(dense[:, a] * x for a, x in reversed(list(zip(t, w, strict=True))))
        want = sorted(((-x, ids[e], e) for e, x in enumerate(s) if x > 0))[:15]
        assert found == [(-x, e) for x, _, e in want]


def test_chunk_and_lower_limits_on_mixtures(spark, sf_dir):
    """Good texts of more than two chunks pass; with a third or the whole replaced by encoded random bytes, or with a
    stretch repeated over a third of them, they go, and the reason is the rule that is meant."""
    import base64
    import random

    r = random.Random(3)
    encoded = lambda n: " ".join(base64.b64encode(r.randbytes(36)).decode() for _ in range(n // 49 + 1))[:n]
    good = {x["doc_id"] for x in table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").collect()}
    prose = [t for i, t in texts(spark, sf_dir).items() if i in good and len(t) > 3 * 4096]
    assert len(prose) >= 5
    rows = []
    for n, t in enumerate(prose):
        third, start = len(t) // 3, 4096
        rows += [
            (4 * n, t), (4 * n + 1, t[:start] + encoded(third) + t[start + third :]), (4 * n + 2, encoded(len(t))),
            (4 * n + 3, t[:start] + "".join(w + " " for w in t.split()[:400])[: third // 4] * 4 + t[start + third :]),
        ]
    got = {x["doc_id"]: x for x in compression_rules.score_quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kinds = [[got[4 * n + k]["reason"] for n in range(len(prose))] for k in range(4)]
    assert set(kinds[0]) == {None}
    assert set(kinds[1]) <= {"chunks", "incompressible"} and "chunks" in kinds[1]
    assert set(kinds[2]) == {"incompressible"}
    assert set(kinds[3]) <= {"chunks", "repetitive", "base"}


def test_far_blocks_stay_closed():
    """Examples in 40 groups of their own terms: the search opens a few blocks of 40, and is exact."""
    rng = np.random.default_rng(11)
    rows = []
    for e in range(40 * toxicity.BLOCK):
        t = sorted(rng.choice(20, 6, replace=False) + 20 * (e // toxicity.BLOCK))
        rows.append(([int(x) for x in t] + [800], [1] * 7))
    index = toxicity.Index(list(range(len(rows))), np.zeros(len(rows)), np.ones(len(rows)), np.concatenate([rng.random(800) + 1, [0.1]]))
    index.build(rows)
    for e in range(0, len(rows), 97):
        index.opened = 0
        got = index.nearest(*rows[e])
        terms, q = index.vector(*rows[e])
        want = sorted(((-sum(w * x for t, w in zip(*index.vector(*r)) for u, x in zip(terms, q) if t == u), i) for i, r in enumerate(rows)))[:15]
        assert [round(x, 9) for x, _ in got] == [round(-x, 9) for x, _ in want]
        assert index.opened <= 12


def test_fit_of_the_quality_model():
    """Ratios by hand; the dual solution against the optimality conditions of the primal problem."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 30, rng.integers(3, 12))).astype(np.int32) for _ in range(80)]
    y = np.where(rng.random(80) < 0.5, 1.0, -1.0)
    ratio = quality_nbsvm.log_count_ratios(rows, y)
    p = [1 + sum(1 for x, label in zip(rows, y) if label > 0 and i in x) for i in range(1 << quality_nbsvm.BITS)]
    q = [1 + sum(1 for x, label in zip(rows, y) if label < 0 and i in x) for i in range(30)] + [1] * ((1 << quality_nbsvm.BITS) - 30)
    want = np.log(np.array(p) / sum(p)) - np.log(np.array(q) / sum(q))
    assert np.allclose(ratio, want)
    values = [ratio[x] / np.sqrt(len(x)) for x in rows]
    cost = np.full(80, 0.7)
    w, bias = quality_nbsvm.dual_coordinate_descent(rows, values, y, cost, epochs=4000)
    dense = np.zeros((80, 31))
    for i, (x, v) in enumerate(zip(rows, values)):
        dense[i, x] = v
        dense[i, 30] = 1

    def loss(u):
        return 0.5 * u @ u + (cost * np.maximum(0, 1 - y * (dense @ u))).sum()

    u = np.append(w[:30], bias)
    best = np.zeros(31)  # a subgradient method of its own
    top = best.copy()
    for t in range(1, 60001):
        active = y * (dense @ best) < 1
        best = best - (best - (cost * y * active) @ dense) / (t + 10)
        if loss(best) < loss(top):
            top = best.copy()
    assert loss(u) <= loss(top) * 1.002


def test_language_of_every_document(spark, sf_dir):
    """Profiles, out-of-place distances and the nearest language by plain loops over whole texts."""
    rows = table(spark, sf_dir, "documents").collect()

    def grams(text):
        words, n = "".join(c.lower() if c.isalpha() else " " for c in text or "").split(), Counter()
        for w in words:
            n.update(w)
            edge = f" {w} "
            n.update(edge[i : i + 2] for i in range(len(edge) - 1))
            n.update(edge[i : i + 3] for i in range(len(edge) - 2))
        return n

    def order(gram):
        return sum((1 if c == " " else ord(c)) << (16 * i) for i, c in enumerate(gram))

    def top(counts):
        # letters, pairs and triples as they stand; of equal counts the least number comes first
        return sorted(counts, key=lambda g: (-counts[g], order(g)))[:400]

    own = {r["doc_id"]: grams(r["text"]) for r in rows}
    sums = defaultdict(Counter)
    for r in rows:
        if r["lang"] is not None and binascii.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            sums[r["lang"]].update(own[r["doc_id"]])
    profiles = {lang: {g: i for i, g in enumerate(top(c))} for lang, c in sorted(sums.items())}
    got = {r["doc_id"]: r for r in QUERIES["op4_rank_order_profiles"](spark, sf_dir).collect()}
    for i, counts in own.items():
        mine = top(counts)
        d = {lang: sum(abs(p[g] - n) if g in p else 400 for n, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(d, key=lambda lang: (d[lang], lang)) if mine else "und"
        score = 1 - d[best] / (400 * len(mine)) if mine else 0.0
        assert (got[i]["lang_pred"], round(got[i]["score"], 9)) == (best, round(score, 9))


def test_sides_beyond_the_broadcast_bound(spark, sf_dir, monkeypatch):
    """Archives and kept rows are the same where nothing is broadcast."""
    from learnmill.llm import common, warc

    pages = table(spark, sf_dir, "pages")
    key = lambda r: (r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"] or -1)
    want = sorted(map(key, warc.round_trip(pages).collect()))
    docs = table(spark, sf_dir, "documents")
    kept = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).select("doc_id").collect())
    monkeypatch.setattr(warc, "BROADCAST_REPEATS", 0)
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    assert sorted(map(key, warc.round_trip(pages).collect())) == want
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).select("doc_id").collect()) == kept


def test_samples_do_not_depend_on_order(spark):
    """An id with several texts and labels counts once, with the least text and the greatest label."""
    from learnmill.llm.common import labelled_sample

    rows = [(1, "b"), (1, "a"), (2, None), (2, "c"), (3, "d"), (None, "e")]
    labels = [(1, 0), (1, 1), (2, 0), (2, None), (4, 1), (None, 1)]
    for order in (1, -1):
        docs, marks = spark.createDataFrame(rows[::order], "doc_id long, text string"), spark.createDataFrame(labels[::order], "doc_id long, quality int")
        got = sorted((r["doc_id"], r["text"], r["y"]) for r in labelled_sample(docs, marks, "quality", 100).collect())
        assert got == [(1, "a", 1), (2, "c", 0)]
    named = spark.createDataFrame([("x1", "b"), ("x2", "a")], "doc_id string, text string")
    marks = spark.createDataFrame([("x1", 1), ("x2", 0)], "doc_id string, toxic int")
    assert {r["doc_id"] for r in toxicity.toxicity_query(named, marks).collect()} == {"x1", "x2"}
