"""The pipeline's near_duplicates stage goes through the fingerprints and Golay keys of op7."""

from learnmill.llm import simhash


def test_near_copies_go_by_golay_keys(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    near = [*words[:399], "other"]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(f"v{i}" for i in range(400))), (4, None)]
    seen, inner = [], simhash.golay_pairs
    monkeypatch.setattr(simhash, "golay_pairs", lambda r: seen.append(inner(r)) or seen[-1])
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {1, 3, 4}
    prints = {i: simhash.fingerprint(t) & (1 << 64) - 1 for i, t in rows}
    tied = (prints[1] ^ prints[2]).bit_count() <= 2
    assert len(seen) == 1 and seen[0].count() == int(tied)
