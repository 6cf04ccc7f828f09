"""Hot keys spread over tasks give what one walk gives, to the last bit."""

import datetime as dt
import random

import pytest
from learnmill.operators import behavior as B
from learnmill.operators import folds
from learnmill.operators import mastery as M
from pyspark.sql import functions as F

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def cut(spark):
    """Range partitions that adaptive execution does not join again."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def events(spark, shape):
    r = random.Random(5)
    rows = []
    for i in range(3000):
        user = "hot" if r.random() < 0.6 else "warm" if r.random() < 0.5 else f"u{r.randrange(40)}"
        # every third right keeps the simple rule's mastery off its clamps for good, so that no stretch forgets its start
        hit = {"random": r.random() < 0.6, "cycle": i % 3 == 0, "right": True, "wrong": False}[shape]
        rows.append((i, user, "s", hit, r.randrange(1, 4), START + dt.timedelta(minutes=i * r.choice([1, 1, 1, 1])) + dt.timedelta(days=3 * (i // 900))))
    if shape == "cycle":
        n = {"hot": 0, "warm": 0}
        for k, x in enumerate(rows):
            if x[1] in n:
                rows[k] = (*x[:3], n[x[1]] % 3 == 0, *x[4:])
                n[x[1]] += 1
    return spark.createDataFrame(rows, "event_id long, user_id string, skill_id string, is_correct boolean, attempts int, timestamp timestamp").repartition(5)


def rows_of(df):
    return sorted(map(repr, (r.asDict() for r in df.select(*sorted(df.columns)).collect())))


@pytest.mark.parametrize("shape", ["random", "cycle", "right", "wrong"])
def test_spread_walks_are_one_walk(spark, cut, shape):
    rows = events(spark, shape)
    assert rows_of(M.rule_states(rows, hot=300)) == rows_of(M.rule_states(rows))
    assert rows_of(M.trajectory(rows, hot=300)) == rows_of(M.trajectory(rows))
    assert rows_of(M.running_streaks(rows, hot=300)) == rows_of(M.running_streaks(rows))


def test_a_hot_key_is_walked_by_several_tasks(spark, cut):
    rows = events(spark, "random").where("user_id = 'hot'")
    moves = M.trajectory(rows, hot=300).withColumn("part", F.spark_partition_id())
    sizes = [r["count"] for r in moves.groupBy("part").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 0.6 * sum(sizes)


def test_states_from_an_unknown_start():
    """Whatever the start, the state after a stretch that forgets it is the one of the blind walk."""
    r = random.Random(1)
    for rule in (M.SimpleRule(), M.BayesRule()):
        known = 0
        for _ in range(300):
            n = r.randrange(1, 60)
            us, hits, tries = [i * r.choice([10**9, 2 * 10**11]) for i in range(n)], [r.random() < 0.7 for _ in range(n)], [1] * n
            blind = folds.walk(rule, folds.State(rule.floor, rule.ceiling), us, hits, tries)
            for p in (rule.floor, rule.ceiling, r.uniform(rule.floor, rule.ceiling)):
                before = folds.State(p, p, None, 7, 3, 2, 0, True, False)
                after = folds.walk(rule, before, us, hits, tries)
                assert blind.after(before) in (None, after)
                known += blind.after(before) is not None
        assert known > 300


def test_trailing_clicks_against_a_plain_loop(spark):
    r = random.Random(2)
    clicks = [(i, r.choice(["a", "a", "a", "b"]), START + dt.timedelta(milliseconds=r.randrange(60_000))) for i in range(400)]
    df = spark.createDataFrame(clicks, "event_id long, user_id string, timestamp timestamp")
    got = {x["event_id"]: x["recent_clicks"] for x in B.trailing_clicks(df, 5).collect()}
    assert got == {i: sum(u == v and dt.timedelta(0) <= t - s <= dt.timedelta(seconds=5) for _, v, s in clicks) for i, u, t in clicks}
