import datetime as dt

import pytest
from learnmill.operators import behavior as B
from learnmill.operators import mastery as M
from pyspark.sql import functions as F

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, user_id string, skill_id string, is_correct boolean, attempts long, time_spent_seconds long, timestamp timestamp"


def answers(spark, marks, seconds=30, gap=60, user="u", skill="s"):
    rows = [(i, user, skill, bool(m), 1, seconds, START + dt.timedelta(seconds=gap * i)) for i, m in enumerate(marks)]
    return spark.createDataFrame(rows, SCHEMA)


def test_bayes_golden(spark):
    got = [r["new_mastery"] for r in M.trajectory(answers(spark, [1, 1, 1, 0, 0, 1])).orderBy("event_id").collect()]
    assert got == pytest.approx([0.826087, 0.957560, 0.99, 0.860870, 0.278873, 0.647504], abs=1e-6)


def test_rule_golden(spark):
    for n, p in enumerate([0.6, 0.7, 0.8, 0.75, 0.7, 0.8], 1):
        s = M.rule_states(answers(spark, [1, 1, 1, 0, 0, 1][:n])).first()
        assert s["probability_mastery"] == pytest.approx(p)
        assert s["total_attempts"] == n


def test_reset_and_prediction(spark):
    row = spark.range(1).select(M.reset(F.lit(0.95), F.lit(48.0)).alias("a"), M.reset(F.lit(0.95), F.lit(168.0)).alias("b"), M.reset(F.lit(0.95), F.lit(24.0)).alias("c"), M.predict(F.lit(0.826087)).alias("p")).first()
    assert (row["a"], row["b"], row["c"], row["p"]) == pytest.approx((0.885714, 0.86, 0.95, 0.819565), abs=1e-6)


def test_trajectory_of_two_halves_is_that_of_the_whole(spark):
    events = answers(spark, [1, 0, 1, 1, 0, 0, 0, 1, 1, 1], gap=3600 * 20)
    whole = M.latest_states(M.trajectory(events)).first()
    p, last = M.START, None
    for r in events.orderBy("event_id").collect():
        if last is not None:
            h = (r["timestamp"] - last).total_seconds() / 3600
            if h > 24:
                f = min(0.2, (h - 24) / 168)
                p = p * (1 - f) + 0.5 * f
        p, last = M.bayes_step(p, r["is_correct"]), r["timestamp"]
    assert whole["new_mastery"] == pytest.approx(p)
    assert 0.01 <= whole["new_mastery"] <= 0.99


def test_empty_and_rejected_events(spark):
    none = answers(spark, [])
    assert M.rule_states(none).count() == 0 and M.trajectory(none).count() == 0
    bad = answers(spark, [1]).withColumn("user_id", F.lit(None).cast("string"))
    good, rejects = M.record_batch(answers(spark, [1]).unionByName(bad))
    assert (good.count(), rejects.count()) == (1, 1)


def signals(spark, marks, seconds):
    return B.frustration(answers(spark, marks, seconds)).first()


def test_frustration_golden(spark):
    a, b, c = signals(spark, [0] * 5, 45), signals(spark, [0] * 3, 5), signals(spark, [0] * 2, 150)
    assert (a["is_frustrated"], a["frustration_confidence"]) == (True, 0.5)
    assert (b["is_frustrated"], b["frustration_confidence"]) == (True, pytest.approx(0.8))
    assert (c["is_frustrated"], c["frustration_confidence"]) == (False, pytest.approx(0.3))


def clicks(spark, n, milliseconds, elements=1):
    rows = [(i, "u", f"e{i % elements}", START + dt.timedelta(milliseconds=milliseconds * i)) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, user_id string, element_id string, timestamp timestamp")


def test_rapid_clicks_and_rates(spark):
    row = B.rapid_clicks(clicks(spark, 5, 200)).first()
    assert (row["span"], row["confidence"]) == pytest.approx((0.8, 0.88))
    assert B.rapid_clicks(clicks(spark, 10, 2000)).count() == 0
    assert B.rapid_now(clicks(spark, 5, 200)).first()["is_rapid_clicking"]
    assert B.click_rates(clicks(spark, 1, 1)).first()["per_minute"] is None
    assert B.trailing_clicks(clicks(spark, 5, 200)).agg(F.max("recent_clicks")).first()[0] == 5


def test_modes(spark):
    schema = "user_id string, current_mode string, suggested_mode string, urgency string, confidence double, is_frustrated boolean, is_struggling boolean, is_engaged boolean, consecutive_errors int, time_on_task_seconds int"
    rows = [
        ("low", "standard", "focus", "none", 0.4, True, False, True, 0, 0), ("urgent", "standard", "high_contrast_focus", "intervention", 0.9, True, False, True, 4, 0),
        ("told", "standard", "focus", "none", 0.9, False, True, True, 0, 0), ("bored", "standard", "standard", "none", 0.6, False, False, False, 0, 0),
        ("long", "standard", "standard", "none", 0.6, False, False, True, 0, 130), ("calm", "standard", "standard", "none", 0.6, False, False, True, 0, 0),
    ]
    got = {r["user_id"]: r["mode"] for r in B.decide_mode(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"low": "standard", "urgent": "intervention", "told": "focus", "bored": "simplified", "long": "high_contrast_focus", "calm": "standard"}
