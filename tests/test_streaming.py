import datetime as dt

import pytest
from learnmill.operators import behavior as B
from learnmill.operators import mastery as M
from learnmill.operators import privacy as P
from learnmill.plans import fixtures as V
from learnmill.streaming import streams as S
from pyspark.sql import functions as F

COLUMNS = ["event_id", "user_id", "skill_id", "is_correct", "attempts", "timestamp"]


def in_files(df, path, parts, order="event_id"):
    n = df.count()
    ids = sorted(r[order] for r in df.select(order).collect())
    for i in range(parts):
        lo, hi = ids[i * n // parts], ids[(i + 1) * n // parts - 1]
        df.where(F.col(order).between(lo, hi)).coalesce(1).write.mode("append").parquet(str(path))
    return df.schema


def run(spark, stream, tmp, name, mode="append", sink=None):
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp / f"c-{name}")).trigger(availableNow=True)
    q = writer.foreachBatch(sink).start() if sink else writer.format("memory").queryName(name).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return None if sink else spark.table(name)


@pytest.fixture(scope="module")
def answers(spark, sf_dir):
    rows = V.learning_events(spark, sf_dir).where("user_id < 4")
    return rows.select(*COLUMNS[:1], F.col("user_id").cast("string").alias("user_id"), *COLUMNS[2:5], F.col("timestamp").cast("timestamp").alias("timestamp")).cache()


def by_time(df):
    """The same rows with ids in order of time, so that files hold stretches of time."""
    from pyspark.sql import Window

    return df.withColumn("event_id", F.row_number().over(Window.orderBy("timestamp", "event_id")).cast("long"))


def test_stream_is_batch(spark, answers, tmp_path):
    rows = by_time(answers)
    schema = in_files(rows, tmp_path / "in", 3)
    stream = S.batched(spark, str(tmp_path / "in"), schema, 1)
    got = run(spark, S.mastery_stream(stream), tmp_path, "moves")
    want = {r["event_id"]: (round(r["new_mastery"], 9), r["total_attempts"]) for r in M.trajectory(rows).collect()}
    assert {r["event_id"]: (round(r["probability_mastery"], 9), r["total_attempts"]) for r in got.collect()} == want
    path = str(tmp_path / "states")
    columns = ["probability_mastery", "total_attempts", "correct_attempts", "consecutive_correct", "consecutive_incorrect", "us", "event_id", "is_correct"]
    run(spark, S.mastery_stream(S.batched(spark, str(tmp_path / "in"), schema, 1), "simple"), tmp_path, "dash", sink=S.into_table(path, ["user_id", "skill_id"], columns))
    live = spark.read.parquet(path).withColumnRenamed("us", "last_attempt_us")
    batch = M.rule_states(rows)
    view = lambda df: {(r["user_id"], r["total_skills"], r["struggling_count"], round(r["avg_mastery"], 9)) for r in M.class_overview(df).collect()}
    assert view(live) == view(batch)


def test_live_feed(spark, answers, tmp_path):
    schema = in_files(answers, tmp_path / "in", 2)
    path = str(tmp_path / "feed")
    run(spark, S.batched(spark, str(tmp_path / "in"), schema, 1), tmp_path, "feed", sink=S.newest_into(path, 20))
    assert {r["event_id"] for r in spark.read.parquet(path).collect()} == {r["event_id"] for r in M.last_events(answers, 20).collect()}


def clicks(spark, rows):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, u, start + dt.timedelta(seconds=s)) for i, (u, s) in enumerate(rows)], "event_id long, user_id string, timestamp timestamp")


def test_rapid_clicks(spark, tmp_path):
    df = clicks(spark, [("a", 0.3 * i) for i in range(6)] + [("b", 2.0 * i) for i in range(6)])
    schema = in_files(df, tmp_path / "in", 3)
    got = run(spark, S.rapid_click_alerts(S.batched(spark, str(tmp_path / "in"), schema, 1)), tmp_path, "alerts")
    assert {r["event_id"] for r in got.collect()} == {r["event_id"] for r in B.rapid_clicks(df).collect()} == {4, 5}


def test_windows_late_rows_and_silence(spark, tmp_path):
    df = clicks(spark, [("a", 0), ("a", 10), ("a", 70), ("b", 5000), ("a", 1), ("b", 9000)])
    schema = in_files(df, tmp_path / "in", 6)
    source = lambda: S.batched(spark, str(tmp_path / "in"), schema, 1)
    got = run(spark, S.clicks_per_minute(source(), delay="10 seconds"), tmp_path, "rates")
    assert {(r["user_id"], r["clicks"]) for r in got.collect()} == {("a", 2), ("a", 1), ("b", 1)}
    kept = run(spark, S.clicks_per_minute(source(), delay="1 day"), tmp_path, "all_rates", "complete")
    assert sum(r["clicks"] for r in kept.collect()) == 6
    sessions = run(spark, S.task_sessions(source(), delay="10 seconds"), tmp_path, "sessions")
    assert {r["user_id"]: r["clicks"] >= 3 for r in sessions.where("user_id = 'a'").collect()} == {"a": True}
    silent = run(spark, S.inactivity(source()), tmp_path, "silent")
    assert {r["user_id"] for r in silent.collect()} >= {"a"}
    assert S.late_rows(df, df.where("event_id <> 4"), ["event_id"]).first()["event_id"] == 4


def test_masking_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "mail a@bc.de"), (2, "plain")], "event_id long, message string")
    schema = in_files(df, tmp_path / "in", 1)
    got = run(spark, S.masked(S.batched(spark, str(tmp_path / "in"), schema)), tmp_path, "masked")
    assert sorted(map(str, got.collect())) == sorted(map(str, P.anonymise(df, "message").collect()))
