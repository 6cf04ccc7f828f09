"""Streams with state and timers, against plain loops, over splits and restarts; tables swapped under crashes."""

import datetime as dt
import random

import pytest
from learnmill.operators import mastery as M
from learnmill.operators import merge as U
from learnmill.streaming import stateful as T
from pyspark.sql import functions as F

START = dt.datetime(2024, 1, 1)


def feed(spark, tmp, df, stretches, begin):
    """The stream over each stretch in turn, started again from its checkpoint."""
    for rows in stretches:
        spark.createDataFrame(rows, df).coalesce(1).write.mode("append").parquet(str(tmp / "in"))
        begin(spark.readStream.schema(df).parquet(str(tmp / "in")), str(tmp / "marks"))


def test_click_batches_by_count_and_by_time(spark, tmp_path):
    r = random.Random(2)
    rows, n = [], 0
    for user, pace in (("fast", 0.05), ("slow", 3.0), ("steady", 0.5)):
        for i in range(300 if user == "fast" else 60):
            rows.append((n, user, START + dt.timedelta(seconds=i * pace + r.random() * pace / 2)))
            n += 1
    rows.sort(key=lambda x: x[2])
    schema = "event_id long, user_id string, timestamp timestamp"

    def begin(stream, marks):
        writer = T.click_batches(stream, delay="1 second").writeStream.format("parquet").option("checkpointLocation", marks)
        T.begin(writer.trigger(availableNow=True), str(tmp_path / "out")).awaitTermination()

    feed(spark, tmp_path, schema, [rows[:100], rows[100:101], rows[101:333], rows[333:]], begin)
    got = sorted((x["user_id"], x["window_us"], x["number"], x["reason"], list(x["event_ids"])) for x in spark.read.parquet(str(tmp_path / "out")).collect())
    us = lambda t: int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    by = {}
    for i, user, t in rows:
        by.setdefault((user, us(t) // 5_000_000 * 5_000_000), []).append(i)
    passed = (us(rows[-1][2]) - 1_000_000) // 1000
    want = []
    for (user, window), ids in by.items():
        for k in range(0, len(ids), 50):
            part = ids[k : k + 50]
            if len(part) == 50 or (window + 5_000_000) // 1000 <= passed:
                want.append((user, window, k // 50, "full" if len(part) == 50 else "time", part))
    assert got == sorted(want) and {x[3] for x in got} == {"full", "time"}


@pytest.mark.parametrize("cuts", [(), (1, 40, 41, 150)])
def test_dashboard_is_the_batch_one_after_any_split(spark, tmp_path, cuts):
    r = random.Random(7)
    rows = [(i, f"u{r.randrange(6)}", f"s{r.randrange(4)}", r.random() < 0.6, 1 + r.randrange(3), START + dt.timedelta(seconds=i)) for i in range(200)]
    schema = "event_id long, user_id string, skill_id string, is_correct boolean, attempts int, timestamp timestamp"
    path = str(tmp_path / "dashboard")
    brought = []

    def begin(stream, marks):
        put = T.dashboard_into(path)
        twice = lambda batch, i: (put(batch, i), put(batch, i), brought.append(batch.count()))  # noqa: E731  a batch that comes again changes nothing
        T.begin(T.card_changes(stream).writeStream.outputMode("update").foreachBatch(twice).option("checkpointLocation", marks).trigger(availableNow=True)).awaitTermination()

    bounds = [0, *cuts, 200]
    feed(spark, tmp_path, schema, [rows[a:b] for a, b in zip(bounds, bounds[1:])], begin)
    states = M.rule_states(spark.createDataFrame(rows, schema))
    columns = ["user_id", "total_skills", "mastered_count", "learning_count", "struggling_count", "avg_mastery", "last_active_us", "overall_status"]
    view = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in df.select(*columns).collect())
    assert view(T.live_cards(spark, path)) == view(M.class_mastery(states))
    assert T.live_totals(spark, path).first().asDict() == M.class_totals(M.class_mastery(states)).first().asDict()
    users = [len({x[1] for x in rows[a:b]}) for a, b in zip(bounds, bounds[1:])]
    assert all(n <= 2 * u for n, u in zip([n for n in brought if n], users))


def test_lateness_by_arrival(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, f"u{r.randrange(3)}", START + dt.timedelta(seconds=i - r.choice([0, 0, 5, 40, 90]))) for i in range(120)]
    schema = "event_id long, user_id string, timestamp timestamp"

    def begin(stream, marks):
        T.begin(T.lateness(stream, 30.0).writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True), str(tmp_path / "out")).awaitTermination()

    feed(spark, tmp_path, schema, [rows[:50], rows[50:51], rows[51:]], begin)
    newest, want = {}, {}
    for i, user, t in rows:
        behind = (newest[user] - dt.timedelta(seconds=30) - t).total_seconds() if user in newest else 0
        want[i] = max(0, round(behind * 1e6))
        newest[user] = max(t, newest.get(user, t))
    got = {x["event_id"]: x for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {i: x["behind_us"] for i, x in got.items()} == want and sum(x["late"] for x in got.values()) > 5


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", range(5))
def test_a_crash_at_any_step_of_a_swap_loses_nothing(spark, tmp_path, monkeypatch, step):
    """After a crash before or after the write, or before or after either rename, the old rows or the new ones are
    there whole, and the batch put again gives the new ones."""
    path = str(tmp_path / "table")
    U.write_swapped(spark.range(100), path)
    calls = []
    move = U._move

    def failing(store, a, b):
        calls.append(1)
        if len(calls) == (step + 1) // 2 and step % 2:
            raise Crash
        move(store, a, b)
        if len(calls) == step // 2 and not step % 2:
            raise Crash

    monkeypatch.setattr(U, "_move", failing)
    put = lambda: U.write_swapped(U.read_swapped(spark, path).union(spark.range(100, 101)).distinct(), path)
    if step:
        with pytest.raises(Crash):
            put()
    else:  # a write that did not end
        spark.range(3).write.parquet(path + ".new")
        (tmp_path / "table.new" / "_SUCCESS").unlink()
    monkeypatch.setattr(U, "_move", move)
    assert U.read_swapped(spark, path).count() in (100, 101)
    put()
    assert sorted(x["id"] for x in U.read_swapped(spark, path).collect()) == list(range(101))
    assert not (tmp_path / "table.new").exists() and not (tmp_path / "table.old").exists()


def test_half_swapped_tables_are_recovered_first(spark, tmp_path):
    path = str(tmp_path / "t")
    assert U.read_swapped(spark, path) is None
    U.write_swapped(spark.range(2), path)
    (tmp_path / "t").rename(tmp_path / "t.old")
    with pytest.raises(RuntimeError):
        U.write_swapped(spark.range(1), path)
    assert U.read_swapped(spark, path).count() == 2


def test_a_rename_that_is_refused_is_an_error():
    class Store:
        def rename(self, a, b):
            return False

    with pytest.raises(OSError):
        U._move(Store(), "a", "b")
