"""Structured Streaming twins: mastery states, feeds, windows, alerts, masking, late rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from learnmill.operators import mastery, privacy
from learnmill.operators.merge import merge, read_swapped, write_swapped

#: A user's skills, and the six numbers of each in the same order.
STATE = "skills array<string>, p array<double>, last_us array<long>, n array<long>, ok array<long>, right array<long>, wrong array<long>"
MOVES = (
    "user_id string, skill_id string, event_id long, us long, is_correct boolean, probability_mastery double, total_attempts long, "
    "correct_attempts long, consecutive_correct long, consecutive_incorrect long"
)


def mastery_stream(events: DataFrame, rule: str = "bayes") -> DataFrame:
    """Every event with the state after it, per (user, skill). Inside a micro-batch the answers of a
    user are put in order of (time, id); the state is six numbers a skill, read and written once a user, since a
    call for each skill costs more than its answers."""
    if rule not in ("bayes", "simple"):
        raise ValueError(rule)

    def walk(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {skill: numbers for skill, *numbers in zip(*state.get, strict=True)} if state.exists else {}
        columns = [[], [], [], [], []]
        for f in frames:
            for column, name in zip(columns, ("us", "event_id", "skill_id", "is_correct", "attempts"), strict=True):
                column += f[name].tolist()
        out = []
        for us, event, skill, hit, attempts in sorted(zip(*columns, strict=True), key=lambda e: e[:2]):
            p, last, n, ok, right, wrong = held.get(skill, (mastery.START, None, 0, 0, 0, 0))
            hit = bool(hit)
            if rule == "bayes":
                p = mastery.bayes_step(mastery.reset_step(p, None if last is None else (us - last) / 3.6e9), hit)
            else:
                p = min(1.0, p + 0.1) if hit else max(0.0, p - 0.05)
            right, wrong = (right + 1, 0) if hit else (0, wrong + 1)
            held[skill] = numbers = (p, int(us), n + int(attempts), ok + hit, right, wrong)
            out.append((key[0], skill, int(event), int(us), hit, p, *numbers[2:]))
        state.update((list(held), *map(list, zip(*held.values(), strict=True))))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in MOVES.split(", ")])

    rows = mastery.with_time(events).select(F.col("user_id").cast("string").alias("user_id"), "skill_id", "event_id", "us", "is_correct", "attempts")
    return rows.groupBy("user_id").applyInPandasWithState(walk, MOVES, STATE, "append", GroupStateTimeout.NoTimeout)


def into_table(path: str, keys: list[str], update: list[str]):
    """A ``foreachBatch`` function that merges each batch into the Parquet table at ``path``, which is written anew;
    for a dashboard over many users ``stateful.dashboard_into`` writes only what a batch brings. A batch that
    comes again changes nothing. Read the table with ``read_swapped``."""

    def put(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("us", "event_id")).alias("s"))
        last = last.select(*keys, *[F.col(f"s.{c}").alias(c) for c in rest])
        before = read_swapped(batch.sparkSession, path)
        write_swapped(last if before is None else merge(before, last, keys, update), path)

    return put


def newest_into(path: str, n: int = 20):
    """A ``foreachBatch`` function that keeps the newest n events at ``path``: n rows, whatever the stream."""

    def put(batch: DataFrame, _: int) -> None:
        before = read_swapped(batch.sparkSession, path)
        rows = batch if before is None else before.unionByName(batch).dropDuplicates(["event_id"])
        write_swapped(mastery.last_events(rows, n).drop("us"), path)

    return put


def clicks_per_minute(clicks: DataFrame, size: str = "1 minute", slide: str | None = None, delay: str = "10 minutes", time: str = "timestamp") -> DataFrame:
    """Clicks of each user by tumbling or sliding window; rows later than the delay are dropped."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return clicks.withWatermark(time, delay).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("clicks")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "clicks")


def task_sessions(clicks: DataFrame, gap: str = "5 minutes", delay: str = "10 minutes", time: str = "timestamp") -> DataFrame:
    """Sessions of each user, closed by a gap."""
    w = F.session_window(time, gap)
    return clicks.withWatermark(time, delay).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("clicks")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "clicks")


def rapid_click_alerts(clicks: DataFrame, n: int = 5, seconds: float = 2.0) -> DataFrame:
    """(user_id, event_id, span, confidence) of every click that ends n clicks within the span; the
    state is the last n - 1 times of a user."""
    def walk(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        out = []
        for e in pd.concat(list(frames)).sort_values(["us", "event_id"]).itertuples():
            held = [*held, int(e.us)][-n:]
            span = (held[-1] - held[0]) / 1e6
            if len(held) == n and span <= seconds:
                out.append((key[0], int(e.event_id), span, min(1.0, 0.7 + 0.3 * (1 - span / seconds))))
        state.update((held[-(n - 1) :],))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "span", "confidence"])

    rows = mastery.with_time(clicks).select(F.col("user_id").cast("string").alias("user_id"), "event_id", "us")
    return rows.groupBy("user_id").applyInPandasWithState(walk, "user_id string, event_id long, span double, confidence double", "held array<long>", "append", GroupStateTimeout.NoTimeout)


def inactivity(events: DataFrame, seconds: int = 300, delay: str = "1 minute", time: str = "timestamp") -> DataFrame:
    """(user_id, last_seen_us) of users silent for longer than ``seconds`` of event time."""
    def walk(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame([(key[0], last)], columns=["user_id", "last_seen_us"])
            return
        last = max([state.get[0] if state.exists else 0, *(int(f["us"].max()) for f in frames)])
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([], columns=["user_id", "last_seen_us"])

    rows = mastery.with_time(events.withWatermark(time, delay)).select(F.col("user_id").cast("string").alias("user_id"), time, "us")
    return rows.groupBy("user_id").applyInPandasWithState(walk, "user_id string, last_seen_us long", "last_us long", "append", GroupStateTimeout.EventTimeTimeout)


def masked(messages: DataFrame, text: str = "message") -> DataFrame:
    """Stateless masking before any sink; it is the batch operator."""
    return privacy.anonymise(messages, text)


def batched(spark, path: str, schema, files: int = 50):
    """A file stream that takes at most so many files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def late_rows(all_rows: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that the stream has dropped as late, by a batch run over everything."""
    return all_rows.join(kept.select(*keys), keys, "left_anti")


def run_to_table(stream: DataFrame, name: str, mode: str = "append", start=None) -> DataFrame:
    """Run a stream over what is there into a new table of the shared folder; its rows. ``start`` takes the writer
    and the path where the stream needs settings of its own (``stateful.begin``)."""
    import uuid

    from learnmill.operators.graph import shared_root

    spark = stream.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}/marks").trigger(availableNow=True)
    (start(writer, f"{path}/rows") if start else writer.start(f"{path}/rows")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
