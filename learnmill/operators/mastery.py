"""Mastery per (user, skill): ordered folds over answer events, states, roll-ups, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from learnmill.functions.scalar import clamp, micros

from . import folds

KEY = ["user_id", "skill_id"]
SLIP, GUESS, START = 0.05, 0.2, 0.5
LOW, HIGH = 0.01, 0.99
RESET_HOURS, RESET_SPAN, RESET_MOST = 24.0, 168.0, 0.2


def bayes(p: Column, correct: Column) -> Column:
    """Mastery after one answer by Bayes' rule, kept in [.01, .99]."""
    p = clamp(p, LOW, HIGH)
    right = (1 - F.lit(SLIP)) * p
    wrong = F.lit(SLIP) * p
    new = F.when(correct, right / (right + GUESS * (1 - p))).otherwise(wrong / (wrong + (1 - F.lit(GUESS)) * (1 - p)))
    return clamp(new, LOW, HIGH)


def reset(p: Column, hours: Column) -> Column:
    """After more than a day away mastery moves toward one half, by at most a fifth."""
    share = F.least(F.lit(RESET_MOST), (hours - RESET_HOURS) / RESET_SPAN)
    return F.when(hours > RESET_HOURS, p * (1 - share) + START * share).otherwise(p)


def predict(p: Column) -> Column:
    """Probability that the next answer is right."""
    return (1 - F.lit(SLIP)) * p + GUESS * (1 - p)


def status(p: Column, attempts: Column) -> Column:
    return F.when((p < 0.6) & (attempts > 3), "STRUGGLING").when(p > 0.9, "MASTERED").otherwise("LEARNING")


def suggested_action(p: Column, attempts: Column) -> Column:
    s = status(p, attempts)
    return F.when(s == "STRUGGLING", "Provide remediation and scaffolding").when(s == "MASTERED", "Ready for next challenge").otherwise("Continue practice")


def confidence(attempts: Column) -> Column:
    return F.least(F.lit(1.0), attempts / 10.0)


def needs_intervention(p: Column, attempts: Column, wrong_in_a_row: Column) -> Column:
    return (p < 0.6) & (attempts > 3) & (wrong_in_a_row >= 2)


STATE = "probability_mastery double, total_attempts long, correct_attempts long, consecutive_correct long, consecutive_incorrect long, last_attempt_us long"


class SimpleRule(folds.Rule):
    """+.1 or -.05 an answer, kept in [0, 1]."""

    start, floor, ceiling = START, 0.0, 1.0

    def step(self, p: float, hit: bool, hours: float | None) -> float:
        return min(1.0, p + 0.1) if hit else max(0.0, p - 0.05)


class BayesRule(folds.Rule):
    """Reset after a day away, then Bayes' rule, kept in [LOW, HIGH]."""

    start, floor, ceiling = START, LOW, HIGH

    def step(self, p: float, hit: bool, hours: float | None) -> float:
        return bayes_step(reset_step(p, hours), hit)

    def both(self, low: float, high: float, hit: bool, hours: float | None) -> tuple[float, float]:
        """The two walks count as one only where both lie clearly beyond a clamp: rounding might change their order."""
        a, b = (posterior(reset_step(p, hours), hit) for p in (low, high))
        if a > HIGH + folds.MARGIN or b < LOW - folds.MARGIN:
            return (HIGH, HIGH) if hit else (LOW, LOW)
        low, high = max(LOW, min(HIGH, a)), max(LOW, min(HIGH, b))
        return (low, high) if low != high else (LOW, HIGH)


def answers(events: DataFrame) -> DataFrame:
    return events.select(*KEY, "event_id", micros("timestamp").alias("us"), "is_correct", F.col("attempts").cast("long").alias("attempts"))


def rule_states(events: DataFrame, hot: int = folds.HOT) -> DataFrame:
    """State of each (user, skill) by the simple rule: +.1 or -.05 an answer, kept in [0, 1].

    One ordered walk a key with one state in memory; keys of more than ``hot`` answers are spread over tasks.
    """
    rows = answers(events)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema if f.name in KEY}
    return folds.fold(rows, KEY, SimpleRule(), LastStates, f"user_id {kinds['user_id']}, skill_id {kinds['skill_id']}, {STATE}", hot)


class LastStates:
    """Gathers the state of each key that has ended."""

    def __init__(self):
        self.rows, self.kinds = [], None

    def each(self, *_):
        return None

    def ended(self, key: tuple, s: folds.State) -> None:
        self.rows.append((*key, s.low, s.n, s.ok, s.right, s.wrong, s.last))

    def batches(self, batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
        self.kinds = batch.schema.types[:2] if batch is not None else self.kinds
        if self.rows:
            kinds = [*self.kinds, pa.float64(), *[pa.int64()] * 5]
            names = [*KEY, *(x.split()[0] for x in STATE.split(", "))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.rows, strict=True), kinds, strict=True)], names=names)
            self.rows = []


TRAJECTORY = (
    "event_id long, us long, is_correct boolean, previous_mastery double, hours_since double, new_mastery double, "
    "total_attempts long, correct_attempts long, consecutive_correct long, consecutive_incorrect long"
)


def posterior(p: float, correct: bool) -> float:
    p = max(LOW, min(HIGH, p))
    a, b = ((1 - SLIP) * p, GUESS * (1 - p)) if correct else (SLIP * p, (1 - GUESS) * (1 - p))
    return a / (a + b)


def bayes_step(p: float, correct: bool) -> float:
    return max(LOW, min(HIGH, posterior(p, correct)))


def reset_step(p: float, hours: float | None) -> float:
    if hours is None or hours <= RESET_HOURS:
        return p
    share = min(RESET_MOST, (hours - RESET_HOURS) / RESET_SPAN)
    return p * (1 - share) + START * share


def trajectory(events: DataFrame, hot: int = folds.HOT) -> DataFrame:
    """Every event with the mastery before and after it: reset, Bayes update, counters.

    One ordered walk a key with one state in memory; keys of more than ``hot`` answers are spread over tasks.
    ``previous_mastery`` is that before the reset.
    """
    rows = answers(events)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema if f.name in KEY}
    return folds.fold(rows, KEY, BayesRule(), Moves, f"user_id {kinds['user_id']}, skill_id {kinds['skill_id']}, {TRAJECTORY}", hot)


class Moves:
    """Gathers a row for each answer."""

    def __init__(self):
        self.rows = []

    def each(self, key: tuple, event: list, us: list, hits: list):
        now = iter(zip(event, us, hits, strict=True))
        return lambda before, hours, p, n, ok, right, wrong: self.rows.append((*key, *next(now), before, hours, p, n, ok, right, wrong))

    def ended(self, *_) -> None:
        pass

    def batches(self, batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
        if self.rows and batch is not None:
            kinds = [*batch.schema.types[:5], *[pa.float64()] * 3, *[pa.int64()] * 4]
            names = [*KEY, *(x.split()[0] for x in TRAJECTORY.split(", "))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.rows, strict=True), kinds, strict=True)], names=names)
            self.rows = []


def record_events(events: DataFrame) -> DataFrame:
    """For each event the mastery before and after, the status and the prediction that follow it."""
    p, n = F.col("new_mastery"), F.col("total_attempts")
    return trajectory(events).select("event_id", *KEY, "is_correct", "previous_mastery", "new_mastery", status(p, n).alias("status"), predict(p).alias("prediction"))


def record_batch(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(recorded, rejected): events without a user, a skill, an answer or a time are kept apart."""
    whole = F.lit(True)
    for c in (*KEY, "is_correct", "timestamp", "event_id"):
        whole = whole & F.col(c).isNotNull()
    whole = whole & (F.coalesce("attempts", F.lit(1)) >= 1)
    return record_events(events.where(whole)), events.where(~whole)


def latest_states(moves: DataFrame) -> DataFrame:
    """The last row of each (user, skill) of a trajectory."""
    rest = [c for c in moves.columns if c not in KEY]
    last = moves.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct("us", "event_id")).alias("s"))
    return last.select(*KEY, *[F.col(f"s.{c}").alias(c) for c in rest])


def class_overview(states: DataFrame) -> DataFrame:
    """Per user: skills, counts by mastery, mean, last activity; a low mastery with few attempts is
    in none of the counts. The mean is rounded to nine places, as on the live dashboard, before a limit is laid on it:
    the sum of the same states in another order may be another double."""
    p = F.col("probability_mastery")
    return states.groupBy("user_id").agg(
        F.count("*").alias("total_skills"), F.count_if(p > 0.9).alias("mastered_count"), F.count_if((p >= 0.6) & (p <= 0.9)).alias("learning_count"),
        F.count_if((p < 0.6) & (F.col("total_attempts") > 3)).alias("struggling_count"), F.round(F.avg(p), 9).alias("avg_mastery"), F.max("last_attempt_us").alias("last_active_us"),
    )


def skill_summary(skills: DataFrame, states: DataFrame) -> DataFrame:
    """Per skill, with or without students: distinct users by mastery, means."""
    p, who = F.col("probability_mastery"), F.col("user_id")
    return skills.join(states, "skill_id", "left").groupBy("skill_id", "skill_name", "subject", "grade_level").agg(
        F.count_distinct(who).alias("total_students"), F.count_distinct(F.when(p > 0.9, who)).alias("mastered_count"),
        F.count_distinct(F.when((p < 0.6) & (F.col("total_attempts") > 3), who)).alias("struggling_count"), F.avg(p).alias("avg_mastery"), F.avg("total_attempts").alias("avg_attempts"),
    )


def student_rollup(states: DataFrame) -> DataFrame:
    s = status(F.col("probability_mastery"), F.col("total_attempts"))
    return states.groupBy("user_id").agg(F.count_if(s == "MASTERED").alias("mastered"), F.count_if(s == "LEARNING").alias("learning"), F.count_if(s == "STRUGGLING").alias("struggling"))


def overall_status(overview: DataFrame) -> DataFrame:
    s = F.when(F.col("struggling_count") > 0, "STRUGGLING").when(F.col("avg_mastery") > 0.85, "MASTERED").otherwise("LEARNING")
    return overview.withColumn("overall_status", s)


def class_mastery(states: DataFrame, struggling_only: bool = False, min_mastery: float | None = None) -> DataFrame:
    """Class cards, with the optional filters folded in when the plan is built."""
    cards = overall_status(class_overview(states))
    if struggling_only:
        cards = cards.where(F.col("struggling_count") > 0)
    if min_mastery is not None:
        cards = cards.where(F.col("avg_mastery") >= min_mastery)
    return cards


CARD_FILTERS = {"ready": "MASTERED", "distracted": "LEARNING", "intervention": "STRUGGLING"}


def filter_cards(cards: DataFrame, kind: str | None = None) -> DataFrame:
    return cards if kind in (None, "all") else cards.where(F.col("overall_status") == CARD_FILTERS[kind])


def class_totals(cards: DataFrame) -> DataFrame:
    s = F.col("overall_status")
    return cards.agg(
        F.count("*").alias("total_students"), F.round(F.coalesce(F.avg("avg_mastery"), F.lit(0.0)), 3).alias("class_mean"), F.count_if(s == "MASTERED").alias("ready"),
        F.count_if(s == "LEARNING").alias("distracted"), F.count_if(s == "STRUGGLING").alias("intervention"),
    )


def status_shares(states: DataFrame) -> DataFrame:
    counted = states.groupBy(status(F.col("probability_mastery"), F.col("total_attempts")).alias("status")).agg(F.count("*").alias("n"))
    return counted.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def student_report(states: DataFrame, skills: DataFrame, user_id=None) -> DataFrame:
    """States with skill names, status and advice; of one user, if given."""
    rows = states if user_id is None else states.where(F.col("user_id") == user_id)
    p, n = F.col("probability_mastery"), F.col("total_attempts")
    return rows.join(skills, "skill_id").select("user_id", "skill_id", "skill_name", p, n, "correct_attempts", status(p, n).alias("status"), suggested_action(p, n).alias("suggested_action"), confidence(n).alias("confidence"), "last_attempt_us")


def intervention_list(states: DataFrame, skills: DataFrame) -> DataFrame:
    need = needs_intervention(F.col("probability_mastery"), F.col("total_attempts"), F.col("consecutive_incorrect"))
    return states.where(need).join(skills, "skill_id").select("user_id", "skill_id", "skill_name", "subject", "grade_level", "probability_mastery", "total_attempts", "consecutive_incorrect", "last_attempt_us")


def reset_student(events: DataFrame, states: DataFrame, user_id) -> tuple[DataFrame, DataFrame]:
    """Events without the student's, and states with theirs set back to the start."""
    mine = F.col("user_id") == user_id
    zero = F.lit(0).cast("long")
    back = {"probability_mastery": F.lit(START), **{c: zero for c in ("total_attempts", "correct_attempts", "consecutive_correct", "consecutive_incorrect")}, "last_attempt_us": F.lit(None).cast("long")}
    return events.where(~mine), states.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in back.items()})


def by_time(*keys: str, desc: bool = False) -> Window:
    order = [F.desc("us"), F.desc("event_id")] if desc else ["us", "event_id"]
    return Window.partitionBy(*keys).orderBy(*order)


def with_time(events: DataFrame) -> DataFrame:
    return events.withColumn("us", micros("timestamp"))


def last_events(events: DataFrame, n: int, *keys: str) -> DataFrame:
    """The newest n events of each key; of all rows, without a key, in one distributed top-n."""
    rows = with_time(events)
    if not keys:
        return rows.orderBy(F.desc("us"), F.desc("event_id")).limit(n)
    return rows.withColumn("rn", F.row_number().over(by_time(*keys, desc=True))).where(F.col("rn") <= n)


def running_streaks(events: DataFrame, hot: int = folds.HOT) -> DataFrame:
    """Right and wrong answers in a row, running totals, and hours since the answer before. Windows for ordinary keys;
    keys of more than ``hot`` answers are walked over several tasks."""
    ordinary, many = folds.split(with_time(events), KEY, hot)
    rows = _streak_windows(ordinary)
    if many is None:
        return rows
    kinds = {f.name: f.dataType.simpleString() for f in many.schema if f.name in KEY}
    schema = f"event_id long, user_id {kinds['user_id']}, skill_id {kinds['skill_id']}, {STREAKS}"
    return rows.unionByName(folds.spread(answers(many), KEY, folds.Counting(), Streaks, schema))


STREAKS = "is_correct boolean, consecutive_correct int, consecutive_incorrect int, total_attempts long, correct_attempts long, hours_since double"


class Streaks:
    """Gathers the counters after each answer."""

    def __init__(self):
        self.rows = []

    def each(self, key: tuple, event: list, us: list, hits: list):
        now = iter(zip(event, hits, strict=True))

        def put(before, hours, p, n, ok, right, wrong):
            event_id, hit = next(now)
            self.rows.append((event_id, *key, hit, right, wrong, n, ok, hours))

        return put

    def ended(self, *_) -> None:
        pass

    def batches(self, batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
        if self.rows and batch is not None:
            kinds = [batch.schema.types[2], *batch.schema.types[:2], pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
            names = ["event_id", *KEY, *(x.split()[0] for x in STREAKS.split(", "))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.rows, strict=True), kinds, strict=True)], names=names)
            self.rows = []


def _streak_windows(rows: DataFrame) -> DataFrame:
    w = by_time(*KEY)
    rows = rows.withColumn("hit", F.col("is_correct").cast("int"))
    changed = F.coalesce((F.col("hit") != F.lag("hit").over(w)).cast("int"), F.lit(1))
    rows = rows.withColumn("changed", changed).withColumn("run", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nth = F.row_number().over(by_time(*KEY, "run"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0)
    return rows.select(
        "event_id", *KEY, "is_correct", F.when(F.col("is_correct"), nth).otherwise(zero).alias("consecutive_correct"), F.when(F.col("is_correct"), zero).otherwise(nth).alias("consecutive_incorrect"),
        F.sum(F.col("attempts").cast("long")).over(upto).alias("total_attempts"), F.sum(F.col("hit").cast("long")).over(upto).alias("correct_attempts"), ((F.col("us") - F.lag("us").over(w)) / 3.6e9).alias("hours_since"),
    )


def error_streaks(events: DataFrame) -> DataFrame:
    """Wrong answers since the last right one, per user: what stands after the newest right answer."""
    rows = with_time(events).select("user_id", "is_correct", "us", "event_id")
    right = rows.groupBy("user_id").agg(F.max(F.when(F.col("is_correct"), F.struct("us", "event_id"))).alias("last_right"))
    after = rows.join(right, "user_id").where(F.col("last_right").isNull() | (F.struct("us", "event_id") > F.col("last_right")))
    return right.select("user_id").join(after.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).alias("consecutive_errors"))
