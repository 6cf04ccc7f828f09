"""Behaviour signals per user from answers and clicks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mastery import by_time, error_streaks, last_events, with_time

ERRORS, LONG_SECONDS, PAUSE_SECONDS = 3, 120, 300


def compact(*reasons: Column) -> Column:
    return F.array_compact(F.array(*reasons))


def frustration(events: DataFrame) -> DataFrame:
    """is_frustrated, frustration_confidence and reasons of each user, from the last ten answers."""
    recent = last_events(events, 10, "user_id")
    ten = recent.groupBy("user_id").agg(
        F.coalesce(F.min(F.when(F.col("is_correct"), F.col("rn"))) - 1, F.count("*")).alias("streak"),
        F.count_if(~F.col("is_correct") & (F.col("rn") <= 5) & (F.col("time_spent_seconds") < 10)).alias("rapid"),
        F.count_if(~F.col("is_correct") & (F.col("time_spent_seconds") > LONG_SECONDS)).alias("long"),
    )
    a, b, c = F.col("streak") >= ERRORS, F.col("rapid") >= 3, F.col("long") > 0
    score = F.when(a, 0.5).otherwise(0.0) + F.when(b, 0.3).otherwise(0.0) + F.when(c, 0.3).otherwise(0.0)
    why = compact(
        F.when(a, F.concat(F.col("streak").cast("string"), F.lit(" consecutive errors detected"))), F.when(b, F.concat(F.col("rapid").cast("string"), F.lit(" rapid failures (<10s each)"))),
        F.when(c, F.concat(F.col("long").cast("string"), F.lit(" long struggles (>2min)"))),
    )
    return ten.select("user_id", (score >= 0.5).alias("is_frustrated"), F.least(score, F.lit(1.0)).alias("frustration_confidence"), why.alias("frustration_reasons"))


def click_rates(clicks: DataFrame) -> DataFrame:
    """Clicks, clicks a minute over the observed span (null if it is 0), distinct elements, last click."""
    span = (F.max("us") - F.min("us")) / 1e6
    return with_time(clicks).groupBy("user_id").agg(F.count("*").alias("clicks"), F.when(span > 0, F.count("*") / span * 60).alias("per_minute"), F.count_distinct("element_id").alias("elements"), F.max("us").alias("last_click_us"))


def distinct_elements(clicks: DataFrame, approximate: bool = False) -> DataFrame:
    f = F.approx_count_distinct if approximate else F.count_distinct
    return clicks.groupBy("user_id").agg(f("element_id").alias("elements"))


def engagement(rates: DataFrame, low: float = 5, high: float = 30, too_high: float = 50) -> DataFrame:
    """From click rates with ``time_on_task``: is_engaged, engagement_confidence, reasons."""
    r, t = F.col("per_minute"), F.col("time_on_task")
    wild = F.coalesce(r > too_high, F.lit(False))
    good = F.coalesce((r >= low) & (r <= high), F.lit(False))
    diverse = F.coalesce(F.col("elements") >= 3, F.lit(False))
    task = F.when((t >= 30) & (t <= 600), 0.4).when(t > 600, -0.2).otherwise(0.0)
    score = F.when(wild, 0.0).otherwise(F.when(good, 0.3).otherwise(0.0) + task + F.when(diverse, 0.3).otherwise(0.0))
    rate, seconds = F.format_string("%.1f", r), t.cast("long").cast("string")
    why = compact(
        F.when(wild, F.concat(F.lit("Very high click rate: "), rate, F.lit("/min (indicates frustration)"))).when(good, F.concat(F.lit("Healthy click rate: "), rate, F.lit("/min"))),
        F.when(~wild & (t >= 30) & (t <= 600), F.concat(F.lit("Good time on task: "), seconds, F.lit("s"))).when(~wild & (t > 600), F.concat(F.lit("Long time on task: "), seconds, F.lit("s (may indicate struggle)"))),
        F.when(~wild & diverse, F.concat(F.lit("Diverse interactions: "), F.col("elements").cast("string"), F.lit(" different elements"))),
    )
    return rates.select("user_id", (~wild & (score >= 0.4)).alias("is_engaged"), F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))).alias("engagement_confidence"), why.alias("engagement_reasons"))


def retry_counts(events: DataFrame, last: int = 5) -> DataFrame:
    """Attempts per user and skill among the last answers of the user."""
    return last_events(events, last, "user_id").groupBy("user_id", "skill_id").agg(F.count("*").alias("attempts"))


def struggling(events: DataFrame) -> DataFrame:
    """is_struggling, struggling_confidence, reasons; the time on task is that of the last answer."""
    recent = last_events(events, 5, "user_id")
    base = recent.groupBy("user_id").agg(F.count_if(~F.col("is_correct")).alias("errors"), F.max(F.when(F.col("rn") == 1, F.col("time_spent_seconds"))).alias("time_on_task"))
    # of five answers one skill at most can have three
    loop = F.when(F.col("attempts") >= 3, F.struct("skill_id", "attempts"))
    loops = retry_counts(events).groupBy("user_id").agg(F.max(loop).alias("loop"))
    rows = base.join(loops, "user_id")
    a, b, c = F.col("errors") >= 3, F.col("time_on_task") > LONG_SECONDS, F.col("loop").isNotNull()
    score = F.when(a, 0.4).otherwise(0.0) + F.when(b, 0.5).otherwise(0.0) + F.when(c, 0.3).otherwise(0.0)
    why = compact(
        F.when(a, F.concat(F.col("errors").cast("string"), F.lit("/5 recent attempts incorrect"))), F.when(b, F.concat(F.lit("Long time on task: "), F.col("time_on_task").cast("long").cast("string"), F.lit("s"))),
        F.when(c, F.concat(F.lit("Retry loop on "), F.col("loop.skill_id"), F.lit(": "), F.col("loop.attempts").cast("string"), F.lit(" attempts"))),
    )
    return rows.select("user_id", "time_on_task", (score >= 0.5).alias("is_struggling"), F.least(score, F.lit(1.0)).alias("struggling_confidence"), why.alias("struggling_reasons"))


def rapid_clicks(clicks: DataFrame, n: int = 5, seconds: float = 2.0) -> DataFrame:
    """Every click that ends n clicks within the span, with its confidence."""
    w = by_time("user_id")
    span = (F.col("us") - F.lag("us", n - 1).over(w)) / 1e6
    rows = with_time(clicks).withColumn("span", span).where(F.col("span") <= seconds)
    return rows.select("event_id", "user_id", "us", "span", F.least(F.lit(1.0), 0.7 + 0.3 * (1 - F.col("span") / seconds)).alias("confidence"))


def rapid_now(clicks: DataFrame, n: int = 5, seconds: float = 2.0) -> DataFrame:
    """Whether the last n clicks of each user fall within the span."""
    last = last_events(clicks, n, "user_id").groupBy("user_id").agg(F.count("*").alias("k"), ((F.max("us") - F.min("us")) / 1e6).alias("span"))
    hit = (F.col("k") == n) & (F.col("span") <= seconds)
    return last.select("user_id", hit.alias("is_rapid_clicking"), F.when(hit, F.least(F.lit(1.0), 0.7 + 0.3 * (1 - F.col("span") / seconds))).otherwise(0.0).alias("rapid_confidence"))


def trailing_clicks(clicks: DataFrame, seconds: int = 5) -> DataFrame:
    """For each click, how many the user made in the trailing seconds, itself included.

    A user's clicks are cut into spans of that length and each span is counted with a copy of the one before
    it, which is as far back as a click looks. So a window holds two spans of a user, however many clicks
    the user has made in all.
    """
    size = int(seconds * 1e6)
    span = F.floor(F.col("us") / size).cast("long")
    looked_at = F.array(F.struct(span.alias("span"), F.lit(True).alias("own")), F.struct((span + 1).alias("span"), F.lit(False).alias("own")))
    rows = with_time(clicks).select("event_id", "user_id", "us", F.explode(looked_at).alias("at")).select("event_id", "user_id", "us", "at.*")
    w = Window.partitionBy("user_id", "span").orderBy("us").rangeBetween(-size, 0)
    return rows.withColumn("recent_clicks", F.count("*").over(w)).where("own").select("event_id", "user_id", "recent_clicks")


def suggest_mode(frustrated: Column, errors: Column, is_struggling: Column, rapid: Column) -> Column:
    return F.when(frustrated & (errors >= ERRORS), "high_contrast_focus").when(is_struggling | rapid, "focus").otherwise("standard")


def mode_reason(frustrated: Column, errors: Column, is_struggling: Column, rapid: Column, engaged: Column, seconds: Column) -> Column:
    """Why ``suggest_mode`` says so."""
    high = F.concat(F.lit("High frustration + "), errors.cast("string"), F.lit(" errors"))
    hard = F.concat(F.lit("User struggling (time: "), seconds.cast("string"), F.lit("s)"))
    return (
        F.when(frustrated & (errors >= ERRORS), high).when(is_struggling, hard).when(rapid, "Rapid clicking detected")
        .when(engaged, "User engaged, maintaining standard mode").otherwise("Default mode selection")
    )


def signals(events: DataFrame, clicks: DataFrame, as_of_us: int) -> DataFrame:
    """All signals of each user with answers or clicks: urgency, confidence, reasons, mode."""
    no, none = F.lit(False), F.array().cast("array<string>")
    answers = frustration(events).join(struggling(events), "user_id").join(error_streaks(events), "user_id")
    both = answers.join(click_rates(clicks), "user_id", "full").withColumn("time_on_task", F.coalesce("time_on_task", F.lit(0)))
    rows = both.join(engagement(both), "user_id", "left").join(rapid_now(clicks), "user_id", "left")
    f, s, r = F.coalesce("is_frustrated", no), F.coalesce("is_struggling", no), F.coalesce("is_rapid_clicking", no)
    errors, g = F.coalesce("consecutive_errors", F.lit(0)).cast("long"), F.coalesce("is_engaged", no)
    seconds = F.col("time_on_task").cast("long")
    urgency = F.when(f & (errors >= ERRORS), "intervention").when(s, "attention").otherwise("none")
    zero = F.lit(0.0)
    top = F.greatest(F.coalesce("frustration_confidence", zero), F.coalesce("struggling_confidence", zero), F.coalesce("engagement_confidence", zero))
    why = F.concat(*[F.coalesce(f"{k}_reasons", none) for k in ("frustration", "engagement", "struggling")], F.array(mode_reason(f, errors, s, r, g, seconds)))
    ago = F.when(F.col("last_click_us").isNotNull(), F.floor((F.lit(as_of_us) - F.col("last_click_us")) / 1e6)).otherwise(0)
    return rows.select(
        "user_id", f.alias("is_frustrated"), g.alias("is_engaged"), s.alias("is_struggling"), r.alias("is_rapid_clicking"), errors.alias("consecutive_errors"),
        seconds.alias("time_on_task_seconds"), ago.cast("long").alias("last_activity_seconds_ago"), urgency.alias("urgency"), top.alias("confidence"), why.alias("reasoning"),
        suggest_mode(f, errors, s, r).alias("suggested_mode"),
    )


def behavioral_status(events: DataFrame, clicks: DataFrame, as_of_us: int) -> DataFrame:
    """The signals over the last 20 answers and 50 clicks of each user up to a time."""
    upto = F.col("us") <= as_of_us
    e = last_events(with_time(events).where(upto), 20, "user_id").drop("rn")
    c = last_events(with_time(clicks).where(upto), 50, "user_id").drop("rn")
    return signals(e, c, as_of_us)


# The modes in order, and the triggers that a signal can set off.
MODES = (
    "standard", "focus", "high_contrast_focus", "simplified", "step_by_step", "visual", "gamified", "collaborative",
    "intervention", "break", "exploration", "immersive", "dyslexic_friendly", "adhd_friendly", "low_vision",
)
TRIGGERS = (
    ("focus", "frustration_detected", None), ("high_contrast_focus", "consecutive_errors", 3), ("high_contrast_focus", "time_spent", 120),
    ("high_contrast_focus", "frustration_detected", None), ("simplified", "low_engagement", None), ("step_by_step", "struggling", None), ("gamified", "low_engagement", None),
)


def decide_mode(rows: DataFrame, current: str = "current_mode", min_confidence: float = 0.5) -> DataFrame:
    """Add ``mode``: the current one below the confidence; else intervention when it is urgent; else a
    known suggestion; else the first other mode with a trigger set off; else the current one."""
    now = F.col(current)
    spark = rows.sparkSession
    order = {m: i for i, m in enumerate(MODES)}
    rules = F.broadcast(spark.createDataFrame([(m, order[m], k, t) for m, k, t in TRIGGERS], "mode string, place int, kind string, threshold int"))
    set_off = (
        F.when(F.col("kind") == "frustration_detected", F.col("is_frustrated")).when(F.col("kind") == "struggling", F.col("is_struggling")).when(F.col("kind") == "low_engagement", ~F.col("is_engaged"))
        .when(F.col("kind") == "consecutive_errors", F.col("consecutive_errors") >= F.col("threshold")).when(F.col("kind") == "time_spent", F.col("time_on_task_seconds") >= F.col("threshold"))
    )
    hits = rows.select("user_id", current, "is_frustrated", "is_struggling", "is_engaged", "consecutive_errors", "time_on_task_seconds").join(rules, set_off & (F.col("mode") != now))
    first = hits.groupBy("user_id").agg(F.min_by("mode", "place").alias("triggered"))
    out = F.when(F.col("confidence") < min_confidence, now).when((F.col("urgency") == "intervention") & (now != "intervention"), "intervention")
    out = out.when((F.col("suggested_mode") != now) & F.col("suggested_mode").isin(*MODES), F.col("suggested_mode")).otherwise(F.coalesce("triggered", now))
    return rows.join(first, "user_id", "left").withColumn("mode", out).drop("triggered")


def mode_history(rows: DataFrame, last: int = 50) -> DataFrame:
    """Changes of mode per user in order of time, the newest ``last``."""
    w = by_time("user_id")
    moved = with_time(rows).withColumn("from_mode", F.lag("mode").over(w)).where("from_mode is not null and from_mode <> mode")
    return last_events(moved, last, "user_id").drop("rn")


def pauses(events: DataFrame, seconds: int = PAUSE_SECONDS) -> DataFrame:
    """Events after which the user was silent for longer, and whether they came back."""
    gap = (F.lead("us").over(by_time("user_id")) - F.col("us")) / 1e6
    rows = with_time(events).withColumn("gap_seconds", gap).where(F.col("gap_seconds").isNull() | (F.col("gap_seconds") > seconds))
    return rows.select("event_id", "user_id", "gap_seconds", F.when(F.col("gap_seconds").isNull(), "abandonment").otherwise("long_pause").alias("kind"))
