"""The registered queries over the test tables, each beside its DuckDB SQL where SQL can say it."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from learnmill.functions import scalar as X
from learnmill.operators import behavior as B
from learnmill.operators import classify as C
from learnmill.operators import graph as G
from learnmill.operators import grounding as K
from learnmill.operators import mastery as M
from learnmill.operators import merge as U
from learnmill.operators import privacy as P
from learnmill.operators import questions as Q
from learnmill.operators import codes, grams, quality, text, vectors
from learnmill.sources import io
from learnmill.streaming import streams as S

from . import fixtures as V
from .registry import ORACLES, QUERIES, query, rounded  # noqa: F401

def states(spark, d) -> DataFrame:
    return M.rule_states(V.learning_events(spark, d))


STATUS = "case when probability_mastery < 0.6 and total_attempts > 3 then 'STRUGGLING' when probability_mastery > 0.9 then 'MASTERED' else 'LEARNING' end"
ACTION = "case when probability_mastery < 0.6 and total_attempts > 3 then 'Provide remediation and scaffolding' when probability_mastery > 0.9 then 'Ready for next challenge' else 'Continue practice' end"
OVERVIEW = """select user_id, count(*) as total_skills, count(*) filter (probability_mastery > 0.9) as mastered_count, count(*) filter (probability_mastery >= 0.6 and probability_mastery <= 0.9) as learning_count,
  count(*) filter (probability_mastery < 0.6 and total_attempts > 3) as struggling_count, round(avg(probability_mastery), 9) as avg_mastery, max(last_attempt_us) as last_active_us from st group by user_id"""
CARDS = f"select *, case when struggling_count > 0 then 'STRUGGLING' when avg_mastery > 0.85 then 'MASTERED' else 'LEARNING' end as overall_status from ({OVERVIEW})"


# mastery ------------------------------------------------------------------------------------------


@query("select * from st")
def m4_rule_states(spark, d):
    return states(spark, d)


@query(OVERVIEW)
def a1_class_overview(spark, d):
    return rounded(M.class_overview(states(spark, d)), "avg_mastery")


@query(f"select user_id, skill_id, {STATUS} as status, {ACTION} as suggested_action, least(1.0::double, total_attempts / 10.0::double) as confidence from st")
def m5_status(spark, d):
    p, n = F.col("probability_mastery"), F.col("total_attempts")
    return states(spark, d).select("user_id", "skill_id", M.status(p, n).alias("status"), M.suggested_action(p, n).alias("suggested_action"), M.confidence(n).alias("confidence"))


@query("select user_id, skill_id, round(0.95 * probability_mastery + 0.2 * (1 - probability_mastery), 9)::double as prediction from st")
def m6_prediction(spark, d):
    return states(spark, d).select("user_id", "skill_id", F.round(M.predict(F.col("probability_mastery")), 9).alias("prediction"))


BAYES = """with recursive bt(user_id, skill_id, rn, event_id, us, is_correct, before, p, n, ok, r, w) as (
  select user_id, skill_id, rn, event_id, us, is_correct, 0.5::double, case when is_correct then 0.475 / (0.475 + 0.1) else 0.025 / (0.025 + 0.4) end::double, attempts::bigint, is_correct::bigint, is_correct::bigint, (not is_correct)::bigint from seq where rn = 1
  union all
  select user_id, skill_id, rn, event_id, us, is_correct, before,
    greatest(0.01::double, least(0.99::double, case when is_correct then 0.95::double * q / (0.95::double * q + 0.2::double * (1 - q)) else 0.05::double * q / (0.05::double * q + 0.8::double * (1 - q)) end)), n, ok, r, w
  from (select s.user_id, s.skill_id, s.rn, s.event_id, s.us, s.is_correct, b.p as before,
      greatest(0.01::double, least(0.99::double, case when (s.us - b.us) / 3.6e9 > 24 then b.p * (1 - least(0.2::double, ((s.us - b.us) / 3.6e9 - 24) / 168)) + 0.5 * least(0.2::double, ((s.us - b.us) / 3.6e9 - 24) / 168) else b.p end)) as q,
      b.n + s.attempts as n, b.ok + s.is_correct::bigint as ok, case when s.is_correct then b.r + 1 else 0 end as r, case when s.is_correct then 0 else b.w + 1 end as w
    from bt b join seq s on s.user_id = b.user_id and s.skill_id = b.skill_id and s.rn = b.rn + 1))"""


@query(BAYES + " select user_id, skill_id, event_id, is_correct, round(before, 6) as previous_mastery, round(p, 6) as new_mastery, n as total_attempts, ok as correct_attempts, r as consecutive_correct, w as consecutive_incorrect from bt")
def m3_bayes_trajectory(spark, d):
    rows = rounded(M.trajectory(V.learning_events(spark, d)), "previous_mastery", "new_mastery", places=6)
    return rows.drop("us", "hours_since")


@query(BAYES + " select user_id, skill_id, round(p, 6) as new_mastery, n as total_attempts from bt qualify row_number() over (partition by user_id, skill_id order by rn desc) = 1")
def w10_latest_states(spark, d):
    return rounded(M.latest_states(M.trajectory(V.learning_events(spark, d))), "new_mastery", places=6).select("user_id", "skill_id", "new_mastery", "total_attempts")


@query(BAYES + """ select event_id, user_id, skill_id, is_correct, round(before, 6) as previous_mastery, round(p, 6) as new_mastery,
  case when p < 0.6 and n > 3 then 'STRUGGLING' when p > 0.9 then 'MASTERED' else 'LEARNING' end as status, round(0.95 * p + 0.2 * (1 - p), 6) as prediction from bt""")
def m9_record_events(spark, d):
    return rounded(M.record_events(V.learning_events(spark, d)), "previous_mastery", "new_mastery", "prediction", places=6)


@query("""select user_id, skill_id, round(case when is_correct then 0.475 / 0.575 else 0.025 / 0.425 end, 9)::double as mastery from seq where rn = 1""")
def m1_first_update(spark, d):
    first = M.with_time(V.learning_events(spark, d)).withColumn("rn", F.row_number().over(M.by_time("user_id", "skill_id"))).where("rn = 1")
    return first.select("user_id", "skill_id", F.round(M.bayes(F.lit(0.5), F.col("is_correct")), 9).alias("mastery"))


@query("""select user_id, skill_id, round(case when h > 24 then probability_mastery * (1 - f) + 0.5 * f else probability_mastery end, 9) as mastery
  from (select *, least(0.2::double, (h - 24) / 168) as f from (select *, (1706745600000000 - last_attempt_us) / 3.6e9 as h from st))""")
def m2_reset(spark, d):
    hours = (F.lit(1706745600000000) - F.col("last_attempt_us")) / 3.6e9
    return states(spark, d).select("user_id", "skill_id", F.round(M.reset(F.col("probability_mastery"), hours), 9).alias("mastery"))


@query("""select st.user_id, st.skill_id, skill_name, subject, grade_level, probability_mastery, total_attempts, consecutive_incorrect, last_attempt_us
  from st join skills using (skill_id) where probability_mastery < 0.6 and total_attempts > 3 and consecutive_incorrect >= 2""")
def m7_intervention_list(spark, d):
    return M.intervention_list(states(spark, d), V.skills(spark, d))


@query(f"select user_id, skill_id, skill_name, probability_mastery, total_attempts, correct_attempts, {STATUS} as status, {ACTION} as suggested_action, least(1.0::double, total_attempts / 10.0::double) as confidence, last_attempt_us from st join skills using (skill_id)")
def m8_student_report(spark, d):
    return M.student_report(states(spark, d), V.skills(spark, d))


@query("""select skill_id, skill_name, subject, grade_level, count(distinct user_id) as total_students, count(distinct user_id) filter (probability_mastery > 0.9) as mastered_count,
  count(distinct user_id) filter (probability_mastery < 0.6 and total_attempts > 3) as struggling_count, round(avg(probability_mastery), 9) as avg_mastery, round(avg(total_attempts), 9) as avg_attempts
  from skills left join st using (skill_id) group by all""")
def a2_skill_summary(spark, d):
    return rounded(M.skill_summary(V.skills(spark, d), states(spark, d)), "avg_mastery", "avg_attempts")


@query(f"select user_id, count(*) filter (s = 'MASTERED') as mastered, count(*) filter (s = 'LEARNING') as learning, count(*) filter (s = 'STRUGGLING') as struggling from (select user_id, {STATUS} as s from st) group by user_id")
def a3_student_rollup(spark, d):
    return M.student_rollup(states(spark, d))


@query(CARDS)
def a4_overall_status(spark, d):
    return rounded(M.overall_status(M.class_overview(states(spark, d))), "avg_mastery")


TOTALS = f"select count(*) as total_students, round(avg(avg_mastery), 3) as class_mean, count(*) filter (overall_status = 'MASTERED') as ready, count(*) filter (overall_status = 'LEARNING') as distracted, count(*) filter (overall_status = 'STRUGGLING') as intervention from ({CARDS})"


@query(TOTALS)
def a5_class_totals(spark, d):
    return M.class_totals(M.class_mastery(states(spark, d)))


@query(f"select s as status, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 9)::double as percent from (select {STATUS} as s from st) group by s")
def a6_status_shares(spark, d):
    return rounded(M.status_shares(states(spark, d)), "percent")


@query(f"select * from ({CARDS}) where struggling_count > 0 and avg_mastery >= 0.55")
def f10_class_cards(spark, d):
    return rounded(M.class_mastery(states(spark, d), True, 0.55), "avg_mastery")


@query(f"select * from ({CARDS}) where overall_status = 'STRUGGLING'")
def f11_card_filter(spark, d):
    return rounded(M.filter_cards(M.class_mastery(states(spark, d)), "intervention"), "avg_mastery")


@query("select user_id, skill_id, probability_mastery < 0.6 and total_attempts > 3 and consecutive_incorrect >= 2 as needs from st")
def f12_needs_intervention(spark, d):
    return states(spark, d).select("user_id", "skill_id", M.needs_intervention(F.col("probability_mastery"), F.col("total_attempts"), F.col("consecutive_incorrect")).alias("needs"))


@query("select skill_id, skill_name, subject, grade_level from skills where subject = 'biology' and grade_level = 6")
def f6_list_skills(spark, d):
    return Q.where_equal(V.skills(spark, d), subject="biology", grade_level=6)


@query("select st.user_id, skill_id, skill_name, probability_mastery from st join skills using (skill_id)")
def j1_states_with_skills(spark, d):
    return states(spark, d).join(F.broadcast(V.skills(spark, d)), "skill_id").select("user_id", "skill_id", "skill_name", "probability_mastery")


@query("select skill_id, user_id from skills left join st using (skill_id)")
def j2_skills_with_students(spark, d):
    return V.skills(spark, d).join(states(spark, d), "skill_id", "left").select("skill_id", "user_id")


@query("select user_id, skill_id, last_attempt_us, rank::int as rank from (select *, row_number() over (order by last_attempt_us desc, user_id, skill_id) as rank from st) where rank <= 50")
def l2_latest_attempts(spark, d):
    top = states(spark, d).orderBy(F.desc("last_attempt_us"), "user_id", "skill_id").limit(50)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("last_attempt_us"), "user_id", "skill_id"))).select("user_id", "skill_id", "last_attempt_us", "rank")


@query("select event_id, user_id, rn::int as rn from (select *, row_number() over (partition by user_id order by us desc, event_id desc) as rn from le) where rn <= 10")
def w1_last_events(spark, d):
    return M.last_events(V.learning_events(spark, d), 10, "user_id").select("event_id", "user_id", "rn")


@query("""select user_id, count(*) filter (c is null or us > c) as consecutive_errors from (select *, max(us) filter (is_correct) over (partition by user_id) as c from le) group by user_id""")
def w2_error_streaks(spark, d):
    return M.error_streaks(V.learning_events(spark, d))


STREAK = """select event_id, seq.user_id, seq.skill_id, is_correct, r::int as consecutive_correct, w::int as consecutive_incorrect, n as total_attempts, ok as correct_attempts,
  round((seq.us - lag(seq.us) over (partition by seq.user_id, seq.skill_id order by seq.us, event_id)) / 3.6e9, 6) as hours_since from seq join fold f on f.user_id = seq.user_id and f.skill_id = seq.skill_id and f.rn = seq.rn"""


@query(STREAK)
def w3_w4_w5_running(spark, d):
    return rounded(M.running_streaks(V.learning_events(spark, d)), "hours_since", places=6)


@query("select event_id, user_id, us from le order by us desc, event_id desc limit 20")
def w11_live_feed(spark, d):
    return M.last_events(V.learning_events(spark, d), 20).select("event_id", "user_id", "us")


@query("select event_id, user_id, skill_id, is_correct from le where user_id <> 3")
def s21_reset_student_events(spark, d):
    return M.reset_student(V.learning_events(spark, d), states(spark, d), 3)[0].select("event_id", "user_id", "skill_id", "is_correct")


@query("select user_id, skill_id, case when user_id = 3 then 0.5 else probability_mastery end as probability_mastery, case when user_id = 3 then 0 else total_attempts end as total_attempts from st")
def s21_reset_student_states(spark, d):
    return M.reset_student(V.learning_events(spark, d), states(spark, d), 3)[1].select("user_id", "skill_id", "probability_mastery", "total_attempts")


SESSIONS = "select event_id as session_id, user_id, us, case when event_id % 5 <> 0 then lead(us) over (partition by user_id order by us, event_id) end as end_us, event_type from (select *, epoch_us(ts) as us from events)"


@query(f"select session_id, user_id, round((1706745600000000 - us) / 6e7, 6) as minutes from ({SESSIONS}) where event_type = 'signup' and end_us is null")
def f8_active_sessions(spark, d):
    rows = M.with_time(V.table(spark, d, "events").withColumnRenamed("ts", "timestamp"))
    rows = rows.withColumn("end_us", F.when(F.col("event_id") % 5 != 0, F.lead("us").over(M.by_time("user_id")))).where("event_type = 'signup' and end_us is null")
    return rows.select(F.col("event_id").alias("session_id"), "user_id", F.round(X.minutes_between("timestamp", F.lit(1706745600000000)), 6).alias("minutes"))


@query("select event_id, user_id from le where user_id = 3")
def f9_own_rows(spark, d):
    return P.apply_policy(V.learning_events(spark, d), "learning_events", "student", 3).select("event_id", "user_id")


@query("select user_id, skill_id from st where false")
def f9_denied(spark, d):
    return P.apply_policy(states(spark, d), "student_skills", "guest").select("user_id", "skill_id")


# behaviour ----------------------------------------------------------------------------------------

LAST = "select *, row_number() over (partition by user_id order by us desc, event_id desc) as rn from le"


def reasons(*cases: str) -> str:
    return f"list_filter([{', '.join(cases)}]::varchar[], lambda x: x is not null)"


FRUSTRATION = f"""select user_id, s >= 0.5 as is_frustrated, round(least(s, 1.0), 6) as frustration_confidence, frustration_reasons from (
  select user_id, (case when streak >= 3 then 0.5 else 0 end + case when rapid >= 3 then 0.3 else 0 end + case when long > 0 then 0.3 else 0 end)::double as s,
    {reasons("case when streak >= 3 then streak || ' consecutive errors detected' end", "case when rapid >= 3 then rapid || ' rapid failures (<10s each)' end", "case when long > 0 then long || ' long struggles (>2min)' end")} as frustration_reasons from (
    select user_id, coalesce(min(rn) filter (is_correct) - 1, count(*)) as streak, count(*) filter (not is_correct and rn <= 5 and time_spent_seconds < 10) as rapid, count(*) filter (not is_correct and time_spent_seconds > 120) as long
    from ({LAST}) where rn <= 10 group by user_id))"""
STRUGGLING = f"""select user_id, s >= 0.5 as is_struggling, round(least(s, 1.0), 6) as struggling_confidence, struggling_reasons, t from (
  select a.user_id, t, (case when errors >= 3 then 0.4 else 0 end + case when t > 120 then 0.5 else 0 end + case when loop is not null then 0.3 else 0 end)::double as s,
    {reasons("case when errors >= 3 then errors || '/5 recent attempts incorrect' end", "case when t > 120 then 'Long time on task: ' || t || 's' end", "'Retry loop on ' || loop || ' attempts'")} as struggling_reasons from
    (select user_id, count(*) filter (not is_correct) as errors, max(time_spent_seconds) filter (rn = 1) as t from ({LAST}) where rn <= 5 group by user_id) a join
    (select user_id, max(skill_id || ': ' || n) filter (n >= 3) as loop from (select user_id, skill_id, count(*) as n from ({LAST}) where rn <= 5 group by all) group by user_id) b on a.user_id = b.user_id)"""


@query(FRUSTRATION)
def b1_frustration(spark, d):
    return rounded(B.frustration(V.learning_events(spark, d)), "frustration_confidence", places=6)


RATES = "select user_id, count(*) as clicks, case when max(us) > min(us) then count(*) / ((max(us) - min(us)) / 1e6) * 60 end as per_minute, count(distinct element_id) as elements, max(us) as last_click_us from clicks group by user_id"


def engaged(rows: str, low: float, high: float) -> str:
    """Engagement of ``rows`` (user_id, per_minute, elements, t)."""
    good, calm, wild = f"coalesce(per_minute between {low} and {high}, false)", "t between 30 and 600", "coalesce(per_minute > 50, false)"
    why = reasons(
        f"case when {wild} then printf('Very high click rate: %.1f/min (indicates frustration)', per_minute) when {good} then printf('Healthy click rate: %.1f/min', per_minute) end",
        f"case when {wild} then null when {calm} then 'Good time on task: ' || t || 's' when t > 600 then 'Long time on task: ' || t || 's (may indicate struggle)' end",
        f"case when not {wild} and coalesce(elements >= 3, false) then 'Diverse interactions: ' || elements || ' different elements' end",
    )
    return f"""select user_id, not wild and s >= 0.4 as is_engaged, round(greatest(0, least(s, 1)), 6)::double as engagement_confidence, engagement_reasons from (
      select user_id, {wild} as wild, case when {wild} then 0 else case when {good} then 0.3 else 0 end + case when {calm} then 0.4 when t > 600 then -0.2 else 0 end + case when coalesce(elements >= 3, false) then 0.3 else 0 end end::double as s,
        {why} as engagement_reasons from ({rows}))"""


@query(engaged(f"select *, 60 as t from ({RATES})", 0.0005, 0.003))
def b2_engagement(spark, d):
    rates = B.click_rates(V.clicks(spark, d)).withColumn("time_on_task", F.lit(60))
    return rounded(B.engagement(rates, 0.0005, 0.003, 50.0), "engagement_confidence", places=6)


@query(f"select * exclude (t), t as time_on_task from ({STRUGGLING})")
def b3_struggling(spark, d):
    return rounded(B.struggling(V.learning_events(spark, d)), "struggling_confidence", places=6)


@query("""select event_id, user_id, round(least(1.0, 0.7 + 0.3 * (1 - span / 400000.0)), 6)::double as confidence from (
  select event_id, user_id, (us - lag(us, 4) over (partition by user_id order by us, event_id)) / 1e6 as span from clicks) where span <= 400000""")
def b4_w6_rapid_clicks(spark, d):
    return rounded(B.rapid_clicks(V.clicks(spark, d), 5, 400000.0).select("event_id", "user_id", "confidence"), "confidence", places=6)


@query("select event_id, user_id, count(*) over (partition by user_id order by us range between 86400000000 preceding and current row) as recent_clicks from clicks")
def w7_trailing_clicks(spark, d):
    return B.trailing_clicks(V.clicks(spark, d), 86400)


@query(f"select user_id, clicks, round(per_minute, 9) as per_minute, elements, last_click_us from ({RATES})")
def w8_click_rates(spark, d):
    return rounded(B.click_rates(V.clicks(spark, d)), "per_minute")


@query("select user_id, count(distinct element_id) as elements from clicks group by user_id")
def a20_distinct_elements(spark, d):
    return B.distinct_elements(V.clicks(spark, d))


@query(f"select user_id, skill_id, count(*) as attempts from ({LAST}) where rn <= 5 group by all")
def a19_retry_counts(spark, d):
    return B.retry_counts(V.learning_events(spark, d))


SIGNALS = f"""select user_id, is_frustrated, is_engaged, is_struggling, is_rapid_clicking, e as consecutive_errors, t as time_on_task_seconds, ago as last_activity_seconds_ago,
  case when high then 'intervention' when is_struggling then 'attention' else 'none' end as urgency, confidence,
  list_concat(reasoning, [case when high then 'High frustration + ' || e || ' errors' when is_struggling then 'User struggling (time: ' || t || 's)' when is_rapid_clicking then 'Rapid clicking detected'
    when is_engaged then 'User engaged, maintaining standard mode' else 'Default mode selection' end]) as reasoning,
  case when high then 'high_contrast_focus' when is_struggling or is_rapid_clicking then 'focus' else 'standard' end as suggested_mode
  from (select user_id, coalesce(is_frustrated, false) as is_frustrated, coalesce(is_engaged, false) as is_engaged, coalesce(is_struggling, false) as is_struggling, coalesce(rapid, false) as is_rapid_clicking, coalesce(e, 0) as e, coalesce(t, 0)::bigint as t,
      coalesce(((1706745600000000 - last_click_us) // 1000000)::bigint, 0) as ago, coalesce(is_frustrated, false) and coalesce(e, 0) >= 3 as high,
      greatest(coalesce(frustration_confidence, 0), coalesce(struggling_confidence, 0), coalesce(engagement_confidence, 0))::double as confidence,
      list_concat(list_concat(coalesce(frustration_reasons, []::varchar[]), coalesce(engagement_reasons, []::varchar[])), coalesce(struggling_reasons, []::varchar[])) as reasoning
    from ({FRUSTRATION}) full join ({STRUGGLING}) using (user_id) full join (select user_id, count(*) filter (c is null or us > c) as e from (select *, max(us) filter (is_correct) over (partition by user_id) as c from le) group by user_id) using (user_id)
      full join ({RATES}) using (user_id)
      left join ({engaged(f"select user_id, per_minute, elements, coalesce(t, 0) as t from ({STRUGGLING}) full join ({RATES}) using (user_id)", 5, 30)}) using (user_id)
      left join (select user_id, count(*) = 5 and max(us) - min(us) <= 2000000 as rapid from (select *, row_number() over (partition by user_id order by us desc, event_id desc) as rn from clicks) where rn <= 5 group by user_id) using (user_id))"""


@query(SIGNALS)
def b5_b6_signals(spark, d):
    return rounded(B.signals(V.learning_events(spark, d), V.clicks(spark, d), 1706745600000000), "confidence", places=6)


@query(f"""select user_id, 'standard' as current_mode, suggested_mode, urgency, confidence, case when confidence < 0.5 then 'standard' when urgency = 'intervention' then 'intervention' when suggested_mode <> 'standard' then suggested_mode
  when is_frustrated then 'focus' when consecutive_errors >= 3 or time_on_task_seconds >= 120 or is_frustrated then 'high_contrast_focus' when not is_engaged then 'simplified' when is_struggling then 'step_by_step' else 'standard' end as mode from ({SIGNALS})""")
def b7_decide_mode(spark, d):
    rows = B.signals(V.learning_events(spark, d), V.clicks(spark, d), 1706745600000000).withColumn("current_mode", F.lit("standard"))
    return rounded(B.decide_mode(rows).select("user_id", "current_mode", "suggested_mode", "urgency", "confidence", "mode"), "confidence", places=6)


@query("""select event_id, user_id, m as mode, p as from_mode from (select *, lag(m) over (partition by user_id order by us, event_id) as p from (
  select *, case event_type when 'error' then 'focus' when 'purchase' then 'gamified' else 'standard' end as m, epoch_us(ts) as us from events)) where p is not null and p <> m
  qualify row_number() over (partition by user_id order by us desc, event_id desc) <= 50""")
def b8_mode_history(spark, d):
    mode = F.when(F.col("event_type") == "error", "focus").when(F.col("event_type") == "purchase", "gamified").otherwise("standard")
    rows = V.table(spark, d, "events").withColumnRenamed("ts", "timestamp").withColumn("mode", mode)
    return B.mode_history(rows).select("event_id", "user_id", "mode", "from_mode")


UPTO = "us <= 1705000000000000"
B9 = SIGNALS.replace("from le", f"from (select * from le where {UPTO} qualify row_number() over (partition by user_id order by us desc, event_id desc) <= 20)").replace(
    "from clicks", f"from (select * from clicks where {UPTO} qualify row_number() over (partition by user_id order by us desc, event_id desc) <= 50)"
).replace("1706745600000000", "1705000000000000")


@query(B9)
def b9_behavioral_status(spark, d):
    return rounded(B.behavioral_status(V.learning_events(spark, d), V.clicks(spark, d), 1705000000000000), "confidence", places=6)


@query("""select event_id, user_id, round(g, 6) as gap_seconds, case when g is null then 'abandonment' else 'long_pause' end as kind from (
  select *, (lead(us) over (partition by user_id order by us, event_id) - us) / 1e6 as g from le) where g is null or g > 300""")
def b10_pauses(spark, d):
    return rounded(B.pauses(V.learning_events(spark, d)), "gap_seconds", places=6)


@query("""select event_id, case when attempts % 3 = 0 then ['attempts'] else [] end as reasons from (select event_id, attempts from le) where attempts % 3 = 0""")
def b11_rejected_events(spark, d):
    rows = V.learning_events(spark, d).withColumn("attempts", F.when(F.col("attempts") % 3 == 0, 0).otherwise(F.col("attempts")))
    return quality.split_by_rules(rows, quality.event_rules())[1].select("event_id", "reasons")


# questions ----------------------------------------------------------------------------------------


@query("select question_id, source, subject from questions where subject = 'Biology' and difficulty = 'easy'")
def f1_f3_question_filters(spark, d):
    return Q.where_equal(V.questions(spark, d), subject="Biology", difficulty="easy", topic=None).select("question_id", "source", "subject")


@query("select question_id, source, difficulty from q0 where question_id = 12 and source = 'sciq'")
def f2_question_by_id(spark, d):
    return Q.lookup(V.questions(spark, d), question_id=12, source="sciq").select("question_id", "source", "difficulty")


@query("select question_id from q0 where contains(lower(question_text), 'tion') order by question_id limit 20")
def f4_search_questions(spark, d):
    return Q.search(V.questions(spark, d), "Tion", ["question_text"], 20).select("question_id")


@query("select question_id from q0 where contains(lower(question_text), 'ations') order by question_id limit 20")
def f4_search_by_trigrams(spark, d):
    """The same search over posting lists of all texts."""
    rows, path = V.questions(spark, d), f"{G.shared_root(spark)}/grams-{uuid.uuid4().hex}"
    grams.write_grams(rows, path, "question_id", ["question_text"])
    return grams.search_grams(rows, path, "question_id", "Ations", ["question_text"], 20).select("question_id")


@query("select node_id, label from nodes where domain = 'Brand#23' and contains(lower(label), '1') order by node_id limit 5")
def f5_search_concepts(spark, d):
    return Q.search(G.nodes_in_domain(V.nodes(spark, d), "Brand#23"), "1", ["label"], 5, "node_id").select("node_id", "label")


@query("select chunk_id, book_id from chunks where book_id = 'src10' and grade_level = 8")
def f7_chunk_filters(spark, d):
    return Q.where_equal(V.chunks(spark, d), book_id="src10", grade_level=8).select("chunk_id", "book_id")


@query("select node_id, label from nodes where domain = 'Brand#12'")
def f13_nodes_by_domain(spark, d):
    return G.nodes_in_domain(V.nodes(spark, d), "Brand#12").select("node_id", "label")


@query("select vec_id, label from embeddings where embedding is not null")
def f15_vector_present(spark, d):
    return V.table(spark, d, "embeddings").where(F.col("embedding").isNotNull()).select("vec_id", "label")


@query("select source, subject, count(*) as total, count(*) filter (difficulty = 'easy') as easy, count(*) filter (difficulty = 'medium') as medium, count(*) filter (difficulty = 'hard') as hard from questions group by all")
def a7_question_statistics(spark, d):
    return Q.statistics(V.questions(spark, d))


@query("""select 'total' as kind, 'all' as value, count(*) as n from questions union all select 'subject', subject, count(*) from questions group by subject
  union all select 'difficulty', difficulty, count(*) from questions group by difficulty union all select 'topics', 'all', count(distinct topic) from questions""")
def a8_bank_statistics(spark, d):
    return Q.bank_statistics(V.questions(spark, d))


@query("select distinct topic from questions where topic is not null and subject = 'Biology' union select topic from questions where topic is not null and subject = 'Chemistry'")
def a9_topics(spark, d):
    return Q.topics(V.questions(spark, d), "Biology", "Chemistry")


@query("select subject, question_id from (select *, row_number() over (partition by subject order by question_id) as rn from questions) where rn <= 3")
def l4_category_quota(spark, d):
    return Q.category_quota(V.questions(spark, d), 10, "subject", "question_id", 3).select("subject", "question_id")


@query()
def l3_random_questions(spark, d):
    return Q.random_questions(V.questions(spark, d), 10, 7, difficulty="easy").select("question_id", "source", "difficulty")


@query("select question_id, subject, topic from questions")
def c6_c7_subject_topic(spark, d):
    return V.questions(spark, d).select("question_id", "subject", "topic")


@query("select question_id, source from questions where source = 'sciq' union all select question_id, source from questions where source <> 'sciq'")
def d_a_union_sources(spark, d):
    q = V.questions(spark, d).select("question_id", "source")
    return io.union_sources(*[q.where(F.col("source") == s) for s in ("sciq", "science_bowl", "opentdb")])


@query("select user_id, skill_id, event_id from seq where rn = 1")
def d_b_first_per_key(spark, d):
    rows = M.with_time(V.learning_events(spark, d))
    return rows.groupBy("user_id", "skill_id").agg(F.min_by("event_id", F.struct("us", "event_id")).alias("event_id"))


@query("select min(event_id) as event_id, user_id, skill_id, event_type from (select *, 1 from le join (select event_id, event_type from events) using (event_id)) group by user_id, skill_id, event_type")
def d_c_distinct_triples(spark, d):
    rows = V.learning_events(spark, d).drop("event_type").join(V.table(spark, d, "events").select("event_id", "event_type"), "event_id")
    return rows.groupBy("user_id", "skill_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("select node_id, array_agg(distinct chunk_id order by chunk_id) as chunk_ids from links group by node_id")
def d_d_distinct_chunks(spark, d):
    return V.links(spark, d).groupBy("node_id").agg(F.array_sort(F.array_distinct(F.collect_list("chunk_id"))).alias("chunk_ids"))


@query("select question_id, question_id % 2 = 1 as added from q0 where question_id % 3 = 0")
def d_e_add_questions(spark, d):
    q = V.questions(spark, d)
    return Q.add_questions(q.where("question_id % 2 = 0"), q.where("question_id % 3 = 0"))[1]


@query("""select coalesce(a.question_id, b.question_id) as question_id, coalesce(a.source, b.source) as source, coalesce(b.question_text, a.question_text) as question_text, coalesce(a.difficulty, b.difficulty) as difficulty, case when b.question_id is not null then 1 else 0 end as updated_at
  from (select *, 'x' as unused from q0 where question_id % 2 = 0) a full join (select question_id, source, reverse(question_text) as question_text, 'new' as difficulty from q0 where question_id % 3 = 0) b on a.question_id = b.question_id and a.source = b.source""")
def s13_upsert_questions(spark, d):
    q = V.questions(spark, d).select("question_id", "source", "question_text", "difficulty")
    old = q.where("question_id % 2 = 0").withColumn("updated_at", F.lit(0))
    new = q.where("question_id % 3 = 0").withColumns({"question_text": F.reverse("question_text"), "difficulty": F.lit("new")})
    return U.upsert_questions(old, new, F.lit(1))


@query("""select coalesce(a.source_id, b.source_id) as source_id, coalesce(a.target_id, b.target_id) as target_id, coalesce(a.t, b.t) as relationship_type, coalesce(b.strength, a.strength) as strength
  from (select start_node_id as source_id, end_node_id as target_id, edge_label as t, 0.8::double as strength from edges where start_node_id % 2 = 0) a
  full join (select start_node_id as source_id, end_node_id as target_id, edge_label as t, 0.5::double as strength from edges where end_node_id % 2 = 0) b on a.source_id = b.source_id and a.target_id = b.target_id and a.t = b.t""")
def s14_upsert_relationships(spark, d):
    e = V.edges(spark, d).select(F.col("start_node_id").alias("source_id"), F.col("end_node_id").alias("target_id"), F.col("edge_label").alias("relationship_type"))
    return U.upsert_relationships(e.where("source_id % 2 = 0").withColumn("strength", F.lit(0.8)), e.where("target_id % 2 = 0").withColumn("strength", F.lit(0.5)))


@query("select chunk_id, book_id, case when chunk_id % 5 = 0 then -1 else grade_level end as word_count from chunks")
def s15_upsert_chunks(spark, d):
    c = V.chunks(spark, d).select("chunk_id", "book_id", F.col("grade_level").alias("word_count"))
    return U.upsert_chunks(c, c.where("chunk_id % 5 = 0").withColumns({"word_count": F.lit(-1).cast("long"), "book_id": F.lit("other")}))


@query("select node_id, label from nodes")
def s16_insert_or_ignore(spark, d):
    n = V.nodes(spark, d).select("node_id", "label")
    return U.insert_or_ignore(n.where("node_id % 2 = 0"), n.withColumn("label", F.when(F.col("node_id") % 2 == 0, "other").otherwise(F.col("label"))), ["node_id"])


# vectors ------------------------------------------------------------------------------------------

COS = "list_cosine_similarity(embedding::double[], query::double[])"


def first_query(spark, d) -> list[float]:
    return list(V.query_vectors(spark, d).where("query_id = 0").first()["query"])


@query(f"select chunk_id, round({COS}, 6) as similarity from vectored, (select query from qv where query_id = 0) where grade_level = 6 and {COS} >= 0.2 order by {COS} desc, chunk_id limit 10")
def v1_search_chunks(spark, d):
    return vectors.search_chunks(V.vectored(spark, d), first_query(spark, d), grade_level=6, threshold=0.2).select("chunk_id", F.round("similarity", 6).alias("similarity"))


@query(f"select question_id, round({COS}, 6) as similarity from (select q0.*, embedding from q0 join embeddings on vec_id = question_id), (select query from qv where query_id = 0) where difficulty = 'medium' and {COS} >= 0.2 order by {COS} desc, question_id limit 10")
def v2_search_questions(spark, d):
    q = V.questions(spark, d).join(V.table(spark, d, "embeddings"), F.col("question_id") == F.col("vec_id"))
    return vectors.search_questions(q, first_query(spark, d), difficulty="medium", threshold=0.2).select("question_id", F.round("similarity", 6).alias("similarity"))


@query(f"select chunk_id, round({COS}, 6) as similarity from vectored, (select query from qv where query_id = 0) order by {COS} desc, chunk_id limit 5")
def v3_hybrid_profile(spark, d):
    return vectors.retrieve(V.vectored(spark, d), first_query(spark, d), "hybrid").select("chunk_id", F.round("similarity", 6).alias("similarity"))


@query(f"select chunk_id, round({COS}, 6) as similarity from vectored, (select query from qv where query_id = 0) where book_id = 'src3' order by {COS} desc, chunk_id limit 5")
def v4_search_book(spark, d):
    return vectors.search_book(V.vectored(spark, d), first_query(spark, d), "src3").select("chunk_id", F.round("similarity", 6).alias("similarity"))


@query(f"select chunk_id, round({COS}, 6) as similarity from vectored, (select query from qv where query_id = 0) where {COS} > 0.25 order by {COS} desc, chunk_id limit 5")
def v5_search_strict(spark, d):
    return vectors.search_strict(V.vectored(spark, d), first_query(spark, d), threshold=0.25).select("chunk_id", F.round("similarity", 6).alias("similarity"))


MANY = f"select query_id, vec_id as key, round(s, 6) as similarity, (row_number() over (partition by query_id order by s desc, vec_id))::int as rank from (select query_id, vec_id, {COS} as s from embeddings, qv) qualify rank <= 5"


@query(MANY)
def v6_w12_many_queries(spark, d):
    return rounded(vectors.many_top_k(V.table(spark, d, "embeddings"), V.query_vectors(spark, d), 5), "similarity", places=6)


@query(MANY)
def j8_broadcast_queries(spark, d):
    return rounded(vectors.joined_top_k(V.table(spark, d, "embeddings"), V.query_vectors(spark, d), 5), "similarity", places=6)


@query(f"select query_id, count(*) as n, round(avg(similarity), 5) as avg_score from ({MANY}) group by query_id")
def a15_context_summary(spark, d):
    return rounded(vectors.context_summary(vectors.many_top_k(V.table(spark, d, "embeddings"), V.query_vectors(spark, d), 5)), "avg_score", places=5)


@query()
def v7_cells(spark, d):
    cells, model = vectors.build_cells(V.table(spark, d, "embeddings"), 16)
    return vectors.probe_cells(cells, model, V.query_vectors(spark, d), 5, 12)


@query()
def v7_codes(spark, d):
    """The five nearest rows of each query by product-quantised codes; a test holds them to those of an exact search."""
    e, path = V.table(spark, d, "embeddings"), f"{G.shared_root(spark)}/codes-{uuid.uuid4().hex}"
    books = codes.fit_books(e)
    codes.write_codes(e, path, books)
    return codes.search_codes(spark, path, books, V.query_vectors(spark, d), 5, 50)


@query("select vec_id, case when vec_id % 2 = 0 then 0.0 else round(list_cosine_similarity(embedding::double[], list_reverse(embedding::double[])), 6) end::double as similarity from embeddings")
def v8_zero_vector(spark, d):
    e = V.table(spark, d, "embeddings")
    other = F.when(F.col("vec_id") % 2 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.reverse("embedding"))
    return e.select("vec_id", F.round(X.cosine("embedding", other), 6).alias("similarity"))


@query()
def v10_embed(spark, d):
    return vectors.embed(V.table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))).select("doc_id", "embedding")


@query("select vec_id, len(embedding)::int as n, round(list_sum(embedding::double[]), 6) as total, round(embedding[1]::double, 6) as first from embeddings")
def v11_vector_text(spark, d):
    back = V.table(spark, d, "embeddings").select("vec_id", X.text_vector(X.vector_text("embedding")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return back.select("vec_id", F.size("v").alias("n"), F.round(total, 6).alias("total"), F.round(F.col("v")[0].cast("double"), 6).alias("first"))


@query("select vec_id, round(list_dot_product(embedding::double[], embedding::double[]), 6) as squared from embeddings")
def x19_dot(spark, d):
    return V.table(spark, d, "embeddings").select("vec_id", F.round(X.dot("embedding", "embedding"), 6).alias("squared"))


# graph --------------------------------------------------------------------------------------------


@query("select start_node_id, a.label as start_label, end_node_id, b.label as end_label, edge_label from edges join nodes a on a.node_id = start_node_id join nodes b on b.node_id = end_node_id where a.label = 'part_3' or b.label = 'part_3'")
def j4_edges_of_label(spark, d):
    return G.labelled_edges(V.nodes(spark, d), V.edges(spark, d)).where("start_label = 'part_3' or end_label = 'part_3'").select("start_node_id", "start_label", "end_node_id", "end_label", "edge_label")


@query("select node_id, edge_id from nodes left join edges on node_id = start_node_id or node_id = end_node_id")
def j5_incident_edges(spark, d):
    ends = V.edges(spark, d).select("edge_id", F.explode(F.array("start_node_id", "end_node_id")).alias("node_id"))
    return V.nodes(spark, d).join(ends, "node_id", "left").select("node_id", "edge_id")


CROSS = "select distinct a.label as start_label, a.domain as start_domain, edge_label, b.label as end_label, b.domain as end_domain from edges join nodes a on a.node_id = start_node_id join nodes b on b.node_id = end_node_id where a.domain <> b.domain"


@query(CROSS)
def j6_g18_cross_domain(spark, d):
    return G.cross_domain(V.nodes(spark, d), V.edges(spark, d))


@query("""select b.label as related_concept, edge_label as relationship_type, 'outgoing' as direction from edges join nodes a on a.node_id = start_node_id join nodes b on b.node_id = end_node_id where a.label = 'part_6'
  union all select a.label, edge_label, 'incoming' from edges join nodes a on a.node_id = start_node_id join nodes b on b.node_id = end_node_id where b.label = 'part_6'""")
def g2_concept_context(spark, d):
    return G.concept_context(V.nodes(spark, d), V.edges(spark, d), "part_6")


@query("""select * from (select b.label as related_concept, edge_label as relationship_type from edges join nodes a on a.node_id = start_node_id join nodes b on b.node_id = end_node_id where a.label = 'part_6'
  union all select a.label, edge_label from edges join nodes a on a.node_id = start_node_id join nodes b on b.node_id = end_node_id where b.label = 'part_6') order by 1, 2 limit 20""")
def g3_relationships(spark, d):
    return G.relationships(V.nodes(spark, d), V.edges(spark, d), "part_6")


#: The queries of the searches are the nodes whose id is divisible by 50.
REACH = """with recursive seeds as (select distinct start_node_id as seed from edges where start_node_id % 50 = 0), hop(seed, node, depth) as (
  select seed, seed, 0 from seeds union select seed, {to}, depth + 1 from hop join edges on node = {via} where depth < {most})"""


def seeds(spark, d, edges=None) -> DataFrame:
    return (V.edges(spark, d) if edges is None else edges).where("start_node_id % 50 = 0").select(F.col("start_node_id").alias("seed")).distinct()


@query(REACH.format(to="start_node_id", via="end_node_id", most=3) + " select seed, node, min(depth)::int as depth from hop where node <> seed group by all")
def g4_prerequisites(spark, d):
    return G.prerequisites(V.edges(spark, d), seeds(spark, d), 3)


@query(REACH.format(to="end_node_id", via="start_node_id", most=2) + " select seed, node, min(depth)::int as depth, round(1.0 / (1 + min(depth)), 9)::double as score from hop where node <> seed group by all")
def g5_related(spark, d):
    return rounded(G.related(V.edges(spark, d), seeds(spark, d), 2), "score")


def pairs(spark, d, edges=None) -> DataFrame:
    """One goal for each start: the node that follows it."""
    return seeds(spark, d, edges).select(F.col("seed").alias("a"), (F.col("seed") + 1).alias("b"))


#: Hops of the shortest path of each pair; the paths themselves are tested by a plain search. No two nodes lie 64 hops apart.
HOPS = """with recursive seeds as (select distinct start_node_id as seed from edges where start_node_id % 50 = 0), ways as ({ways}), hop(seed, node, depth) as (
  select seed, seed, 0 from seeds union select seed, t, depth + 1 from hop join ways on node = f where depth < {most} and node <> seed + 1)
  select seed as a, seed + 1 as b, min(depth)::int as hops from hop where node = seed + 1 group by seed"""


@query(HOPS.format(ways="select start_node_id as f, end_node_id as t from edges", most=64))
def g6_learning_paths(spark, d):
    edges = G.pinned(V.edges(spark, d).select("start_node_id", "end_node_id"))  # read for the pairs and for the steps
    return G.learning_paths(edges, pairs(spark, d, edges)).select("a", "b", (F.size("path") - 1).alias("hops"))


@query(HOPS.format(ways="select start_node_id as f, end_node_id as t from edges union select end_node_id, start_node_id from edges", most=5))
def g7_undirected_paths(spark, d):
    return G.undirected_paths(V.nodes(spark, d), V.edges(spark, d), pairs(spark, d)).select("a", "b", (F.size("path") - 1).alias("hops"))


@query("""with recursive known as (select distinct start_node_id % 5 as learner, start_node_id as node from edges), e as (select distinct start_node_id as s, end_node_id as t from edges)
  select distinct learner, t as node from known join e on node = s where not exists (select 1 from e e2 where e2.t = e.t and not exists (select 1 from known k where k.learner = known.learner and k.node = e2.s))
    and not exists (select 1 from known k where k.learner = known.learner and k.node = e.t)""")
def g8_j13_knowledge_gaps(spark, d):
    known = V.edges(spark, d).select((F.col("start_node_id") % 5).alias("learner"), F.col("start_node_id").alias("node")).distinct()
    return G.knowledge_gaps(V.edges(spark, d), known)


@query("""with recursive far(a, b) as (select node_id, node_id from nodes union select a, end_node_id from far join edges on b = start_node_id),
  near(a, b) as (select min(node_id), min(node_id) from nodes union select a, case when b = start_node_id then end_node_id else start_node_id end from near join edges on b = start_node_id or b = end_node_id)
  select (select count(*) from nodes) as nodes, (select count(*) from edges) as relationships, round((select count(distinct (start_node_id, end_node_id)) from edges) / ((select count(*) from nodes) * ((select count(*) from nodes) - 1.0)), 12)::double as density,
    (select count(*) from near) = (select count(*) from nodes) as weakly_connected, (select count(distinct c) from (select x.a, min(x.b) as c from far x join far y on x.a = y.b and x.b = y.a group by x.a)) as strong_components""")
def g12_statistics(spark, d):
    return rounded(G.statistics(V.nodes(spark, d), V.edges(spark, d)), "density", places=12)


@query("select 'parts' as graph_name, (select count(distinct node_id) from nodes) as node_count, (select count(distinct edge_id) from edges) as edge_count, (select count(distinct label) from nodes) as label_count")
def a11_graph_counts(spark, d):
    return G.graph_counts(V.nodes(spark, d), V.edges(spark, d))


@query("select domain, count(distinct node_id) as concept_count, count(distinct edge_id) as relationship_count, list_sort(list(distinct label)) as sample_concepts from nodes left join edges on node_id = start_node_id or node_id = end_node_id group by domain")
def a12_domain_statistics(spark, d):
    return G.domain_statistics(V.nodes(spark, d), V.edges(spark, d))


@query("""select c.chunk_id, count(n.node_id) as n_concepts, coalesce(round(sum(relevance) filter (n.node_id is not null), 6), 0) as relevance, coalesce(string_agg(label, ',' order by n.node_id), '') as labels
  from chunks c left join links l on c.chunk_id = l.chunk_id left join nodes n on n.node_id = l.node_id group by c.chunk_id""")
def j3_a10_a22_chunk_concepts(spark, d):
    got = G.chunk_concepts(V.chunks(spark, d), V.links(spark, d), V.nodes(spark, d))
    total = F.aggregate("related_concepts", F.lit(0.0), lambda s, x: s + x["relevance"])
    return got.select("chunk_id", F.size("related_concepts").cast("long").alias("n_concepts"), F.round(total, 6).alias("relevance"), F.array_join(F.transform("related_concepts", lambda x: x["label"]), ",").alias("labels"))


@query("""select a.node_id as i, b.node_id as j, count(*) as n from links a join links b on a.chunk_id = b.chunk_id and a.node_id < b.node_id group by all""")
def j7_pairs_in_chunk(spark, d):
    a, b = V.links(spark, d).select("chunk_id", F.col("node_id").alias("i")), V.links(spark, d).select("chunk_id", F.col("node_id").alias("j"))
    return a.join(b, "chunk_id").where("i < j").groupBy("i", "j").agg(F.count("*").alias("n"))


@query("select doc_id from documents join embeddings on doc_id = vec_id")
def j9_chunks_with_vectors(spark, d):
    return V.table(spark, d, "documents").join(V.table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id")).select("doc_id")


WORDS = r"list_filter(string_split_regex(lower(message), '[^\p{L}\p{N}_]+'), lambda w: w <> '')"


@query(rf"""select distinct message_id, w as concept from (select message_id, unnest({WORDS}) as w from messages) where w in ('the', 'that', 'erth', 'tion')""")
def j10_concepts_in_text(spark, d):
    names = spark.createDataFrame([("the",), ("That",), ("erth",), ("tion",)], "label string")
    return G.concepts_in_text(V.messages(spark, d), names).select("message_id", F.lower("concept").alias("concept"))


@query("select chunk_id from chunks where chunk_id % 7 = 0")
def j11_not_yet_processed(spark, d):
    return V.chunks(spark, d).join(V.links(spark, d).select("chunk_id").distinct(), "chunk_id", "left_anti").select("chunk_id")


@query("select edge_id from edges where start_node_id % 2 = 0 and end_node_id % 2 = 0")
def j12_valid_relationships(spark, d):
    new = V.edges(spark, d).select("edge_id", F.col("start_node_id").alias("source_id"), F.col("end_node_id").alias("target_id"), F.col("edge_label").alias("relationship_type"))
    return G.add_relationships(V.nodes(spark, d).where("node_id % 2 = 0"), new, "node_id")[0].select("edge_id")


@query("select distinct end_node_id as node_id from edges where end_node_id not in (select start_node_id from edges)")
def j14_exclusion(spark, d):
    e = V.edges(spark, d)
    return e.select(F.col("end_node_id").alias("node_id")).distinct().join(e.select(F.col("start_node_id").alias("node_id")).distinct(), "node_id", "left_anti")


@query("""select start_node_id, a.label as start_label, (row_number() over (order by start_node_id % 6, start_node_id))::int as place from edges join nodes a on a.node_id = start_node_id where end_node_id = 5 and edge_label = 'PREREQUISITE'""")
def l5_prerequisites_by_grade(spark, d):
    grade = F.to_json(F.struct((F.col("node_id") % 6).alias("grade_level"), G.domain().alias("domain")))
    got = G.prerequisites_by_grade(V.nodes(spark, d).withColumn("properties", grade), V.edges(spark, d), "part_5")
    return got.select("start_node_id", "start_label", F.row_number().over(Window.orderBy("grade_level", "start_node_id")).alias("place"))


def concept_chunks(spark, d) -> DataFrame:
    """Chunks with the terms of their whole content as concepts, and a definition of the first in every third."""
    rows = V.chunks(spark, d).withColumn("k", text.capital_terms("content"))
    first = F.create_map(F.get("k", F.lit(0)), F.concat(F.lit("of "), F.col("chunk_id").cast("string")))
    return rows.select("book_id", "chunk_id", F.col("chunk_id").alias("seq"), F.col("k").alias("key_concepts"), F.when((F.col("chunk_id") % 3 == 0) & (F.size("k") > 0), first).alias("definitions"))


#: Terms of a text, in SQL.
CAPITALS = r"""list_sort(list_distinct(list_filter(flatten(list_transform(string_split_regex({text}, '[.!?]'), lambda s: (list_filter(string_split_regex(s, '\s+'), lambda w: w <> ''))[2:])),
  lambda w: regexp_matches(w, '^\p{{Lu}}') and length(w) > 3 and (ends_with(w, 's') or (upper(w) = w and lower(w) <> w) or contains(w, '_')))))"""
EACH = f"""each_concept as (select book_id, chunk_id, pos, name, book_id || '_' || replace(lower(name), ' ', '_') as id, def, first from (
    select book_id, chunk_id, pos, trim(replace(raw, chr(10), ' ')) as name, case when chunk_id % 3 = 0 then 'of ' || chunk_id end as def, raw = k[1] as first from (
      select *, k[pos] as raw from (select *, unnest(range(1, len(k) + 1)) as pos from (select book_id, chunk_id, {CAPITALS.format(text="content")} as k from chunks)))) where length(name) >= 3)"""


@query("with " + EACH + " select id as concept_id, book_id, arg_min(name, (chunk_id, pos)) as name, arg_min(def, (chunk_id, pos)) filter (first and def is not null) as definition, list_sort(list(distinct chunk_id)) as chunk_ids from each_concept group by id, book_id")
def g9_w13_concepts_from_chunks(spark, d):
    return G.concepts_from_chunks(concept_chunks(spark, d))


@query("with " + EACH + """ select a.id as source_id, b.id as target_id, 'RELATED_TO' as relationship_type, 0.8::double as strength, arg_min(a.chunk_id, (a.chunk_id, a.pos, b.pos)) as chunk_id
  from each_concept a join each_concept b on a.chunk_id = b.chunk_id and a.pos < b.pos and a.id <> b.id group by a.id, b.id""")
def g10_cooccurrences(spark, d):
    return G.cooccurrences(concept_chunks(spark, d))


# text ---------------------------------------------------------------------------------------------


@query("select doc_id, len(p)::bigint as n, coalesce(list_sum(list_transform(p, lambda x: length(x))), 0)::bigint as chars from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as p from documents)")
def t8_paragraphs(spark, d):
    p = text.paragraphs("text", "\n")
    rows = V.table(spark, d, "documents").select("doc_id", p.alias("p"))
    return rows.select("doc_id", F.size("p").cast("long").alias("n"), F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("chars"))


CHUNKING = r"""with recursive para as (
  select doc_id, row_number() over (partition by doc_id order by i) as i, n from (select doc_id, i, len(list_filter(string_split_regex(p, '\s+'), lambda w: w <> '')) as n
    from (select doc_id, unnest(string_split(text, chr(10))) as p, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)) where n > 0),
  walk(doc_id, i, chunk, first, words) as (select doc_id, i, 1, i, n from para where i = 1 union all
  select w.doc_id, p.i, case when full_ then chunk + 1 else chunk end, case when full_ then case when p.i - first > 2 then p.i - 2 else p.i end else first end,
    case when full_ then (case when p.i - first > 2 then p1 + p2 else 0 end) + p.n else words + p.n end
  from (select w.*, w.words + p.n > 800 as full_, p.i as pi, p.n as pn, p1, p2 from walk w join (select *, lag(n, 1, 0) over (partition by doc_id order by i) as p1, lag(n, 2, 0) over (partition by doc_id order by i) as p2 from para) p on p.doc_id = w.doc_id and p.i = w.i + 1) w
  join para p on p.doc_id = w.doc_id and p.i = w.pi)
  select doc_id, chunk as chunk_number, max(words)::int as word_count from walk group by all"""


@query(CHUNKING)
def t9_chunks(spark, d):
    return text.chunk_documents(V.table(spark, d, "documents"), separator="\n").select("doc_id", "chunk_number", "word_count")


@query(r"""select doc_id, case when regexp_matches(t, '^(.+) is (?:defined as|a|an) ') or regexp_matches(t, '^definition:?\s*(.+)') or regexp_matches(t, '^(.+) - (?:defined as|means?) ') then 'definition'
  when regexp_matches(t, '^for example|^for instance|^example|^(e\.g\.|eg)') then 'example' when regexp_matches(t, '^(summary|key terms|review|chapter review)') then 'summary' else 'narrative' end as content_type
  from (select doc_id, lower(trim(text)) as t from documents)""")
def t12_content_type(spark, d):
    return V.table(spark, d, "documents").select("doc_id", text.content_type("text").alias("content_type"))


@query(r"""select doc_id, coalesce(len(list_filter(string_split_regex(trim(text), '\s+'), lambda w: w <> '')), 0)::int as word_count, length(text)::int as char_count, left(source, 100) as title from documents""")
def t15_x2_chunk_metadata(spark, d):
    return V.table(spark, d, "documents").select("doc_id", *text.chunk_metadata("text", "source")).select("doc_id", "word_count", "char_count", "title")


@query("""select source || '-' || (doc_id // 100) as chapter_id, string_agg(coalesce(text, ''), chr(10) || chr(10) order by doc_id) as text from documents group by all""")
def t5_chapter_texts(spark, d):
    """A chapter is a block of a hundred pages of a source, so that no source, however large, is one row."""
    block = F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 100).cast("string"))
    pages = V.table(spark, d, "documents").select(F.lit("b").alias("book_id"), block.alias("chapter_id"), F.col("doc_id").alias("page_number"), "text")
    return text.chapter_texts(pages).select("chapter_id", "text")


@query(f"select doc_id, {CAPITALS.format(text='text')} as terms from documents")
def t14_capital_terms(spark, d):
    return V.table(spark, d, "documents").select("doc_id", text.capital_terms("text").alias("terms"))


@query()
def t16_pipeline(spark, d):
    docs = V.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chapter_id"), F.col("source").alias("title"), "text")
    none = spark.createDataFrame([], "chapter_id string, section_number int, title string, content string")
    tables = spark.createDataFrame([], "chapter_id string, table_number int, title string, content string")
    return text.process_chapters(docs, none, tables)[0].select("chunk_id", "chapter_id", "chunk_number", "content_type", "word_count", "char_count", "key_concepts", "embedding")


@query("""select count(*) as chunks, count(*) filter (k = 'definition') as definition, count(*) filter (k = 'example') as example, count(*) filter (k = 'summary') as summary, count(*) filter (k = 'narrative') as narrative, count(distinct book_id) as books, round(avg(length(content)), 1) as mean_words
  from (select *, case grade_level when 6 then 'definition' when 7 then 'example' when 8 then 'summary' else 'narrative' end as k from chunks)""")
def a13_chunk_statistics(spark, d):
    kind = F.when(F.col("grade_level") == 6, "definition").when(F.col("grade_level") == 7, "example").when(F.col("grade_level") == 8, "summary").otherwise("narrative")
    return io.chunk_statistics(V.chunks(spark, d).withColumn("content_type", kind), F.length("content"))


@query("select 'documents' as table_name, (select count(*) from documents) as n union all select 'embeddings', (select count(*) from embeddings) union all select 'part', (select count(*) from part)")
def a16_content_totals(spark, d):
    return io.content_totals(**{t: V.table(spark, d, t) for t in ("documents", "embeddings", "part")})


# scalar functions ---------------------------------------------------------------------------------


@query(r"""select doc_id, source || '_' || replace(replace(lower(trim(text)), chr(10), ' '), ' ', '_') as slug_raw, case when length(text) > 100 then left(text, 100) || '...' else text end as short,
  (regexp_extract(lower(source || '-chapter' || (doc_id % 10)), 'chapter(\d+)', 1))::int as chapter from documents""")
def x4_x6_x7_strings(spark, d):
    return V.table(spark, d, "documents").select("doc_id", X.concept_id("source", "text").alias("slug_raw"), X.truncate("text", 100).alias("short"), X.chapter_number(F.concat("source", F.lit("-chapter"), (F.col("doc_id") % 10).cast("string"))).alias("chapter"))


@query(r"""select doc_id, left(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\s-]', '', 'g'), '\s+', '_', 'g'), 50) as title, case when contains(book, 'government') then 'government' when contains(book, 'biology') then 'biology' when contains(book, 'math') then 'mathematics' else 'general' end as subject,
  regexp_extract(text, '([a-z]+)', 1) as first_word, starts_with(text, 'The') as the, coalesce(nullif(lang, 'en'), 'none') as lang_or_none, case when doc_id % 2 = 0 then 'x' || doc_id end as looked_up
  from (select *, case doc_id % 4 when 0 then 'american-government-3e' when 1 then 'biology-2e' when 2 then 'mathematics-1e' else 'art' end as book from documents)""")
def x1_x3_x5_x8_x18_x20_strings(spark, d):
    i = F.col("doc_id")
    book = F.when(i % 4 == 0, "american-government-3e").when(i % 4 == 1, "Biology-2e").when(i % 4 == 2, "mathematics-1e").otherwise("art")
    terms = F.map_from_entries(F.array(F.struct(F.lit(0).alias("k"), F.concat(F.lit("x"), i.cast("string")).alias("v"))))
    return V.table(spark, d, "documents").select(
        "doc_id", X.safe_title("text").alias("title"), X.book_subject(book).alias("subject"), F.regexp_extract("text", "([a-z]+)", 1).alias("first_word"), F.startswith("text", F.lit("The")).alias("the"),
        F.coalesce(F.when(F.col("lang") != "en", F.col("lang")), F.lit("none")).alias("lang_or_none"), F.element_at(terms, (i % 2).cast("int")).alias("looked_up"),
    )


@query("select event_id, greatest(50.0, least(200.0, value))::double as clamped, regexp_extract(props, '([0-9]+)', 1) as k, lower(trim(event_type)) = 'click' as same from events")
def x12_x13_x14_values(spark, d):
    return V.table(spark, d, "events").select("event_id", X.clamp(F.col("value"), 50.0, 200.0).alias("clamped"), F.get_json_object("props", "$.k").alias("k"), X.same_answer("event_type", F.lit(" Click ")).alias("same"))


@query("select doc_id, len(w)::int as n, list_contains(w, 'the') as has_the, array_to_string(w[1:3], ' ') as first3, len(list_distinct(w))::int as distinct_n from (select doc_id, string_split(lower(text), ' ') as w from documents)")
def x16_x17_arrays(spark, d):
    w = F.split(F.lower("text"), " ")
    return V.table(spark, d, "documents").select("doc_id", F.size(w).alias("n"), F.array_contains(w, "the").alias("has_the"), F.array_join(F.slice(w, 1, 3), " ").alias("first3"), F.size(F.array_distinct(w)).alias("distinct_n"))


# privacy ------------------------------------------------------------------------------------------


#: Digits, spaces and word characters outside ASCII, as (?U) has them in Java.
_DIGITS, _SPACES = r"[^\x00-\x7F\P{Nd}]", r"[\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_LETTERS = r"[^\x00-\x7F\PL]|[^_\P{Pc}]|[\pM\p{Nl}\x{200C}\x{200D}\x{24B6}-\x{24E9}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}]"


def pattern_sql() -> str:
    """DuckDB's patterns know the digits, spaces and words of ASCII only. So the letters of ASCII are made capitals, in text
    and patterns, and every other digit is written d, every other word character w, every other space as a space.
    The four characters that fold to a letter of ASCII become that letter where a pattern has no case."""
    small, large = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = f"translate(text, '{small}', '{large}')"
    for of, sign in ((_SPACES, " "), (_DIGITS, "d"), (_LETTERS, "w")):
        plain = f"regexp_replace({plain}, '{of}', '{sign}', 'g')"
    folded = plain.replace("text", f"translate(text, '\u017f\u212a\u0131\u0130', 'SKII')")
    parts = []
    for kind, _, _, patterns in P.RULES:
        counts = []
        for p in patterns:
            capitals = re.sub(r"\\.|[a-z]", lambda m: m[0] if m[0][0] == "\\" else m[0].upper(), p.removeprefix("(?i)"))
            capitals = capitals.replace(r"\d", "[0-9d]").replace("'", "''")
            counts.append(f"len(regexp_extract_all({'folded' if p.startswith('(?i)') else 'plain'}, '{capitals}'))")
        parts.append(f"coalesce({' + '.join(counts)}, 0)::bigint as {kind}")
    return f"select doc_id, {', '.join(parts)} from (select doc_id, {plain} as plain, {folded} as folded from documents)"


@query(pattern_sql())
def a21_pattern_counts(spark, d):
    return P.pattern_counts(V.table(spark, d, "documents"), "doc_id")


@query()
def p5_anonymise(spark, d):
    return P.anonymise(V.table(spark, d, "documents").select("doc_id", "text"))


@query("select message_id, 'user-' || left(sha256('salt' || user_id), 16) as masked from messages")
def p7_masked_user(spark, d):
    return V.messages(spark, d).select("message_id", P.masked_user("user_id", "salt").alias("masked"))


@query("select event_id, case when event_id % 2 = 0 then case when length(u) > 8 then left(u, 8) || '...' else '***' end else u end as masked from (select event_id, 'student-uuid-' || user_id as u from events)")
def p8_masked_student(spark, d):
    role = F.when(F.col("event_id") % 2 == 0, "researcher").otherwise("teacher")
    return V.table(spark, d, "events").select("event_id", P.masked_student(F.concat(F.lit("student-uuid-"), F.col("user_id").cast("string")), role).alias("masked"))


@query()
def p9_report(spark, d):
    return P.pii_report(V.table(spark, d, "documents").select("doc_id", F.col("text").alias("line")))[0]


@query()
def p10_gate(spark, d):
    return P.privacy_gate(P.anonymise(V.table(spark, d, "documents").select("doc_id", "text")))[0].select("doc_id", "pii_count")


# classifiers --------------------------------------------------------------------------------------

_P, _N = V.votes("lower(message)", C.POSITIVE), V.votes("lower(message)", C.NEGATIVE)


@query(f"select message_id, round(case when {_P} > {_N} then least(0.8, 0.3 + {_P} * 0.1) when {_N} > {_P} then greatest(-0.8, -0.3 - {_N} * 0.1) else 0 end, 6)::double as score, case when {_P} > {_N} then 'positive' when {_N} > {_P} then 'negative' else 'neutral' end as label from messages")
def c1_sentiment(spark, d):
    return V.messages(spark, d).select("message_id", F.round(C.sentiment_score("message"), 6).alias("score"), C.sentiment_label("message").alias("label"))


_WC = r"len(list_filter(string_split_regex(message, '\s+'), lambda w: w <> ''))"
_REASON = f"""coalesce({V.ladder("lower(message)", [(p, f"hybrid_pattern: {p}") for p in C.HYBRID], "null")}, {V.ladder("lower(message)", [(p, f"fact_pattern: {n}") for p, n in C.FACT], "null")},
  {V.ladder("lower(message)", [(p, f"concept_pattern: {n}") for p, n in C.CONCEPT], "null")}, case when contains(message, ',') or {_WC} > 50 then 'complex_query' when {_WC} > 15 then 'long_query' else 'short_query' end)"""


@query(f"select message_id, r as reason, case when r like 'hybrid%' or r = 'complex_query' then 'hybrid' when r like 'concept%' or r = 'long_query' then 'concept' else 'fact' end as kind from (select message_id, {_REASON} as r from messages)")
def c2_route(spark, d):
    return V.messages(spark, d).select("message_id", C.routing_reason("message").alias("reason"), C.retrieval_type("message").alias("kind"))


@query(f"""select message_id, coalesce({V.ladder("lower(message)", [(C.CONCEPTUAL, "concept"), (C.FACTUAL, "fact")], "null")}, case when starts_with(lower(message), 'what') then 'fact' when {_WC} > 10 then 'concept' else 'fact' end) as class from messages""")
def c3_query_class(spark, d):
    return V.messages(spark, d).select("message_id", C.query_class("message").alias("class"))


@query(f"""select message_id, round(least(1, case when {_WC} > 100 then 0.3 when {_WC} > 50 then 0.2 when {_WC} > 20 then 0.1 else 0 end + case when contains(message, '?') and contains(lower(message), 'why') then 0.15 else 0 end + case when contains(message, '?') and contains(lower(message), 'how') then 0.15 else 0 end
  + case when contains(lower(message), 'compare') or contains(lower(message), 'contrast') then 0.2 else 0 end + case when contains(lower(message), 'explain') then 0.1 else 0 end + case when len(regexp_extract_all(message, '[?]')) > 1 then 0.2 else 0 end
  + case when {V.contains_any("lower(message)", C.COMPLEX)} then 0.05 else 0 end), 6)::double as complexity from messages""")
def c4_complexity(spark, d):
    return V.messages(spark, d).select("message_id", F.round(C.complexity("message"), 6).alias("complexity"))


@query()
def c5_routing_decision(spark, d):
    rows = V.messages(spark, d).withColumn("e", P.entities("message"))
    pii, safe = F.size("e") > 0, ~F.exists("e", lambda x: x["confidence"] >= P.SAFE_BELOW)
    return rows.select("message_id", C.routing_decision("message", F.lit("classification"), pii, safe).alias("decision")).select("message_id", "decision.*")


@query(f"select message_id, case when {_WC} > 50 then 'focus' else 'standard' end as mode from messages")
def c10_suggested_mode(spark, d):
    return V.messages(spark, d).select("message_id", C.suggested_mode("message").alias("mode"))


_STOP = ", ".join(f"'{w}'" for w in C.STOP)


@query(rf"select message_id, array_to_string((list_filter(string_split_regex(lower(trim(message)), '\s+'), lambda w: length(w) > 3 and w not in ({_STOP})))[1:5], ' ') as terms from messages")
def c11_query_terms(spark, d):
    return V.messages(spark, d).select("message_id", F.array_join(C.query_terms("message"), " ").alias("terms"))


@query(r"""select message_id, (regexp_matches(message, '(?i)\b(is|are|was|were)\b')::int + regexp_matches(message, '(?i)\b(according to|research shows|studies indicate)\b')::int + regexp_matches(message, '(?i)\b(causes|leads to|results in)\b')::int + regexp_matches(message, '(?i)\b(important|significant|critical)\b')::int) as claims from messages""")
def q2_claims(spark, d):
    return V.messages(spark, d).select("message_id", K.claim_count("message").alias("claims"))


def asked_messages(spark, d) -> DataFrame:
    """User messages, each with a vector of the embeddings that its conversation and turn choose."""
    e, m = V.table(spark, d, "embeddings"), F.col("message_id")
    at = (F.floor(m / 1000) * 31 + m % 1000 * 7) % e.count()
    return V.messages(spark, d).withColumn("at", at).join(e.select(F.col("vec_id").alias("at"), F.col("embedding").alias("query")), "at").drop("at")


@query()
def q9_answers(spark, d):
    return K.answer_messages(asked_messages(spark, d), V.vectored(spark, d), V.nodes(spark, d), V.edges(spark, d), thresholds=(("fact", 0.2), ("concept", 0.2)))


@query()
def q10_grounding_report(spark, d):
    return K.grounding_report(q9_answers(spark, d))


# searches from vectors into the graph --------------------------------------------------------------


def linked_chunks(spark, d) -> DataFrame:
    """Chunks with the labels of their linked nodes as concepts."""
    rows = V.links(spark, d).join(V.nodes(spark, d).select("node_id", "label"), "node_id")
    return rows.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "label"))), lambda x: x["label"]).alias("key_concepts"))


def few_hits(spark, d, k: int) -> DataFrame:
    return vectors.many_top_k(V.table(spark, d, "embeddings"), V.query_vectors(spark, d), k)


@query()
def q5_locked_answers(spark, d):
    return K.lock(q9_answers(spark, d))[0].select("message_id", "response", "citations", "disclaimer")


# streams ------------------------------------------------------------------------------------------


def event_stream(spark, d) -> DataFrame:
    """The events table read as a stream, as answers."""
    rows = spark.readStream.schema(V.table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    return rows.select("event_id", "user_id", "event_type", F.concat(F.lit("skill_"), (k % 8).cast("string")).alias("skill_id"), (~F.col("event_type").isin("error", "signup")).alias("is_correct"), (F.col("event_id") % 3 + 1).alias("attempts"), F.col("ts").cast("timestamp").alias("timestamp"))


@query(BAYES + " select user_id::varchar as user_id, skill_id, event_id, is_correct, round(p, 6) as probability_mastery, n as total_attempts, ok as correct_attempts, r as consecutive_correct, w as consecutive_incorrect from bt")
def r1_mastery_stream(spark, d):
    return rounded(S.run_to_table(S.mastery_stream(event_stream(spark, d)), "moves"), "probability_mastery", places=6).drop("us")


@query("select * from (select user_id, (us // 3600000000)::bigint as hour, count(*) as clicks from clicks group by all) where (hour + 1) * 3600000 <= (select max(us) // 1000 - 60000 from clicks)")
def r6_clicks_by_window(spark, d):
    """The windows that the watermark, a minute behind the last click, has closed."""
    rows = S.clicks_per_minute(event_stream(spark, d).where("event_type = 'click'"), "1 hour", delay="1 minute")
    return S.run_to_table(rows, "rates").select("user_id", F.floor(F.unix_timestamp("start") / 3600).cast("long").alias("hour"), "clicks")


@query("""select user_id::varchar as user_id, event_id, round(least(1.0, 0.7 + 0.3 * (1 - span / 400000.0)), 6)::double as confidence from (
  select event_id, user_id, (us - lag(us, 4) over (partition by user_id order by us, event_id)) / 1e6 as span from clicks) where span <= 400000""")
def r7_rapid_click_stream(spark, d):
    return rounded(S.run_to_table(S.rapid_click_alerts(event_stream(spark, d).where("event_type = 'click'"), 5, 400000.0), "alerts"), "confidence", places=6).select("user_id", "event_id", "confidence")


@query()
def r8_masking_stream(spark, d):
    rows = spark.readStream.schema(V.table(spark, d, "conversations").schema).parquet(f"{d}/conversation[s].parquet")
    return S.run_to_table(S.masked(rows.select("conv_id", "turn", F.col("text").alias("message"))), "masked")


from . import coverage  # noqa: E402,F401  (registers its queries)
