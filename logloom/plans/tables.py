"""The given tables, and log-shaped views that Spark derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.sessions import SessionRules

# events.event_type stands for the event name; error has no expected step
RULES = SessionRules(event_steps={"signup": 1, "view": 2, "click": 3, "purchase": 4})


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def auth_events(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as authentication events; one session per user and day."""
    kind, user = F.col("event_type"), F.col("user_id")
    is_error = kind == "error"
    step = (
        F.when(kind == "signup", 1)
        .when(kind == "view", 2)
        .when(kind == "click", 3)
        .when(kind == "purchase", 4)
        .otherwise(5)
    )
    group, host = F.floor(user / 250) % 256, user % 250 + 1
    net = (
        F.when(user % 4 == 0, F.concat(F.lit("10.0."), group, F.lit(".")))
        .when(user % 4 == 1, F.lit("203.0.113."))
        .when(user % 4 == 2, F.concat(F.lit("8.8."), group, F.lit(".")))
        .otherwise(F.lit("192.168.1."))
    )
    return table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(is_error, "ERROR").otherwise("INFO").alias("level"),
        F.concat(user, F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"),
        kind.alias("event"),
        (step + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)).cast("bigint").alias("step_id"),
        F.concat(F.lit("u"), user).alias("user_id"),
        F.when(is_error, "fail").otherwise("success").alias("status"),
        F.concat(
            F.when(is_error, F.lit("request failed: ")).otherwise(F.concat(kind, F.lit(" "))), "props"
        ).alias("message"),
        F.concat(net, host).alias("source_ip"),
        F.concat(F.lit("/api/"), kind).alias("target"),
        F.col("event_id").alias("line_number"),
    )


AUTH_SQL = """
ev AS (SELECT event_id AS line_number, ts,
  CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
  user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id,
  event_type AS event,
  (CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END
    + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS step_id,
  'u' || user_id AS user_id,
  CASE WHEN event_type = 'error' THEN 'fail' ELSE 'success' END AS status,
  CASE WHEN event_type = 'error' THEN 'request failed: ' ELSE event_type || ' ' END || props AS message,
  CASE user_id % 4 WHEN 0 THEN '10.0.' || ((user_id // 250) % 256) || '.' WHEN 1 THEN '203.0.113.'
    WHEN 2 THEN '8.8.' || ((user_id // 250) % 256) || '.' ELSE '192.168.1.' END || (user_id % 250 + 1) AS source_ip,
  CASE WHEN user_id % 4 = 2 THEN 0 ELSE 1 END AS internal,
  '/api/' || event_type AS target
  FROM events),
lagged AS (SELECT *,
  lag(ts) OVER w AS prev_ts, lag(step_id) OVER w AS prev_step, lag(event) OVER w AS prev_event
  FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY ts, step_id, line_number)),
feat0 AS (SELECT *,
  coalesce((epoch_us(ts) - epoch_us(prev_ts)) / 1000.0, 0.0) AS delta_ms,
  coalesce(step_id - prev_step, 1) AS step_gap,
  CASE event WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 END AS expected_step,
  regexp_matches(message, '(?i)(error|fail|invalid|denied|timeout)')::INT AS has_error_keyword,
  length(message) AS message_length
  FROM lagged),
feat AS (SELECT *,
  (step_gap > 1)::INT AS step_jump, (step_gap < 1)::INT AS step_reverse,
  (delta_ms = 0)::INT AS simultaneous_event,
  coalesce(step_id <> expected_step, false)::INT AS step_event_mismatch,
  (delta_ms < 10)::INT AS delta_too_fast, (delta_ms > 30000)::INT AS delta_too_slow,
  (message_length < 10 OR message_length > 200)::INT AS message_unusual_length
  FROM feat0)
"""

SESSION_SQL = AUTH_SQL + """,
sess AS (SELECT session_id, min(ts) AS tmin, max(ts) AS tmax, count(ts) AS n_events,
  min(step_id) AS step_id_min, max(step_id) AS step_id_max, count(DISTINCT step_id) AS step_id_nunique,
  round_even(sum(delta_ms), 3) AS delta_ms_sum, round_even(avg(delta_ms), 3) AS delta_ms_mean,
  round_even(stddev_samp(delta_ms), 3) AS delta_ms_std, round_even(max(delta_ms), 3) AS delta_ms_max,
  count(*) FILTER (WHERE status = 'fail') AS n_failures,
  count(*) FILTER (WHERE level = 'ERROR') AS n_errors,
  sum(step_jump)::BIGINT AS step_jump_sum, sum(step_reverse)::BIGINT AS step_reverse_sum,
  sum(step_event_mismatch)::BIGINT AS step_event_mismatch_sum,
  sum(delta_too_fast)::BIGINT AS delta_too_fast_sum, sum(delta_too_slow)::BIGINT AS delta_too_slow_sum,
  sum(simultaneous_event)::BIGINT AS simultaneous_event_sum,
  sum(has_error_keyword)::BIGINT AS has_error_keyword_sum,
  count(DISTINCT source_ip) AS source_ip_nunique, count(DISTINCT user_id) AS user_id_nunique,
  count(DISTINCT target) AS target_nunique,
  arg_min(user_id, (ts, step_id, line_number)) AS user_id_first,
  arg_min(target, (ts, step_id, line_number)) AS target_first,
  arg_max(status, (ts, step_id, line_number)) AS final_status,
  min(line_number) AS line_number_min, max(line_number) AS line_number_max,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0 AS duration_ms
  FROM feat GROUP BY session_id),
mom AS (SELECT
  stddev_samp(duration_ms) AS s1, avg(duration_ms) AS m1, stddev_pop(duration_ms) AS p1,
  stddev_samp(delta_ms_mean) AS s2, avg(delta_ms_mean) AS m2, stddev_pop(delta_ms_mean) AS p2,
  stddev_samp(n_events) AS s3, avg(n_events) AS m3, stddev_pop(n_events) AS p3,
  stddev_samp(step_jump_sum) AS s4, avg(step_jump_sum) AS m4, stddev_pop(step_jump_sum) AS p4,
  stddev_samp(n_failures) AS s5, avg(n_failures) AS m5, stddev_pop(n_failures) AS p5,
  stddev_samp(delta_ms_std) AS s6, avg(coalesce(delta_ms_std, 0)) AS m6,
  stddev_pop(coalesce(delta_ms_std, 0)) AS p6 FROM sess),
scored AS (SELECT sess.*, (final_status = 'success')::INT AS is_successful,
  hour(tmin) AS start_hour, isodow(tmin) - 1 AS start_dayofweek,
  (CASE WHEN s1 > 0 THEN abs((duration_ms - m1) / p1) ELSE 0 END
   + CASE WHEN s2 > 0 THEN abs((delta_ms_mean - m2) / p2) ELSE 0 END
   + CASE WHEN s3 > 0 THEN abs((n_events - m3) / p3) ELSE 0 END
   + CASE WHEN s4 > 0 THEN abs((step_jump_sum - m4) / p4) ELSE 0 END
   + CASE WHEN s5 > 0 THEN abs((n_failures - m5) / p5) ELSE 0 END
   + CASE WHEN s6 > 0 THEN abs((coalesce(delta_ms_std, 0) - m6) / p6) ELSE 0 END)
  / ((s1 > 0)::INT + (s2 > 0)::INT + (s3 > 0)::INT + (s4 > 0)::INT + (s5 > 0)::INT + (s6 > 0)::INT)
  AS anomaly_score_statistical,
  0.3 * (duration_ms > 300000)::DOUBLE + 0.4 * (n_failures > 3)::DOUBLE
  + 0.2 * (step_jump_sum > 0)::DOUBLE + 0.1 * (step_reverse_sum > 0)::DOUBLE AS anomaly_score_rules
  FROM sess, mom),
final AS (SELECT *, 0.6 * anomaly_score_statistical + 0.4 * anomaly_score_rules AS anomaly_score_final FROM scored)
"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines' summation orders compare equal."""
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def text_time(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps as text, to compare independent of zone types."""
    return df.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in columns}
    )


def sql_time(c: str) -> str:
    """The same text form in SQL."""
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"
