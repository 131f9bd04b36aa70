"""Registered queries of the session pipeline, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import sessions as S
from logloom.operators import summaries as A
from logloom.plans.tables import AUTH_SQL, RULES, SESSION_SQL, auth_events, rounded, sql_time, text_time
from logloom.session import durable

QUERIES = {}
ORACLE = {}


def query(sql: str | None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def stepped(spark: SparkSession, sf: str) -> DataFrame:
    return S.step_features(auth_events(spark, sf), RULES)


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    return S.session_table(stepped(spark, sf))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return S.score_sessions(sessions(spark, sf), RULES)


_EVENT_OUT = (
    "line_number", "session_id", "delta_ms", "prev_step", "step_increment_normal", "step_gap",
    "step_jump", "step_reverse", "simultaneous_event", "expected_step", "step_event_mismatch",
    "delta_too_fast", "delta_too_slow", "has_error_keyword", "message_length",
    "message_unusual_length",
)


@query(
    f"WITH {AUTH_SQL} SELECT line_number, session_id, round(delta_ms, 6) AS delta_ms, prev_step,"
    " CASE WHEN prev_step IS NULL THEN 1 ELSE (step_id = prev_step + 1)::INT END::TINYINT AS step_increment_normal,"
    " step_gap, step_jump::TINYINT AS step_jump, step_reverse::TINYINT AS step_reverse,"
    " simultaneous_event::TINYINT AS simultaneous_event, expected_step::BIGINT AS expected_step,"
    " step_event_mismatch::TINYINT AS step_event_mismatch, delta_too_fast::TINYINT AS delta_too_fast,"
    " delta_too_slow::TINYINT AS delta_too_slow, has_error_keyword::TINYINT AS has_error_keyword,"
    " message_length, message_unusual_length::TINYINT AS message_unusual_length FROM feat"
)
def event_step_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stepped(spark, sf).select(*_EVENT_OUT))


@query(
    f"WITH {AUTH_SQL} SELECT line_number, epoch_us(ts) // 1000 AS ts_epoch_ms, hour(ts)::BIGINT AS ts_hour,"
    " minute(ts)::BIGINT AS ts_minute, second(ts)::BIGINT AS ts_second, (epoch_us(ts) // 1000) % 1000 AS ts_millisecond,"
    " (isodow(ts) - 1)::BIGINT AS ts_dayofweek, (isodow(ts) >= 6)::TINYINT AS ts_is_weekend,"
    " (hour(ts) BETWEEN 9 AND 17)::TINYINT AS ts_is_business_hours FROM ev"
)
def event_time_features(spark: SparkSession, sf: str) -> DataFrame:
    df = S.time_features(auth_events(spark, sf))
    return df.select("line_number", *[c for c in df.columns if c.startswith("ts_")])


@query(
    f"WITH {AUTH_SQL}, parts AS (SELECT *, string_split(source_ip, '.') AS p FROM ev)"
    " SELECT line_number, p[1]::BIGINT * 16777216 + p[2]::BIGINT * 65536 + p[3]::BIGINT * 256 + p[4]::BIGINT"
    " AS source_ip_int, internal::TINYINT AS source_ip_is_internal FROM parts"
)
def event_ip_features(spark: SparkSession, sf: str) -> DataFrame:
    return S.ip_features(auth_events(spark, sf)).select(
        "line_number", "source_ip_int", "source_ip_is_internal"
    )


@query(
    f"""WITH {AUTH_SQL},
    us AS (SELECT user_id, count(DISTINCT session_id) AS k, count(*) AS n FROM ev GROUP BY 1),
    ips AS (SELECT source_ip, count(DISTINCT session_id) AS k, count(*) AS n FROM ev GROUP BY 1)
    SELECT line_number, (us.k > 1)::TINYINT AS user_multi_session, us.n AS user_id_freq,
    (ips.k > 1)::TINYINT AS ip_multi_session, ips.n AS source_ip_freq
    FROM ev JOIN us USING (user_id) JOIN ips USING (source_ip)"""
)
def event_multi_session(spark: SparkSession, sf: str) -> DataFrame:
    base = auth_events(spark, sf).select("line_number", "user_id", "source_ip", "session_id")
    df = S.multi_session(base, base, "user_id", "user_multi_session", "user_id_freq")
    df = S.multi_session(df, base, "source_ip", "ip_multi_session", "source_ip_freq")
    return df.select(
        "line_number", "user_multi_session", "user_id_freq", "ip_multi_session", "source_ip_freq"
    )


@query(
    f"""WITH {AUTH_SQL},
    m AS (SELECT message, count(*) AS n FROM ev GROUP BY 1), e AS (SELECT event, count(*) AS n FROM ev GROUP BY 1),
    s AS (SELECT status, count(*) AS n FROM ev GROUP BY 1), t AS (SELECT target, count(*) AS n FROM ev GROUP BY 1)
    SELECT line_number, m.n AS message_freq, e.n AS event_freq, s.n AS status_freq, t.n AS target_freq,
    CASE WHEN m.n < 20 THEN 'RARE' ELSE message END AS message_processed, (m.n < 20)::TINYINT AS message_is_rare
    FROM ev JOIN m USING (message) JOIN e USING (event) JOIN s USING (status) JOIN t USING (target)"""
)
def event_frequency_encoding(spark: SparkSession, sf: str) -> DataFrame:
    """Frequency codes; the message column has values on both sides of the rare limit."""
    base = auth_events(spark, sf).select("line_number", "message", "event", "status", "target")
    df = S.frequency_encoding(base, base, ["message", "event", "status", "target"], rare_below=20)
    return df.select(
        "line_number", "message_freq", "event_freq", "status_freq", "target_freq",
        "message_processed", "message_is_rare",
    )


@query(
    f"WITH {SESSION_SQL} SELECT session_id, {sql_time('tmin')} AS timestamp_min, {sql_time('tmax')} AS timestamp_max,"
    " n_events, step_id_min, step_id_max, step_id_nunique, delta_ms_sum, delta_ms_mean,"
    " delta_ms_std, delta_ms_max, n_failures, n_errors, step_jump_sum, step_reverse_sum,"
    " step_event_mismatch_sum, delta_too_fast_sum, delta_too_slow_sum, simultaneous_event_sum,"
    " has_error_keyword_sum, source_ip_nunique, user_id_nunique, user_id_first, target_nunique, target_first,"
    " line_number_min, line_number_max, round(duration_ms, 3) AS duration_ms, final_status FROM sess"
)
def session_features(spark: SparkSession, sf: str) -> DataFrame:
    df = text_time(sessions(spark, sf), "timestamp_min", "timestamp_max")
    return df.select(
        "session_id", "timestamp_min", "timestamp_max", "n_events", "step_id_min", "step_id_max",
        "step_id_nunique",
        "delta_ms_sum", "delta_ms_mean", "delta_ms_std", "delta_ms_max",
        "n_failures", "n_errors", *[f"{f}_sum" for f in S.FLAGS], "source_ip_nunique",
        "user_id_nunique", "user_id_first", "target_nunique", "target_first", "line_number_min",
        "line_number_max", F.round("duration_ms", 3).alias("duration_ms"), "final_status",
    )


_SCORE_SQL = (
    "session_id, n_events, n_failures, is_successful::TINYINT AS is_successful, start_hour::BIGINT AS start_hour,"
    " start_dayofweek::BIGINT AS start_dayofweek, round(anomaly_score_statistical, 6) AS anomaly_score_statistical,"
    " round(anomaly_score_rules::DOUBLE, 6) AS anomaly_score_rules, round(anomaly_score_final, 6) AS anomaly_score_final"
)
_SCORE_OUT = (
    "session_id", "n_events", "n_failures", "is_successful", "start_hour", "start_dayofweek",
    "anomaly_score_statistical", "anomaly_score_rules", "anomaly_score_final",
)


@query(f"WITH {SESSION_SQL} SELECT {_SCORE_SQL} FROM final")
def session_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scored(spark, sf).select(*_SCORE_OUT))


@query(
    f"""WITH {SESSION_SQL} SELECT CASE WHEN is_successful = 1 THEN 'success' ELSE 'failure' END AS outcome, count(*) AS n
    FROM final GROUP BY 1"""
)
def outcome_split(spark: SparkSession, sf: str) -> DataFrame:
    return A.outcome_split(scored(spark, sf))


@query(f"WITH {SESSION_SQL} SELECT {_SCORE_SQL} FROM final WHERE anomaly_score_final > 1.0")
def high_risk_sessions(spark: SparkSession, sf: str) -> DataFrame:
    df = scored(spark, sf).filter(F.col("anomaly_score_final") > RULES.high_risk)
    return rounded(df.select(*_SCORE_OUT))


@query(
    f"WITH {SESSION_SQL} SELECT session_id, round(anomaly_score_final, 6) AS anomaly_score_final FROM final"
    " WHERE anomaly_score_final > (SELECT quantile_cont(anomaly_score_final, 0.9) FROM final) + 1e-9"
)
def score_quantile_cut(spark: SparkSession, sf: str) -> DataFrame:
    scores = durable(scored(spark, sf).select("session_id", "anomaly_score_final"))
    return rounded(A.above_quantile(scores, "anomaly_score_final", 0.9))


@query(
    f"""WITH {SESSION_SQL}, t AS (SELECT (SELECT count(*) FROM ev)::DOUBLE AS total_events,
    count(*)::DOUBLE AS total_sessions, avg(is_successful) AS success_rate,
    avg(duration_ms) AS avg_session_duration_ms,
    count(*) FILTER (WHERE anomaly_score_final > 1.0)::DOUBLE AS anomalous_sessions_count,
    avg(anomaly_score_final) AS score_mean, stddev_samp(anomaly_score_final) AS score_std,
    min(anomaly_score_final) AS score_min, max(anomaly_score_final) AS score_max FROM final),
    u AS (SELECT *, total_events / total_sessions AS avg_events_per_session FROM t)
    SELECT metric, round(value, 4) AS value FROM (UNPIVOT u ON COLUMNS(*) INTO NAME metric VALUE value)"""
)
def pipeline_statistics(spark: SparkSession, sf: str) -> DataFrame:
    stats = S.pipeline_stats(auth_events(spark, sf), scored(spark, sf), RULES)
    return rounded(S.stats_rows(stats), 4)


@query(
    f"WITH {AUTH_SQL} SELECT prev_event AS event, event AS next_event, count(*) AS n FROM lagged"
    " WHERE prev_event IS NOT NULL GROUP BY 1, 2"
)
def transitions(spark: SparkSession, sf: str) -> DataFrame:
    return S.transitions(auth_events(spark, sf), RULES)


_PATTERNS = ", ".join(
    f"count(*) FILTER (WHERE {f} > 0) AS {f}"
    for f in ("step_jump", "step_reverse", "step_event_mismatch", "delta_too_fast", "delta_too_slow",
              "simultaneous_event", "has_error_keyword", "message_unusual_length")
)
_PATTERN_NAMES = (*S.FLAGS, "message_unusual_length")


@query(
    f"""WITH {AUTH_SQL}, w AS (SELECT count(*) AS total, {_PATTERNS} FROM feat)
    SELECT pattern, n, round(n / total * 100, 2) AS ratio
    FROM (UNPIVOT w ON COLUMNS(* EXCLUDE total) INTO NAME pattern VALUE n) WHERE n > 0"""
)
def pattern_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.pattern_counts(stepped(spark, sf), _PATTERN_NAMES)


@query(
    f"""WITH {AUTH_SQL}, w AS (SELECT date_trunc('hour', ts) AS h, {_PATTERNS} FROM feat GROUP BY 1)
    SELECT strftime(h, '%Y-%m-%d %H') AS hour, pattern, n
    FROM (UNPIVOT w ON COLUMNS(* EXCLUDE h) INTO NAME pattern VALUE n) WHERE n > 0"""
)
def hourly_pattern_counts(spark: SparkSession, sf: str) -> DataFrame:
    df = A.pattern_counts_by_hour(stepped(spark, sf), "timestamp", _PATTERN_NAMES)
    return df.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


@query(
    f"""WITH {AUTH_SQL} SELECT user_id, count(*) AS total_events,
    sum((greatest(delta_too_fast, delta_too_slow, has_error_keyword, simultaneous_event, message_unusual_length,
    step_jump, step_reverse) > 0)::INT)::BIGINT AS anomaly_events
    FROM feat GROUP BY 1 ORDER BY total_events DESC, user_id LIMIT 10"""
)
def user_anomaly_top10(spark: SparkSession, sf: str) -> DataFrame:
    return A.user_activity(stepped(spark, sf), S.any_anomaly(), 10)


@query(
    f"""WITH {SESSION_SQL} SELECT start_hour::BIGINT AS start_hour, round_even(avg(is_successful), 3) AS success_rate,
    round_even(avg(anomaly_score_final), 3) AS avg_score, count(*) AS n_sessions FROM final GROUP BY 1"""
)
def sessions_by_start_hour(spark: SparkSession, sf: str) -> DataFrame:
    return A.sessions_by_start_hour(scored(spark, sf))


@query(
    f"""WITH {SESSION_SQL} SELECT count(*) AS n_failed, round(avg(anomaly_score_final), 6) AS avg_score,
    round(avg(n_failures), 6) AS avg_failures FROM final WHERE is_successful = 0"""
)
def failed_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.failed_sessions(scored(spark, sf)))


@query(
    f"""WITH {SESSION_SQL} SELECT count(*) AS total_sessions, round(avg(is_successful) * 100, 4) AS success_rate,
    round(avg(duration_ms), 4) AS avg_duration_ms, round(avg(n_events), 4) AS avg_events,
    round(avg(n_failures), 4) AS avg_failures, round(avg(anomaly_score_final), 4) AS avg_anomaly_score,
    count(*) FILTER (WHERE anomaly_score_final > 1) AS high_anomaly_sessions,
    round(avg((anomaly_score_final > 1)::INT) * 100, 4) AS high_risk_pct FROM final"""
)
def session_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.session_kpis(scored(spark, sf)), 4)


@query(
    f"""WITH {SESSION_SQL} SELECT right(session_id, 8) AS session_suffix, round(duration_ms, 0) AS duration_ms,
    CASE WHEN is_successful = 1 THEN 'success' ELSE 'failure' END AS outcome, n_events FROM final"""
)
def session_duration_table(spark: SparkSession, sf: str) -> DataFrame:
    return A.session_durations(sessions(spark, sf))


@query(f"WITH {AUTH_SQL} SELECT internal::TINYINT AS source_ip_is_internal, count(*) AS n FROM ev GROUP BY 1")
def internal_external(spark: SparkSession, sf: str) -> DataFrame:
    return A.internal_external(S.ip_features(auth_events(spark, sf)))


@query(
    f"""WITH {AUTH_SQL} SELECT source_ip, internal::TINYINT AS source_ip_is_internal, count(*) AS n FROM ev
    GROUP BY 1, 2 ORDER BY n DESC, source_ip LIMIT 12"""
)
def top_addresses(spark: SparkSession, sf: str) -> DataFrame:
    return A.top_addresses(S.ip_features(auth_events(spark, sf)), 12)


@query(
    f"WITH {AUTH_SQL} SELECT CASE WHEN internal = 1 THEN 'KR' ELSE 'Unknown' END AS country, count(*) AS n"
    " FROM ev GROUP BY 1"
)
def country_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.country_counts(auth_events(spark, sf))


@query(
    f"""WITH {AUTH_SQL} SELECT count(*) AS total_events, count(DISTINCT session_id) AS unique_sessions,
    count(DISTINCT user_id) AS unique_users, count(DISTINCT source_ip) AS unique_ips,
    {sql_time('min(ts)')} AS "start", {sql_time('max(ts)')} AS "end" FROM ev"""
)
def overview(spark: SparkSession, sf: str) -> DataFrame:
    return text_time(A.overview(auth_events(spark, sf)), "start", "end")


@query(
    f"""WITH {AUTH_SQL} SELECT split, n FROM (
    SELECT CASE WHEN hour(ts) BETWEEN 9 AND 17 THEN 'business_hours' ELSE 'other_hours' END AS split, count(*) AS n
    FROM ev GROUP BY 1 UNION ALL
    SELECT CASE WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'weekday' END, count(*) FROM ev GROUP BY 1)"""
)
def binary_splits(spark: SparkSession, sf: str) -> DataFrame:
    return A.binary_splits(auth_events(spark, sf))


@query(f"WITH {AUTH_SQL} SELECT step_id, event, count(*) AS n FROM ev GROUP BY 1, 2")
def step_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.value_counts(auth_events(spark, sf), "step_id", "event").orderBy("step_id", F.desc("n"))
