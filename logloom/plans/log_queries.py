"""Registered queries over structured log records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import profiles
from logloom.functions.records import error_code, log_category
from logloom.functions.text import BASE_STEPS, complexity, message_template, squeeze
from logloom.operators import lines as L
from logloom.operators import summaries as A
from logloom.operators import systemlog
from logloom.operators.ordered import line_chunk, scan_prior
from logloom.plans.derived_logs import (
    CLOCK_LINES_SQL,
    SIGNATURE_SQL,
    SSO_LINES_SQL,
    clock_lines,
    pool_lines,
    signature_lines,
    sso_lines,
)
from logloom.plans.tables import rounded, table

QUERIES = {}
ORACLE = {}


def query(sql: str | None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def records(spark: SparkSession, sf: str) -> DataFrame:
    return systemlog.structure(sso_lines(spark, sf), profiles.SSO)


def assembled(spark: SparkSession, sf: str) -> DataFrame:
    quiet = L.drop_noise(sso_lines(spark, sf), profiles.SSO)
    return L.assemble(L.attach_records(quiet, profiles.SSO))


def featured(spark: SparkSession, sf: str) -> DataFrame:
    return systemlog.record_features(assembled(spark, sf), profiles.SSO)


@query(
    f"""WITH {SSO_LINES_SQL} SELECT source, pos, value, row_number() OVER (PARTITION BY source ORDER BY pos) AS line_no
    FROM lines"""
)
def line_numbering(spark: SparkSession, sf: str) -> DataFrame:
    return L.number_lines(sso_lines(spark, sf)).select("source", "pos", "value", "line_no")


@query(
    f"""WITH {SSO_LINES_SQL} SELECT role, count(*) AS n FROM (
    SELECT CASE WHEN value LIKE '%Pool stats%' THEN 'noise' END AS role FROM lines WHERE value LIKE '%Pool stats%'
    UNION ALL SELECT CASE WHEN rec = 0 THEN 'orphan' WHEN is_header THEN 'header'
      WHEN value LIKE '    %' OR value LIKE 'Caused by: %' THEN 'stack' ELSE 'text' END FROM grouped) GROUP BY 1"""
)
def line_census(spark: SparkSession, sf: str) -> DataFrame:
    return L.line_census(sso_lines(spark, sf), profiles.SSO)


@query(f'WITH {SSO_LINES_SQL} SELECT source, pos, "timestamp", level, thread, logger, pid, message FROM recs')
def record_assembly(spark: SparkSession, sf: str) -> DataFrame:
    return assembled(spark, sf).select(
        "source", "pos", "timestamp", "level", "thread", "logger", "pid", "message"
    )


@query(
    f"""WITH {SSO_LINES_SQL}, placed AS (SELECT *, coalesce(sum(strlen(value)) OVER (PARTITION BY source ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 200 AS cell FROM grouped WHERE rec >= 0)
    SELECT source, min(pos) AS pos, count(DISTINCT cell) AS segments, count(*) FILTER (WHERE is_stack) AS n_stack,
      count(*) FILTER (WHERE NOT is_header AND NOT is_stack) AS n_text
    FROM (SELECT *, NOT is_header AND (value LIKE '    %' OR value LIKE 'Caused by: %') AS is_stack FROM placed)
    WHERE rec > 0 GROUP BY source, rec"""
)
def record_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Records in segments of 200 bytes: how many each has, and its lines by kind over all of them."""
    quiet = L.drop_noise(sso_lines(spark, sf), profiles.SSO)
    segments = L.record_segments(L.attach_records(quiet, profiles.SSO, segment_bytes=200))
    return segments.groupBy("source", F.col("rec.pos").alias("pos")).agg(
        F.count(F.lit(1)).alias("segments"), F.sum("n_stack").alias("n_stack"), F.sum("n_text").alias("n_text")
    )


@query(
    f"""WITH {CLOCK_LINES_SQL},
    clocked AS (SELECT *, lag(clock) OVER w AS prev, max(CASE WHEN dated THEN pos END) OVER (w ROWS UNBOUNDED PRECEDING) AS from_pos
      FROM lines WINDOW w AS (PARTITION BY source ORDER BY pos)),
    rolled AS (SELECT *, CASE WHEN NOT dated AND prev - clock > 43200 THEN 1 ELSE 0 END AS roll FROM clocked),
    summed AS (SELECT r.source, r.pos, r.clock, r.from_pos, sum(r.roll) OVER (PARTITION BY r.source ORDER BY r.pos) AS rolls FROM rolled r)
    SELECT s.source, s.pos, strftime(f.day + to_days((s.rolls - f.rolls)::INT) + to_seconds(s.clock), '%Y-%m-%dT%H:%M:%S.%g') AS "timestamp"
    FROM summed s JOIN (SELECT a.*, l.day FROM summed a JOIN lines l USING (source, pos)) f ON f.source = s.source AND f.pos = s.from_pos"""
)
def midnight_rollover(spark: SparkSession, sf: str) -> DataFrame:
    """Clocks without a date run over many midnights between two dated headers, across chunks."""
    found = L.assemble(L.attach_records(clock_lines(spark, sf), profiles.SSO))
    return L.roll_over_midnight(found).select("source", "pos", "timestamp")


@query(
    f"""WITH {SSO_LINES_SQL} SELECT source, pos, stacktrace, exception_type, has_stacktrace, severity_score::INT AS severity_score,
    log_category, error_code, message_template, message_len::INT AS message_len, length(message_template)::INT AS template_len,
    CASE WHEN log_category = 'LICENSE' THEN 'CHECKING' END AS license_status,
    CASE WHEN message LIKE '%saml2:Response%' THEN 'RESPONSE' END AS saml_message_type FROM recs"""
)
def record_features(spark: SparkSession, sf: str) -> DataFrame:
    return featured(spark, sf).select(
        "source", "pos", "stacktrace", "exception_type", "has_stacktrace", "severity_score", "log_category",
        "error_code", "message_template", "message_len", "template_len", "license_status", "saml_message_type",
    )


@query(
    f"""WITH {SSO_LINES_SQL} SELECT source, pos, template_frequency, template_frequency > 1 AS is_frequent_template
    FROM recs"""
)
def template_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("source", "pos", "template_frequency", "is_frequent_template")


@query(
    f"""WITH {SSO_LINES_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE severity_score >= 90) AS high_severity,
    count(*) FILTER (WHERE level IN ('ERROR', 'WARN')) AS error_warn, 0::BIGINT AS license_issues FROM recs"""
)
def log_headline(spark: SparkSession, sf: str) -> DataFrame:
    return A.headline(featured(spark, sf))


@query(
    f"""WITH {SSO_LINES_SQL} SELECT level, CASE WHEN severity_score <= 30 THEN '0-30' WHEN severity_score <= 60 THEN '30-60'
    WHEN severity_score <= 90 THEN '60-90' WHEN severity_score <= 100 THEN '90-100' END AS severity_bin, count(*) AS n
    FROM recs GROUP BY 1, 2"""
)
def level_by_severity(spark: SparkSession, sf: str) -> DataFrame:
    return A.level_by_severity(featured(spark, sf))


_FENCES = """f AS (SELECT quantile_cont(message_len, 0.25) AS a, quantile_cont(message_len, 0.75) AS b FROM recs),
flagged AS (SELECT recs.*, severity_score >= 90 AS high_severity, has_stacktrace AS with_stacktrace,
  level IN ('ERROR', 'WARN') AS error_warn, false AS license_issues,
  log_category = 'SAML' AND level IN ('ERROR', 'WARN') AS saml_errors, false AS crypto_errors,
  template_frequency < 10 AS low_frequency,
  message_len < a - 1.5 * (b - a) OR message_len > b + 1.5 * (b - a) AS outlier_length FROM recs, f)"""


@query(
    f"""WITH {SSO_LINES_SQL}, {_FENCES}, w AS (SELECT {", ".join(f"count(*) FILTER (WHERE {x}) AS {x}" for x in A.FAMILIES)}
    FROM flagged) SELECT family, n FROM (UNPIVOT w ON COLUMNS(*) INTO NAME family VALUE n)"""
)
def anomaly_families(spark: SparkSession, sf: str) -> DataFrame:
    return A.family_counts(A.flag_anomalies(records(spark, sf)))


@query(
    f"""WITH {SSO_LINES_SQL}, {_FENCES} SELECT source, pos, "timestamp", level, message FROM flagged
    WHERE high_severity OR with_stacktrace OR outlier_length ORDER BY ts DESC, pos DESC LIMIT 10"""
)
def newest_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    flagged = A.flag_anomalies(records(spark, sf))
    top = A.newest_anomalies(flagged, ["high_severity", "with_stacktrace", "outlier_length"], 10)
    return top.select("source", "pos", "timestamp", "level", "message")


@query(
    f"""WITH {SSO_LINES_SQL} SELECT source, pos, message FROM recs WHERE level IN ('ERROR', 'WARN')
    AND severity_score >= 40 AND log_category IN ('LICENSE', 'SAML', 'OTHER') AND contains(lower(message), 'user 1')
    ORDER BY ts DESC, pos DESC LIMIT 100"""
)
def faceted_search(spark: SparkSession, sf: str) -> DataFrame:
    found = A.search(
        featured(spark, sf), levels=["ERROR", "WARN"], min_severity=40,
        categories=["LICENSE", "SAML", "OTHER"], text="User 1",
    )
    return found.select("source", "pos", "message")


@query(
    f"""WITH {SSO_LINES_SQL} SELECT field, value, count(*) AS n FROM (
    SELECT 'level' AS field, level AS value FROM recs UNION ALL SELECT 'log_category', log_category FROM recs
    UNION ALL SELECT 'exception_type', exception_type FROM recs UNION ALL SELECT 'logger', logger FROM recs)
    WHERE value IS NOT NULL GROUP BY 1, 2"""
)
def domain_summary(spark: SparkSession, sf: str) -> DataFrame:
    return A.domain_summary(featured(spark, sf), ["level", "log_category", "exception_type", "logger"])


@query(
    f"""WITH {SSO_LINES_SQL} SELECT logger AS value, count(*) AS n FROM recs GROUP BY 1 ORDER BY n DESC, value LIMIT 3"""
)
def top_loggers(spark: SparkSession, sf: str) -> DataFrame:
    return A.top_counts(assembled(spark, sf), "logger", 3).withColumnRenamed("logger", "value")


@query(
    f"""WITH {SIGNATURE_SQL} SELECT source, pos, 'User' || user_id AS user_name, code::INT AS signature_response_code,
    code = 0 AS signature_success, CASE code WHEN 0 THEN 'OK' ELSE 'BAD' END AS signature_msg,
    'A' || user_id || ',Team' AS user_organization, 'KR' AS user_country, hx AS primary_cert_hash,
    2::INT AS cert_chain_length, hx || ',ff' AS chain, hr::INT AS signing_hour,
    CASE WHEN hr < 6 OR hr >= 22 THEN 'night' WHEN hr < 12 THEN 'morning' WHEN hr < 18 THEN 'afternoon' ELSE 'evening' END
      AS signing_time_period,
    3::INT AS sign_data_length, round((131 + user_id) / 3.0, 6) AS sign_data_avg, least(65, user_id)::INT AS sign_data_min,
    greatest(66, user_id)::INT AS sign_data_max, (user_id BETWEEN 32 AND 126) AS sign_data_ascii_range,
    1::INT AS signer_count, 12::INT AS processing_time_ms FROM sig"""
)
def signature_fields(spark: SparkSession, sf: str) -> DataFrame:
    quiet = L.drop_noise(signature_lines(spark, sf), profiles.SIGNATURE)
    df = systemlog.record_features(L.assemble(L.attach_records(quiet, profiles.SIGNATURE)), profiles.SIGNATURE)
    return rounded(
        df.select(
            "source", "pos", "user_name", "signature_response_code", "signature_success", "signature_msg",
            "user_organization", "user_country", "primary_cert_hash", "cert_chain_length",
            F.array_join("cert_chain_hashes", ",").alias("chain"), "signing_hour", "signing_time_period",
            "sign_data_length", "sign_data_avg", "sign_data_min", "sign_data_max", "sign_data_ascii_range",
            "signer_count", "processing_time_ms",
        )
    )


@query(
    f"""WITH {SIGNATURE_SQL}, g AS (SELECT *, (epoch_us(ts) - epoch_us(prev)) / 1000000.0 AS gap FROM sigw)
    SELECT source, pos, round(gap, 6) AS signature_interval_seconds, gap < 30 AS rapid_signature,
    gap > 3600 AS delayed_signature, k AS user_signature_count FROM g"""
)
def signature_intervals(spark: SparkSession, sf: str) -> DataFrame:
    df = systemlog.structure(signature_lines(spark, sf), profiles.SIGNATURE)
    return rounded(
        df.select(
            "source", "pos", "signature_interval_seconds", "rapid_signature", "delayed_signature",
            "user_signature_count",
        )
    )


@query(
    """SELECT 'node' || (user_id % 4) AS source, event_id * 10 AS pos, strftime(ts, '%Y-%m-%dT%H:%M:%S.000') AS "timestamp",
    CASE WHEN event_id % 3 = 2 THEN (user_id % 5)::INT END AS pool_total,
    CASE WHEN event_id % 3 = 2 THEN (user_id % 3)::INT END AS pool_active,
    CASE WHEN event_id % 3 = 2 THEN CASE WHEN user_id % 5 = 0 THEN 0.0::DOUBLE
      ELSE round((user_id % 3)::DOUBLE / (user_id % 5), 6) END END AS pool_utilization,
    CASE event_id % 3 WHEN 0 THEN 'ADDED' WHEN 1 THEN 'CLOSED' END AS connection_action,
    CASE event_id % 3 WHEN 1 THEN 'MAX_LIFETIME' END AS close_reason FROM events"""
)
def pool_statistics(spark: SparkSession, sf: str) -> DataFrame:
    df = systemlog.structure(pool_lines(spark, sf), profiles.IAM)
    return rounded(
        df.select(
            "source", "pos", "timestamp", "pool_total", "pool_active", "pool_utilization",
            "connection_action", "close_reason",
        )
    )


_TEMPLATE_SQL = "text"
for _pattern, _label in (
    (r"JSESSIONID=[A-Z0-9]+", "JSESSIONID=<ID>"),
    (r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "<EMAIL>"),
    (r"\b[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b", "<UUID>"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<IP>"),
    (r"\b[0-9a-fA-F]{16,}\b", "<HEX>"),
    (r"(?:/[^ \t\n\r\f\v:]+)+", "<PATH>"),
    (r"\"[^\"]+\"|''[^'']+''", "<QUOTE>"),
    (r"\b\d+\b", "<NUM>"),
):
    _TEMPLATE_SQL = f"regexp_replace({_TEMPLATE_SQL}, '{_pattern}', '{_label}', 'g')"


@query(f"SELECT doc_id, md5(trim(regexp_replace({_TEMPLATE_SQL}, '\\s+', ' ', 'g'))) AS template_md5 FROM documents")
def message_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Templates of whole document texts."""
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(message_template(F.col("text"), BASE_STEPS)).alias("template_md5")
    )


@query(
    """WITH w AS (SELECT *, list_filter(string_split_regex(text, '[\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{3000}]+'), lambda x: x <> '') AS toks FROM documents)
    SELECT doc_id, len(toks)::INT AS word_count, length(text)::INT AS char_count,
    len(list_distinct(list_transform(toks, lambda x: lower(x))))::INT AS unique_words,
    length(regexp_replace(text, '[^.,;:!?]', '', 'g'))::INT AS punctuation_count,
    len(regexp_extract_all(text, '\\p{Nd}+'))::INT AS number_count FROM w"""
)
def message_complexity(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "documents")
    return df.select("doc_id", *[c.alias(n) for n, c in complexity(F.col("text")).items()])


@query(
    """SELECT doc_id, CASE WHEN regexp_matches(text, '\\b[4-5]\\d{2}\\b') THEN 'HTTP_' || regexp_extract(text, '\\b([4-5]\\d{2})\\b', 1)
    WHEN regexp_matches(text, '\\b[A-Z]{2,}-\\d{3,}\\b') THEN regexp_extract(text, '\\b([A-Z]{2,}-\\d{3,})\\b', 1) END AS error_code,
    CASE WHEN source IS NULL OR source = '' THEN 'UNKNOWN'
      WHEN regexp_matches(lower(source), 'catalina|tomcat|bootstrap') THEN 'SYSTEM'
      WHEN regexp_matches(lower(source), 'security|auth|ssl|cert') THEN 'SECURITY'
      WHEN regexp_matches(lower(source), 'http|nio|coyote|connector') THEN 'NETWORK'
      WHEN regexp_matches(lower(source), 'servlet|jsp|filter|valve') THEN 'APPLICATION'
      WHEN regexp_matches(lower(source), 'sql|jdbc|database|datasource|hikari|connection') THEN 'DATABASE'
      WHEN regexp_matches(lower(source), 'quartz|scheduler|job') THEN 'SCHEDULER'
      WHEN regexp_matches(lower(source), 'compiler|jasper|jdt') THEN 'COMPILER'
      WHEN regexp_matches(lower(source), 'spring|boot|context') THEN 'FRAMEWORK' ELSE 'OTHER' END AS log_category
    FROM documents"""
)
def codes_and_categories(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id",
        error_code(F.col("text")).alias("error_code"),
        log_category(F.col("source"), F.col("text"), profiles.IAM).alias("log_category"),
    )


@query(
    """WITH t AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS rec FROM conversations)
    SELECT conv_id, min(turn) AS turn, md5(string_agg(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ' ORDER BY turn)) AS merged,
    count(*) AS lines FROM t WHERE rec > 0 GROUP BY conv_id, rec"""
)
def conversation_records(spark: SparkSession, sf: str) -> DataFrame:
    """User turns open records, later turns are merged into them."""
    turns = table(spark, sf, "conversations").withColumn("chunk", line_chunk(F.col("turn"), 4))
    is_user = F.col("role") == "user"
    seen = scan_prior(turns, ["conv_id"], ["chunk"], ["turn"], last={"open": F.when(is_user, F.col("turn"))})
    rec = F.when(is_user, F.col("turn")).otherwise(F.col("open"))
    lines = F.array_sort(F.collect_list(F.struct("turn", squeeze(F.col("text")).alias("text"))))
    return (
        seen.withColumn("rec", rec)
        .filter("rec IS NOT NULL")
        .groupBy("conv_id", "rec")
        .agg(lines.alias("body"), F.count(F.lit(1)).alias("lines"))
        .select(
            "conv_id", F.col("rec").alias("turn"),
            F.md5(F.array_join(F.transform("body", lambda b: b["text"]), " ")).alias("merged"), "lines",
        )
    )


@query(
    """SELECT role AS value, min(conv_id * 1000 + turn) AS first_at, count(*) AS n,
    row_number() OVER (ORDER BY min(conv_id * 1000 + turn)) AS seen_rank FROM conversations GROUP BY 1"""
)
def first_seen_order(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "conversations").withColumn("at", F.col("conv_id") * 1000 + F.col("turn"))
    seen = A.first_seen(df, "role", "at").withColumn("block", F.floor(F.col("first_at") / 1_000_000))
    ranked = scan_prior(seen, [], ["block"], ["first_at"], totals={"before": F.lit(1)})
    return ranked.select(
        F.col("role").alias("value"), "first_at", "n", (F.col("before") + 1).alias("seen_rank")
    )
