"""Log text derived from ``events``, in Spark and in SQL, line for line the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.plans.tables import table

# pos = event_id * 10 + k; small chunks so that records straddle chunk borders often
CHUNK = 25_000


def _fmt(pattern: str) -> Column:
    return F.date_format("ts", pattern)


def _lines(df: DataFrame, parts: list[tuple[int, Column, Column]]) -> DataFrame:
    """``(offset, condition, text)`` triples per event -> the common line columns."""
    made = F.filter(
        F.array(*[F.when(cond, F.struct(F.lit(k).alias("k"), text.alias("value"))) for k, cond, text in parts]),
        lambda x: x.isNotNull(),
    )
    pos = F.col("event_id") * 10 + F.col("line.k")
    return df.withColumn("line", F.explode(made)).select(
        F.concat(F.lit("node"), F.col("user_id") % 4).alias("source"),
        F.floor(pos / CHUNK).cast("bigint").alias("chunk"),
        pos.cast("bigint").alias("pos"),
        F.col("line.value").alias("value"),
    )


def sso_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Records with three header forms, stack traces, continuation and noise lines."""
    df = table(spark, sf, "events")
    e, kind, user = F.col("event_id"), F.col("event_type"), F.col("user_id").cast("string")
    level = (
        F.when(kind == "error", "ERROR").when(kind == "view", "WARN").when(kind == "click", "DEBUG")
        .when(kind == "signup", "경고").otherwise("INFO")
    )
    topic = (
        F.when(kind == "error", "request failed code 503").when(kind == "view", "license check")
        .when(kind == "click", "login page").when(kind == "signup", "saml2:Response received")
        .otherwise("order placed")
    )
    msg = F.concat(
        topic, F.lit(" for user "), user, F.lit(" from 10.0.0."), user, F.lit(" value "),
        F.col("value").cast("decimal(12,2)").cast("string"), F.lit(" props "), F.col("props"),
    )
    form = e % 5
    header = (
        F.when(form == 4, F.concat(_fmt("HH:mm:ss.SSS"), F.lit(" [exec-"), user, F.lit("] "), level, F.lit(" a.b.Clock - "), msg))
        .when(form == 3, F.concat(_fmt("dd-MMM-yyyy HH:mm:ss.SSS"), F.lit(" "), level, F.lit(" [main] org.apache.catalina.Core "), msg))
        .otherwise(F.concat(_fmt("yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" "), level, F.lit(" 121 --- [  exec-1] com.app."), kind, F.lit(" : "), msg))
    )
    is_error = kind == "error"
    return _lines(
        df,
        [
            (0, F.lit(True), header),
            (1, is_error, F.concat(F.lit("    at com.app.Handler.run(Handler.java:"), e.cast("string"), F.lit(")"))),
            (2, is_error & (e % 3 == 0), F.concat(F.lit("Caused by: java.lang.IllegalStateException: value "), user)),
            (3, kind == "click", F.concat(F.lit("  continued "), user, F.lit(" times"))),
            (5, e % 6 == 0, F.lit("Pool stats (total=9)")),
        ],
    )


_LEVEL_SQL = """CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARN' WHEN 'click' THEN 'DEBUG'
  WHEN 'signup' THEN '경고' ELSE 'INFO' END"""
SSO_LINES_SQL = f"""
src AS (SELECT *, 'node' || (user_id % 4) AS source,
  CASE event_type WHEN 'error' THEN 'request failed code 503' WHEN 'view' THEN 'license check'
    WHEN 'click' THEN 'login page' WHEN 'signup' THEN 'saml2:Response received' ELSE 'order placed' END
  || ' for user ' || user_id || ' from 10.0.0.' || user_id || ' value ' || value::DECIMAL(12,2)::VARCHAR
  || ' props ' || props AS msg, {_LEVEL_SQL} AS lev FROM events),
lines AS (
  SELECT source, event_id * 10 AS pos, CASE event_id % 5
    WHEN 4 THEN strftime(ts, '%H:%M:%S.') || strftime(ts, '%f')[1:3] || ' [exec-' || user_id || '] ' || lev || ' a.b.Clock - ' || msg
    WHEN 3 THEN strftime(ts, '%d-%b-%Y %H:%M:%S.') || strftime(ts, '%f')[1:3] || ' ' || lev || ' [main] org.apache.catalina.Core ' || msg
    ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.') || strftime(ts, '%f')[1:3] || ' ' || lev || ' 121 --- [  exec-1] com.app.' || event_type || ' : ' || msg
    END AS value FROM src
  UNION ALL SELECT source, event_id * 10 + 1, '    at com.app.Handler.run(Handler.java:' || event_id || ')' FROM src WHERE event_type = 'error'
  UNION ALL SELECT source, event_id * 10 + 2, 'Caused by: java.lang.IllegalStateException: value ' || user_id FROM src
    WHERE event_type = 'error' AND event_id % 3 = 0
  UNION ALL SELECT source, event_id * 10 + 3, '  continued ' || user_id || ' times' FROM src WHERE event_type = 'click'
  UNION ALL SELECT source, event_id * 10 + 5, 'Pool stats (total=9)' FROM src WHERE event_id % 6 = 0),
quiet AS (SELECT * FROM lines WHERE value NOT LIKE '%Pool stats%'),
heads AS (SELECT *,
  CASE WHEN regexp_matches(value, '^\\d{{2}}:\\d{{2}}:\\d{{2}}\\.\\d{{3}} \\[') THEN 'clock'
       WHEN regexp_matches(value, '^\\d{{2}}-[A-Za-z]{{3}}-\\d{{4}} ') THEN 'container'
       WHEN regexp_matches(value, '^\\d{{4}}-\\d{{2}}-\\d{{2}} ') THEN 'framework' END AS form FROM quiet),
dated AS (SELECT *, CASE form
  WHEN 'container' THEN strptime(left(value, 24), '%d-%b-%Y %H:%M:%S.%g')
  WHEN 'framework' THEN strptime(left(value, 23), '%Y-%m-%d %H:%M:%S.%g') END AS full_ts FROM heads),
carried AS (SELECT *, last_value(full_ts IGNORE NULLS) OVER (PARTITION BY source ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM dated),
marked AS (SELECT *, (form IS NOT NULL AND seen IS NOT NULL) AS is_header,
  coalesce(full_ts, CASE WHEN form = 'clock' AND seen IS NOT NULL
    THEN strptime(strftime(seen, '%Y-%m-%d ') || left(value, 12), '%Y-%m-%d %H:%M:%S.%g') END) AS ts FROM carried),
grouped AS (SELECT *, sum(is_header::INT) OVER (PARTITION BY source ORDER BY pos) AS rec FROM marked),
parsed AS (SELECT *,
  CASE WHEN is_header THEN CASE form
    WHEN 'clock' THEN regexp_extract(value, '\\] (\\S+) ', 1)
    WHEN 'container' THEN regexp_extract(value, '^\\S+ \\S+ (\\S+) ', 1)
    ELSE regexp_extract(value, '^\\S+ \\S+ (\\S+) ', 1) END END AS raw_level,
  CASE WHEN is_header THEN CASE form WHEN 'clock' THEN regexp_extract(value, '\\[([^\\]]+)\\]', 1)
    WHEN 'container' THEN 'main' ELSE 'exec-1' END END AS thread,
  CASE WHEN is_header THEN CASE form WHEN 'clock' THEN 'a.b.Clock' WHEN 'container' THEN 'org.apache.catalina.Core'
    ELSE regexp_extract(value, '(com\\.app\\.\\w+) : ', 1) END END AS logger,
  CASE WHEN is_header AND form = 'framework' THEN '121' END AS pid,
  CASE WHEN is_header THEN CASE form WHEN 'clock' THEN regexp_extract(value, ' - (.*)$', 1)
    WHEN 'container' THEN regexp_extract(value, 'Core (.*)$', 1) ELSE regexp_extract(value, ' : (.*)$', 1) END END AS head_msg,
  (NOT is_header AND (value LIKE '    %' OR value LIKE 'Caused by: %')) AS is_stack FROM grouped WHERE rec > 0),
recs0 AS (SELECT source, rec, min(pos) AS pos, max(ts) AS ts,
  max(CASE raw_level WHEN '경고' THEN 'WARN' ELSE raw_level END) AS level, max(thread) AS thread,
  max(logger) AS logger, max(pid) AS pid,
  trim(max(head_msg) || coalesce(' ' || string_agg(trim(value), ' ' ORDER BY pos) FILTER (WHERE NOT is_header AND NOT is_stack), '')) AS message,
  string_agg(value, chr(10) ORDER BY pos) FILTER (WHERE is_stack) AS stacktrace,
  max(CASE WHEN is_stack AND value LIKE 'Caused by: %' THEN 'java.lang.IllegalStateException' END) AS caused,
  arg_min(trim(value), pos) FILTER (WHERE is_stack) AS first_stack
  FROM parsed GROUP BY source, rec),
-- clicks carry "login", so DEBUG survives; nothing holds a drop word
recs1 AS (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS "timestamp",
  coalesce(caused, string_split(first_stack, ':')[1]) AS exception_type,
  stacktrace IS NOT NULL AS has_stacktrace,
  CASE level WHEN 'ERROR' THEN 80 WHEN 'WARN' THEN 40 WHEN 'DEBUG' THEN 10 ELSE 20 END
    + CASE WHEN stacktrace IS NOT NULL AND level IN ('ERROR', 'WARN') THEN 20 ELSE 0 END AS severity_score,
  CASE WHEN message LIKE '%license%' THEN 'LICENSE' WHEN message LIKE '%saml2:%' THEN 'SAML'
    WHEN logger LIKE '%catalina%' THEN 'SYSTEM' ELSE 'OTHER' END AS log_category,
  CASE WHEN regexp_matches(message, '\\b[4-5]\\d{{2}}\\b') THEN 'HTTP_' || regexp_extract(message, '\\b([4-5]\\d{{2}})\\b', 1) END AS error_code,
  length(message) AS message_len,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(message,
    '\\b\\d{{1,3}}(?:\\.\\d{{1,3}}){{3}}\\b', '<IP>', 'g'), '"[^"]+"|''[^'']+''', '<QUOTE>', 'g'),
    '\\b\\d+\\b', '<NUM>', 'g'), '\\s+', ' ', 'g')) AS message_template FROM recs0),
recs AS (SELECT *, count(*) OVER (PARTITION BY message_template) AS template_frequency FROM recs1)
"""


def clock_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A record per event whose header has a date in one of sixty only; a node's clock goes on by hours."""
    df = table(spark, sf, "events")
    e, user = F.col("event_id"), F.col("user_id").cast("string")
    seconds = (e * 5003) % 86400
    clock = F.date_format(F.timestamp_seconds(seconds), "HH:mm:ss.SSS")
    dated = e % 60 < 4
    line = F.when(
        dated, F.concat(_fmt("yyyy-MM-dd "), clock, F.lit(" INFO 121 --- [  exec-1] com.app.Clock : at "), user)
    ).otherwise(F.concat(clock, F.lit(" [exec-1] INFO a.b.Clock - at "), user))
    return _lines(df, [(0, F.lit(True), line)])


CLOCK_LINES_SQL = """lines AS (SELECT 'node' || (user_id % 4) AS source, event_id * 10 AS pos, (event_id * 5003) % 86400 AS clock,
  event_id % 60 < 4 AS dated, date_trunc('day', ts)::TIMESTAMP AS day FROM events)"""


def signature_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One signature verifier record per event."""
    df = table(spark, sf, "events")
    e, user = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    hexa = F.lower(F.hex(F.col("event_id") + 4096))
    kind = F.col("event_type")
    code = F.when(kind == "purchase", "0").when(kind == "signup", "7").when(kind == "error", "9").otherwise(F.length(kind).cast("string"))
    text = F.concat(
        _fmt("yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" INFO 7 --- [exec-1] com.app.SignedDataVerifier : SignedDataVO(responseCode="),
        code, F.lit(", msg="), F.when(code == "0", "OK").otherwise("BAD"), F.lit(", userCert=X509Certificate@"), hexa,
        F.lit(", userCerts=[X509Certificate@"), hexa, F.lit(", X509Certificate@ff"), F.lit("], dn=cn=User"), user,
        F.lit("(),ou=A"), user, F.lit(",ou=Team,o=Org,c=KR, signOrgData=[65, 66, "), F.col("user_id").cast("string"),
        F.lit("], signerInfos=[SignerInfo@"), hexa, F.lit("], signingTime="), _fmt("EEE MMM dd HH:mm:ss"),
        F.lit(" KST "), _fmt("yyyy"), F.lit(") in took 12ms for "), e,
    )
    return _lines(df, [(0, F.lit(True), text)])


SIGNATURE_SQL = """
sig AS (SELECT event_id * 10 AS pos, 'node' || (user_id % 4) AS source, date_trunc('millisecond', ts) AS ts, user_id,
  CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 7 WHEN 'error' THEN 9 ELSE length(event_type) END AS code,
  lower(to_hex(event_id + 4096)) AS hx, hour(ts) AS hr FROM events),
sigw AS (SELECT *, lag(ts) OVER w AS prev, row_number() OVER w AS k FROM sig
  WINDOW w AS (PARTITION BY user_id ORDER BY source, pos))
"""


def pool_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Connection pool records per event."""
    df = table(spark, sf, "events")
    user = F.col("user_id")
    action = (
        F.when(F.col("event_id") % 3 == 0, F.lit("Added connection c@ab12"))
        .when(F.col("event_id") % 3 == 1, F.lit("Closing connection c@ab12: (connection has passed maxLifetime)"))
        .otherwise(
            F.concat(
                F.lit("Pool stats (total="), (user % 5).cast("string"), F.lit(", active="),
                (user % 3).cast("string"), F.lit(", idle=1, waiting=0)"),
            )
        )
    )
    text = F.concat(F.lit("DEBUG "), _fmt("yy-MM-dd HH:mm:ss"), F.lit("[pool adder] [HikariPool:729] - "), action)
    return _lines(df, [(0, F.lit(True), text)])
