"""Registered queries: two-sided matching, address ranges, country names.

Orders play the requesting side and their line items the responding side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import correlate as C
from logloom.operators import geo
from logloom.plans.tables import rounded, sql_time, table, text_time

QUERIES = {}
ORACLE = {}


def query(sql: str | None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Orders; the id of low-priority orders is unknown."""
    return table(spark, sf, "orders").select(
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderkey")).alias("request_id"),
        F.col("o_orderdate").cast("timestamp").alias("request_timestamp"),
        F.col("o_orderpriority").alias("sp_provider"),
    )


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """First shipped line of each order."""
    one = C.first_per_key(
        table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate"),
        "l_orderkey",
        ["l_shipdate", "l_partkey", "l_suppkey"],
    )
    return one.select(
        F.col("l_orderkey").alias("in_response_to"),
        F.col("l_partkey").alias("response_id"),
        F.col("l_shipdate").cast("timestamp").alias("response_timestamp"),
    )


_SIDES = """req AS (SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey END AS request_id,
  o_orderdate AS request_timestamp, o_orderpriority AS sp_provider FROM orders),
resp AS (SELECT l_orderkey AS in_response_to, arg_min(l_partkey, (l_shipdate, l_partkey, l_suppkey)) AS response_id,
  min(l_shipdate) AS response_timestamp FROM lineitem GROUP BY 1)"""


@query(
    f"""WITH {_SIDES} SELECT request_id, in_response_to, response_id, sp_provider,
    {sql_time('request_timestamp')} AS request_timestamp, {sql_time('response_timestamp')} AS response_timestamp,
    round((epoch_us(response_timestamp) - epoch_us(request_timestamp)) / 1000000.0, 3) AS transaction_duration
    FROM req FULL OUTER JOIN resp ON request_id = in_response_to"""
)
def request_response_match(spark: SparkSession, sf: str) -> DataFrame:
    df = C.match_requests(requests(spark, sf), responses(spark, sf))
    return rounded(text_time(df, "request_timestamp", "response_timestamp"), 3)


@query(
    f"""WITH {_SIDES} SELECT request_id, sp_provider FROM req WHERE NOT EXISTS
    (SELECT 1 FROM resp WHERE in_response_to = request_id)"""
)
def unmatched_requests(spark: SparkSession, sf: str) -> DataFrame:
    df = C.unmatched(requests(spark, sf), responses(spark, sf), "request_id", "in_response_to")
    return df.select("request_id", "sp_provider")


def matches(spark: SparkSession, sf: str) -> DataFrame:
    idp = table(spark, sf, "orders").select(
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderkey")).alias("idp_id"),
        F.col("o_orderdate").cast("timestamp").alias("idp_ts"),
        F.lit(None).cast("timestamp").alias("idp_issue_instant"),
        F.col("o_orderpriority").alias("idp_provider"),
        F.when(F.col("o_orderstatus") == "P", "License Error").alias("idp_error"),
        F.lit("idp.log").alias("idp_file"),
        F.col("o_orderkey").alias("idp_line"),
    )
    sp = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("sp_id"),
        F.col("l_shipdate").cast("timestamp").alias("sp_ts"),
        F.lit(None).cast("timestamp").alias("sp_issue_instant"),
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("SP"), F.col("l_suppkey") % 3)).alias("sp_provider"),
        F.when(F.col("l_linestatus") == "F", "Success").alias("sp_status"),
        F.concat(F.lit("agent"), F.col("l_suppkey") % 4).alias("sp_agent"),
        F.lit("sp.log").alias("sp_file"),
        # lines of an order in the sequence of their parts and suppliers
        (F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("sp_line"),
    )
    return C.enrich_matches(C.match_sides(idp, sp))


_MATCH = """idp AS (SELECT o_orderkey AS idp_id, o_orderdate AS idp_ts, o_orderpriority AS idp_provider,
  CASE WHEN o_orderstatus = 'P' THEN 'License Error' END AS idp_error FROM orders WHERE o_orderpriority <> '5-LOW'),
spl AS (SELECT l_orderkey AS sp_id, l_shipdate AS ts, CASE WHEN l_returnflag = 'A' THEN 'SP' || (l_suppkey % 3) END AS provider,
  CASE WHEN l_linestatus = 'F' THEN 'Success' END AS status, 'agent' || (l_suppkey % 4) AS agent,
  l_partkey * 100000 + l_suppkey AS line FROM lineitem),
sp AS (SELECT sp_id, arg_min(ts, line) AS sp_ts, arg_min(provider, line) AS sp_provider, arg_min(status, line) AS sp_status,
  arg_min(agent, line) AS sp_agent FROM spl GROUP BY 1),
m0 AS (SELECT coalesce(sp.sp_id, idp_id) AS sp_id, idp_ts, sp_ts, idp_provider, sp_provider, idp_error, sp_status, sp_agent
  FROM idp FULL OUTER JOIN sp ON idp_id = sp.sp_id),
m AS (SELECT *, CASE WHEN idp_error IS NOT NULL AND sp_ts IS NULL THEN 'IDP ERROR: ' || idp_error || ' (unmatched)'
    WHEN idp_ts IS NOT NULL AND sp_ts IS NULL THEN 'IdP-only (unmatched)'
    WHEN sp_ts IS NOT NULL AND idp_ts IS NULL THEN 'SP-only (unmatched)'
    WHEN idp_ts IS NOT NULL AND sp_ts IS NOT NULL AND sp_status = 'Success' THEN 'Completed' ELSE 'Unknown' END AS sequence_status,
  coalesce(sp_ts, idp_ts) AS ts_any,
  CASE WHEN sp_ts >= idp_ts THEN (epoch_us(sp_ts) - epoch_us(idp_ts)) / 1000000.0 END AS duration_sec,
  coalesce(sp_provider, idp_provider, 'Unknown') AS provider_any, coalesce(sp_agent, 'Unknown') AS agent_any,
  coalesce(sp_status = 'Success', false) AS is_completed, (idp_ts IS NULL) <> (sp_ts IS NULL) AS is_unmatched FROM m0)"""


@query(
    f"""WITH {_MATCH} SELECT sp_id, sequence_status, {sql_time('ts_any')} AS ts_any, round(duration_sec, 3) AS duration_sec,
    provider_any, agent_any, is_completed, is_unmatched FROM m"""
)
def sequence_matches(spark: SparkSession, sf: str) -> DataFrame:
    df = matches(spark, sf).select(
        "sp_id", "sequence_status", "ts_any", "duration_sec", "provider_any", "agent_any", "is_completed", "is_unmatched"
    )
    return rounded(text_time(df, "ts_any"), 3)


@query(
    f"""WITH {_MATCH} SELECT count(*) AS total, count(*) FILTER (WHERE is_completed) AS completed,
    count(*) FILTER (WHERE NOT is_completed) AS not_completed, count(*) FILTER (WHERE is_unmatched) AS unmatched,
    round(count(*) FILTER (WHERE is_completed) * 100.0 / count(*), 6) AS success_rate,
    round(avg(duration_sec), 4) AS avg_duration, round(quantile_cont(duration_sec, 0.5), 4) AS median_duration,
    round(quantile_cont(duration_sec, 0.95), 4) AS p95_duration FROM m"""
)
def match_kpis(spark: SparkSession, sf: str) -> DataFrame:
    df = C.match_kpis(matches(spark, sf))
    return df.select(
        "total", "completed", "not_completed", "unmatched", F.round("success_rate", 6).alias("success_rate"),
        *[F.round(c, 4).alias(c) for c in ("avg_duration", "median_duration", "p95_duration")],
    )


@query(
    f"""WITH {_MATCH} SELECT strftime(date_trunc('hour', ts_any + INTERVAL 9 HOUR), '%Y-%m-%d %H:00') AS hour,
    CASE WHEN is_completed THEN 'Completed' ELSE 'Not Completed' END AS completed_flag, count(*) AS n FROM m GROUP BY 1, 2"""
)
def completion_trend(spark: SparkSession, sf: str) -> DataFrame:
    return C.completion_trend(matches(spark, sf))


@query(
    f"""WITH {_MATCH} SELECT provider_any, CASE WHEN is_completed THEN 'Completed' ELSE 'Not Completed' END AS completed_flag,
    count(*) AS n FROM m GROUP BY 1, 2"""
)
def completion_by_provider(spark: SparkSession, sf: str) -> DataFrame:
    return C.completion_by(matches(spark, sf), "provider_any")


@query(f"WITH {_MATCH} SELECT sequence_status, count(*) AS n FROM m GROUP BY 1")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return matches(spark, sf).groupBy("sequence_status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_MATCH} SELECT agent_any, round(avg(is_completed::INT) * 100, 2) AS success_rate FROM m GROUP BY 1")
def success_rate_by_agent(spark: SparkSession, sf: str) -> DataFrame:
    return C.success_rate_by(matches(spark, sf), "agent_any")


@query(
    f"""WITH {_MATCH} SELECT sp_id, sequence_status, round(duration_sec, 3) AS duration_sec, agent_any FROM m
    WHERE duration_sec IS NOT NULL ORDER BY duration_sec DESC, sp_id LIMIT 15"""
)
def slowest_matches(spark: SparkSession, sf: str) -> DataFrame:
    df = C.slowest(matches(spark, sf), 15)
    return rounded(df.select("sp_id", "sequence_status", "duration_sec", "agent_any"), 3)


@query(
    f"""WITH {_MATCH} SELECT count(*) AS n FROM m WHERE ts_any >= DATE '1997-01-01' AND ts_any < DATE '1998-01-01'
    AND agent_any IN ('agent1', 'agent2') AND sequence_status = 'Completed'"""
)
def filtered_matches(spark: SparkSession, sf: str) -> DataFrame:
    df = C.select_matches(
        matches(spark, sf), "1997-01-01", "1997-12-31", agents=["agent1", "agent2"], statuses=["Completed"]
    )
    return df.agg(F.count(F.lit(1)).alias("n"))


def address_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Two v4 ranges and one v6 range per nation, with gaps between them."""
    n = F.col("n_nationkey")
    parts = F.array(
        F.struct(
            F.concat(F.lit("10."), n, F.lit(".0.0")).alias("ip_start"),
            F.concat(F.lit("10."), n, F.lit(".127.255")).alias("ip_end"),
        ),
        F.struct(
            F.concat(F.lit("8."), n * 2, F.lit(".0.0")).alias("ip_start"),
            F.concat(F.lit("8."), n * 2 + 1, F.lit(".63.255")).alias("ip_end"),
        ),
        F.struct(
            F.concat(F.lit("2001:db8:"), n + 10, F.lit("::")).alias("ip_start"),
            F.concat(F.lit("2001:db8:"), n + 10, F.lit(":7fff:ffff:ffff:ffff:ffff")).alias("ip_end"),
        ),
    )
    return table(spark, sf, "nation").select(
        F.inline(parts), F.left("n_name", F.lit(3)).alias("country")
    )


def addresses(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    ip = (
        F.when(k % 4 == 0, F.concat_ws(".", F.lit("10"), k % 30, k % 256, k % 250))
        .when(k % 4 == 1, F.concat_ws(".", F.lit("8"), k % 60, k % 256, k % 250))
        .when(k % 4 == 2, F.concat(F.lit("2001:db8:"), k % 40, F.lit(":"), k % 9000, F.lit("::1")))
        .when(k % 8 == 3, F.lit("not-an-ip"))
    )
    return table(spark, sf, "customer").select("c_custkey", ip.alias("source_ip"))


@query(
    """WITH a AS (SELECT c_custkey AS k, c_custkey % 4 AS f FROM customer)
    SELECT k AS c_custkey, left(n_name, 3) AS country FROM a LEFT JOIN nation ON CASE
      WHEN f = 0 THEN n_nationkey = k % 30 AND k % 256 <= 127
      WHEN f = 1 THEN (n_nationkey * 2 = k % 60) OR (n_nationkey * 2 + 1 = k % 60 AND k % 256 <= 63)
      WHEN f = 2 THEN n_nationkey + 10 = k % 40 AND
        ('0x' || (k % 9000)::VARCHAR)::BIGINT <= 32767 ELSE false END"""
)
def country_of_ip(spark: SparkSession, sf: str) -> DataFrame:
    df = geo.country_of_ip(addresses(spark, sf), address_ranges(spark, sf))
    return df.select("c_custkey", "country")


def nested_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges of both families inside and across each other: a whole network, nations in it, parts of nations, border strips."""
    n, name = F.col("n_nationkey"), F.col("n_name")

    def one(first: list, last: list, country) -> Column:
        return F.struct(F.concat(*first).alias("ip_start"), F.concat(*last).alias("ip_end"), country.alias("country"))

    t, v6 = F.lit("10."), F.lit("2001:db8:")
    parts = F.array(
        one([t, F.lit("0.0.0")], [t, F.lit("255.255.255")], F.lit("ALL")),
        one([t, n, F.lit(".0.0")], [t, n, F.lit(".127.255")], name),
        one([t, n, F.lit(".64.0")], [t, n, F.lit(".80.255")], F.concat(F.lit("I"), name)),
        one([t, n, F.lit(".100.0")], [t, n + 1, F.lit(".20.255")], F.concat(F.lit("O"), name)),
        one([v6, F.lit(":")], [v6, F.lit("ffff:ffff:ffff:ffff:ffff:ffff")], F.lit("ALL")),
        one([v6, n + 10, F.lit("::")], [v6, n + 10, F.lit(":7fff:ffff:ffff:ffff:ffff")], name),
        one([v6, n + 10, F.lit(":1000::")], [v6, n + 10, F.lit(":2fff:ffff:ffff:ffff:ffff")], F.concat(F.lit("I"), name)),
    )
    return table(spark, sf, "nation").select(F.inline(parts))


@query(
    """WITH k AS (SELECT c_custkey, c_custkey % 4 AS f, c_custkey AS k FROM customer),
    a AS (SELECT c_custkey, CASE f WHEN 0 THEN printf('%08x', (10 << 24) + (k % 30 << 16) + (k % 256 << 8) + k % 250)
        WHEN 1 THEN printf('%08x', (8 << 24) + (k % 60 << 16) + (k % 256 << 8) + k % 250)
        WHEN 2 THEN '20010db8' || lpad((k % 40)::VARCHAR, 4, '0') || lpad((k % 9000)::VARCHAR, 4, '0') || repeat('0', 15) || '1' END AS ip FROM k),
    n AS (SELECT n_nationkey AS n, n_name AS name, lpad((n_nationkey + 10)::VARCHAR, 4, '0') AS h FROM nation),
    r AS (SELECT printf('%08x', 10 << 24) AS s, printf('%08x', (11 << 24) - 1) AS e, 'ALL' AS c
      UNION ALL SELECT printf('%08x', (10 << 24) + (n << 16)), printf('%08x', (10 << 24) + (n << 16) + 32767), name FROM n
      UNION ALL SELECT printf('%08x', (10 << 24) + (n << 16) + 16384), printf('%08x', (10 << 24) + (n << 16) + 20735), 'I' || name FROM n
      UNION ALL SELECT printf('%08x', (10 << 24) + (n << 16) + 25600), printf('%08x', (10 << 24) + (n + 1 << 16) + 5375), 'O' || name FROM n
      UNION ALL SELECT '20010db8' || repeat('0', 24), '20010db8' || repeat('f', 24), 'ALL'
      UNION ALL SELECT '20010db8' || h || repeat('0', 20), '20010db8' || h || '7' || repeat('f', 19), name FROM n
      UNION ALL SELECT '20010db8' || h || '1' || repeat('0', 19), '20010db8' || h || '2' || repeat('f', 19), 'I' || name FROM n)
    SELECT c_custkey, c AS country FROM a LEFT JOIN r ON length(ip) = length(s) AND ip BETWEEN s AND e
    QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY s DESC NULLS LAST, e) = 1"""
)
def country_of_nested_ip(spark: SparkSession, sf: str) -> DataFrame:
    df = geo.country_of_ip(addresses(spark, sf), nested_ranges(spark, sf), chunk_rows=500)
    return df.select("c_custkey", "country")


def _codes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("s_nationkey")
    code = (
        F.when(n == 7, F.lit(None)).when(n % 5 == 0, F.concat(F.lit("n"), n)).when(n % 3 == 0, F.concat(F.lit("Q"), n))
        .otherwise(F.concat(F.lit("N"), n))
    )
    return table(spark, sf, "supplier").select("s_suppkey", code.alias("country"))


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(
        F.concat(F.lit("N"), F.col("n_nationkey")).alias("code"), F.col("n_name").alias("name")
    )


_CODES = """c AS (SELECT s_suppkey, CASE WHEN s_nationkey = 7 THEN NULL WHEN s_nationkey % 5 = 0 THEN 'n' || s_nationkey
  WHEN s_nationkey % 3 = 0 THEN 'Q' || s_nationkey ELSE 'N' || s_nationkey END AS country FROM supplier),
d AS (SELECT 'N' || n_nationkey AS code, n_name AS name FROM nation)"""


@query(
    f"""WITH {_CODES} SELECT s_suppkey, CASE WHEN country IS NULL THEN '정보 없음' WHEN name IS NOT NULL THEN name
    ELSE '알 수 없음(' || country || ')' END AS country_name FROM c LEFT JOIN d ON upper(trim(country)) = code"""
)
def country_names(spark: SparkSession, sf: str) -> DataFrame:
    return geo.country_names(_codes(spark, sf), _names(spark, sf)).select("s_suppkey", "country_name")


@query(
    f"""WITH {_CODES} SELECT upper(country) AS code, name IS NOT NULL AS converted, count(*) AS n
    FROM c LEFT JOIN d ON upper(country) = code WHERE country IS NOT NULL GROUP BY 1, 2"""
)
def country_conversion_report(spark: SparkSession, sf: str) -> DataFrame:
    return geo.conversion_report(geo.country_names(_codes(spark, sf), _names(spark, sf)))


@query(f"WITH {_CODES} SELECT DISTINCT upper(country) AS code FROM c WHERE country IS NOT NULL AND upper(country) NOT IN (SELECT code FROM d)")
def unmapped_countries(spark: SparkSession, sf: str) -> DataFrame:
    return geo.unmapped_codes(_codes(spark, sf), _names(spark, sf))
