"""Registered queries: report aggregates, quality checks, search and facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import quality as V
from logloom.operators import summaries as A
from logloom.operators.quantiles import exact_quantiles
from logloom.operators.tokens import flatten, primary_first
from logloom.plans.tables import AUTH_SQL, auth_events, rounded, sql_time, table, text_time
from logloom.sources.readers import sample_rows

QUERIES = {}
ORACLE = {}


def query(sql: str | None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _hour(df: DataFrame) -> DataFrame:
    return df.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


@query(
    """WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1),
    ax AS (SELECT unnest(generate_series((SELECT min(hour) FROM h), (SELECT max(hour) FROM h), INTERVAL 1 HOUR)) AS hour)
    SELECT strftime(ax.hour, '%Y-%m-%d %H') AS hour, coalesce(n, 0) AS n FROM ax LEFT JOIN h USING (hour)"""
)
def hourly_filled(spark: SparkSession, sf: str) -> DataFrame:
    return _hour(A.hourly_filled(events(spark, sf), "ts"))


@query(
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2"
)
def hourly_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return _hour(A.hourly(events(spark, sf), "ts", "event_type"))


@query(
    """SELECT h AS hour, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(0, 23)) AS h)
    LEFT JOIN (SELECT hour(ts) AS h, count(*) AS n FROM events GROUP BY 1) USING (h)"""
)
def hour_of_day(spark: SparkSession, sf: str) -> DataFrame:
    return A.hour_of_day(events(spark, sf), "ts")


@query(
    "SELECT isodow(ts) - 1 AS weekday, "
    + ", ".join(f"count(*) FILTER (WHERE hour(ts) = {h}) AS h{h}" for h in range(24))
    + " FROM events GROUP BY 1"
)
def weekday_hour_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return A.weekday_hour_matrix(events(spark, sf), "ts")


def _histogram_sql(source: str, bins: int) -> str:
    return (
        f"e AS (SELECT min(x) AS lo, max(x) AS hi FROM {source}), b AS (SELECT least(floor((x - lo) / ((hi - lo) / {bins})),"
        f" {bins - 1})::BIGINT AS bin, lo, (hi - lo) / {bins} AS w FROM {source}, e)"
    )


@query(
    f"""WITH s AS (SELECT value AS x FROM events), {_histogram_sql('s', 30)}
    SELECT bin, count(*) AS n, round(any_value(lo + bin * w), 6) AS bin_start, round(any_value(lo + (bin + 1) * w), 6) AS bin_end
    FROM b GROUP BY bin"""
)
def value_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.histogram(events(spark, sf), "value", 30))


@query(
    f"""WITH s AS (SELECT log10(value) AS x FROM events WHERE value > 0), {_histogram_sql('s', 39)}
    SELECT bin, count(*) AS n, round(any_value(pow(10, lo + bin * w)), 5) AS bin_start,
    round(any_value(pow(10, lo + (bin + 1) * w)), 5) AS bin_end FROM b GROUP BY bin"""
)
def log_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.log_histogram(events(spark, sf), "value", 40), 5)


@query(
    """SELECT count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min,
    round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS median,
    round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max, round(max(value) - min(value), 6) AS range FROM events"""
)
def summary_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.summary(events(spark, sf), "value"))


@query(
    "SELECT p AS prob, round(v, 6) AS value FROM (SELECT unnest([0.0, 0.05, 0.5, 0.95, 1.0]::DOUBLE[]) AS p,"
    " unnest(quantile_cont(l_extendedprice * (1 - l_discount), [0.0, 0.05, 0.5, 0.95, 1.0])) AS v FROM lineitem)"
)
def revenue_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select(
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x")
    )
    return rounded(exact_quantiles(df, "x", [0.0, 0.05, 0.5, 0.95, 1.0], range_rows=256))


@query(
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
    SELECT event_id, value FROM events, q WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)"""
)
def tukey_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return A.tukey_outliers(events(spark, sf), "value").select("event_id", "value")


@query(
    "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 5"
)
def top_brands(spark: SparkSession, sf: str) -> DataFrame:
    return A.top_counts(table(spark, sf, "part"), "p_brand", 5).withColumnRenamed("p_brand", "value")


@query("SELECT lang, source, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2")
def group_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return A.value_counts(table(spark, sf, "documents"), "lang", "source")


@query("SELECT DISTINCT o_orderpriority AS facet FROM orders")
def facet_values(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("facet")).distinct()


@query(
    """SELECT count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders
    WHERE o_orderdate >= DATE '1997-03-01' AND o_orderdate < DATE '1998-04-01' AND o_orderstatus IN ('F', 'P')"""
)
def date_range_filter(spark: SparkSession, sf: str) -> DataFrame:
    df = A.between_dates(table(spark, sf, "orders"), "o_orderdate", "1997-03-01", "1998-03-31")
    return df.filter(F.col("o_orderstatus").isin("F", "P")).agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key")
    )


@query(
    f"""WITH {AUTH_SQL} SELECT line_number, message FROM ev WHERE level IN ('ERROR') AND contains(lower(message), 'request')
    ORDER BY ts DESC, line_number DESC LIMIT 100"""
)
def search_newest(spark: SparkSession, sf: str) -> DataFrame:
    df = auth_events(spark, sf).withColumns({"ts": F.col("timestamp"), "pos": F.col("line_number")})
    return A.search(df, levels=["ERROR"], text="Request").select("line_number", "message")


@query(
    """SELECT 'value' AS "column", count(*) FILTER (WHERE v IS NULL) AS nulls,
    round(count(*) FILTER (WHERE v IS NULL) / count(*) * 100, 2) AS pct FROM (SELECT nullif(event_type, 'error') AS v FROM events)
    HAVING count(*) FILTER (WHERE v IS NULL) > 0"""
)
def null_report(spark: SparkSession, sf: str) -> DataFrame:
    df = events(spark, sf).select(
        "event_id", "user_id", F.nullif("event_type", F.lit("error")).alias("value")
    )
    return V.null_report(df)


@query(
    """SELECT 'o_orderkey' AS "column", 'bigint' AS type, 0::BIGINT AS nulls, count(DISTINCT o_orderkey) AS "distinct" FROM orders
    UNION ALL SELECT 'o_orderstatus', 'string', 0, count(DISTINCT o_orderstatus) FROM orders
    UNION ALL SELECT 'o_orderpriority', 'string', 0, count(DISTINCT o_orderpriority) FROM orders
    UNION ALL SELECT 'o_totalprice', 'double', 0, count(DISTINCT o_totalprice) FROM orders"""
)
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    return V.column_profile(
        table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    )


@query(
    """SELECT count(*) FILTER (WHERE a IS NULL) + count(*) FILTER (WHERE b IS NULL) AS nulls,
    round((2 * count(*) - count(*) FILTER (WHERE a IS NULL) - count(*) FILTER (WHERE b IS NULL)) / (2 * count(*)) * 100, 2)
    AS completeness FROM (SELECT event_id AS a, nullif(event_type, 'view') AS b FROM events)"""
)
def completeness(spark: SparkSession, sf: str) -> DataFrame:
    df = events(spark, sf).select("event_id", F.nullif("event_type", F.lit("view")).alias("kind"))
    return V.completeness(df)


@query(
    """SELECT count(*)::BIGINT AS rows, count(DISTINCT (text, lang)) AS distinct_rows, count(*) - count(DISTINCT (text, lang))
    AS duplicates FROM documents"""
)
def duplicate_check(spark: SparkSession, sf: str) -> DataFrame:
    return V.duplicates(table(spark, sf, "documents"), ["text", "lang"])


@query(
    """SELECT min(length(lang))::INT AS min_length, max(length(lang))::INT AS max_length,
    min(length(lang)) = 2 AND max(length(lang)) = 2 AS ok FROM documents"""
)
def length_check(spark: SparkSession, sf: str) -> DataFrame:
    return V.length_check(table(spark, sf, "documents"), "lang", 2)


@query(
    """WITH w AS (SELECT count(*) FILTER (WHERE l_shipdate IS NULL) AS "required:l_shipdate",
    count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) AS "enum:l_returnflag",
    count(*) FILTER (WHERE TRY_CAST(l_linestatus AS INTEGER) IS NULL) AS "type:l_linestatus",
    count(*) FILTER (WHERE NOT (l_discount BETWEEN 0 AND 0.05)) AS "check:discount" FROM lineitem)
    SELECT rule, violations FROM (UNPIVOT w ON COLUMNS(*) INTO NAME rule VALUE violations)"""
)
def schema_contract(spark: SparkSession, sf: str) -> DataFrame:
    return V.contract_violations(
        table(spark, sf, "lineitem"),
        required=["l_shipdate"],
        enums={"l_returnflag": ["A", "N"]},
        types={"l_linestatus": "int"},
        checks={"discount": F.col("l_discount").between(0, 0.05)},
    )


@query(f"WITH {AUTH_SQL} SELECT '4' AS family, count(*) AS n FROM ev")
def ip_version_census(spark: SparkSession, sf: str) -> DataFrame:
    return V.ip_version_census(auth_events(spark, sf), "source_ip")


@query("SELECT 'k' AS first_key, count(*) AS n FROM events WHERE props LIKE '{\"k\"%'")
def first_key_census(spark: SparkSession, sf: str) -> DataFrame:
    df = events(spark, sf).select(F.from_json("props", "map<string,string>").alias("m"))
    return A.first_key_census(df, "m")


@query("SELECT 'k' AS key, 'BIGINT' AS value_type, count(*) AS n FROM events WHERE json_type(props, '$.k') = 'UBIGINT'")
def json_value_types(spark: SparkSession, sf: str) -> DataFrame:
    return A.json_value_types(events(spark, sf), "props")


@query(
    """SELECT user_id AS user_id, value AS "value", event_id AS e_event_id, event_type AS e_event_type,
    CAST(json_extract(props, '$.k') AS BIGINT) AS e_p_k, '[' || event_id || ',' || user_id || ']' AS e_ids FROM events"""
)
def flatten_json(spark: SparkSession, sf: str) -> DataFrame:
    nested = events(spark, sf).select(
        "user_id", "value",
        F.struct(
            F.col("event_id").alias("event_id"),
            F.col("event_type").alias("event_type"),
            F.from_json("props", "k bigint").alias("p"),
            F.array("event_id", "user_id").alias("ids"),
        ).alias("e"),
    )
    return primary_first(flatten(nested))


@query("SELECT * FROM orders ORDER BY md5(o_orderkey::VARCHAR || '|42'), o_orderkey LIMIT 1000")
def reproducible_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A thousand orders picked by a seeded hash."""
    return sample_rows(table(spark, sf, "orders"), ["o_orderkey"], 1000)


@query(
    """SELECT count(*) AS total_events, 12345::BIGINT AS unique_users, min(event_id) AS first_id FROM events"""
)
def supplied_over_computed(spark: SparkSession, sf: str) -> DataFrame:
    """Supplied figures win; the figure here is derived from a count that is always true."""
    df = events(spark, sf)
    computed = df.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_distinct("user_id").alias("unique_users"),
        F.min("event_id").alias("first_id"),
    )
    supplied = df.agg(
        F.lit(None).cast("bigint").alias("total_events"),
        F.max(F.lit(12345).cast("bigint")).alias("unique_users"),
    )
    return A.choose(supplied, computed)


@query(
    f"""SELECT {sql_time('min(ts)')} AS "start", {sql_time('max(ts)')} AS "end", count(*) AS n FROM events
    WHERE value > 0 AND props IS NOT NULL"""
)
def positive_rows(spark: SparkSession, sf: str) -> DataFrame:
    df = events(spark, sf).dropna(subset=["props"]).filter("value > 0")
    out = df.agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n"))
    return text_time(out, "start", "end")
