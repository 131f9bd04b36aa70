"""Registered queries over files written and read again, record kinds that other queries lack, and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import profiles
from logloom.functions.records import low_value
from logloom.functions.text import label
from logloom.operators import lines as L
from logloom.operators import systemlog
from logloom.operators.forest import flagged_by
from logloom.operators.keyed import count_by_key
from logloom.plans.derived_logs import _fmt, _lines
from logloom.plans.match_queries import address_ranges
from logloom.plans.tables import rounded, sql_time, table, text_time
from logloom.session import shared_folder
from logloom.sources import readers, sinks
from logloom.streaming import live

QUERIES = {}
ORACLE = {}


def query(sql: str | None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    """SELECT event_id, CASE WHEN event_id % 5 > 0 THEN event_type END AS event_type, props || ' é' AS props FROM events"""
)
def ndjson_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "ndjson")
    kind = F.when(F.col("event_id") % 5 > 0, F.col("event_type"))
    rows = table(spark, sf, "events").select("event_id", kind.alias("event_type"), F.concat("props", F.lit(" é")).alias("props"))
    sinks.write_ndjson(rows, path)
    return readers.ndjson(spark, path, "event_id long, event_type string, props string")


@query(
    """SELECT 'kept' AS part, count(*) FILTER (WHERE event_id % 3 > 0) AS n, sum(event_id) FILTER (WHERE event_id % 3 > 0)::BIGINT AS ids FROM events
    UNION ALL SELECT 'rejected', count(*) FILTER (WHERE event_id % 3 = 0), 0 FROM events"""
)
def ndjson_bad_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every third line is cut short; bad lines are dropped by one reader and listed by the other."""
    path, schema = _folder(spark, "bad-lines"), "event_id long, event_type string"
    doc = F.to_json(F.struct("event_id", "event_type"))
    line = F.when(F.col("event_id") % 3 == 0, F.substring(doc, F.lit(1), F.length(doc) - 3)).otherwise(doc)
    table(spark, sf, "events").select(line.alias("value")).write.text(path)
    kept = readers.ndjson(spark, path, schema, strict=False)
    kept = kept.agg(F.lit("kept").alias("part"), F.count("event_id").alias("n"), F.sum("event_id").alias("ids"))
    bad = readers.ndjson_rejects(spark, path, schema)
    return kept.unionByName(bad.agg(F.lit("rejected").alias("part"), F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("ids")))


@query("""SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation""")
def json_array_files(spark: SparkSession, sf: str) -> DataFrame:
    """A file with one array of objects for each region."""
    path = _folder(spark, "arrays")
    one = F.to_json(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))))
    arrays = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(one.alias("value"))
    arrays.write.partitionBy("region").text(path)
    read = readers.json_documents(spark, path, "key long, name string, region long")
    return read.select("key", "name", F.col("region").cast("long").alias("region"))


@query("""SELECT event_id, event_type, props, round(value, 6) AS value FROM events""")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "csv")
    sinks.write_csv(table(spark, sf, "events").select("event_id", "event_type", "props", "value"), path)
    return rounded(readers.csv_table(spark, path, "event_id long, event_type string, props string, value double"))


@query("""SELECT left(n_name, 3) AS country, 3 * count(*) AS n FROM nation GROUP BY 1""")
def ip_range_files(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges through gzipped CSV without a header."""
    path = _folder(spark, "ranges")
    address_ranges(spark, sf).select("ip_start", "ip_end", "country").write.option("compression", "gzip").csv(path)
    read = readers.ip_ranges(spark, path).filter("ip_start IS NOT NULL AND ip_end IS NOT NULL")
    return count_by_key(read, ["country"])


@query(
    """SELECT strftime(ts, '%Y-%m-%d') AS event_date, count(*) AS n, sum(event_id)::BIGINT AS ids, 7::INT AS n_fields FROM events GROUP BY 1"""
)
def parquet_by_day(spark: SparkSession, sf: str) -> DataFrame:
    """Events in a folder a day, with their schema beside them."""
    path = _folder(spark, "days")
    events = table(spark, sf, "events")
    sinks.write_parquet(events, path, "ts")
    sinks.write_schema(events, f"{path}-schema")
    read = spark.read.parquet(path)
    fields = F.size(F.from_json("value", "fields array<struct<name:string>>")["fields"]) + 1
    found = spark.read.text(f"{path}-schema").agg(F.max(fields).cast("int").alias("n")).scalar()
    days = read.groupBy(F.col("event_date").cast("string").alias("event_date"))
    return days.agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")).withColumn("n_fields", found)


@query(
    """SELECT 'node' || (user_id % 4) AS source, count(*)::BIGINT AS n, sum(length(props) + 3)::BIGINT AS letters, count(*)::BIGINT AS last_line FROM events GROUP BY 1"""
)
def text_file_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Text files a folder each, read and numbered again; replacement characters are dropped."""
    path = _folder(spark, "text")
    value = F.concat(F.col("props"), F.lit(" é�x"))
    source = F.concat(F.lit("node"), F.col("user_id") % 4)
    table(spark, sf, "events").select(source.alias("node"), value.alias("value")).repartition("node").write.partitionBy("node").text(path)
    numbered = L.number_lines(readers.text_lines(spark, path))
    return numbered.groupBy(F.regexp_extract("source", "node=(node[0-9]+)", 1).alias("source")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("letters"), F.max("line_no").alias("last_line")
    )


@query(
    """SELECT 'node' || (user_id % 4) AS source, event_id * 10 AS pos, event_type IN ('purchase', 'signup') AS has_xml,
    CASE event_type WHEN 'purchase' THEN 'SAML_RESPONSE' WHEN 'signup' THEN 'SAML_ASSERTION' END AS xml_type,
    CASE event_type WHEN 'purchase' THEN 'p' || event_id WHEN 'signup' THEN 'a' || event_id END AS saml_id,
    CASE event_type WHEN 'purchase' THEN 'Success' END AS saml_status, CASE event_type WHEN 'signup' THEN 'n<' || user_id END AS saml_name_id,
    event_type = 'error' AS has_stacktrace FROM events"""
)
def xml_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records with XML blocks over several lines and on one, and stack lines behind them."""
    kind, e = F.col("event_type"), F.col("event_id").cast("string")
    header = F.concat(_fmt("yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" WARN 121 --- [  exec-1] com.app.Saml : exchange "), e)
    buys, joins = kind == "purchase", kind == "signup"
    lines = _lines(
        table(spark, sf, "events"),
        [
            (0, F.lit(True), header),
            (1, buys, F.concat(F.lit('<?xml version="1.0"?><p:Response xmlns:p="urn:p" ID="p'), e, F.lit('">'))),
            (2, buys, F.lit('  <p:Status><p:StatusCode Value="urn:x:Success"/></p:Status>')),
            (3, buys, F.lit("</p:Response>")),
            (
                4, joins,
                F.concat(
                    F.lit('<saml:Assertion xmlns:saml="urn:a" ID="a'), e, F.lit('"><saml:Subject><saml:NameID>n&lt;'),
                    F.col("user_id").cast("string"), F.lit("</saml:NameID></saml:Subject></saml:Assertion>"),
                ),
            ),
            (5, kind == "error", F.lit("    at com.app.Handler.run(Handler.java:1)")),
        ],
    )
    names = ("has_xml", "xml_type", "saml_id", "saml_status", "saml_name_id", "has_stacktrace")
    return systemlog.structure(lines, profiles.SSO).select("source", "pos", *names)


@query(
    """SELECT 'node' || (user_id % 4) AS source, event_id * 10 AS pos, '2030-01-02T' || strftime(ts, '%H:%M:%S') || '.000' AS "timestamp",
    CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level, 'exec-' || user_id AS thread, 'com.app.Agent.run' AS logger,
    'got ' || event_type AS message FROM events"""
)
def agent_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Bracketed headers with a clock only, dated by a given day."""
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    text = F.concat(
        F.lit("["), level, F.lit("]["), _fmt("HH:mm:ss"), F.lit("][exec-"), F.col("user_id").cast("string"),
        F.lit("][com.app.Agent.run] - got "), F.col("event_type"),
    )
    lines = _lines(table(spark, sf, "events"), [(0, F.lit(True), text)])
    found = L.assemble(L.attach_records(lines, profiles.AGENT, base_date="2030-01-02"))
    return found.select("source", "pos", "timestamp", "level", "thread", "logger", "message")


@query(
    """WITH r AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'DEBUG' WHEN 'view' THEN 'TRACE' WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
      event_id % 4 AS form, event_id % 3 = 0 AS signed FROM events)
    SELECT event_id, CASE level WHEN 'DEBUG' THEN form IN (1, 3) WHEN 'TRACE' THEN true ELSE form = 1 END AS dropped,
      CASE WHEN signed THEN false WHEN level IN ('DEBUG', 'TRACE') THEN true ELSE form IN (1, 2) END AS dropped_earlier FROM r"""
)
def dropped_records(spark: SparkSession, sf: str) -> DataFrame:
    """What the present and the earlier rules for records of little value drop; a word inside a longer one counts as well."""
    kind, e = F.col("event_type"), F.col("event_id")
    level = F.when(kind == "click", "DEBUG").when(kind == "view", "TRACE").when(kind == "error", "ERROR").otherwise("INFO")
    message = F.element_at(F.array(*[F.lit(x) for x in ("user login", "Module DEPLOYED", "configuration read", "paid")]), (e % 4 + 1).cast("int"))
    logger = F.when(e % 3 == 0, "com.app.SignedDataVerifier").otherwise("com.app.Shop")
    return table(spark, sf, "events").select(
        "event_id",
        low_value(level, message, logger, profiles.SSO).alias("dropped"),
        low_value(level, message, logger, profiles.SIGNATURE_EARLIER).alias("dropped_earlier"),
    )


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'Seen' WHEN 'error' THEN 'Failed' ELSE event_type END AS shown FROM events""")
def event_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", label(F.col("event_type"), {"view": "Seen", "error": "Failed"}).alias("shown"))


@query("""SELECT source, lang, count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE quality = 0 GROUP BY ALL""")
def flagged_by_group(spark: SparkSession, sf: str) -> DataFrame:
    flags = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 0).alias("is_anomaly"))
    return flagged_by(flags.join(table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id"), "source", "lang")


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")  # a pattern: the table may be a file or a folder


def _run(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """What a stream has appended once it has read all that is there."""
    path = _folder(spark, name)
    sink = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


_PASSED = "(SELECT max(date_trunc('millisecond', ts)) - INTERVAL 1 HOUR FROM events)"


@query(
    f"""SELECT {sql_time("date_trunc('hour', ts)")} AS hour, event_type, count(*) AS n FROM events GROUP BY ALL
    HAVING date_trunc('hour', any_value(ts)) + INTERVAL 1 HOUR <= {_PASSED}"""
)
def stream_hourly_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Hours that a watermark of one hour has closed."""
    events = _stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return text_time(_run(spark, live.hourly_counts(events, "ts", "event_type", late="1 hour"), "hours"), "hour")


@query(
    f"""WITH e AS (SELECT user_id, ts, event_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER w AS pus, lag(event_id) OVER w AS pstep FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    d AS (SELECT *, pus IS NULL OR us - pus > 7200000000 AS anew FROM e)
    SELECT 'u' || user_id AS session_id, {sql_time("ts")} AS "timestamp", event_id AS step_id,
    CASE WHEN anew THEN 0.0 ELSE round((us - pus) / 1000.0, 3) END AS delta_ms, CASE WHEN anew THEN 1 ELSE event_id - pstep END AS step_gap
    FROM d WHERE ts <= {_PASSED}"""
)
def stream_session_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Steps of users' sessions, in the order of time, as far as the watermark has passed."""
    events = _stream(spark, sf).select(
        F.concat(F.lit("u"), "user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_id").alias("step_id")
    )
    found = _run(spark, live.session_deltas(events, idle_ms=7_200_000), "deltas")
    return text_time(found.withColumn("delta_ms", F.round("delta_ms", 3)), "timestamp")


@query(
    f"""WITH e AS (SELECT user_id, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000000.0 AS gap FROM events)
    SELECT 'u' || user_id AS user_name, {sql_time("ts")} AS ts, round(gap, 6) AS interval_seconds, gap < 300 AS rapid, gap > 7200 AS delayed FROM e
    WHERE (gap < 300 OR gap > 7200) AND gap <= 86400 AND ts <= {_PASSED}"""
)
def stream_signature_alerts(spark: SparkSession, sf: str) -> DataFrame:
    events = _stream(spark, sf).select(F.concat(F.lit("u"), "user_id").alias("user_name"), F.col("ts").cast("timestamp").alias("ts"))
    found = _run(spark, live.signature_alerts(events, 300.0, 7200.0), "alerts")
    return text_time(rounded(found), "ts")
