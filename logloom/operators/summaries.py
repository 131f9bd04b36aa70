"""Aggregates behind the reports: counts, time buckets, histograms, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.net import simple_country
from logloom.functions.times import calendar
from logloom.operators.keyed import distinct_counts
from logloom.operators.quantiles import quantile_row


def value_counts(df: DataFrame, *by: str, keep_null: bool = False) -> DataFrame:
    """Rows per value (or per combination of values)."""
    rows = df if keep_null else df.dropna(subset=list(by))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def top_counts(df: DataFrame, by: str, n: int) -> DataFrame:
    """The ``n`` most frequent values; equal counts are ordered by value."""
    return value_counts(df, by).orderBy(F.desc("n"), F.col(by)).limit(n)


def hourly_filled(df: DataFrame, ts: str) -> DataFrame:
    """Rows per hour from the first to the last hour, empty hours as 0.

    The hour axis grows with the time span only, never with the rows.
    """
    counts = hourly(df, ts)
    ends = counts.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    axis = ends.filter(F.col("lo").isNotNull()).select(
        F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias("hour")
    )
    return axis.join(counts, "hour", "left").select(
        "hour", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def hourly(df: DataFrame, ts: str, *by: str) -> DataFrame:
    """Rows per hour (and further columns), empty hours left out."""
    hour = F.date_trunc("hour", F.col(ts))
    return (
        df.filter(F.col(ts).isNotNull())
        .groupBy(hour.alias("hour"), *by)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def hour_of_day(df: DataFrame, ts: str) -> DataFrame:
    """Rows per hour of day, all 24 hours present."""
    counts = df.groupBy(F.hour(ts).cast("bigint").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    hours = df.sparkSession.range(24).withColumnRenamed("id", "hour")
    return hours.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def weekday_hour_matrix(df: DataFrame, ts: str) -> DataFrame:
    """Seven rows (Monday = 0) with one count column per hour, ``h0`` to ``h23``."""
    day, hour = F.weekday(ts).cast("bigint"), F.hour(ts)
    counts = df.groupBy(day.alias("weekday")).agg(
        *[F.count_if(hour == h).alias(f"h{h}") for h in range(24)]
    )
    days = df.sparkSession.range(7).withColumnRenamed("id", "weekday")
    return days.join(counts, "weekday", "left").na.fill(0)


def severity_bin(score: Column) -> Column:
    """Bins (0,30], (30,60], (60,90], (90,100]; anything else is null."""
    return (
        F.when((score > 0) & (score <= 30), "0-30")
        .when((score > 30) & (score <= 60), "30-60")
        .when((score > 60) & (score <= 90), "60-90")
        .when((score > 90) & (score <= 100), "90-100")
    )


def level_by_severity(df: DataFrame) -> DataFrame:
    return df.groupBy("level", severity_bin(F.col("severity_score")).alias("severity_bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between the extremes; the largest value joins the last bin."""
    x = F.col(column).cast("double")
    rows = df.select(x.alias("x")).filter(F.col("x").isNotNull())
    ends = rows.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    width = (ends["hi"] - ends["lo"]) / bins
    at = F.when(
        width > 0, F.least(F.floor((F.col("x") - ends["lo"]) / width), F.lit(bins - 1))
    ).otherwise(F.lit(0))
    return (
        rows.groupBy(at.cast("bigint").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumns(
            {
                "bin_start": ends["lo"] + F.col("bin") * width,
                "bin_end": ends["lo"] + (F.col("bin") + 1) * width,
            }
        )
    )


def log_histogram(df: DataFrame, column: str, edges: int = 40) -> DataFrame:
    """Histogram of the positive values between ``edges`` log-spaced edges."""
    x = F.col(column).cast("double")
    logged = df.filter(x > 0).select(F.log10(x).alias("log_x"))
    out = histogram(logged, "log_x", edges - 1)
    return out.select(
        "bin",
        "n",
        F.pow(F.lit(10.0), "bin_start").alias("bin_start"),
        F.pow(F.lit(10.0), "bin_end").alias("bin_end"),
    )


def summary(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, deviation, extremes, quartiles and range of a numeric column."""
    x = F.col(column)
    moments = df.agg(
        F.count(x).alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).cast("double").alias("min"),
        F.max(x).cast("double").alias("max"),
    )
    quarts = quantile_row(df, column, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    q = quarts.select(F.struct("q25", "median", "q75")).scalar()
    return moments.withColumn("__q", q).select(
        "count", "mean", "std", "min",
        F.col("__q.q25").alias("q25"),
        F.col("__q.median").alias("median"),
        F.col("__q.q75").alias("q75"),
        "max",
        (F.col("max") - F.col("min")).alias("range"),
    )


def above_quantile(df: DataFrame, column: str, prob: float) -> DataFrame:
    """Rows strictly above a quantile of the column."""
    cut = quantile_row(df, column, {"q": prob}).scalar()
    return df.filter(F.col(column) > cut)


def tukey_outliers(df: DataFrame, column: str) -> DataFrame:
    """Rows outside the fences at 1.5 interquartile ranges."""
    fences = tukey_fences(df, column).select(F.struct("low", "high")).scalar()
    marked = df.withColumn("__f", fences)
    x = F.col(column)
    return marked.filter((x < F.col("__f.low")) | (x > F.col("__f.high"))).drop("__f")


def tukey_fences(df: DataFrame, column: str) -> DataFrame:
    """One row ``(low, high)``."""
    q = quantile_row(df, column, {"q25": 0.25, "q75": 0.75})
    iqr = F.col("q75") - F.col("q25")
    return q.select((F.col("q25") - 1.5 * iqr).alias("low"), (F.col("q75") + 1.5 * iqr).alias("high"))


def pattern_counts(events: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Rows with each flag set and their share in percent; patterns that occur only."""
    total = F.count(F.lit(1))
    wide = events.agg(total.alias("total"), *[F.count_if(F.col(f) > 0).alias(f) for f in flags])
    return (
        wide.unpivot(["total"], list(flags), "pattern", "n")
        .filter("n > 0")
        .select("pattern", "n", F.round(F.col("n") / F.col("total") * 100, 2).alias("ratio"))
    )


def pattern_counts_by_hour(events: DataFrame, ts: str, flags: Sequence[str]) -> DataFrame:
    """Rows per hour and pattern, counted wide first so that rows are not multiplied."""
    wide = events.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(
        *[F.count_if(F.col(f) > 0).alias(f) for f in flags]
    )
    return wide.unpivot(["hour"], list(flags), "pattern", "n").filter("n > 0")


def user_activity(events: DataFrame, anomaly: Column, n: int = 10) -> DataFrame:
    """The users with the most events, with their anomalous events."""
    return (
        events.filter(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("total_events"), F.sum(anomaly).alias("anomaly_events"))
        .orderBy(F.desc("total_events"), "user_id")
        .limit(n)
    )


def internal_external(events: DataFrame) -> DataFrame:
    """Events from internal (1) and external (0) addresses."""
    return events.groupBy("source_ip_is_internal").agg(F.count("source_ip").alias("n"))


def top_addresses(events: DataFrame, n: int = 12) -> DataFrame:
    return (
        value_counts(events, "source_ip", "source_ip_is_internal")
        .orderBy(F.desc("n"), "source_ip")
        .limit(n)
    )


def country_counts(events: DataFrame, country: Column | None = None) -> DataFrame:
    """Events per country; without a country column the simple address rule is used."""
    code = country if country is not None else simple_country(F.col("source_ip"))
    return events.groupBy(code.alias("country")).agg(F.count(F.lit(1)).alias("n"))


def overview(events: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows, distinct sessions, users and addresses, and the time range."""
    names = {"session_id": "unique_sessions", "user_id": "unique_users", "source_ip": "unique_ips"}
    range_ = [F.min("timestamp").alias("start"), F.max("timestamp").alias("end")]
    total = F.count(F.lit(1)).alias("total_events")
    if approximate:
        return events.agg(total, *[F.approx_count_distinct(c).alias(n) for c, n in names.items()], *range_)
    found = distinct_counts(events, list(names))
    wide = found.agg(*[F.coalesce(F.max(F.when(F.col("column") == c, F.col("distinct"))), F.lit(0)).alias(n) for c, n in names.items()])
    # two rows, one of totals and one of distinct counts, become one
    both = events.agg(total, *range_).unionByName(wide, allowMissingColumns=True)
    order = ("total_events", *names.values(), "start", "end")
    return both.agg(*[F.max(c).alias(c) for c in order])


def session_kpis(scored: DataFrame, high_risk: float = 1.0) -> DataFrame:
    """Mean length, events and failures of sessions, share of success and of high risk."""
    return scored.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        (F.avg((F.col("is_successful") == 1).cast("int")) * 100).alias("success_rate"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.avg("n_events").alias("avg_events"),
        F.avg("n_failures").alias("avg_failures"),
        F.avg("anomaly_score_final").alias("avg_anomaly_score"),
        F.count_if(F.col("anomaly_score_final") > high_risk).alias("high_anomaly_sessions"),
        (F.avg((F.col("anomaly_score_final") > high_risk).cast("int")) * 100).alias("high_risk_pct"),
    )


def sessions_by_start_hour(scored: DataFrame) -> DataFrame:
    return scored.groupBy("start_hour").agg(
        F.bround(F.avg("is_successful"), 3).alias("success_rate"),
        F.bround(F.avg("anomaly_score_final"), 3).alias("avg_score"),
        F.count(F.lit(1)).alias("n_sessions"),
    )


def failed_sessions(scored: DataFrame) -> DataFrame:
    return scored.filter("is_successful = 0").agg(
        F.count(F.lit(1)).alias("n_failed"),
        F.avg("anomaly_score_final").alias("avg_score"),
        F.avg("n_failures").alias("avg_failures"),
    )


def session_durations(scored: DataFrame) -> DataFrame:
    """Short session id, duration, outcome and number of events."""
    return scored.select(
        F.right("session_id", F.lit(8)).alias("session_suffix"),
        F.round("duration_ms", 0).alias("duration_ms"),
        F.when(F.col("is_successful") == 1, "success").otherwise("failure").alias("outcome"),
        "n_events",
    )


def binary_splits(events: DataFrame, zone: str | None = None) -> DataFrame:
    """Business against other hours, weekend against weekday."""
    cal = calendar(F.col("timestamp"), zone)
    wide = events.select(
        cal["ts_is_business_hours"].alias("b"), cal["ts_is_weekend"].alias("w")
    ).agg(
        F.count_if(F.col("b") == 1).alias("business_hours"),
        F.count_if(F.col("b") == 0).alias("other_hours"),
        F.count_if(F.col("w") == 1).alias("weekend"),
        F.count_if(F.col("w") == 0).alias("weekday"),
    )
    return wide.unpivot([], wide.columns, "split", "n")


def outcome_split(sessions: DataFrame) -> DataFrame:
    """Sessions that succeeded against those that did not."""
    outcome = F.when(F.col("is_successful") == 1, "success").otherwise("failure")
    return sessions.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def headline(records: DataFrame) -> DataFrame:
    """Counters of a log dashboard: all, severe, errors and warnings, license issues."""
    has_status = "license_status" in records.columns
    issue = (
        F.col("license_status").isin("EXPIRED", "INVALID")
        if has_status
        else F.col("log_category") == "LICENSE"
    )
    return records.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("severity_score") >= 90).alias("high_severity"),
        F.count_if(F.col("level").isin("ERROR", "WARN")).alias("error_warn"),
        F.count_if(issue).alias("license_issues"),
    )


def domain_summary(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of each value of several columns as ``(field, value, n)``."""
    pair = lambda c: F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))
    pairs = records.select(F.explode(F.array(*[pair(c) for c in columns])).alias("p")).select("p.*")
    return pairs.filter("value IS NOT NULL").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def first_key_census(df: DataFrame, column: str) -> DataFrame:
    """Rows per first key of a map column."""
    key = F.get(F.map_keys(column), F.lit(0))
    return df.filter(F.size(column) > 0).groupBy(key.alias("first_key")).agg(
        F.count(F.lit(1)).alias("n")
    )


def json_value_types(df: DataFrame, column: str) -> DataFrame:
    """Rows per top-level key and JSON type of its value, for JSON text."""
    pairs = df.select(
        F.explode(F.from_json(column, "map<string,variant>")).alias("key", "value")
    )
    return pairs.groupBy("key", F.schema_of_variant("value").alias("value_type")).agg(
        F.count(F.lit(1)).alias("n")
    )


def first_seen(df: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values with the place of their first row and their count.

    Rank among first places is a running count over the distinct values only.
    """
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(
        F.min(order).alias("first_at"), F.count(F.lit(1)).alias("n")
    )


def choose(supplied: DataFrame, computed: DataFrame) -> DataFrame:
    """One-row KPIs where supplied values win over computed ones."""
    given = supplied.select(F.struct(*supplied.columns)).scalar()
    return computed.withColumn("__s", given).select(
        *[
            F.coalesce(F.col(f"__s.{c}"), F.col(c)).alias(c) if c in supplied.columns else F.col(c)
            for c in computed.columns
        ]
    )


def anomaly_families(records: DataFrame, rare_below: int = 10) -> dict[str, Column]:
    """Rule-based families as boolean columns (the length family needs ``tukey_fences``)."""
    bad = F.col("level").isin("ERROR", "WARN")
    license_issue = (
        F.col("license_status").isin("EXPIRED", "INVALID")
        if "license_status" in records.columns
        else F.col("log_category") == "LICENSE"
    )
    return {
        "high_severity": F.col("severity_score") >= 90,
        "with_stacktrace": F.col("has_stacktrace"),
        "error_warn": bad,
        "license_issues": F.coalesce(license_issue, F.lit(False)),
        "saml_errors": (F.col("log_category") == "SAML") & bad,
        "crypto_errors": (F.col("log_category") == "CRYPTO") & bad,
        "low_frequency": F.col("template_frequency") < rare_below,
    }


def flag_anomalies(records: DataFrame, rare_below: int = 10) -> DataFrame:
    """All families as columns, including message lengths outside the fences."""
    fences = tukey_fences(records, "message_len").select(F.struct("low", "high")).scalar()
    size = F.col("message_len")
    return (
        records.withColumn("__f", fences)
        .withColumns(
            {
                **anomaly_families(records, rare_below),
                "outlier_length": (size < F.col("__f.low")) | (size > F.col("__f.high")),
            }
        )
        .drop("__f")
    )


FAMILIES = (
    "high_severity", "with_stacktrace", "error_warn", "license_issues",
    "saml_errors", "crypto_errors", "low_frequency", "outlier_length",
)


def family_counts(flagged: DataFrame) -> DataFrame:
    wide = flagged.agg(*[F.count_if(F.col(f)).alias(f) for f in FAMILIES])
    return wide.unpivot([], list(FAMILIES), "family", "n")


def newest_anomalies(flagged: DataFrame, families: Sequence[str], n: int = 10) -> DataFrame:
    """The newest records in any of the families (a record counts once)."""
    hit = F.lit(False)
    for f in families:
        hit = hit | F.col(f)
    return flagged.filter(hit).orderBy(F.desc("ts"), F.desc("pos")).limit(n)


def search(
    records: DataFrame,
    levels: Sequence[str] | None = None,
    loggers: Sequence[str] | None = None,
    min_severity: int | None = None,
    categories: Sequence[str] | None = None,
    saml_types: Sequence[str] | None = None,
    text: str | None = None,
    n: int = 100,
) -> DataFrame:
    """Faceted search: newest ``n`` records that fit all given facets."""
    out = records
    for column, wanted in (
        ("level", levels),
        ("logger", loggers),
        ("log_category", categories),
        ("saml_type", saml_types),
    ):
        if wanted:
            out = out.filter(F.col(column).isin(*wanted))
    if min_severity is not None:
        out = out.filter(F.col("severity_score") >= min_severity)
    if text:
        out = out.filter(F.contains(F.lower("message"), F.lit(text.lower())))
    return out.orderBy(F.desc("ts"), F.desc("pos")).limit(n)


def between_dates(df: DataFrame, ts: str, first: str, final: str) -> DataFrame:
    """Rows from the start of ``first`` to the end of ``final``; pushes down to the scan."""
    kind = dict(df.dtypes)[ts]
    low = F.lit(first).cast(kind)
    high = F.date_add(F.lit(final).cast("date"), 1).cast(kind)
    return df.filter((F.col(ts) >= low) & (F.col(ts) < high))
