"""Matching the two sides of a transaction and the report on the matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.times import seconds_between
from logloom.operators.keyed import outer_match
from logloom.operators.quantiles import quantile_row


def match_requests(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests and responses joined on ``request_id = in_response_to``; both sides kept.

    ``requests`` has ``request_id, request_timestamp, ...`` and ``responses`` has
    ``response_id, response_timestamp, in_response_to, ...``.
    """
    both = outer_match(requests, responses, "request_id", "in_response_to")
    return both.withColumn(
        "transaction_duration",
        seconds_between(F.col("response_timestamp"), F.col("request_timestamp")),
    )


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: per column the first non-null value in line order."""
    at = F.struct(*order)
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in rest]
    )


def match_sides(idp: DataFrame, sp: DataFrame, raw_rows: bool = False) -> DataFrame:
    """Identity-provider and service-provider rows of the same id, with a status label.

    Columns are prefixed ``idp_`` and ``sp_``, keys are ``idp_id`` and ``sp_id``. Each
    side is first reduced to one row per id, unless ``raw_rows`` asks for every pair.
    Rows without an id belong to no sequence.
    """
    idp, sp = idp.filter("idp_id IS NOT NULL"), sp.filter("sp_id IS NOT NULL")
    if not raw_rows:
        idp = first_per_key(idp, "idp_id", ["idp_file", "idp_line"])
        sp = first_per_key(sp, "sp_id", ["sp_file", "sp_line"])
    both = outer_match(idp, sp, "idp_id", "sp_id")
    return both.withColumn("sp_id", F.coalesce("sp_id", "idp_id")).drop("idp_id").withColumn(
        "sequence_status", sequence_status()
    )


def sequence_status() -> Column:
    """Fixed labels: error, one-sided, completed, unknown."""
    idp, sp = F.col("idp_ts").isNotNull(), F.col("sp_ts").isNotNull()
    return (
        F.when(
            F.col("idp_error").isNotNull() & ~sp,
            F.concat(F.lit("IDP ERROR: "), F.col("idp_error"), F.lit(" (unmatched)")),
        )
        .when(idp & ~sp, "IdP-only (unmatched)")
        .when(sp & ~idp, "SP-only (unmatched)")
        .when(idp & sp & F.contains(F.lower("sp_status"), F.lit("success")), "Completed")
        .otherwise("Unknown")
    )


def duration(start: Column, end: Column) -> Column:
    """Seconds from start to end, null when negative."""
    d = seconds_between(end, start)
    return F.when(d >= 0, d)


def enrich_matches(matches: DataFrame) -> DataFrame:
    """Representative values, duration and the completed / unmatched flags."""
    idp_ts, sp_ts = F.col("idp_ts"), F.col("sp_ts")
    return matches.withColumns(
        {
            "ts_any": F.coalesce(sp_ts, idp_ts),
            "duration_sec": F.coalesce(
                duration(F.col("idp_issue_instant"), F.col("sp_issue_instant")),
                duration(idp_ts, sp_ts),
            ),
            "provider_any": F.coalesce("sp_provider", "idp_provider", F.lit("Unknown")),
            "agent_any": F.coalesce("sp_agent", F.lit("Unknown")),
            "is_completed": F.coalesce(F.contains(F.lower("sp_status"), F.lit("success")), F.lit(False)),
            "is_unmatched": idp_ts.isNull() != sp_ts.isNull(),
        }
    )


def select_matches(
    matches: DataFrame,
    first: str | None = None,
    final: str | None = None,
    providers: list[str] | None = None,
    agents: list[str] | None = None,
    statuses: list[str] | None = None,
) -> DataFrame:
    """Report filters: whole days inclusive, and value lists."""
    out = matches
    if first:
        out = out.filter(F.col("ts_any") >= F.lit(first).cast("timestamp"))
    if final:
        out = out.filter(F.col("ts_any") < F.date_add(F.lit(final).cast("date"), 1).cast("timestamp"))
    for column, wanted in (
        ("provider_any", providers),
        ("agent_any", agents),
        ("sequence_status", statuses),
    ):
        if wanted:
            out = out.filter(F.col(column).isin(*wanted))
    return out


def match_kpis(matches: DataFrame) -> DataFrame:
    """Totals, success rate, and average, median and 95th percentile duration."""
    q = quantile_row(matches, "duration_sec", {"median": 0.5, "p95": 0.95})
    quantiles = q.select(F.struct("median", "p95")).scalar()
    totals = matches.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_completed").alias("completed"),
        F.count_if("is_unmatched").alias("unmatched"),
        F.avg("duration_sec").alias("avg_duration"),
    )
    return totals.withColumn("__q", quantiles).select(
        "total",
        "completed",
        (F.col("total") - F.col("completed")).alias("not_completed"),
        "unmatched",
        F.try_divide(F.col("completed") * 100.0, F.col("total")).alias("success_rate"),
        "avg_duration",
        F.col("__q.median").alias("median_duration"),
        F.col("__q.p95").alias("p95_duration"),
    )


def completed_label() -> Column:
    return F.when(F.col("is_completed"), "Completed").otherwise("Not Completed")


def completion_trend(matches: DataFrame, zone: str = "Asia/Seoul") -> DataFrame:
    """Matches per local hour, completed or not."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("ts_any").cast("timestamp_ntz"))
    hour = F.date_format(F.date_trunc("hour", local), "yyyy-MM-dd HH:00")
    return matches.filter(F.col("ts_any").isNotNull()).groupBy(
        hour.alias("hour"), completed_label().alias("completed_flag")
    ).agg(F.count(F.lit(1)).alias("n"))


def completion_by(matches: DataFrame, column: str) -> DataFrame:
    return matches.groupBy(column, completed_label().alias("completed_flag")).agg(
        F.count(F.lit(1)).alias("n")
    )


def success_rate_by(matches: DataFrame, column: str) -> DataFrame:
    return matches.groupBy(column).agg(
        F.round(F.avg(F.col("is_completed").cast("int")) * 100, 2).alias("success_rate")
    )


def slowest(matches: DataFrame, n: int = 15) -> DataFrame:
    return (
        matches.filter(F.col("duration_sec").isNotNull())
        .orderBy(F.desc("duration_sec"), "sp_id")
        .limit(n)
    )


def unmatched(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of ``left`` without a partner."""
    return left.join(right, left[left_key] == right[right_key], "left_anti")
