"""Feature vectors of two-sided transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.times import seconds_between
from logloom.operators.keyed import attach_by_key
from logloom.operators.ordered import scan_some, time_chunk
from logloom.session import durable


def transaction_features(
    tx: DataFrame, one_hot: dict[str, str], levels: dict[str, Sequence[str | None]] | None = None
) -> tuple[DataFrame, list[str]]:
    """Numeric features per transaction and their names.

    ``tx`` has ``request_id, request_timestamp, response_id, status_code,
    transaction_duration`` and the columns to encode. ``one_hot`` maps such a column to
    the prefix of its indicator columns; missing values get the level ``nan``. ``levels``
    names the levels of a column (None for missing values); a column whose levels aren't named becomes one
    map ``<prefix>level`` from the row's level to 1, so that their number doesn't matter.
    """
    tx = durable(tx)  # scanned, counted by hour and averaged: matched once
    ts = F.col("request_timestamp")
    chunked = tx.withColumn("__chunk", time_chunk(ts, "10 minutes"))
    # rows without a time have no predecessor
    scanned = scan_some(
        chunked,
        ts.isNotNull(),
        [],
        ["__chunk"],
        [ts, F.col("request_id"), F.col("response_id")],
        last={"__prev": ts},
    ).drop("__chunk")
    per_hour = (
        tx.groupBy(F.date_trunc("hour", ts).alias("__hour"))
        .agg(F.count("request_timestamp").alias("hourly_transaction_count"), F.count(F.lit(1)).alias("n"))
    )
    df = attach_by_key(
        scanned.withColumn("__hour", F.date_trunc("hour", ts)), per_hour, ["__hour"], ["hourly_transaction_count"]
    )
    moments = tx.agg(
        F.struct(
            F.avg("transaction_duration").alias("m"), F.stddev_samp("transaction_duration").alias("s")
        )
    ).scalar()
    hour, day = F.hour(ts), F.weekday(ts)
    named = {
        "hour": hour,
        "minute": F.minute(ts),
        "day_of_week": day,
        "is_weekend": day.isin(5, 6).cast("int"),
        "is_business_hours": hour.between(9, 17).cast("int"),
        "is_complete": (F.col("request_id").isNotNull() & F.col("response_id").isNotNull()).cast("int"),
        "is_success": F.contains(F.col("status_code"), F.lit("Success")).cast("int"),
        "transaction_duration_filled": F.col("transaction_duration"),
        "request_id_length": F.length(F.col("request_id").cast("string")),
        "response_id_length": F.length(F.col("response_id").cast("string")),
        "time_since_last": seconds_between(ts, F.col("__prev")),
        "hourly_transaction_count": F.col("hourly_transaction_count"),
        "duration_z_score": F.try_divide(F.col("transaction_duration") - F.col("__m.m"), F.col("__m.s")),
    }
    maps = []
    for column, prefix in one_hot.items():
        if column not in (levels or {}):
            maps.append(F.create_map(F.coalesce(F.col(column).cast("string"), F.lit("nan")), F.lit(1)).alias(f"{prefix}level"))
            continue
        for level in levels[column]:
            hit = F.col(column).isNull() if level is None else F.col(column).eqNullSafe(F.lit(level))
            named[f"{prefix}{'nan' if level is None else level}"] = hit.cast("int")
    keep = [c for c in tx.columns if c not in named]
    out = df.withColumn("__m", moments).select(
        *keep, *maps, *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in named.items()]
    )
    return out, list(named)

