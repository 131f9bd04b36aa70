"""Addresses in country ranges, and country names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.net import ip_sort_key
from logloom.operators.keyed import attach_by_key, count_by_key
from logloom.session import durable

# Codes outside the standard list, and their names.
NAME_OVERRIDES = {
    "UK": "영국",
    "EU": "유럽 연합",
    "XK": "코소보",
    "ZZ": "미할당",
    "XX": "알 수 없음",
}
UNKNOWN = "알 수 없음"
NO_INFO = "정보 없음"


_PLACED = "start string, until string, country string"


def _open_at_end(part: pd.DataFrame) -> pd.DataFrame:
    """Of the ranges that begin in a chunk those no later and farther one makes needless."""
    stack: list[tuple] = []
    for r in part.sort_values(["start", "until"], ascending=[True, False]).itertuples(index=False):
        while stack and stack[-1].until <= r.until:
            stack.pop()
        stack.append(r)
    return pd.DataFrame(stack, columns=part.columns)


def _sweep(part: pd.DataFrame) -> pd.DataFrame:
    """The innermost open range at each address of a chunk; ranges come before addresses at the same place."""
    part = part.sort_values(["key", "kind", "until"], ascending=[True, True, False], na_position="last")
    stack: list[tuple[str, str | None]] = []
    keys, countries = [], []
    for kind, key, until, country in zip(part["kind"], part["key"], part["until"], part["country"]):
        while stack and stack[-1][0] < key:
            stack.pop()
        if kind:
            keys.append(key)
            countries.append(stack[-1][1] if stack else None)
        else:
            while stack and stack[-1][0] <= until:
                stack.pop()
            stack.append((until, country))
    return pd.DataFrame({"key": keys, "country": countries}, dtype=object)


def placed_addresses(keys: DataFrame, ranges: DataFrame, chunk_rows: int = 50_000) -> DataFrame:
    """``key, country`` of distinct address keys: a sweep over addresses and range ends in one order.

    The order is cut into chunks of some ``chunk_rows`` rows whatever the addresses are. A range that reaches
    beyond its chunk enters every chunk up to the one of its end, unless a range that begins later in the
    same chunk reaches as far; so a chunk starts with the stack of ranges open there, which
    is as deep as ranges are nested.
    """
    named = lambda c: F.concat(F.when(F.length(c) == 8, "4").otherwise("6"), c)
    bounds = ranges.select(
        named(ip_sort_key(F.col("ip_start"))).alias("start"), named(ip_sort_key(F.col("ip_end"))).alias("until"), "country"
    )
    bounds = bounds.filter("start <= until AND left(start, 1) = left(until, 1)")
    bounds = bounds.groupBy("start", "until").agg(F.min("country").alias("country"))
    none = F.lit(None).cast("string")
    rows = (
        keys.select(named(F.col("key")).alias("key"), F.lit(1).alias("kind"), none.alias("start"), none.alias("until"), none.alias("country"))
        .unionByName(bounds.select(F.col("start").alias("key"), F.lit(0).alias("kind"), "start", "until", "country"))
        .unionByName(bounds.select(F.col("until").alias("key"), F.lit(2).alias("kind"), "start", "until", none.alias("country")))
    )
    rows = durable(rows)
    parts = max(1, -(-rows.count() // chunk_rows))
    laid = durable(rows.repartitionByRange(parts, "key").withColumn("chunk", F.spark_partition_id()))
    starts = laid.filter("kind = 0").select("chunk", "start", "until", "country")
    ends = laid.filter("kind = 2").select("start", "until", F.col("chunk").alias("last"))
    beyond = starts.join(ends, ["start", "until"]).filter("last > chunk")
    shape = "chunk int, " + _PLACED + ", last int"
    kept = beyond.select("chunk", "start", "until", "country", "last").groupBy("chunk").applyInPandas(_open_at_end, shape)
    seeds = kept.select(
        F.explode(F.sequence(F.col("chunk") + 1, F.col("last"))).alias("chunk"), F.col("start").alias("key"),
        F.lit(0).alias("kind"), "until", "country",
    )
    here = laid.filter("kind < 2").select("chunk", "key", "kind", "until", "country").unionByName(seeds)
    swept = here.groupBy("chunk").applyInPandas(lambda p: _sweep(p), "key string, country string")
    return swept.select(F.substring("key", 2, 32).alias("key"), "country")


def country_of_ip(events: DataFrame, ranges: DataFrame, ip: str = "source_ip", chunk_rows: int = 50_000) -> DataFrame:
    """Add ``country``: that of the innermost range that holds the address, null when none does.

    Of several ranges that hold an address the one with the latest start counts, then that with the
    earliest end, so nested and overlapping ranges of both families may be mixed. Distinct addresses are placed once
    and hot ones get their result back by broadcast. Rows with a null or invalid address pass by.
    """
    key = ip_sort_key(F.col(ip))
    keyed = events.withColumn("__key", key)
    counts = durable(count_by_key(keyed.filter("__key IS NOT NULL"), ["__key"]))
    found = placed_addresses(counts.select(F.col("__key").alias("key")), ranges, chunk_rows)
    placed = durable(counts.join(found.withColumnRenamed("key", "__key"), "__key"))
    known = attach_by_key(keyed.filter("__key IS NOT NULL"), placed, ["__key"], ["country"])
    others = keyed.filter("__key IS NULL").withColumn("country", F.lit(None).cast("string"))
    return known.unionByName(others).drop("__key")


def country_names(df: DataFrame, names: DataFrame, code: str = "country") -> DataFrame:
    """Add ``country_name`` from a ``(code, name)`` dimension.

    Null codes read "no info", codes without a name "unknown(code)"; of several names of a
    code the first in order counts. Only the distinct codes meet the dimension, their names
    come back to the rows as per-key results.
    """
    dim = names.groupBy(F.upper(F.trim("code")).alias("__code")).agg(F.min("name").alias("__name"))
    used = count_by_key(df.select(code), [code])
    named = used.join(dim, F.upper(F.trim(F.col(code))) == F.col("__code"), "left")
    name = (
        F.when(F.col(code).isNull(), F.lit(NO_INFO))
        .when(F.col("__name").isNotNull(), F.col("__name"))
        .otherwise(F.concat(F.lit(f"{UNKNOWN}("), F.col(code), F.lit(")")))
    )
    return attach_by_key(df, named.select(code, "n", name.alias("country_name")), [code], ["country_name"])


def name_overrides(df: DataFrame) -> DataFrame:
    """The fixed extra codes as a ``(code, name)`` table, to union with a dimension."""
    return df.sparkSession.createDataFrame(list(NAME_OVERRIDES.items()), "code string, name string")


def conversion_report(named: DataFrame, code: str = "country") -> DataFrame:
    """Rows per code that got a name or none."""
    known = ~F.col("country_name").startswith(f"{UNKNOWN}(")
    return (
        named.filter(F.col(code).isNotNull())
        .groupBy(F.upper(F.trim(F.col(code))).alias("code"), known.alias("converted"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def unmapped_codes(df: DataFrame, names: DataFrame, code: str = "country") -> DataFrame:
    """Codes in use that the dimension does not know."""
    used = df.filter(F.col(code).isNotNull()).select(F.upper(F.trim(F.col(code))).alias("code")).distinct()
    return used.join(names.select(F.upper(F.trim("code")).alias("code")), "code", "left_anti")
