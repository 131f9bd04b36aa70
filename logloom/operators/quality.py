"""Data quality: nulls, profiles, duplicates, contracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.operators.keyed import distinct_counts
from logloom.functions.net import ip_family


def null_report(df: DataFrame) -> DataFrame:
    """Columns with nulls: count and share in percent. One pass over the table."""
    wide = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns],
    )
    return (
        wide.unpivot(["__rows"], df.columns, "column", "nulls")
        .filter("nulls > 0")
        .select("column", "nulls", F.round(F.col("nulls") / F.col("__rows") * 100, 2).alias("pct"))
    )


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Per column: type, nulls, distinct values."""
    kinds = dict(df.dtypes)
    more = {c: {"distinct": F.approx_count_distinct(c)} if approximate else {} for c in df.columns}
    wide = df.agg(
        *[
            F.struct(
                F.lit(kinds[c]).alias("type"),
                F.count_if(F.col(c).isNull()).alias("nulls"),
                *[x.alias(n) for n, x in more[c].items()],
            ).alias(c)
            for c in df.columns
        ]
    )
    long = wide.unpivot([], df.columns, "column", "p").select("column", "p.*")
    if approximate:
        return long
    counts = distinct_counts(df, df.columns)
    return long.join(counts, "column", "left").select("column", "type", "nulls", F.coalesce("distinct", F.lit(0)).alias("distinct"))


def completeness(df: DataFrame) -> DataFrame:
    """Share of filled cells in percent, and the number of empty ones."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    cells = F.count(F.lit(1)) * len(df.columns)
    return df.agg(
        nulls.alias("nulls"), F.round((cells - nulls) / cells * 100, 2).alias("completeness")
    )


def duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier row. Counted per distinct row, so copies collapse map-side."""
    copies = df.groupBy(*(columns or df.columns)).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        (F.sum("n") - F.count(F.lit(1))).alias("duplicates"),
    )


def length_check(df: DataFrame, column: str, length: int) -> DataFrame:
    """Shortest and longest text and whether all have the wanted length."""
    size = F.length(column)
    return df.agg(F.min(size).alias("min_length"), F.max(size).alias("max_length")).withColumn(
        "ok", (F.col("min_length") == length) & (F.col("max_length") == length)
    )


def column_set_check(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Expected columns that are missing and columns nobody expected."""
    rows = [(c, "missing") for c in expected if c not in df.columns]
    rows += [(c, "unexpected") for c in df.columns if c not in expected]
    return df.sparkSession.createDataFrame(rows, "column string, problem string")


def ip_version_census(df: DataFrame, column: str) -> DataFrame:
    family = F.coalesce(ip_family(F.col(column)), F.lit("invalid"))
    return df.groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("n"))


def contract_violations(
    df: DataFrame,
    required: Sequence[str] = (),
    enums: Mapping[str, Sequence[str]] | None = None,
    types: Mapping[str, str] | None = None,
    checks: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Violations per rule: required fields, enums, castable types, and own checks."""
    tests: dict[str, Column] = {f"required:{c}": F.col(c).isNull() for c in required}
    for c, allowed in (enums or {}).items():
        tests[f"enum:{c}"] = F.col(c).isNotNull() & ~F.col(c).isin(*allowed)
    for c, kind in (types or {}).items():
        tests[f"type:{c}"] = F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull()
    for name, ok in (checks or {}).items():
        tests[f"check:{name}"] = ~F.coalesce(ok, F.lit(False))
    wide = df.agg(*[F.count_if(t).alias(n) for n, t in tests.items()])
    return wide.unpivot([], list(tests), "rule", "violations")
