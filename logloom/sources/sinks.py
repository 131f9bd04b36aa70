"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_ndjson(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line; null fields are left out, non-ASCII text is kept."""
    df.write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, ts: str | None = None, mode: str = "overwrite") -> None:
    """Parquet, one folder per event day when a time column is named."""
    if ts is None:
        df.write.mode(mode).parquet(path)
        return
    dated = df.withColumn("event_date", F.to_date(ts))
    # rows of a day are spread over several files by their hash, then sorted for pruning
    dated.repartition("event_date", F.pmod(F.xxhash64(ts), F.lit(64))).sortWithinPartitions(
        "event_date", ts
    ).write.mode(mode).partitionBy("event_date").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", bom: bool = False) -> None:
    """CSV with a header line; nested columns are written as JSON text.

    With ``bom`` every file begins with a byte order mark, which spreadsheets take as a sign of UTF-8.
    """
    flat = [
        F.to_json(c).alias(c) if "<" in dict(df.dtypes)[c] else F.col(c) for c in df.columns
    ]
    named = df.select(*flat)
    if bom:
        named = named.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    named.write.mode(mode).option("header", True).csv(path)


def write_schema(df: DataFrame, path: str) -> None:
    """The declared schema as one JSON line beside the data."""
    df.sparkSession.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(path)


def write_report(report: DataFrame, path: str) -> None:
    """A small ``(metric, value)`` report as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)
