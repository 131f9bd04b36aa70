"""Readers: text lines, key/value lines, NDJSON, JSON documents, CSV and IP ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.keyvalue import colon_parts
from logloom.functions.text import strip
from logloom.operators.lines import number_lines

IP_RANGE_SCHEMA = "ip_start string, ip_end string, country string"
EVENT_COLUMNS = (
    "timestamp", "level", "session_id", "event", "step_id", "user_id",
    "status", "message", "source_ip", "target",
)


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines as ``(source, chunk, pos, value)``.

    ``chunk`` is the byte offset of the file split and ``pos`` the order inside it, so
    a file of any size is read by many tasks and still has a total line order. Bytes
    that are not UTF-8 are dropped.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("pos"),
        F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit("")).alias("value"),
    )


def table_lines(df: DataFrame, source: str, line_no: str, value: str, chunk_lines: int = 1_000_000) -> DataFrame:
    """The same shape from a table that already numbers its lines."""
    return df.select(
        F.col(source).cast("string").alias("source"),
        F.floor(F.col(line_no) / chunk_lines).cast("bigint").alias("chunk"),
        F.col(line_no).cast("bigint").alias("pos"),
        F.col(value).alias("value"),
    )


def key_value_events(lines: DataFrame) -> DataFrame:
    """``key: value, ...`` lines -> the ten event columns, ``extras`` and ``line_number``."""
    numbered = number_lines(lines).withColumn("line", strip(F.col("value"))).filter("line <> ''")
    parsed = numbered.select(
        "source",
        F.col("line_no").alias("line_number"),
        colon_parts(F.col("line")).alias("parts"),
    ).select("source", "line_number", "parts.pairs", F.col("parts.rest").alias("unparsed")).filter((F.size("pairs") > 0) | F.col("unparsed").isNotNull())
    return parsed.select(
        *[F.col("pairs")[c].alias(c) for c in EVENT_COLUMNS],
        F.map_filter("pairs", lambda k, _: ~k.isin(*EVENT_COLUMNS)).alias("extras"),
        "unparsed",
        "source",
        "line_number",
    )


def ndjson(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """One JSON object per line; blank lines are skipped.

    ``strict`` fails on a bad line, otherwise bad lines are dropped.
    """
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return spark.read.schema(schema).option("mode", mode).json(path)


def ndjson_rejects(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Lines an NDJSON read with this schema would drop."""
    wide = T.StructType(
        [*_schema(schema).fields, T.StructField("_corrupt_record", T.StringType())]
    )
    lines = spark.read.text(path).filter(F.trim("value") != "")
    read = lines.select(
        "value",
        F.from_json("value", wide, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"),
    )
    return read.filter(F.col("r._corrupt_record").isNotNull()).select("value")


def _schema(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def json_documents(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Files that each hold one JSON object or one array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def csv_table(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with a header line."""
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)


def ip_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Headerless range CSV, plain or gzipped: first address, last address, country."""
    return spark.read.schema(IP_RANGE_SCHEMA).csv(path)


def sample_rows(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """A repeatable sample of ``n`` rows, the same for any partitioning."""
    order = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))).cast("binary"))
    return df.orderBy(order, *keys).limit(n)
