"""Audit logs that mix JSON payload lines, one-line pairs and multi-line pair blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.keyvalue import equals_pairs
from logloom.functions.text import strip
from logloom.operators.ordered import scan_prior

# Columns of an audit case.
CASE_FIELDS = ("timestamp", "caseData", "index", "caseResult", "caseUser", "caseType")
_ROWS = (
    "struct<rows:array<struct<logDatetime:string,caseData:string,index:string,"
    "caseResult:string,caseUser:string,caseType:string>>>"
)
# Character references that occur in times.
_ENTITIES = (
    ("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"),
    ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
)


def line_kind(value: Column) -> Column:
    """json, pairs (one line), block (first line of a block), blank, member or other."""
    text = strip(value)
    starts = text.startswith("timestamp=")
    return (
        F.when(text == "", "blank")
        .when(F.contains(value, F.lit("AUDIT_PAYLOAD")), "json")
        .when(starts & F.contains(value, F.lit(" caseData=")), "pairs")
        .when(starts, "block")
        .when(
            value.startswith("  ")
            | value.startswith("\t")
            | (F.contains(text, F.lit("=")) & ~text.startswith("=")),
            "member",
        )
        .otherwise("other")
    )


def format_census(lines: DataFrame) -> DataFrame:
    """Non-blank lines per format."""
    text = strip(F.col("value"))
    kind = (
        F.when(text.rlike(r"AUDIT_PAYLOAD\s*\{"), "json")
        .when(text.rlike(r"timestamp=\d{4}-\d{2}-\d{2}"), "pairs")
        .otherwise("other")
    )
    return lines.filter(text != "").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def unescape_time(c: Column) -> Column:
    out = c
    for entity, char in _ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.replace(out, F.lit("\u00a0"), F.lit(" ")))


def payload_rows(value: Column) -> Column:
    """``rows`` of the JSON object after the payload mark; null when it cannot be read."""
    doc = F.regexp_extract(value, r"(?s)AUDIT_PAYLOAD[^{]*(\{.*)$", 1)
    rows = F.from_json(doc, _ROWS)["rows"]
    return F.transform(
        rows,
        lambda r: F.struct(
            unescape_time(F.coalesce(r["logDatetime"], F.lit(""))).alias("timestamp"),
            *[F.coalesce(r[c], F.lit("")).alias(c) for c in CASE_FIELDS[1:]],
        ),
    )


def _case(pairs: Column) -> Column:
    return F.struct(*[F.coalesce(pairs[c], F.lit("")).alias(c) for c in CASE_FIELDS])


def audit_cases(lines: DataFrame) -> DataFrame:
    """All valid cases, numbered ``no`` per source in order of appearance."""
    value = F.col("value")
    here = F.struct("chunk", "pos")
    kinds = lines.withColumn("kind", line_kind(value))
    # a block line opens a block, anything but a member line closes it
    turn = F.when(
        F.col("kind") != "member",
        F.struct(here.alias("at"), (F.col("kind") == "block").alias("open")),
    )
    scanned = scan_prior(kinds, ["source"], ["chunk"], ["pos"], last={"turn": turn})
    block = F.when(F.col("kind") == "block", here).when(
        (F.col("kind") == "member") & F.col("turn.open"), F.col("turn.at")
    )
    marked = scanned.withColumn("block", block)

    # a block is only the last value of each of its keys, found without gathering its lines
    pair = F.split(strip(value), "=", 2)
    named = marked.filter(F.col("block").isNotNull() & (F.size(pair) == 2)).select(
        "source", "block", strip(pair[0]).alias("key"), strip(pair[1]).alias("v"), here.alias("at")
    )
    fields = named.groupBy("source", "block", "key").agg(F.max_by("v", "at").alias("v"))
    blocks = fields.groupBy("source", "block").agg(
        F.count_if(F.col("v") != "").alias("filled"),
        *[F.max(F.when(F.col("key") == c, F.col("v"))).alias(c) for c in CASE_FIELDS],
    )
    valid = (F.coalesce("timestamp", F.lit("")) != "") & (F.col("filled") >= 2)
    from_blocks = blocks.filter(valid).select(
        "source", F.col("block.chunk").alias("chunk"), F.col("block.pos").alias("pos"),
        F.lit(0).alias("part"), F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in CASE_FIELDS]).alias("case"),
    )
    from_pairs = (
        marked.filter("kind = 'pairs'")
        .withColumn("pairs", equals_pairs(value))
        .filter(F.col("pairs")["timestamp"].isNotNull())
        .select("source", "chunk", "pos", F.lit(0).alias("part"), _case(F.col("pairs")).alias("case"))
    )
    from_json = marked.filter("kind = 'json'").select(
        "source", "chunk", "pos", F.posexplode(payload_rows(value)).alias("part", "case")
    )
    cases = from_blocks.unionByName(from_pairs).unionByName(from_json)
    numbered = scan_prior(cases, ["source"], ["chunk"], ["pos", "part"], totals={"n": F.lit(1)})
    return numbered.select("source", (F.col("n") + 1).alias("no"), "case.*")
