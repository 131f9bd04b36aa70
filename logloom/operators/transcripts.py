"""Bracketed transcripts: ``[time] [direction] action``, metadata lines, a payload block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.keyvalue import header_map, last_wins_map, metadata_pair
from logloom.functions.payload import classify_payload
from logloom.functions.text import strip
from logloom.operators.bodies import FIRST_SEGMENTS, segment, segmented, united
from logloom.operators.lines import number_lines
from logloom.operators.ordered import scan_prior

_HEADER = r"^\[([^\]]+)\]\s+\[([^\]]+)\]\s+(.+)$"


def transcript_entries(lines: DataFrame, first_segments: int = FIRST_SEGMENTS) -> DataFrame:
    """One row per entry with metadata map and classified payload.

    A header-like line inside a payload starts a new entry; a header-like line that is
    no header closes the current entry. Of several payload blocks the last one closed
    counts; a block without an end is closed by the next header or the end of the file. Metadata and
    payload come from the first segments of an entry; ``cut`` tells entries that have more.
    """
    value, text = F.col("value"), strip(F.col("value"))
    opens = value.startswith("[") & F.contains(value, F.lit("] ["))
    here = F.struct("chunk", "pos")
    mark = (
        F.when(opens, F.lit("header"))
        .when(text == "-- payload begin --", F.lit("begin"))
        .when(text == "-- payload end --", F.lit("end"))
    )
    marked = number_lines(lines).withColumn("mark", mark)
    scanned = scan_prior(
        marked,
        ["source"],
        ["chunk"],
        ["pos"],
        last={
            "rec": F.when(
                F.col("mark") == "header",
                F.struct(here.alias("at"), text.rlike(_HEADER).alias("ok")),
            ),
            "before": F.when(
                F.col("mark").isNotNull(), F.struct(here.alias("at"), F.col("mark").alias("mark"))
            ),
        },
        totals={"bytes": F.octet_length(value)},
    )
    is_header = F.col("mark") == "header"
    own = F.struct(here.alias("at"), text.rlike(_HEADER).alias("ok"))
    in_block = F.col("before.mark") == "begin"
    rows = scanned.select(
        "source", "line_no", "value", "mark", segment(F.col("bytes")).alias("segment"),
        here.alias("at"),
        F.when(is_header, own).otherwise(F.col("rec")).alias("rec"),
        # the block a payload line or an end marker belongs to
        F.when(~F.coalesce(is_header, F.lit(False)) & in_block, F.col("before.at")).alias("block"),
    ).filter("rec.ok")
    plain = F.col("mark").isNull() & F.col("block").isNull()
    rows = rows.withColumn("pair", F.when(plain, metadata_pair(F.col("value"))))
    inside = F.col("mark").isNull() & F.col("block").isNotNull()

    def head(c):
        return F.when(F.col("mark") == "header", c)

    trimmed = strip(value)
    marked = F.col("mark").isNotNull()
    heads = {
        "line_number": head(F.col("line_no")),
        "timestamp": head(F.regexp_extract(trimmed, _HEADER, 1)),
        "direction": head(F.regexp_extract(trimmed, _HEADER, 2)),
        "action": head(F.regexp_extract(trimmed, _HEADER, 3)),
        "last_end": F.when(F.col("mark") == "end", F.struct("at", "block")),
        "last_mark": F.when(marked, F.struct("at", "mark")),
    }
    parts = {"meta": F.col("pair"), "body": F.when(inside, F.struct("block", "value"))}
    segments = segmented(rows, ["source", "rec"], ["at"], parts, heads)
    grouped = united(segments, ["source", "rec"], list(parts), list(heads), first_segments)
    open_at_end = F.col("last_mark.mark") == "begin"
    wanted = F.when(open_at_end, F.col("last_mark.at")).otherwise(F.col("last_end.block"))
    chosen = F.filter("body", lambda b: b["block"] == F.col("wanted"))["value"]
    entries = grouped.withColumn("wanted", wanted).select(
        "source", "line_number", "timestamp", "direction", "action",
        last_wins_map(F.col("meta")["k"], F.col("meta")["v"]).alias("metadata"),
        F.when(
            open_at_end | F.col("last_end").isNotNull(), F.coalesce(chosen, F.array())
        ).alias("payload_lines"),
        "cut",
    )
    headers = F.col("metadata")["headers"]
    return classify_payload(
        entries.withColumn("headers", F.when(headers.isNotNull(), header_map(headers)))
    )
