"""From text lines to multi-line records.

Input lines have the columns ``source, chunk, pos, value`` (see ``sources.readers``).
State between lines (line number, last date, current record, open XML block) is
carried by ``scan_prior``, so one huge file is worked on by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.records import noise_line, stack_line, xml_closes, xml_opens
from logloom.functions.text import strip
from logloom.functions.times import (
    clock_on_date,
    full_timestamp,
    is_clock,
    iso_millis,
    normalize_level,
    timestamp_text,
)
from logloom.operators.bodies import FIRST_SEGMENTS, SEGMENT_BYTES, segment, segmented, united
from logloom.operators.ordered import scan_prior
from logloom.profiles import HeaderPattern, LogProfile
from logloom.session import durable

_SEP = "\u0001"


def number_lines(lines: DataFrame) -> DataFrame:
    """Add ``line_no``, 1-based per source."""
    counted = scan_prior(lines, ["source"], ["chunk"], ["pos"], totals={"__n": F.lit(1)})
    return counted.withColumn("line_no", F.col("__n") + 1).drop("__n")


def drop_noise(lines: DataFrame, profile: LogProfile) -> DataFrame:
    """Remove the lines no record needs."""
    return lines.filter(~noise_line(F.col("value"), profile))


def parse_headers(lines: DataFrame, profile: LogProfile) -> DataFrame:
    """Add ``hdr``: the parts of the first header pattern that fits, else null.

    ``hdr.full_ts`` is set when the header carries a date, ``hdr.clock`` otherwise. A
    header whose time is impossible is no header; no further pattern is tried.

    The steps are columns of their own, so that each regex runs once per line.
    """
    value = F.col("value")
    form, cut = None, None
    for i, pattern in enumerate(profile.headers):
        fits = value.rlike(f"(?s){pattern.regex}")
        form = F.when(fits, F.lit(i)) if form is None else form.when(fits, F.lit(i))
        chosen, parts = F.col("__form") == i, _cut(value, pattern)
        cut = F.when(chosen, parts) if cut is None else cut.when(chosen, parts)
    clocks = [i for i, pattern in enumerate(profile.headers) if pattern.clock_only]
    staged = (
        lines.withColumn("__form", form)
        .withColumn("__cut", cut)
        .withColumn("__ts", timestamp_text(F.get("__cut", F.lit(0))))
    )
    is_clock_form = F.col("__form").isin(*clocks) if clocks else F.lit(False)
    ts = F.col("__ts")
    staged = staged.withColumns(
        {
            "__full": F.when(
                ~is_clock_form, full_timestamp(ts, profile.two_digit_year, profile.two_digit_year)
            ),
            "__clock": F.when(
                is_clock_form,
                F.when(ts.rlike(r"^\d{2}:\d{2}:\d{2}$"), F.concat(ts, F.lit(".000"))).otherwise(ts),
            ),
        }
    )

    def part(i: int) -> Column:
        return F.get("__cut", F.lit(i))

    header = F.struct(
        F.col("__full").alias("full_ts"),
        F.col("__clock").alias("clock"),
        normalize_level(part(1)).alias("level"),
        part(2).alias("thread"),
        part(3).alias("logger"),
        F.when(part(4) != "", part(4)).alias("pid"),
        strip(part(5)).alias("message"),
    )
    valid = F.col("__full").isNotNull() | is_clock(F.col("__clock"))
    return staged.withColumn("hdr", F.when(valid, header)).drop(
        "__form", "__cut", "__ts", "__full", "__clock"
    )


def _cut(value: Column, p: HeaderPattern) -> Column:
    """All groups of a pattern from one replace, instead of one regex run per group."""
    groups = [f"${g}" if g else "" for g in (p.ts, p.level, p.thread, p.logger, p.pid, p.message)]
    return F.split(F.regexp_replace(value, f"(?s){p.regex}", _SEP.join(groups)), _SEP, 6)


def attach_records(
    lines: DataFrame, profile: LogProfile, base_date: str | None = None, segment_bytes: int = SEGMENT_BYTES
) -> DataFrame:
    """Give every line its record and its part in it.

    Adds ``rec`` (chunk and position of the record's header line), ``ts`` on header
    lines, ``kind``: header, xml, stack or text, and ``segment``, the line's place on a grid of
    ``segment_bytes`` over the file. Lines before the first header
    get a null ``rec``. A clock-only header takes the date of the last header before
    it in the source, else ``base_date``; without either it is an ordinary line.
    """
    value, hdr = F.col("value"), F.col("hdr")
    here = F.struct(F.col("chunk").alias("chunk"), F.col("pos").alias("pos"))
    marker = F.when(hdr.isNotNull(), F.lit("closed"))
    if profile.xml_blocks:
        # cheap test first: most lines hold no tag at all
        tagged = F.contains(value, F.lit("<")) & F.contains(value, F.lit(">"))
        marker = marker.when(
            tagged, F.when(xml_closes(value), F.lit("closed")).when(xml_opens(value), F.lit("open"))
        )
    # parsed once, by as many tasks as there are chunks; the scan reads its narrow columns twice
    parsed = parse_headers(lines.repartition("source", "chunk"), profile).withColumns(
        {"mark": marker, "size": F.octet_length(value)}
    )
    scanned = scan_prior(
        durable(parsed),
        ["source"],
        ["chunk"],
        ["pos"],
        last={
            "__date": F.to_date(hdr["full_ts"]),
            "__rec": F.when(hdr.isNotNull(), here),
            "__mark": F.col("mark"),
        },
        totals={"__bytes": F.col("size")},
    )
    date = F.coalesce("__date", F.lit(base_date).cast("date"))
    dated = scanned.withColumn("ts", F.coalesce(hdr["full_ts"], clock_on_date(hdr["clock"], date)))
    header = F.col("ts").isNotNull()
    # without a date seen so far no clock-only header can have opened a record
    rec = F.when(header, here).when(date.isNotNull(), F.col("__rec"))
    in_xml = F.coalesce(F.col("__mark") == "open", F.lit(False))
    if profile.xml_blocks:
        in_xml = in_xml | F.coalesce(F.col("mark") == "open", F.lit(False))
        # a block that opens and closes on one line is still XML
        in_xml = in_xml | (F.coalesce(F.col("mark") == "closed", F.lit(False)) & xml_opens(value))
    kind = (
        F.when(header, F.lit("header"))
        .when(in_xml, F.lit("xml"))
        .when(stack_line(value), F.lit("stack"))
        .otherwise(F.lit("text"))
    )
    return dated.select(
        "source", "chunk", "pos", "value", "hdr", rec.alias("rec"), "ts", kind.alias("kind"),
        segment(F.col("__bytes"), segment_bytes).alias("segment"),
    )


_BODY = ("text", "stack", "xml")
_HEAD = ("ts", "dated", "level", "thread", "logger", "pid", "head_message")


def record_segments(attached: DataFrame) -> DataFrame:
    """One row per record and segment of its body; a segment is bounded whatever the record is.

    ``text``, ``stack`` and ``xml`` are the lines of the segment, ``n_text``, ``n_stack`` and ``n_xml``
    their numbers; the parts of the header are in the record's first segment.
    """

    def head(c: Column) -> Column:
        return F.when(F.col("kind") == "header", c)

    def of(kind: str, c: Column) -> Column:
        return F.when(F.col("kind") == kind, c)

    heads = {
        "ts": head(F.col("ts")),
        "dated": head(F.col("hdr.full_ts").isNotNull()),
        **{c: head(F.col(f"hdr.{c}")) for c in ("level", "thread", "logger", "pid")},
        "head_message": head(F.col("hdr.message")),
    }
    parts = {"text": of("text", strip(F.col("value"))), "stack": of("stack", F.col("value")), "xml": of("xml", F.col("value"))}
    return segmented(attached.filter(F.col("rec").isNotNull()), ["source", "rec"], ["chunk", "pos"], parts, heads)


def assemble(attached: DataFrame, first_segments: int = FIRST_SEGMENTS) -> DataFrame:
    """One row per record: header parts, merged message, stack lines and XML text.

    ``n_lines`` counts all lines behind the header. Texts come from the first segments of the body; where there are
    more, ``cut`` is true and ``record_segments`` has the rest.
    """
    grouped = united(record_segments(attached), ["source", "rec"], _BODY, _HEAD, first_segments)
    message = F.array_join(F.concat(F.array("head_message"), F.col("text")), " ")
    return grouped.select(
        "source",
        F.col("rec.chunk").alias("chunk"),
        F.col("rec.pos").alias("pos"),
        "ts",
        iso_millis(F.col("ts")).alias("timestamp"),
        "dated",
        "level",
        "thread",
        "logger",
        "pid",
        strip(message).alias("message"),
        "stack",
        F.when(F.size("xml") > 0, F.array_join("xml", "\n")).alias("xml_content"),
        (F.col("n_text") + F.col("n_stack") + F.col("n_xml")).alias("n_lines"),
        "cut",
    )


def roll_over_midnight(records: DataFrame, hours: int = 12) -> DataFrame:
    """Move records whose header has only a clock on by the midnights passed since the last dated one.

    A midnight has passed where such a clock lies more than ``hours`` before the clock of the record before it.
    Chunks are scanned by themselves; each is then summed up by its first and last clock, the midnights in it and
    those since its last dated record, and these states are composed from chunk to chunk.
    """
    clock = F.unix_micros(F.col("ts").cast("timestamp")) % F.lit(86_400_000_000)
    in_chunk = Window.partitionBy("source", "chunk").orderBy("pos")
    so_far = in_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = lambda before, now: (before - now > F.lit(hours * 3_600_000_000)).cast("long")
    dated = F.col("dated")
    rows = records.withColumn("__clock", clock).withColumn("__before", F.lag("__clock").over(in_chunk))
    rows = rows.withColumn("__roll", F.when(dated, F.lit(0)).otherwise(F.coalesce(passed(F.col("__before"), F.col("__clock")), F.lit(0))))
    rows = rows.withColumn("__rolls", F.sum("__roll").over(so_far))
    rows = rows.withColumn("__at", F.last(F.when(dated, F.col("__rolls")), ignorenulls=True).over(so_far))

    end = F.struct("pos")
    chunks = rows.groupBy("source", "chunk").agg(
        F.min_by("__clock", end).alias("first"), F.max_by("__clock", end).alias("last"),
        F.min_by("dated", end).alias("starts_dated"), F.max("__rolls").alias("rolls"), F.max("__at").alias("at"),
    )
    of_source = Window.partitionBy("source").orderBy("chunk")
    before = of_source.rowsBetween(Window.unboundedPreceding, -1)
    edge = passed(F.lag("last").over(of_source), F.col("first"))
    chunks = chunks.withColumn("edge", F.when(F.col("starts_dated"), F.lit(0)).otherwise(F.coalesce(edge, F.lit(0))))
    # midnights up to the end of each chunk, and up to the last dated record at its end
    chunks = chunks.withColumn("total", F.sum(F.col("edge") + F.col("rolls")).over(of_source))
    chunks = chunks.withColumn("seen", F.col("total") - F.col("rolls") + F.col("at"))
    carried = chunks.select(
        F.col("source").alias("__source"), F.col("chunk").alias("__chunk"),
        (F.col("total") - F.col("rolls") - F.coalesce(F.last("seen", ignorenulls=True).over(before), F.lit(0))).alias("__days"),
    )
    same = F.col("source").eqNullSafe(F.col("__source")) & F.col("chunk").eqNullSafe(F.col("__chunk"))
    days = F.when(F.col("__at").isNotNull(), F.col("__rolls") - F.col("__at")).otherwise(F.col("__days") + F.col("__rolls"))
    moved = rows.join(carried, same, "left").withColumn("ts", F.col("ts") + F.make_interval(days=days.cast("int")))
    out = moved.withColumn("timestamp", iso_millis(F.col("ts"))) if "timestamp" in records.columns else moved
    return out.select(*records.columns)


def line_census(lines: DataFrame, profile: LogProfile, base_date: str | None = None) -> DataFrame:
    """Lines per role: noise, header, xml, stack, text, orphan."""
    quiet = drop_noise(lines, profile)
    noise = lines.filter(noise_line(F.col("value"), profile)).select(F.lit("noise").alias("role"))
    roles = attach_records(quiet, profile, base_date).select(
        F.when(F.col("rec").isNull(), F.lit("orphan")).otherwise(F.col("kind")).alias("role")
    )
    return noise.unionByName(roles).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def tagged_xml_fields(message: Column) -> Column:
    """``<SAML_X:ID=..:TIME=..:ISSUER=..>`` inside a message -> map of its fields.

    Values may hold colons (times, ports): a field ends where ``:NAME=`` begins.
    """
    tag = F.regexp_extract(message, r"<SAML_\w+:(.*?)>", 1)
    pair = r"(\w+)=((?:(?!:[A-Za-z_]+=).)*)"
    keys = F.regexp_extract_all(tag, F.lit(pair), F.lit(1))
    values = F.regexp_extract_all(tag, F.lit(pair), F.lit(2))
    return F.when(F.size(keys) > 0, F.map_from_arrays(keys, values))
