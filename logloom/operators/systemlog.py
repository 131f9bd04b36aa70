"""Structured records of the SSO, IAM and signature logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import records as R
from logloom.functions import saml
from logloom.functions.text import complexity, message_template
from logloom.functions.times import seconds_between
from logloom.operators.keyed import attach_by_key, count_by_key
from logloom.operators.lines import assemble, attach_records, drop_noise, roll_over_midnight
from logloom.operators.ordered import scan_prior
from logloom.profiles import LogProfile
from logloom.session import durable


def structure(
    lines: DataFrame, profile: LogProfile, base_date: str | None = None, roll_midnight: bool = False
) -> DataFrame:
    """Lines -> structured records with all features of the profile.

    With ``roll_midnight`` headers without a date are moved on by the midnights that passed in the file.

    The records are written out once before they are counted by template, so the text is
    parsed a single time however often the result is used.
    """
    quiet = _drop_noise_keeping_pool_stats(lines, profile)
    records = assemble(attach_records(quiet, profile, base_date))
    if roll_midnight:
        records = roll_over_midnight(records)
    kept = records.filter(
        ~R.low_value(F.col("level"), F.col("message"), F.col("logger"), profile)
        | _pool_stats(F.col("message"), F.col("logger"), profile)
    )
    featured = template_frequency(durable(record_features(kept, profile)))
    return signature_intervals(featured) if profile.signature_fields else featured


def _pool_stats(message: Column, logger: Column, profile: LogProfile) -> Column:
    """Pool counters and connection actions: dropped as noise before they could be read
    if only the noise rules were followed, so they are saved when the profile wants them."""
    if not profile.pool_fields:
        return F.lit(False)
    fields = R.pool_fields(message, logger)
    return fields["pool_total"].isNotNull() | fields["connection_action"].isNotNull()


def _drop_noise_keeping_pool_stats(lines: DataFrame, profile: LogProfile) -> DataFrame:
    if not profile.pool_fields:
        return drop_noise(lines, profile)
    value = F.col("value")
    pool = value.rlike(r"Pool stats \(total=\d+, active=|Added connection|Closing connection")
    return lines.filter(~R.noise_line(value, profile) | pool)


def record_features(records: DataFrame, profile: LogProfile) -> DataFrame:
    """Row-wise features of assembled records; one narrow projection per layer."""
    message, logger = F.col("message"), F.col("logger")
    has_stack = F.size("stack") > 0
    base = records.withColumns(
        {
            "stacktrace": F.when(has_stack, F.array_join("stack", "\n")),
            "exception_type": R.exception_type(F.col("stack")),
            "has_stacktrace": has_stack,
            "severity_score": R.severity_score(F.col("level"), has_stack),
            "log_category": R.log_category(logger, message, profile),
            "error_code": R.error_code(message, profile.timing_aware_codes),
            "message_template": message_template(message, profile.template_steps),
            "message_len": F.length(message),
            **complexity(message),
        }
    ).withColumn("template_len", F.length("message_template"))
    if profile.sso_fields:
        base = _sso(base)
    if profile.pool_fields:
        base = base.withColumns(R.pool_fields(message, logger))
    if profile.signature_fields:
        if profile.timing_aware_codes:
            base = base.withColumn("processing_time_ms", R.processing_time_ms(message))
        # in layers, so that no piece is extracted twice
        base = base.withColumns(R.signature_parts(message, logger)).withColumns(R.signature_arrays())
        base = base.withColumns(R.signature_fields())
        base = base.drop(*[c for c in base.columns if c.startswith("__")])
    return base.drop("stack")


def _sso(base: DataFrame) -> DataFrame:
    xml = F.col("xml_content")
    # kept as its own column: the reader runs once per record, not once per field
    base = base.withColumn("__saml", saml.read_saml(xml))
    parsed = saml.saml_fields(xml, F.col("__saml"))
    told = R.sso_fields(F.col("message"))
    # fields told by the message text overrule the same fields of the XML
    merged = {**parsed, **told}
    for name in parsed.keys() & told.keys():
        merged[name] = F.coalesce(told[name], parsed[name])
    return base.withColumns(
        {"has_xml": xml.isNotNull(), "xml_type": saml.xml_kind(xml), **merged}
    ).drop("__saml")


def template_frequency(records: DataFrame, template: str = "message_template") -> DataFrame:
    """Records per template, and whether a template occurs more than once."""
    counts = count_by_key(records, [template]).withColumn("template_frequency", F.col("n"))
    return attach_by_key(records, counts, [template], ["template_frequency"]).withColumn(
        "is_frequent_template", F.col("template_frequency") > 1
    )


def signature_intervals(records: DataFrame) -> DataFrame:
    """Seconds since the user's previous signature, running count, and the two alarms.

    Order is the order of arrival, so an interval may be negative.
    """
    signed = (
        F.col("signature_response_code").isNotNull()
        & F.col("user_name").isNotNull()
        & F.col("ts").isNotNull()
    )
    marked = records.withColumn("__signed", signed)
    users = marked.filter("__signed")
    scanned = scan_prior(
        users,
        ["user_name"],
        ["source", "chunk"],
        ["pos"],
        last={"__prev": F.col("ts")},
        totals={"__before": F.lit(1)},
    )
    gap = seconds_between(F.col("ts"), F.col("__prev"))
    with_gap = scanned.withColumns(
        {
            "signature_interval_seconds": gap,
            "rapid_signature": gap < 30,
            "delayed_signature": gap > 3600,
            "user_signature_count": F.col("__before") + 1,
        }
    ).drop("__prev", "__before")
    others = marked.filter(~F.col("__signed"))
    return with_gap.unionByName(others, allowMissingColumns=True).drop("__signed")
