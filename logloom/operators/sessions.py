"""Authentication events: event features, session features, scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.net import internal_flag, ipv4_to_int
from logloom.functions.text import error_keyword_flag, strip, unusual_length_flag
from logloom.functions.times import calendar, millis_between, utc_timestamp
from logloom.operators.keyed import attach_by_key, count_by_key
from logloom.operators.ordered import scan_prior, scan_some, time_chunk

EXPECTED_COLUMNS = (
    "timestamp", "level", "session_id", "event", "step_id", "user_id",
    "status", "message", "source_ip", "target",
)


@dataclass(frozen=True)
class SessionRules:
    """Fixed values of the session rules."""

    event_steps: Mapping[str, int] = field(
        default_factory=lambda: {
            "login_attempt": 1,
            "message_validation": 2,
            "credential_validation": 3,
            "token_verification": 3,
            "business_process": 4,
            "response_return": 5,
        }
    )
    max_session_ms: int = 300_000
    max_step_ms: int = 30_000
    min_step_ms: int = 10
    max_failures: int = 3
    high_risk: float = 1.0
    rare_below: int = 2
    first_event_flags: bool = True  # the first event of a session counts as too fast
    chunk: str = "1 hour"  # width of the time buckets that split a huge session


FLAGS = (
    "step_jump", "step_reverse", "step_event_mismatch", "delta_too_fast",
    "delta_too_slow", "simultaneous_event", "has_error_keyword",
)
ANOMALY_FLAGS = (
    "delta_too_fast", "delta_too_slow", "has_error_keyword", "simultaneous_event",
    "message_unusual_length", "step_jump", "step_reverse",
)


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("tinyint")


def _half_even(c: Column, digits: int = 3) -> Column:
    """Round the way numpy does: scale, nearest even integer, scale back."""
    scale = float(10**digits)
    return F.rint(c * scale) / scale


def add_missing_columns(df: DataFrame, names: Sequence[str] = EXPECTED_COLUMNS) -> DataFrame:
    """Add the expected columns that are absent, as null text."""
    absent = [n for n in names if n not in df.columns]
    return df.withColumns({n: F.lit(None).cast("string") for n in absent}) if absent else df


def normalize_events(raw: DataFrame) -> DataFrame:
    """Typed and trimmed event columns; unreadable values become null."""
    df = add_missing_columns(raw)
    ts = F.col("timestamp")
    if dict(df.dtypes)["timestamp"] == "string":
        ts = utc_timestamp(ts)
    step = F.trim(F.col("step_id").cast("string")).try_cast("double").try_cast("bigint")
    return df.withColumns(
        {
            "timestamp": ts.cast("timestamp"),
            "step_id": step,
            "level": F.upper(strip(F.col("level"))),
            "status": F.lower(strip(F.col("status"))),
            **{
                n: strip(F.col(n))
                for n in ("event", "user_id", "session_id", "source_ip", "target")
            },
        }
    )


def event_order() -> list[Column]:
    """Total order of the events of a session; unknown times and steps come last."""
    return [
        F.col("timestamp").isNull(),
        F.col("timestamp"),
        F.col("step_id").isNull(),
        F.col("step_id"),
        F.col("line_number"),
    ]


def time_features(df: DataFrame, zone: str | None = None) -> DataFrame:
    return df.withColumns(calendar(F.col("timestamp"), zone))


def ip_features(df: DataFrame) -> DataFrame:
    ip = F.col("source_ip")
    return df.withColumns(
        {"source_ip_int": ipv4_to_int(ip), "source_ip_is_internal": internal_flag(ip)}
    )


def session_deltas(df: DataFrame, rules: SessionRules = SessionRules()) -> DataFrame:
    """Time and step differences to the previous event of the session, with their flags."""
    chunked = df.withColumn("__chunk", time_chunk(F.col("timestamp"), rules.chunk))
    # events without a session have no predecessor
    scanned = scan_some(
        chunked,
        F.col("session_id").isNotNull(),
        ["session_id"],
        ["__chunk"],
        event_order(),
        last={"__prev": F.struct(F.col("timestamp").alias("ts"), F.col("step_id").alias("step"))},
    ).drop("__chunk")
    prev = F.col("__prev")
    steps = F.create_map(*[F.lit(x) for pair in rules.event_steps.items() for x in pair])
    with_prev = scanned.withColumns(
        {
            "prev_ts": prev["ts"],
            "prev_step": prev["step"],
            "delta_ms": F.coalesce(millis_between(F.col("timestamp"), prev["ts"]), F.lit(0.0)),
            "step_gap": F.coalesce(F.col("step_id") - prev["step"], F.lit(1)).cast("bigint"),
            "expected_step": steps[F.col("event")].cast("bigint"),
        }
    ).drop("__prev")
    first = F.col("prev_ts").isNull() & F.col("prev_step").isNull()
    timed = F.lit(True) if rules.first_event_flags else ~first
    delta, gap = F.col("delta_ms"), F.col("step_gap")
    follows = F.col("step_id") == F.col("prev_step") + 1
    return with_prev.withColumns(
        {
            "step_increment_normal": F.when(F.col("prev_step").isNull(), F.lit(1))
            .otherwise(_flag(follows))
            .cast("tinyint"),
            "step_jump": _flag(gap > 1),
            "step_reverse": _flag(gap < 1),
            "simultaneous_event": _flag((delta == 0) & timed),
            "step_event_mismatch": _flag(
                F.col("expected_step").isNotNull() & (F.col("step_id") != F.col("expected_step"))
            ),
            "delta_too_fast": _flag((delta < rules.min_step_ms) & timed),
            "delta_too_slow": _flag(delta > rules.max_step_ms),
        }
    )


def message_flags(df: DataFrame) -> DataFrame:
    message = F.col("message")
    return df.withColumns(
        {
            "has_error_keyword": error_keyword_flag(message),
            "message_length": F.coalesce(F.length(message), F.lit(0)).cast("bigint"),
            "message_unusual_length": unusual_length_flag(message),
        }
    )


def multi_session(
    df: DataFrame, base: DataFrame, key: str, flag: str, freq: str | None = None
) -> DataFrame:
    """Flag keys seen in more than one session; ``freq`` also adds the key's row count.

    Sessions per key are counted by distinct (key, session) pairs of the narrow
    ``base`` rows, never gathered.
    """
    pairs = base.groupBy(key, "session_id").agg(F.count(F.lit(1)).alias("rows"))
    stats = pairs.groupBy(key).agg(
        F.sum("rows").alias("n"), F.count("session_id").alias("__sessions")
    )
    values = ["__sessions"]
    if freq:
        stats, values = stats.withColumn(freq, F.col("n")), ["__sessions", freq]
    many = _flag((F.col("__sessions") > 1) & F.col(key).isNotNull())
    return attach_by_key(df, stats, [key], values).withColumn(flag, many).drop("__sessions")


def frequency_encoding(
    df: DataFrame, base: DataFrame, columns: Sequence[str], rare_below: int = 2
) -> DataFrame:
    """Per column: row count of its value, value or ``RARE``, and a rare flag.

    The per-column counts meet on the distinct combinations of the columns, so the rows
    themselves are joined once and not once per column.
    """
    columns = list(columns)
    combos = count_by_key(base, columns)
    for c in columns:
        per_value = base.groupBy(F.col(c).alias("__v")).agg(F.count(F.lit(1)).alias(f"{c}_freq"))
        combos = combos.join(per_value, F.col(c).eqNullSafe(F.col("__v")), "left").drop("__v")
    coded = attach_by_key(df, combos, columns, [f"{c}_freq" for c in columns])
    out = {}
    for c in columns:
        rare = F.col(f"{c}_freq") < rare_below
        out[f"{c}_processed"] = F.when(rare, F.lit("RARE")).otherwise(F.col(c))
        out[f"{c}_is_rare"] = _flag(rare)
    return coded.withColumns(out)


def step_features(raw: DataFrame, rules: SessionRules = SessionRules()) -> DataFrame:
    """The event features a session table needs: one shuffle of the events."""
    return message_flags(session_deltas(normalize_events(raw), rules))


def event_features(raw: DataFrame, rules: SessionRules = SessionRules()) -> DataFrame:
    """All event features."""
    base = normalize_events(raw)
    df = ip_features(time_features(step_features(raw, rules)))
    df = multi_session(df, base, "user_id", "user_multi_session", "user_id_freq")
    df = multi_session(df, base, "source_ip", "ip_multi_session", "source_ip_freq")
    columns = ["level", "event", "status", "target"]
    return frequency_encoding(df, base, columns, rules.rare_below)


def session_table(events: DataFrame) -> DataFrame:
    """One row per session: aggregates and what follows from them.

    Sums, extremes and moments combine map-side. Distinct counts are an aggregate of
    their own over the bare columns, so that Spark's two-step plan for them multiplies
    neither the windows nor the wide rows; both sides end up partitioned by session.
    """
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(event_order())])
    d = F.col("delta_ms")

    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.col("__at"))

    own = events.filter(F.col("session_id").isNotNull())
    distinct = own.groupBy("session_id").agg(
        *[
            F.count_distinct(c).alias(f"{c}_nunique")
            for c in ("step_id", "source_ip", "user_id", "target")
        ]
    )
    agg = (
        own.withColumn("__at", at)
        .groupBy("session_id")
        .agg(
            F.min("timestamp").alias("timestamp_min"),
            F.max("timestamp").alias("timestamp_max"),
            F.count("timestamp").alias("timestamp_count"),
            F.min("step_id").alias("step_id_min"),
            F.max("step_id").alias("step_id_max"),
            _half_even(F.sum(d)).alias("delta_ms_sum"),
            _half_even(F.avg(d)).alias("delta_ms_mean"),
            _half_even(F.stddev_samp(d)).alias("delta_ms_std"),
            _half_even(F.max(d)).alias("delta_ms_max"),
            F.count_if(F.col("status") == "fail").alias("n_failures"),
            F.count_if(F.col("level") == "ERROR").alias("n_errors"),
            *[F.sum(f).alias(f"{f}_sum") for f in FLAGS],
            F.min_by("user_id", known("user_id")).alias(
                "user_id_first"
            ),
            F.min_by("target", known("target")).alias(
                "target_first"
            ),
            F.min("line_number").alias("line_number_min"),
            F.max("line_number").alias("line_number_max"),
            F.max_by("status", known("status")).alias(
                "final_status"
            ),
        )
    )
    start = F.col("timestamp_min")
    return agg.join(distinct, "session_id").withColumns(
        {
            "duration_ms": millis_between(F.col("timestamp_max"), start),
            "avg_step_interval": F.col("delta_ms_mean"),
            "n_events": F.col("timestamp_count"),
            "n_unique_steps": F.col("step_id_nunique"),
            "step_range": F.col("step_id_max") - F.col("step_id_min"),
            "is_successful": _flag(F.col("final_status") == "success"),
            "start_hour": F.hour(start).cast("bigint"),
            "start_dayofweek": F.weekday(start).cast("bigint"),
        }
    )


SCORED = (
    "duration_ms", "avg_step_interval", "n_events", "step_jump_sum", "n_failures", "delta_ms_std",
)


def score_sessions(
    sessions: DataFrame, rules: SessionRules = SessionRules(), features: Sequence[str] = SCORED
) -> DataFrame:
    """Statistical, rule and final score.

    Statistical: mean of |z| over the features whose sample deviation (nulls skipped) is
    positive; z itself takes null as 0 and the population deviation. All moments come
    from one single-row aggregate.
    """
    filled = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features}
    moments = sessions.agg(
        F.struct(
            *[F.stddev_samp(f).alias(f"s_{f}") for f in features],
            *[F.avg(filled[f]).alias(f"m_{f}") for f in features],
            *[F.stddev_pop(filled[f]).alias(f"p_{f}") for f in features],
        )
    ).scalar()
    with_moments = sessions.withColumn("__m", moments)
    m = F.col("__m")
    total, used = F.lit(0.0), F.lit(0)
    for f in features:
        counts = F.coalesce(m[f"s_{f}"] > 0, F.lit(False))
        z = F.abs(F.try_divide(filled[f] - m[f"m_{f}"], m[f"p_{f}"]))
        total = total + F.when(counts, F.coalesce(z, F.lit(0.0))).otherwise(0.0)
        used = used + counts.cast("int")
    statistical = F.coalesce(F.try_divide(total, used), F.lit(0.0))

    def weigh(test: Column, weight: float) -> Column:
        return F.coalesce(test, F.lit(False)).cast("int") * F.lit(weight)

    rule_score = (
        weigh(F.col("duration_ms") > rules.max_session_ms, 0.3)
        + weigh(F.col("n_failures") > rules.max_failures, 0.4)
        + weigh(F.col("step_jump_sum") > 0, 0.2)
        + weigh(F.col("step_reverse_sum") > 0, 0.1)
    )
    return (
        with_moments.withColumns(
            {"anomaly_score_statistical": statistical, "anomaly_score_rules": rule_score}
        )
        .withColumn(
            "anomaly_score_final",
            F.lit(0.6) * F.col("anomaly_score_statistical") + F.lit(0.4) * F.col("anomaly_score_rules"),
        )
        .drop("__m")
    )


def pipeline_stats(events: DataFrame, scored: DataFrame, rules: SessionRules = SessionRules()) -> DataFrame:
    """The one-row summary of a run."""
    n_events = events.agg(F.count(F.lit(1))).scalar()
    return scored.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.avg((F.col("is_successful") == 1).cast("double")).alias("success_rate"),
        F.avg("duration_ms").alias("avg_session_duration_ms"),
        F.count_if(F.col("anomaly_score_final") > rules.high_risk).alias("anomalous_sessions_count"),
        F.avg("anomaly_score_final").alias("score_mean"),
        F.stddev_samp("anomaly_score_final").alias("score_std"),
        F.min("anomaly_score_final").alias("score_min"),
        F.max("anomaly_score_final").alias("score_max"),
    ).select(
        n_events.alias("total_events"),
        "total_sessions",
        F.try_divide(n_events, F.col("total_sessions")).alias("avg_events_per_session"),
        "success_rate", "avg_session_duration_ms", "anomalous_sessions_count",
        "score_mean", "score_std", "score_min", "score_max",
    )


def stats_rows(stats: DataFrame) -> DataFrame:
    """A one-row summary as ``(metric, value)`` rows."""
    names = stats.columns
    return stats.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot(
        [], names, "metric", "value"
    )


def transitions(events: DataFrame, rules: SessionRules = SessionRules()) -> DataFrame:
    """How often one event follows another inside a session."""
    rows = events.filter(F.col("session_id").isNotNull()).withColumn(
        "__chunk", time_chunk(F.col("timestamp"), rules.chunk)
    )
    pairs = scan_prior(
        rows.select("session_id", "__chunk", "timestamp", "step_id", "line_number", "event"),
        ["session_id"],
        ["__chunk"],
        event_order(),
        last={"__prev": F.struct(F.col("event").alias("event"))},
    )
    return (
        pairs.filter(F.col("__prev.event").isNotNull() & F.col("event").isNotNull())
        .groupBy(F.col("__prev.event").alias("event"), F.col("event").alias("next_event"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def any_anomaly(flags: Sequence[str] = ANOMALY_FLAGS) -> Column:
    """1 when any of the flag columns is set."""
    return (F.greatest(*[F.col(f) for f in flags]) > 0).cast("int")
