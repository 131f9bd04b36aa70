"""Streaming forms of hourly counts, session features, matching and signature alarms.

The batch operators define the results; these keep them current on a stream. Watermarks
bound the state: rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hourly_counts(stream: DataFrame, ts: str, *by: str, late: str = "2 hours") -> DataFrame:
    """Rows per hour (and further columns) of a stream."""
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.window(ts, "1 hour"), *by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("hour"), *by, "n")
    )


def session_totals(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events, failures, errors and duration of each burst of a session."""
    return (
        stream.withWatermark("timestamp", late)
        .groupBy(F.session_window("timestamp", gap).alias("burst"), "session_id")
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.count_if(F.col("status") == "fail").alias("n_failures"),
            F.count_if(F.col("level") == "ERROR").alias("n_errors"),
            F.min("timestamp").alias("timestamp_min"),
            F.max("timestamp").alias("timestamp_max"),
            F.max_by("status", "timestamp").alias("final_status"),
        )
        .withColumn(
            "duration_ms",
            (F.unix_micros("timestamp_max") - F.unix_micros("timestamp_min")) / F.lit(1000.0),
        )
        .drop("burst")
    )


_DELTA_OUT = "session_id string, timestamp timestamp, step_id long, delta_ms double, step_gap long"


def _wake_at(state: GroupState, at_us: int) -> None:
    """Call again once the watermark passes ``at_us``."""
    state.setTimeoutTimestamp(max(-(-at_us // 1000), state.getCurrentWatermarkMs() + 1))


def _in_order(pieces: Iterator[pd.DataFrame], state: GroupState, columns: list[str], idle_ms: int) -> tuple[pd.DataFrame, tuple]:
    """Rows of one key that are final, in order, and the last row that was given out before them.

    A row waits in the state until the watermark passes its time: then no earlier one can come. So neither the
    borders of batches nor those of pieces matter. ``columns`` are whole numbers, the time in
    microseconds first. The state is dropped after ``idle_ms`` of silence.
    """
    before, waiting = None, [[] for _ in columns]
    if state.exists:
        held = state.get
        before = held[0]
        waiting = [list(c or ()) for c in held[1:]]
    if not state.hasTimedOut:
        for pdf in pieces:
            for column, name in zip(waiting, columns):
                column.extend(None if pd.isna(v) else int(v) for v in pdf[name])
    passed = state.getCurrentWatermarkMs() * 1000
    rows = sorted(zip(*waiting), key=lambda r: tuple((v is not None, v or 0) for v in r))
    ready = [r for r in rows if r[0] <= passed]
    rest = rows[len(ready) :]
    last = ready[-1] if ready else before
    if rest:
        state.update((last and list(last), *[list(c) for c in zip(*rest)]))
        _wake_at(state, rest[0][0])
    elif last is not None and last[0] + idle_ms * 1000 > passed:
        state.update((list(last), *[[] for _ in columns]))
        _wake_at(state, last[0] + idle_ms * 1000)
    elif state.exists:
        state.remove()
    return pd.DataFrame(ready, columns=columns, dtype="Int64"), before


def _state_of(columns: list[str]) -> str:
    return "before array<long>, " + ", ".join(f"{c} array<long>" for c in columns)


def _shifted(column: pd.Series, first) -> pd.Series:
    """Each value's predecessor; that of the first one is ``first``."""
    out = column.shift(1).astype("Int64")
    if len(out):
        out.iloc[0] = pd.NA if first is None else first
    return out


def session_deltas(stream: DataFrame, idle_ms: int = 3_600_000, late: str = "1 hour") -> DataFrame:
    """Time and step difference of each event to the one before it in its session.

    Rows leave in the order of time (then step) once the watermark has passed them, so any split into
    batches gives what the whole gives. After more than ``idle_ms`` of silence a session starts anew.
    """
    columns = ["us", "step_id"]

    def step(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, last = _in_order(pieces, state, columns, idle_ms)
        if rows.empty:
            return
        before, step_before = (_shifted(rows[c], last[i] if last else None) for i, c in enumerate(columns))
        gone = rows["us"] - before
        anew = (gone > idle_ms * 1000).fillna(True)
        gap = (rows["step_id"] - step_before).mask(anew)
        yield pd.DataFrame(
            {
                "session_id": key[0],
                "timestamp": pd.to_datetime(rows["us"].astype("int64"), unit="us"),
                "step_id": rows["step_id"],
                "delta_ms": gone.mask(anew, 0).astype("float64") / 1000.0,
                "step_gap": gap.fillna(1).astype("int64"),
            }
        )

    return (
        stream.select("session_id", "timestamp", F.col("step_id").cast("long"))
        .filter("timestamp IS NOT NULL AND session_id IS NOT NULL")
        .withWatermark("timestamp", late)
        .withColumn("us", F.unix_micros(F.col("timestamp").cast("timestamp")))
        .groupBy("session_id")
        .applyInPandasWithState(step, _DELTA_OUT, _state_of(columns), "append", GroupStateTimeout.EventTimeTimeout)
    )


def match_stream(
    requests: DataFrame, responses: DataFrame, within: str = "10 minutes", late: str = "10 minutes"
) -> DataFrame:
    """Requests and responses matched on a stream, both sides kept.

    An unmatched row comes out once the watermark shows that no partner can follow.
    """
    a = requests.withWatermark("request_timestamp", late)
    b = responses.withWatermark("response_timestamp", late)
    cond = (
        (F.col("request_id") == F.col("in_response_to"))
        & (F.col("response_timestamp") >= F.col("request_timestamp") - F.expr(f"interval {late}"))
        & (F.col("response_timestamp") <= F.col("request_timestamp") + F.expr(f"interval {within}"))
    )
    return a.join(b, cond, "full_outer").withColumn(
        "transaction_duration",
        (F.unix_micros("response_timestamp") - F.unix_micros("request_timestamp")) / F.lit(1e6),
    )


_ALERT_OUT = "user_name string, ts timestamp, interval_seconds double, rapid boolean, delayed boolean"


def signature_alerts(
    stream: DataFrame,
    rapid_below: float = 30.0,
    delayed_above: float = 3600.0,
    idle_ms: int = 86_400_000,
    late: str = "1 hour",
) -> DataFrame:
    """Signatures that follow the user's previous one too quickly or too late.

    Rows are looked at in the order of time once the watermark has passed them. Silence of more
    than ``idle_ms`` is a new start and no alarm.
    """

    def watch(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, last = _in_order(pieces, state, ["us"], idle_ms)
        if rows.empty:
            return
        gone = rows["us"] - _shifted(rows["us"], last[0] if last else None)
        gap = gone.mask((gone > idle_ms * 1000).fillna(True)).astype("float64") / 1e6
        out = pd.DataFrame(
            {
                "user_name": key[0],
                "ts": pd.to_datetime(rows["us"].astype("int64"), unit="us"),
                "interval_seconds": gap,
                "rapid": gap < rapid_below,
                "delayed": gap > delayed_above,
            }
        )
        yield out[out["rapid"] | out["delayed"]]

    return (
        stream.select("user_name", "ts")
        .filter("ts IS NOT NULL AND user_name IS NOT NULL")
        .withWatermark("ts", late)
        .withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
        .groupBy("user_name")
        .applyInPandasWithState(watch, _ALERT_OUT, _state_of(["us"]), "append", GroupStateTimeout.EventTimeTimeout)
    )
