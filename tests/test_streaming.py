"""Streams read from files, run to completion with ``availableNow``."""

from __future__ import annotations

import datetime as dt
import random

from logloom.streaming import live

UTC = dt.timezone.utc


def at(h, m=0, s=0.0):
    return dt.datetime(2030, 1, 1, h, m, int(s), int(round(s % 1 * 1e6)), tzinfo=UTC)


def source(spark, tmp_path, name, batches, schema):
    path = str(tmp_path / name)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, df, tmp_path, name, mode="append"):
    q = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_hourly_counts(spark, tmp_path):
    rows = [[(at(1, 5), "a"), (at(1, 50), "a"), (at(1, 59), "b")], [(at(2, 10), "a")]]
    df = live.hourly_counts(source(spark, tmp_path, "h", rows, "ts timestamp, kind string"), "ts", "kind")
    got = {(r.hour.hour, r.kind): r.n for r in run(spark, df, tmp_path, "hourly", "complete")}
    assert sorted(got.values()) == [1, 1, 2]


END = at(23, 59)


def splits(rows, end, seed):
    """The same rows in one batch, one by one, and in shuffled batches; a far row at the end moves the watermark on."""
    rng = random.Random(seed)
    mixed = list(rows)
    rng.shuffle(mixed)
    cut = sorted(rng.sample(range(1, len(mixed)), 2))
    return [[rows, [end]], [[r] for r in sorted(rows, key=lambda r: r[1])] + [[end]], [mixed[: cut[0]], mixed[cut[0] : cut[1]], mixed[cut[1] :], [end]]]


def test_session_deltas_do_not_depend_on_batches(spark, tmp_path):
    rows = [
        ("s", at(1, 0, 1.5), 3), ("s", at(1), 1), ("s", at(1, 0, 2), 2), ("s", at(1, 0, 2), None), ("t", at(1, 30), 1),
        ("t", at(1, 0, 0.25), 4), ("s", at(1, 50), 7), ("u", at(1), None), (None, at(1), 1),
    ]
    want = [
        ("s", at(1), 1, 0.0, 1), ("s", at(1, 0, 1.5), 3, 1500.0, 2), ("s", at(1, 0, 2), None, 500.0, 1), ("s", at(1, 0, 2), 2, 0.0, 1),
        ("s", at(1, 50), 7, 2998000.0, 5), ("t", at(1, 0, 0.25), 4, 0.0, 1), ("t", at(1, 30), 1, 1799750.0, -3), ("u", at(1), None, 0.0, 1),
    ]
    for i, batches in enumerate(splits(rows, ("end", END, 1), 3)):
        stream = source(spark, tmp_path, f"d{i}", batches, "session_id string, timestamp timestamp, step_id long")
        got = run(spark, live.session_deltas(stream), tmp_path, f"deltas{i}")
        got = [(r.session_id, r.timestamp.replace(tzinfo=UTC), r.step_id, r.delta_ms, r.step_gap) for r in got if r.session_id != "end"]
        for key in {r[0] for r in want}:
            assert [r for r in got if r[0] == key] == [r for r in want if r[0] == key], "in order of time"
        assert len(got) == len(want)


def test_a_long_silence_starts_a_session_anew(spark, tmp_path):
    for i, batches in enumerate(splits([("s", at(1), 1), ("s", at(3), 2), ("s", at(3, 5), 4)], ("end", END, 1), 4)[:2]):
        stream = source(spark, tmp_path, f"w{i}", batches, "session_id string, timestamp timestamp, step_id long")
        got = sorted((r.timestamp.hour, r.delta_ms, r.step_gap) for r in run(spark, live.session_deltas(stream), tmp_path, f"anew{i}") if r.session_id == "s")
        assert [g[1:] for g in got] == [(0.0, 1), (0.0, 1), (300000.0, 2)]


def test_session_totals(spark, tmp_path):
    schema = "session_id string, timestamp timestamp, status string, level string"
    rows = [
        [("s", at(1), "success", "INFO"), ("s", at(1, 10), "fail", "ERROR")],
        [("s", at(6), "success", "INFO")],
        [("z", at(12), "success", "INFO")],
    ]
    got = run(spark, live.session_totals(source(spark, tmp_path, "t", rows, schema)), tmp_path, "totals")
    first = [r for r in got if r.n_events == 2]
    assert len(first) == 1
    assert (first[0].n_failures, first[0].n_errors, first[0].duration_ms, first[0].final_status) == (1, 1, 600000.0, "fail")


def test_match_stream(spark, tmp_path):
    req = source(
        spark, tmp_path, "rq", [[("r1", at(1)), ("r2", at(1))], [("late", at(9))], [("end", at(20))]],
        "request_id string, request_timestamp timestamp",
    )
    res = source(
        spark, tmp_path, "rs", [[("r1", at(1, 0, 2))], [("x", at(9))], [("end2", at(20))]],
        "in_response_to string, response_timestamp timestamp",
    )
    got = run(spark, live.match_stream(req, res), tmp_path, "matches")
    pairs = {(r.request_id, r.in_response_to): r.transaction_duration for r in got}
    assert pairs[("r1", "r1")] == 2.0
    assert ("r2", None) in pairs


def test_signature_alerts_do_not_depend_on_batches(spark, tmp_path):
    rows = [("u", at(1, 0, 59)), ("u", at(1)), ("u", at(1, 0, 29)), ("v", at(2, 0, 1)), ("v", at(1)), (None, at(1))]
    for i, batches in enumerate(splits(rows, ("end", END), 5)):
        stream = source(spark, tmp_path, f"s{i}", batches, "user_name string, ts timestamp")
        got = run(spark, live.signature_alerts(stream, late="2 hours"), tmp_path, f"alerts{i}")
        got = sorted((r.user_name, r.interval_seconds, r.rapid, r.delayed) for r in got)
        assert got == [("u", 29.0, True, False), ("v", 3601.0, False, True)]
