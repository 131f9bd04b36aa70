"""The session pipeline against known results of the sample events."""

from __future__ import annotations

import pytest

from logloom.operators import sessions as S
from logloom.sources.readers import key_value_events, text_lines

STEPS = ["login_attempt", "message_validation", "credential_validation", "business_process", "response_return"]


def sample() -> str:
    lines = []
    for minute, session, user in ((35, "aaaaaaaaaaaa", "u1"), (37, "cccccccccccc", "u3")):
        for i, event in enumerate(STEPS):
            lines.append(
                f"timestamp: 2030-09-17T13:{minute}:0{i}Z, level: INFO, session_id: {session}, event: {event}, "
                f'step_id: {i + 1}, user_id: {user}, status: success, message: "Step, done {i} ok", '
                f"source_ip: 203.0.113.{minute}, target: /api/flow"
            )
        if minute == 35:
            lines.append(
                "timestamp: 2030-09-17T13:36:00Z, level: INFO, session_id: bbbbbbbbbbbb, event: login_attempt, "
                'step_id: 1, user_id: u2, status: fail, message: "Login failed", source_ip: 203.0.113.2, '
                "target: /api/flow"
            )
    return "\n".join(lines)


def test_golden_sessions(spark, log_file):
    raw = key_value_events(text_lines(spark, log_file(sample())))
    events = S.event_features(raw)
    scored = S.score_sessions(S.session_table(events))
    rows = {r.session_id: r for r in scored.collect()}
    assert set(rows) == {"aaaaaaaaaaaa", "bbbbbbbbbbbb", "cccccccccccc"}
    for name in ("aaaaaaaaaaaa", "cccccccccccc"):
        r = rows[name]
        assert (r.delta_ms_sum, r.delta_ms_mean, r.delta_ms_std, r.delta_ms_max) == (4000.0, 800.0, 447.214, 1000.0)
        assert (r.duration_ms, r.n_events, r.step_range, r.n_failures) == (4000.0, 5, 4, 0)
        assert (r.delta_too_fast_sum, r.simultaneous_event_sum) == (1, 1)
        assert (r.final_status, r.is_successful, r.start_hour, r.start_dayofweek) == ("success", 1, 13, 1)
        assert r.anomaly_score_final == pytest.approx(0.42426406871192845, abs=1e-12)
    b = rows["bbbbbbbbbbbb"]
    assert (b.delta_ms_std, b.n_failures, b.final_status, b.is_successful) == (None, 1, "fail", 0)
    assert b.anomaly_score_final == pytest.approx(0.8485281374238569, abs=1e-12)
    stats = S.pipeline_stats(events, scored).first()
    assert (stats.total_events, stats.total_sessions, stats.anomalous_sessions_count) == (11, 3, 0)
    assert stats.success_rate == pytest.approx(2 / 3)
    assert stats.avg_session_duration_ms == pytest.approx(2666.6666666666665)
    assert stats.avg_events_per_session == pytest.approx(11 / 3)


def test_golden_events(spark, log_file):
    raw = key_value_events(text_lines(spark, log_file(sample())))
    rows = S.event_features(raw).orderBy("line_number").collect()
    first, second = rows[0], rows[1]
    assert first.message == "Step, done 0 ok"
    assert (first.source_ip_is_internal, first.delta_ms, first.step_gap, first.simultaneous_event) == (1, 0.0, 1, 1)
    assert (second.delta_ms, second.prev_step, second.step_gap, second.delta_too_fast) == (1000.0, 1, 1, 0)
    assert (first.level_freq, first.event_freq, first.status_freq, first.user_id_freq) == (11, 3, 10, 5)
    assert (second.event_freq, second.event_processed, second.event_is_rare) == (2, "message_validation", 0)
    failed = rows[5]
    assert (failed.status_processed, failed.status_is_rare, failed.has_error_keyword) == ("RARE", 1, 1)


def _events(spark, rows):
    return S.normalize_events(
        spark.createDataFrame(
            rows, "timestamp string, session_id string, step_id string, event string, line_number long"
        )
    )


def test_steps_and_gaps(spark):
    rows = [
        ("2030-01-01T10:00:00.000Z", "s", "1", "login_attempt", 1),
        ("2030-01-01T10:00:00.005Z", "s", "3", "message_validation", 2),
        ("2030-01-01T10:00:00.015Z", "s", "2", "other", 3),
        ("2030-01-01T10:00:30.015Z", "s", "2", "other", 4),
        ("2030-01-01T10:01:00.016Z", "s", None, "other", 5),
        ("bad", "s", "9", "other", 6),
        ("2030-01-01T12:00:00Z", None, "1", "x", 7),
        ("2030-01-01T12:00:01Z", None, "2", "x", 8),
    ]
    out = {r.line_number: r for r in S.session_deltas(_events(spark, rows)).collect()}
    assert [out[i].step_jump for i in (1, 2, 3, 4)] == [0, 1, 0, 0]
    assert [out[i].step_reverse for i in (1, 2, 3, 4)] == [0, 0, 1, 1]
    assert [out[i].delta_ms for i in (2, 3, 4, 5)] == [5.0, 10.0, 30000.0, 30001.0]
    assert [out[i].delta_too_fast for i in (1, 2, 3)] == [1, 1, 0]
    assert [out[i].delta_too_slow for i in (4, 5)] == [0, 1]
    assert (out[2].expected_step, out[2].step_event_mismatch) == (2, 1)
    assert out[6].timestamp is None and out[6].delta_ms == 0.0
    assert (out[8].prev_ts, out[8].delta_ms) == (None, 0.0)
    relaxed = S.session_deltas(_events(spark, rows), S.SessionRules(first_event_flags=False))
    assert relaxed.filter("line_number = 1").first().delta_too_fast == 0


def test_chunk_width_does_not_matter(spark):
    rows = [
        (f"2030-01-01T{10 + i // 7}:{(i * 13) % 60:02d}:{(i * 29) % 60:02d}Z", f"s{i % 3}", str(i % 5), "e", i)
        for i in range(60)
    ]
    df = _events(spark, rows)
    wide = S.session_deltas(df, S.SessionRules(chunk="1 day"))
    thin = S.session_deltas(df.repartition(7), S.SessionRules(chunk="1 minute"))
    key = ["line_number", "delta_ms", "prev_step", "step_gap"]
    assert sorted(map(tuple, wide.select(*key).collect()), key=str) == sorted(
        map(tuple, thin.select(*key).collect()), key=str
    )


def test_transitions(spark):
    rows = [
        ("2030-01-01T10:00:00Z", "s", "1", "a", 1),
        ("2030-01-01T11:30:00Z", "s", "2", "b", 2),
        ("2030-01-01T13:00:00Z", "s", "3", "a", 3),
        ("2030-01-01T13:00:01Z", "s", "4", "b", 4),
        ("2030-01-01T10:00:00Z", "t", "1", "a", 5),
    ]
    got = {(r.event, r.next_event): r.n for r in S.transitions(_events(spark, rows)).collect()}
    assert got == {("a", "b"): 2, ("b", "a"): 1}
