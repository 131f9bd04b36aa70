"""Long record bodies, clocks over midnight and nested address ranges."""

from __future__ import annotations

import datetime as dt
import ipaddress
import random

import pytest

from logloom import profiles as P
from logloom.operators import geo
from logloom.operators import lines as L
from logloom.operators.audit import audit_cases
from logloom.operators.transcripts import transcript_entries

LINES = "source string, chunk long, pos long, value string"


def chunked(spark, values, per_chunk, source="a"):
    return spark.createDataFrame([(source, i // per_chunk, i, v) for i, v in enumerate(values)], LINES)


def long_log():
    head = "2030-01-01 10:00:00.000 ERROR 1 --- [main] a.b.C : "
    body = [f"\tat x.Y.m(Y.java:{i})" for i in range(3000)] + [f"more {i}" for i in range(500)] + ["Caused by: a.BadException: late"]
    return [head + "long", *body, head + "short", "tail", head + "last"]


def test_segments_are_bounded_and_give_the_whole_record(spark):
    lines = chunked(spark, long_log(), 700)
    attached = L.attach_records(lines, P.SSO, segment_bytes=4000)
    segments = L.record_segments(attached).collect()
    assert max(sum(len(v) for v in r.text + r.stack + r.xml) for r in segments) < 4100
    assert max(r.segment_no for r in segments if r.rec.pos == 0) > 10
    whole = {r.pos: r for r in L.assemble(attached).collect()}
    one = {r.pos: r for r in L.assemble(L.attach_records(lines, P.SSO)).collect()}
    assert whole == one
    assert whole[0].n_lines == 3501 and not whole[0].cut
    assert len(whole[0].stack) == 3001 and whole[0].message.endswith("more 498 more 499")
    cut = {r.pos: r for r in L.assemble(attached, first_segments=2).collect()}
    assert cut[0].cut and cut[0].n_lines == 3501 and cut[0].stack == whole[0].stack[: len(cut[0].stack)]
    assert 100 < len(cut[0].stack) < 3000
    assert {k: v for k, v in cut.items() if k} == {k: v for k, v in whole.items() if k}


def test_transcripts_and_audit_blocks_of_many_lines(spark):
    payload = [f"line {i}" for i in range(2000)]
    entry = ["[2030-01-01] [IN] get", "- who: x", "-- payload begin --", *payload, "-- payload end --"]
    lines = chunked(spark, entry + ["[2030-01-02] [OUT] put", "- who: y"], 300)
    rows = {r.action: r for r in transcript_entries(lines).collect()}
    assert rows["get"].payload_text == "\n".join(payload) and rows["get"].metadata == {"who": "x"} and not rows["get"].cut
    assert rows["put"].payload_kind is None and rows["put"].line_number == len(entry) + 1
    block = ["timestamp=2030-01-01", *[f"k{i % 50} = v{i}" for i in range(3000)], "caseUser=u", "caseUser=w", "", "other"]
    (case,) = audit_cases(chunked(spark, block, 400)).collect()
    assert (case.timestamp, case.caseUser, case.no) == ("2030-01-01", "w", 1)


@pytest.mark.parametrize("per_chunk", [1, 3, 7, 1000])
def test_clocks_over_midnights(spark, per_chunk):
    rng = random.Random(per_chunk)
    at, lines, want = dt.datetime(2030, 1, 1, 22), [], []
    for i in range(120):
        at += dt.timedelta(minutes=rng.randrange(1, 700))
        if i % 40 == 0:
            at = at.replace(microsecond=0) + dt.timedelta(days=5 * (i > 0))
            lines.append(f"{at:%Y-%m-%d %H:%M:%S}.000 INFO 1 --- [main] a.b.C : x")
        else:
            lines.append(f"{at:%H:%M:%S}.000 [exec-1] INFO a.b.Clock - x")
        want.append(at)
    found = L.roll_over_midnight(L.assemble(L.attach_records(chunked(spark, lines, per_chunk), P.SSO)))
    got = {r.pos: (r.ts, r.timestamp) for r in found.collect()}
    assert (max(want) - min(want)).days > 10
    assert got == {i: (t, f"{t:%Y-%m-%dT%H:%M:%S}.000") for i, t in enumerate(want)}


@pytest.mark.parametrize("chunk_rows", [9, 10_000])
def test_innermost_range_by_brute_force(spark, chunk_rows):
    rng = random.Random(chunk_rows)
    ranges = []
    for _ in range(120):
        a, b = sorted((rng.randrange(1 << 12), rng.randrange(1 << 12)))
        b = min(b, a + rng.choice([0, 3, 40, 4000]))
        ranges.append((str(ipaddress.ip_address((10 << 24) + a)), str(ipaddress.ip_address((10 << 24) + b)), f"c{rng.randrange(9)}"))
        a, b = sorted((rng.getrandbits(64), rng.getrandbits(64)))
        ranges.append((str(ipaddress.ip_address((0x20010DB8 << 96) + a)), str(ipaddress.ip_address((0x20010DB8 << 96) + b)), "v6"))
    ranges += [("0.0.0.0", "255.255.255.255", "all"), (ranges[0][0], ranges[0][1], "zz"), ("5.0.0.9", "5.0.0.1", "turned")]
    points = [str(ipaddress.ip_address((10 << 24) + rng.randrange(1 << 12))) for _ in range(300)]
    points += [str(ipaddress.ip_address((0x20010DB8 << 96) + rng.getrandbits(64))) for _ in range(60)]
    points += ["5.0.0.5", "8.8.8.8", None, "no address", points[0]] + [None] * 50

    def country(ip):
        try:
            x = ipaddress.ip_address(ip)
        except ValueError:
            return None
        held = [
            (-int(s), int(e), c)
            for a, b, c in ranges
            for s, e in [(ipaddress.ip_address(a), ipaddress.ip_address(b))]
            if s.version == x.version and s <= x <= e
        ]
        return min(held)[2] if held else None

    events = spark.createDataFrame(list(enumerate(points)), "i int, source_ip string")
    dim = spark.createDataFrame(ranges, "ip_start string, ip_end string, country string")
    got = {r.i: r.country for r in geo.country_of_ip(events, dim, chunk_rows=chunk_rows).collect()}
    assert got == {i: country(p) for i, p in enumerate(points)}
