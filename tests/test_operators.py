"""Joins under skew, quantiles, ranges, parsers and models on small fixtures."""

from __future__ import annotations

import hashlib
import ipaddress

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.functions import net, times
from logloom.functions.keyvalue import colon_pairs, colon_pairs_rest, colon_parts, equals_pairs
from logloom.operators import correlate, geo, importance, keyed, ordered, quantiles
from logloom.operators.audit import audit_cases
from logloom.operators.forest import isolation_forest
from logloom.operators.quality import column_set_check
from logloom.operators.quantiles import exact_quantiles, rank_quantiles
from logloom.operators.transcripts import transcript_entries
from logloom.sources import readers, sinks
from logloom.functions.net import simple_country
from logloom.functions.payload import NESTED_ACTIONS, classify_payload
from logloom.functions.saml import read_saml, saml_fields
from logloom.operators.geo import NO_INFO, UNKNOWN, country_names
from logloom.operators.keyed import row_salt


@pytest.mark.parametrize("hot_keys", [1, 3, 1000])
def test_attach_by_key(spark, hot_keys):
    rows = [(i, "hot" if i % 3 == 0 else (None if i % 7 == 0 else f"k{i % 20}")) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string")
    stats = keyed.count_by_key(df, ["k"]).withColumn("freq", F.col("n"))
    out = keyed.attach_by_key(df, stats, ["k"], ["freq"], hot_keys=hot_keys).collect()
    want = {}
    for _, k in rows:
        want[k] = want.get(k, 0) + 1
    assert len(out) == 300 and all(r.freq == want[r.k] for r in out)


def test_outer_match_counts(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, None)], "lid long, lk string")
    right = spark.createDataFrame([(1, "a"), (2, "c"), (3, None)], "rid long, rk string")
    out = keyed.outer_match(left, right, "lk", "rk").collect()
    both = [r for r in out if r.lid is not None and r.rid is not None]
    assert len(both) == 1 and len(out) == 1 + 3 + 2


@pytest.mark.parametrize("chunk", [1, 7, 100])
def test_scan_prior(spark, chunk):
    rows = [("a" if i % 5 else "b", i, i if i % 3 == 0 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, n long, v long").withColumn("c", F.floor(F.col("n") / chunk))
    df = df.withColumn("wide", F.floor(F.col("n") / (chunk * 4))).repartition(6)
    out = ordered.scan_prior(df, ["k"], ["wide", "c"], ["n"], last={"seen": F.col("v")}, totals={"before": F.lit(1)})
    state: dict[str, list] = {"a": [None, 0], "b": [None, 0]}
    for r in sorted(out.collect(), key=lambda r: r.n):
        assert [r.seen, r.before] == state[r.k]
        state[r.k] = [r.v if r.v is not None else state[r.k][0], state[r.k][1] + 1]


@pytest.mark.parametrize("range_rows", [30, 65536])
def test_exact_quantiles(spark, range_rows):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.lognormal(0, 3, 400), np.full(200, 2.5), [-7.0, 1e6]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {r.prob: r.value for r in exact_quantiles(df, "x", probs, range_rows).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(x, p)), rel=1e-9)


def test_quantile_ranges_stay_few(spark, monkeypatch):
    assert quantiles.range_count(1000, 256) == 4 and quantiles.range_count(0, 256) == 1
    assert quantiles.range_count(36_000_000, 256) == 200
    assert quantiles.range_count(500_000_000, 256) == 1000
    monkeypatch.setattr(quantiles, "_MOST_SMALL", 3)
    x = np.random.default_rng(4).normal(0, 9, 900)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = {r.prob: r.value for r in exact_quantiles(df, "x", [0.0, 0.3, 0.5, 1.0], 16).collect()}
    assert all(got[p] == pytest.approx(float(np.quantile(x, p)), rel=1e-9) for p in got) and len(got) == 4


def test_quantiles_beside_extreme_values(spark):
    """Spread doesn't matter: small values are told apart beside 1e300 and infinity, and no range is much larger than asked for."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.random(20000) * 1e-9, [1e300, float("inf"), -1e300]])
    rows = [(float(v), None if i % 3 else float(i % 7)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "x double, y double")
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r.feature, r.prob): r.value for r in rank_quantiles(df, {"x": probs, "y": [0.25, 0.5]}, 1000).collect()}
    for p in probs[:-1]:
        assert got["x", p] == pytest.approx(float(np.quantile(x, p)), rel=1e-9)
    assert got["x", 1.0] == float("inf")
    y = np.array([r[1] for r in rows if r[1] is not None])
    assert [got["y", p] for p in (0.25, 0.5)] == [float(np.quantile(y, p)) for p in (0.25, 0.5)]
    assert exact_quantiles(df, "x", [0.99999]).first().value == float("inf")
    sizes = df.select("x").distinct().repartitionByRange(20, "x").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 3000


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, "x", [0.5]).first().value is None


def test_addresses(spark):
    good = ["10.0.0.1", "255.255.255.255", "::", "::1", "2001:db8::ff00:42:8329", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "fe80::"]
    bad = ["256.1.1.1", "1.2.3", "1::2::3", "1:2:3:4:5:6:7", "12345::", "x", "", "1:2:3:4:5:6:7:8:9"]
    df = spark.createDataFrame([(a,) for a in good + bad] + [(None,)], "a string")
    for r in df.select("a", net.ip_sort_key(F.col("a")).alias("k"), net.ip_family(F.col("a")).alias("f")).collect():
        if r.a in good:
            ip = ipaddress.ip_address(r.a)
            assert r.k == format(int(ip), "08x" if ip.version == 4 else "032x") and r.f == str(ip.version)
        else:
            assert r.k is None and r.f is None
    flags = spark.createDataFrame([("192.0.2.9",), ("172.31.0.1",), ("172.32.0.1",), ("bad",), (None,)], "a string")
    assert [r[0] for r in flags.select(net.internal_flag(F.col("a"))).collect()] == [1, 1, 0, 0, 0]


def test_country_ranges(spark, log_file):
    path = log_file(
        "1.0.0.0,1.0.0.255,AU\n0.0.0.0,0.255.255.255,ZZ\n9.0.0.0,99.255.255.255,US\n"
        "2001:db8::,2001:db8:ffff:ffff:ffff:ffff:ffff:ffff,KR\n", "ranges.csv",
    )
    ips = ["1.0.0.0", "1.0.0.255", "1.0.1.0", "50.1.2.3", "99.255.255.255", "100.0.0.0", "2001:db8:7::1", "2001:db9::", "x", None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ips * 3)], "id long, source_ip string")
    out = geo.country_of_ip(df, readers.ip_ranges(spark, path)).orderBy("id").collect()
    assert [r.country for r in out] == ["AU", "AU", None, "US", "US", None, "KR", None, None, None] * 3


def test_key_value_line(spark):
    line = 'a: 1, note: "x, \\"y\\" \\u0041", junk a: 2 , b-c: \'q\', rest of it'
    df = spark.createDataFrame([(line,)], "l string")
    r = df.select(colon_pairs(F.col("l")).alias("m"), colon_pairs_rest(F.col("l")).alias("rest")).first()
    assert r.m == {"note": 'x, "y" A', "a": "2", "b-c": "q"} and r.rest == "rest of it"
    p = spark.createDataFrame([("t=a b  k2=c=d x=",)], "l string").select(equals_pairs(F.col("l")).alias("m")).first().m
    assert p["t"] == "a b" and p["x"] == ""


def test_lenient_times(spark):
    df = spark.createDataFrame([("10:11:12",), ("2030-01-02 03:04:05",), ("2030-01-02T03:04:05Z",), ("soon",)], "t string")
    got = [str(r[0]) for r in df.select(times.lenient_timestamp(F.col("t"), F.lit("2030-05-06").cast("date")).cast("string")).collect()]
    assert got == ["2030-05-06 10:11:12", "2030-01-02 03:04:05", "2030-01-02 03:04:05", "None"]


AUDIT = """timestamp=2030-01-01 10:00
  caseData=x
caseUser=u

timestamp=2030-01-02
timestamp=2030-01-03 caseData=a b caseUser=w
x AUDIT_PAYLOAD {"rows": [{"logDatetime": "2030&nbsp;10", "caseUser": "j"}, {"index": "7"}]} t
AUDIT_PAYLOAD {"rows": [
timestamp=2030-01-04
caseType=t
foreign
caseUser=lost
timestamp=2030-01-05
\tcaseResult=r"""


def test_audit_cases(spark, log_file):
    rows = audit_cases(readers.text_lines(spark, log_file(AUDIT))).orderBy("no").collect()
    assert [(r.no, r.timestamp, r.caseUser) for r in rows] == [
        (1, "2030-01-01 10:00", "u"), (2, "2030-01-03", "w"), (3, "2030 10", "j"), (4, "", ""),
        (5, "2030-01-04", ""), (6, "2030-01-05", ""),
    ]
    assert rows[1].caseData == "a b" and rows[5].caseResult == "r"


TRANSCRIPT = """[t1] [IN] verify
- who: me
- headers: {'Content-Type': 'text/html'}
-- payload begin --
user_dn=cn=Ex,ou=A,ou=B,c=KR
-- payload end --
[t2] [OUT] opa_anomaly_check
-- payload begin --
{"input": "{\\"user_dn\\": \\"cn=Z,ou=Q\\"}"}
[t3] [bad
[t4] [OUT] text
-- payload begin --
old
-- payload end --
-- payload begin --
plain words
-- payload end --
[t5] [OUT] none"""


def test_transcripts(spark, log_file):
    rows = {r.timestamp: r for r in transcript_entries(readers.text_lines(spark, log_file(TRANSCRIPT))).collect()}
    assert set(rows) == {"t1", "t2", "t4", "t5"}
    a = rows["t1"]
    assert (a.line_number, a.direction, a.action, a.payload_kind) == (1, "IN", "verify", "pairs")
    assert a.metadata["who"] == "me" and a.headers == {"Content-Type": "text/html"}
    assert a.user_dn == {"cn": ["Ex"], "ou": ["A", "B"], "c": ["KR"]}
    assert rows["t2"].payload_kind == "json" and rows["t2"].user_dn == {"cn": ["Z"], "ou": ["Q"]}
    assert (rows["t4"].payload_kind, rows["t4"].payload_text) == ("text", "plain words")
    assert rows["t5"].payload_kind is None


def test_match_report(spark):
    idp = spark.createDataFrame(
        [("a", "2030-01-01 10:00:00", None, "P", None, "f", 1), ("b", "2030-01-01 10:00:00", None, "P", "License Error", "f", 2),
         ("c", "2030-01-01 10:00:00", None, "P", None, "f", 3)],
        "idp_id string, ts string, idp_issue_instant timestamp, idp_provider string, idp_error string, idp_file string, idp_line long",
    ).withColumn("idp_ts", F.col("ts").cast("timestamp")).drop("ts")
    sp = spark.createDataFrame(
        [("a", "2030-01-01 10:00:05", None, None, None, "A1", "g", 1), ("a", None, None, "Q", "Success", None, "g", 2),
         ("d", "2030-01-01 10:00:00", None, None, None, None, "g", 3)],
        "sp_id string, ts string, sp_issue_instant timestamp, sp_provider string, sp_status string, sp_agent string, sp_file string, sp_line long",
    ).withColumn("sp_ts", F.col("ts").cast("timestamp")).drop("ts")
    rows = {r.sp_id: r for r in correlate.enrich_matches(correlate.match_sides(idp, sp)).collect()}
    assert rows["a"].sequence_status == "Completed" and rows["a"].duration_sec == 5.0 and rows["a"].provider_any == "Q"
    assert rows["b"].sequence_status == "IDP ERROR: License Error (unmatched)"
    assert rows["c"].is_unmatched and rows["d"].sequence_status == "SP-only (unmatched)"
    assert correlate.match_sides(idp, sp, raw_rows=True).count() == 5


def test_statistical_importance_known_values(spark):
    rows = [(i, i < 6, 1.0 if i == 0 else 0.0) for i in range(59)]
    df = spark.createDataFrame(rows, "id long, flag boolean, x double")
    r = importance.statistical_importance(df, "flag", ["x"]).first()
    assert r.mean_diff == pytest.approx(1.2911799231206254, rel=1e-12)
    assert r.std_ratio == pytest.approx(316273197.7771495, rel=1e-9)
    assert r.cohens_d == pytest.approx(1.3784048604938, rel=1e-7)
    assert r.importance == pytest.approx(562893132.2969677, rel=1e-6)


@pytest.mark.parametrize("range_rows", [13, 100_000])
def test_permutation_is_one_and_the_same(spark, range_rows):
    rows = [(i, float(i % 9), f"t{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, x double, y string").repartition(4)
    out = {r.id: (r.p_x, r.p_y) for r in importance.permuted(df, "id", ["x", "y"], 3, range_rows).collect()}
    order = sorted(range(500), key=lambda i: hashlib.md5(f"3:{i}".encode()).hexdigest())
    assert out == {i: rows[order[(k + 1) % 500]][1:] for k, i in enumerate(order)}


def test_isolation_forest(spark):
    rng = np.random.default_rng(1)
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (300, 2)))] + [(300, 9.0, 9.0), (301, -9.0, 9.0)]
    df = spark.createDataFrame(points, "id long, a double, b double")
    out = isolation_forest(df, "id", ["a", "b"], 0.01, trees=40, sample=64).collect()
    flagged = {r.id for r in out if r.is_anomaly}
    assert {300, 301} <= flagged and len(flagged) <= 4
    again = isolation_forest(df.repartition(5), "id", ["a", "b"], 0.01, trees=40, sample=64).collect()
    assert {r.id: round(r.iso_score, 9) for r in out} == {r.id: round(r.iso_score, 9) for r in again}


def test_readers_and_sinks(spark, tmp_path, log_file):
    path = log_file('{"a": 1, "b": "x"}\n\nnot json\n{"a": 2}\n', "x.ndjson")
    assert readers.ndjson(spark, path, "a long, b string", strict=False).filter("a IS NOT NULL").count() == 2
    assert [r.value for r in readers.ndjson_rejects(spark, path, "a long, b string").collect()] == ["not json"]
    df = spark.createDataFrame([(1, ["p", "q"])], "id long, tags array<string>")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert readers.csv_table(spark, str(tmp_path / "csv"), "id long, tags string").first().tags == '["p","q"]'
    timed = spark.createDataFrame([(1,)], "id long").withColumn("ts", F.lit("2030-01-01 10:00:00").cast("timestamp"))
    sinks.write_parquet(timed, str(tmp_path / "pq"), "ts")
    assert spark.read.parquet(str(tmp_path / "pq")).first().event_date.isoformat() == "2030-01-01"
    sinks.write_ndjson(df, str(tmp_path / "nd"))
    sinks.write_schema(df, str(tmp_path / "schema"))
    assert "tags" in spark.read.text(str(tmp_path / "schema")).first().value
    checked = {(r.column, r.problem) for r in column_set_check(df, ["id", "other"]).collect()}
    assert checked == {("other", "missing"), ("tags", "unexpected")}


def test_local_addresses_of_both_families(spark):
    local = ["::1", "::", "fd00::1", "fe80::1", "2001:db8::5", "::ffff:8.8.8.8", "198.18.0.1", "192.0.0.3", "10.1.2.3"]
    public = ["2606:4700::1", "8.8.8.8", "198.20.0.1", "2001:4860::8888", "no address", None]
    df = spark.createDataFrame([(x,) for x in local + public], "ip string")
    rows = df.select("ip", simple_country(F.col("ip")).alias("c")).collect()
    assert [r.c for r in rows] == ["KR"] * len(local) + ["Unknown"] * len(public)


def test_salt_of_nested_maps(spark):
    df = spark.sql("SELECT 1 AS a, named_struct('m', map('x', 1)) AS s, array(map('y', 2)) AS l")
    assert 1 <= df.select(row_salt(df).alias("r")).first().r <= 1024


def test_names_of_hot_null_and_unknown_codes(spark):
    codes = spark.createDataFrame([("kr",)] * 50 + [(None,)] * 50 + [("Q1",), (" KR ",)], "country string")
    names = spark.createDataFrame([("KR", "b"), ("kr ", "a")], "code string, name string")
    rows = country_names(codes, names).groupBy("country", "country_name").count().collect()
    assert {(r.country, r.country_name, r["count"]) for r in rows} == {
        ("kr", "a", 50), (None, NO_INFO, 50), ("Q1", f"{UNKNOWN}(Q1)", 1), (" KR ", "a", 1)
    }


def test_rows_without_state_pass_by(spark):
    rows = [(1, 5, "a"), (1, 7, "b"), (None, 6, "c"), (None, 8, "d")]
    df = spark.createDataFrame(rows, "k int, t int, v string").withColumn("c", F.col("t").cast("long"))
    out = ordered.scan_some(df, F.col("k").isNotNull(), ["k"], ["c"], ["t"], last={"prev": F.col("v")}).collect()
    assert {(r.k, r.v, r.prev) for r in out} == {(1, "a", None), (1, "b", "a"), (None, "c", None), (None, "d", None)}


def test_nested_input_that_is_no_object_survives(spark):
    lines = [["{'input': 'not json'}"], ['{"input": "{\\"user_dn\\": \\"cn=\\\\\\\\u00e9,o=x\\"}"}']]
    df = spark.createDataFrame([(NESTED_ACTIONS[0], x) for x in lines], "action string, payload_lines array<string>")
    rows = classify_payload(df).collect()
    assert rows[0].payload_input == {"raw": "not json"}
    assert "é" in str(rows[1].user_dn)


def test_saml_elements_at_any_depth(spark):
    text = (
        '<saml:Assertion xmlns:saml="s" ID="i"><saml:Subject><saml:EncryptedID><xenc:EncryptedData xmlns:xenc="e"/>'
        "</saml:EncryptedID></saml:Subject><x><saml:NameID>deep</saml:NameID></x></saml:Assertion>"
    )
    df = spark.createDataFrame([(text,)], "xml string").withColumn("x", read_saml(F.col("xml")))
    row = df.select(*[c.alias(n) for n, c in saml_fields(F.col("xml"), F.col("x")).items()]).first()
    assert (row.saml_has_encrypted_data, row.saml_name_id, row.saml_has_signature) == (True, "deep", None)


def test_saml_markup_as_a_reader_sees_it(spark):
    ns = 'xmlns:p="urn:p" xmlns:a="urn:a"'
    texts = [
        f'<p:Response {ns} ID="1"><!-- <a:EncryptedAssertion/> --><![CDATA[<Signature/>]]></p:Response>',
        f'<p:AuthnRequest {ns} ID="2"><x><a:NameID Format="a>b"><![CDATA[u<1>&]]></a:NameID></x></p:AuthnRequest>',
        f'<p:AuthnRequest {ns} ID="3"><x><a:NameID>A&amp;B &#xE9;&#8364;<!-- c -->&lt;t&gt;</a:NameID></x></p:AuthnRequest>',
        f'<p:AuthnRequest {ns} ID="4"><a:NameID x="/"/><y>no</y><!-- <a:NameID>hidden</a:NameID> --></p:AuthnRequest>',
        f'<?xml version="1.0"?><!-- <p:Response> --><p:Response {ns} ID="5"><Signature><SignedInfo/></Signature></p:Response>',
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, xml string").withColumn("x", read_saml(F.col("xml")))
    fields = saml_fields(F.col("xml"), F.col("x"))
    names = ("saml_type", "saml_name_id", "saml_has_encrypted_assertion", "saml_has_signature", "xml_parse_error")
    got = {r.i: tuple(r[1:]) for r in df.select("i", *[fields[n].alias(n) for n in names]).collect()}
    assert got == {
        0: ("Response", None, None, None, None),
        1: ("AuthnRequest", "u<1>&", None, None, None),
        2: ("AuthnRequest", "A&B \u00e9\u20ac<t>", None, None, None),
        3: ("AuthnRequest", None, None, None, None),
        4: ("Response", None, None, True, None),
    }


def test_csv_with_byte_order_mark(spark, tmp_path):
    path = str(tmp_path / "bom")
    df = spark.createDataFrame([(1, "é", [1, 2]), (2, None, None)], "i int, t string, a array<int>")
    sinks.write_csv(df.coalesce(1), path, bom=True)
    (part,) = (tmp_path / "bom").glob("part-*.csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfi,t,a")
    rows = readers.csv_table(spark, path, "i int, t string, a string").collect()
    assert sorted((r.i, r.t, r.a) for r in rows) == [(1, "é", "[1,2]"), (2, None, None)]


def test_key_value_lines_without_patterns_inside(spark):
    lines = [
        r'a: "x \"y\"", b: "c:\\d", c: "\\\"q", d: "\u0041\"", e: plain, f: ""',
        "a: 1\u0001, b\u0003: 2, a: 3, tail",
        "no pair",
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, v string")
    got = [(r.p.pairs, r.p.rest) for r in df.orderBy("i").select(colon_parts(F.col("v")).alias("p")).collect()]
    assert got[0] == ({"a": 'x "y"', "b": "c:\\d", "c": '\\"q', "d": 'A"', "e": "plain", "f": ""}, None)
    assert got[1] == ({"a": "3", "b": "2"}, "tail") and got[2] == ({}, "no pair")
    plan = df.select(colon_parts(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()
    assert "\u0002|\u0003" not in plan  # no pattern is compiled for each piece
