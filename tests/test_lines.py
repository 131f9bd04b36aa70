"""Line handling, records and log families on small made-up logs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from logloom import profiles as P
from logloom.functions import records as R
from logloom.functions import text
from logloom.operators import lines as L
from logloom.operators import systemlog as S
from logloom.sources.readers import table_lines, text_lines

SSO_LOG = """orphan line
14:13:17.330 [main] DEBUG a.b.Provider - license check 12
18-Mar-2030 10:51:51.333 WARNING [main] org.x.Y message 가나12 is 12
\tat a.b.C(X.java:1)
NOTE: Picked up JDK_JAVA_OPTIONS: noise
Caused by: java.lang.IllegalStateException: boom
  more text
2030-04-24 10:09:19.752 ERROR 121 --- [   main] o.s.App : failure 500 for 10.1.2.3
<?xml version="1.0"?>
<saml2p:AuthnRequest xmlns:saml2p="p" xmlns:saml2="a" ID="x1" Destination="http://d" Version="2.0">
    <saml2:Issuer SPProvidedID="S">iss</saml2:Issuer>
</saml2p:AuthnRequest>
after text
14:15:00.000 [exec] ERROR c.d.Z - <saml2p:Response ID='1'> told
<saml2p:Response ID="one" xmlns:saml2p="p"></saml2p:Response>
    at later.Stack(Line.java)
DEBUG 30-03-21 03:34:06[pool] [Pool:729] - error in pool
2030-04-24 10:09:19,752 ERROR [main] com.x.Foo - version broke
2030-99-24 10:09:19.752 ERROR [main] com.x.Foo - impossible
2030-04-24 10:09:20.752 FATAL [main] com.x.Foo - fatal
    at x.Y(Z)
<!DOCTYPE a><saml2:Assertion>
&x;</saml2:Assertion>"""


@pytest.fixture(scope="module")
def sso(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sso") / "a.log"
    path.write_text(SSO_LOG, encoding="utf-8")
    return S.structure(text_lines(spark, str(path)), P.SSO).orderBy("pos").collect()


def test_records(sso):
    assert [r.timestamp for r in sso] == [
        "2030-03-18T10:51:51.333", "2030-04-24T10:09:19.752", "2030-04-24T14:15:00.000",
        "2030-03-21T03:34:06.000", "2030-04-24T10:09:20.752",
    ]
    warn = sso[0]
    assert (warn.level, warn.thread, warn.logger, warn.pid) == ("WARN", "main", "org.x.Y", None)
    assert warn.message == "message 가나12 is 12 more text"
    assert warn.message_template == "message 가나12 is <NUM> more text"
    assert (warn.exception_type, warn.severity_score) == ("java.lang.IllegalStateException", 60)
    assert warn.stacktrace.count("\n") == 1


def test_saml_block(sso):
    r = sso[1]
    assert (r.pid, r.thread, r.error_code, r.xml_type) == ("121", "main", "HTTP_500", "SAML_AUTHN_REQUEST")
    assert (r.saml_id, r.saml_issuer, r.saml_sp_provided_id, r.saml_destination) == ("x1", "iss", "S", "http://d")
    assert r.message.endswith("10.1.2.3 after text") and r.xml_parse_error is None
    one_line = sso[2]
    assert (one_line.saml_type, one_line.saml_id, one_line.has_stacktrace) == ("Response", "one", True)
    assert one_line.saml_message_type == "RESPONSE" and one_line.log_category == "SAML"


def test_dtd_is_refused(sso):
    r = sso[-1]
    assert (r.level, r.severity_score) == ("FATAL", 110)
    assert r.xml_parse_error == "document type declaration refused" and r.saml_type is None


def test_line_count_is_conserved(spark, log_file):
    lines = text_lines(spark, log_file(SSO_LOG))
    census = {r.role: r.n for r in L.line_census(lines, P.SSO).collect()}
    assert sum(census.values()) == SSO_LOG.count("\n") + 1
    assert census["orphan"] == 2 and census["noise"] == 1


def test_chunks_do_not_matter(spark):
    rows = [("f", i, v) for i, v in enumerate(SSO_LOG.split("\n"))]
    df = spark.createDataFrame(rows, "source string, n long, value string")
    out = []
    for size in (1, 3, 1000):
        lines = table_lines(df.repartition(5), "source", "n", "value", size)
        rec = L.assemble(L.attach_records(L.drop_noise(lines, P.SSO), P.SSO))
        out.append(sorted(rec.select("pos", "timestamp", "message", "xml_content", "stack").collect(), key=lambda r: r.pos))
    assert out[0] == out[1] == out[2] and len(out[0]) == 6


def test_split_files_keep_their_order(spark, log_file):
    body = "\n".join(
        f"2030-04-24 10:09:19.{i % 1000:03d} ERROR [main] com.x.Foo - event {i}\ncontinued {i}" for i in range(4000)
    )
    path = log_file(body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = text_lines(spark, path)
        assert lines.select("chunk").distinct().count() > 5
        rec = L.assemble(L.attach_records(lines, P.SSO))
        numbered = L.number_lines(lines)
        assert rec.count() == 4000
        assert rec.filter(F.col("message") != F.regexp_replace("message", r"event (\d+) continued .*", "event $1 continued $1")).count() == 0
        assert numbered.agg(F.max("line_no")).first()[0] == 8000
        assert numbered.filter("value = 'continued 3999'").first().line_no == 8000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_base_date_and_no_header(spark, log_file):
    text = "10:00:00.000 [t] ERROR a.B - one\nmore"
    lines = text_lines(spark, log_file(text))
    assert L.assemble(L.attach_records(lines, P.SSO)).count() == 0
    r = L.assemble(L.attach_records(lines, P.SSO, base_date="2030-02-03")).first()
    assert (r.timestamp, r.message) == ("2030-02-03T10:00:00.000", "one more")


def test_bad_bytes_are_dropped(spark, log_file):
    path = log_file(b"2030-04-24 10:09:19.752 ERROR [main] com.x.Foo - a\xffb\n")
    assert L.assemble(L.attach_records(text_lines(spark, path), P.SSO)).first().message == "ab"


def test_agent_headers(spark, log_file):
    text = "2030-04-24 10:09:19.752 ERROR [main] com.x.Foo - dated\n[DEBUG][14:15:18][exec-9][com.x.Y.run] - license expired"
    rows = S.structure(text_lines(spark, log_file(text)), P.AGENT).orderBy("pos").collect()
    assert (rows[1].timestamp, rows[1].logger, rows[1].license_status) == ("2030-04-24T14:15:18.000", "com.x.Y.run", "EXPIRED")


def test_low_value_records(spark):
    from logloom.functions.records import low_value

    rows = [
        ("DEBUG", "plain", "a.B"), ("DEBUG", "login ok", "a.B"), ("TRACE", "login", "a.B"),
        ("ERROR", "version broke", "a.B"), ("INFO", "fine", "a.B"), ("DEBUG", "plain", "x.SignedDataVerifier"),
    ]
    df = spark.createDataFrame(rows, "level string, message string, logger string")

    def drop(profile):
        return [r[0] for r in df.select(low_value(F.col("level"), F.col("message"), F.col("logger"), profile)).collect()]

    assert drop(P.SSO) == [True, False, True, True, False, True]
    assert drop(P.SSO.options(protect_errors=True))[3] is False
    assert drop(P.SIGNATURE)[5] is False
    assert drop(P.SIGNATURE_EARLIER) == [True, True, True, True, False, False]
    assert drop(P.SSO.with_terms(keep_debug=("plain",)))[0] is False


def test_signature_intervals(spark, log_file):
    def line(clock, user):
        return (
            f"2030-01-01 {clock}.000 INFO 7 --- [e] c.SignedDataVerifier : SignedDataVO(responseCode=0, msg=OK, "
            f"dn=cn={user}(),ou=A,o=B,c=KR, signOrgData=[1], signerInfos=[SignerInfo@aa])"
        )

    clocks = [("10:00:00", "u"), ("10:00:10", "v"), ("10:00:29", "u"), ("10:00:59", "u"), ("12:00:00", "u"), ("11:00:00", "u")]
    text = "\n".join(line(*c) for c in clocks)
    rows = S.structure(text_lines(spark, log_file(text)), P.SIGNATURE).orderBy("pos").collect()
    assert [r.signature_interval_seconds for r in rows] == [None, None, 29.0, 30.0, 7141.0, -3600.0]
    assert [r.rapid_signature for r in rows] == [None, None, True, False, False, True]
    assert [r.delayed_signature for r in rows][4] is True
    assert [r.user_signature_count for r in rows] == [1, 1, 2, 3, 4, 5]


def test_template_is_idempotent(spark):
    from logloom.functions.text import SSO_STEPS, message_template

    texts = [
        'ID="abc" IssueInstant="t" x', "mail a.b@c.org at 10.0.0.1", "/a/b/c 123 'q' @ff00 deadbeefdeadbeef0",
        "550e8400-e29b-41d4-a716-446655440000", "가나다12 12 x12", "https://h/x?y=1 JSESSIONID=AB12",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "m string").select(message_template(F.col("m"), SSO_STEPS).alias("t"))
    once = [r.t for r in df.collect()]
    assert once == [
        "ID=<QUOTE> IssueInstant=<QUOTE> x", "mail <EMAIL> at <IP>", "<PATH> <NUM> <QUOTE> @<HASH> <HEX>",
        "<UUID>", "가나다12 <NUM> x12", "<URL> JSESSIONID=<ID>",
    ]
    twice = [r[0] for r in df.select(message_template(F.col("t"), SSO_STEPS)).collect()]
    assert twice == once


def test_texts_are_worked_out_once(spark):
    df = spark.createDataFrame([("DEBUG", "Login page", "a.B"), ("INFO", "VERSION 2", None), (None, None, None)], "level string, message string, logger string")
    level, message, logger = F.col("level"), F.col("message"), F.col("logger")
    low = df.filter(R.low_value(level, F.concat(message, logger), logger, P.SSO))
    plan = low._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(concat(message") == 1
    found = df.select(R.low_value(level, message, logger, P.SSO), R.log_category(logger, message, P.SSO)).collect()
    assert [tuple(r) for r in found] == [(False, "OTHER"), (True, "UNKNOWN"), (False, "UNKNOWN")]


def test_template_steps_pass_by_what_they_cannot_change(spark):
    texts = [
        "X509Certificate@1ab2, a.b@c.de a@b.c1 x@y, 1.2.3.4 11.22.33 1.2.3.4.5 v1.2.3.4", "0123456789abcdef 0123456789abcde g0123456789abcdef01",
        "12345678-1234-1234-1234-123456789abc 2-3 https://a/b /c/d:e 'q' \"r\" \uff11\uff12 \u4e001 5", "", None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = F.col("t")
    for step in text.SSO_STEPS:
        out = F.regexp_replace(out, *text.TEMPLATE_STEPS[step])
    rows = df.select(text.message_template(F.col("t"), text.SSO_STEPS).alias("a"), text.squeeze(out).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and "<EMAIL>" in "".join(r.a or "" for r in rows)
    shown = df.select(text.message_template(F.col("t"), text.SSO_STEPS))._jdf.queryExecution().optimizedPlan().toString()
    assert "JSESSIONID=)" in shown  # looked for before the pattern runs


def test_words_and_points(spark):
    df = spark.createDataFrame([("a\tb\u00a0c  a.,!",), ("",), (None,)], "t string")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in text.complexity(F.col("t")).items()]).collect()]
    assert got == [(4, 11, 4, 3, 0), (0, 0, 0, 0, 0), (None, None, None, None, None)]
