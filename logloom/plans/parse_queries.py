"""Registered queries: parsers over text that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import keyvalue as K
from logloom.functions import net, saml, text, times
from logloom.functions.payload import labelled_fields, strip_html
from logloom.operators.audit import audit_cases, format_census
from logloom.operators.lines import tagged_xml_fields
from logloom.operators.tokens import embedded_json, token_rows
from logloom.operators.transcripts import transcript_entries
from logloom.plans.derived_logs import CHUNK
from logloom.plans.tables import sql_time, table, text_time
from logloom.sources.readers import key_value_events, table_lines

QUERIES = {}
ORACLE = {}


def query(sql: str | None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def _text(c):
    return F.col(c).cast("string")


def _numbered(df: DataFrame, parts) -> DataFrame:
    """``(condition, text)`` lines per row, numbered over ``id`` in blocks of ten."""
    made = F.filter(
        F.array(
            *[
                F.when(cond, F.struct(F.lit(k).alias("k"), value.alias("value")))
                for k, (cond, value) in enumerate(parts)
            ]
        ),
        lambda x: x.isNotNull(),
    )
    rows = df.withColumn("line", F.explode(made)).select(
        F.lit("one-file").alias("source"),
        (F.col("id") * 10 + F.col("line.k")).alias("line_no"),
        F.col("line.value").alias("value"),
    )
    return table_lines(rows, "source", "line_no", "value", CHUNK)


@query(
    f"""SELECT event_id * 10 + 0 AS pos_id, {sql_time('ts')} AS "timestamp", upper('info') AS level,
    'u,' || user_id || ' "q"' AS message, event_type AS event, '9' AS step_id, props AS extra_note,
    CASE WHEN event_id % 3 = 0 THEN 'tail without key' END AS unparsed FROM events"""
)
def key_value_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``key: value`` lines with quoted commas, escapes, duplicates and a tail."""
    e = table(spark, sf, "events").withColumn("id", F.col("event_id"))
    line = F.concat(
        F.lit("timestamp: "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z, level: INFO, step_id: 1, event: "),
        F.col("event_type"), F.lit(', message: "u,'), _text("user_id"), F.lit(' \\"q\\"", note: "'),
        F.replace(F.col("props"), F.lit('"'), F.lit('\\"')), F.lit('", step_id: 9, id: '), _text("event_id"),
        F.when(F.col("event_id") % 3 == 0, F.lit(", tail without key")).otherwise(F.lit("")),
    )
    df = key_value_events(_numbered(e, [(F.lit(True), line)]))
    parsed = df.select(
        (F.col("extras")["id"].cast("bigint") * 10).alias("pos_id"),
        times.utc_timestamp(F.col("timestamp")).alias("timestamp"),
        "level", "message", "event", "step_id", F.col("extras")["note"].alias("extra_note"), "unparsed",
    )
    return text_time(parsed, "timestamp")


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS "timestamp", 'case ' || o_orderpriority AS "caseData",
    o_orderstatus AS "caseResult" FROM orders"""
)
def equals_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``k=v`` on one line, values with blanks."""
    line = F.concat(
        F.lit("timestamp="), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" caseData=case "),
        F.col("o_orderpriority"), F.lit("  caseResult="), F.col("o_orderstatus"),
    )
    p = K.equals_pairs(line)
    return table(spark, sf, "orders").select(
        "o_orderkey", *[p[c].alias(c) for c in ("timestamp", "caseData", "caseResult")]
    )


@query(
    """SELECT s_suppkey, s_name AS cn, 'A' || s_nationkey || '|' || 'B' AS ou, 'KR' AS c FROM supplier"""
)
def name_parts(spark: SparkSession, sf: str) -> DataFrame:
    dn = F.concat(
        F.lit("CN="), F.col("s_name"), F.lit(", ou=A"), _text("s_nationkey"), F.lit(",OU=B,c=KR")
    )
    parts = K.name_parts(dn)
    return table(spark, sf, "supplier").select(
        "s_suppkey", parts["cn"][0].alias("cn"), F.array_join(parts["ou"], "|").alias("ou"), parts["c"][0].alias("c")
    )


@query(
    """SELECT c_custkey, 'JSESSIONID' AS cookie_name, c_name AS cookie_value, '/' AS cookie_path, 'true' AS http_only,
    'text/html' AS content_type, 'UTF-8' AS charset, c_nationkey::VARCHAR AS keep_timeout FROM customer"""
)
def http_headers(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(
        F.lit("{'Set-Cookie': 'JSESSIONID="), F.col("c_name"), F.lit("; Path=/; HttpOnly', 'Content-Type': 'text/html; "),
        F.lit("charset=UTF-8', 'Keep-Alive': 'timeout="), _text("c_nationkey"), F.lit(", max=100'}"),
    )
    df = table(spark, sf, "customer").select("c_custkey", K.header_map(raw).alias("h")).select(
        "c_custkey",
        K.set_cookie(F.col("h")["Set-Cookie"]).alias("cookie"),
        K.content_type(F.col("h")["Content-Type"]).alias("kind"),
        K.keep_alive(F.col("h")["Keep-Alive"]).alias("keep"),
    )
    return df.select(
        "c_custkey", F.col("cookie.name").alias("cookie_name"), F.col("cookie.value").alias("cookie_value"),
        F.col("cookie.attributes")["Path"].alias("cookie_path"), F.col("cookie.attributes")["HttpOnly"].alias("http_only"),
        F.col("kind.type").alias("content_type"), F.col("kind.params")["charset"].alias("charset"),
        F.col("keep")["timeout"].alias("keep_timeout"),
    )


@query(
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS a, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS b,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.000') AS c, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS d,
    CASE event_id % 3 WHEN 0 THEN 'WARN' WHEN 1 THEN 'ERROR' ELSE 'CUSTOM' END AS level,
    strftime(ts, '2020-05-06T%H:%M:%S.%g') AS on_date FROM events"""
)
def timestamps_and_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Four full formats, a clock on a base date, and level names."""
    day = F.lit("2020-05-06").cast("date")

    def iso(pattern: str, comma: bool = False):
        raw = F.date_format("ts", pattern)
        return times.iso_millis(times.full_timestamp(times.timestamp_text(F.translate(raw, ".", ",") if comma else raw)))

    level = F.when(F.col("event_id") % 3 == 0, "경고").when(F.col("event_id") % 3 == 1, "SEVERE").otherwise("custom")
    return table(spark, sf, "events").select(
        "event_id",
        iso("dd-MMM-yyyy HH:mm:ss.SSS").alias("a"),
        iso("yyyy-MM-dd HH:mm:ss.SSS", comma=True).alias("b"),
        iso("yy-MM-dd HH:mm:ss").alias("c"),
        iso("yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("d"),
        times.normalize_level(level).alias("level"),
        times.iso_millis(times.clock_on_date(F.date_format("ts", "HH:mm:ss.SSS"), day)).alias("on_date"),
    )


@query(
    f"""SELECT o_orderkey, {sql_time('o_orderdate')} AS iso, {sql_time("o_orderdate + INTERVAL 5 HOUR")} AS plain,
    '2020-05-06 07:08:09.000000' AS clock, NULL::VARCHAR AS bad FROM orders"""
)
def lenient_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    base = F.lit("2020-05-06").cast("date")

    def read(c):
        return times.lenient_timestamp(c, base)

    df = table(spark, sf, "orders").select(
        "o_orderkey",
        read(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("iso"),
        read(F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 5 HOURS"), "yyyy-MM-dd HH:mm:ss")).alias("plain"),
        read(F.lit("07:08:09")).alias("clock"),
        read(F.lit("soon")).alias("bad"),
    )
    return text_time(df, "iso", "plain", "clock", "bad")


@query(
    """SELECT c_custkey, (c_custkey % 256)::BIGINT * 16777216 + (c_custkey % 200) * 65536 + 258 AS number,
    (c_custkey % 256) || '.' || (c_custkey % 200) || '.1.2' AS back FROM customer"""
)
def ip_numbers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    number = net.ipv4_to_int(F.concat_ws(".", k % 256, k % 200, F.lit("1"), F.lit("2")))
    return table(spark, sf, "customer").select(
        "c_custkey", number.alias("number"), net.int_to_ipv4(number).alias("back")
    )


@query(
    """SELECT page_id, md5(regexp_replace(regexp_replace(html, '<br\\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g')) AS stripped
    FROM pages"""
)
def html_strip(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(strip_html(F.col("html"))).alias("stripped"))


@query(
    """SELECT page_id, 'true' AS signature_verify_success, 'sn-' || page_id AS cert_sn, url AS "own label",
    'true' AS cert_verify_success, 5::INT AS n_fields,
    md5(trim(regexp_replace(regexp_replace(html, '<br\\s*/?>|\n', ' ', 'g'), '<[^>]+>', '', 'g'))) AS plaintext_md5 FROM pages"""
)
def labelled_report(spark: SparkSession, sf: str) -> DataFrame:
    body = F.concat(
        F.lit("<b>- 서명 검증 성공 [yes]</b><br/>- 인증서 SN<br>[sn-"), _text("page_id"), F.lit("]<br />- own label ["),
        F.col("url"), F.lit("]\n- 추출한 서명 원문 ["), F.regexp_replace("html", r"<br\s*/?>|\n", " "), F.lit("]\n- 인증서 검증 성공"),
    )
    m = labelled_fields(body)
    names = ("signature_verify_success", "cert_sn", "own label", "cert_verify_success")
    read = table(spark, sf, "pages").select("page_id", m.alias("m"))
    m = F.col("m")
    return read.select(
        "page_id", *[m[n].alias(n) for n in names], F.size("m").alias("n_fields"),
        F.md5(F.trim(m["signature_plaintext"])).alias("plaintext_md5"),
    )


@query(
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'IN' ELSE 'OUT' END AS direction,
    role AS action, role AS who, CASE role WHEN 'user' THEN 'json' WHEN 'assistant' THEN 'pairs' ELSE 'text' END AS payload_kind,
    CASE role WHEN 'user' THEN turn::VARCHAR WHEN 'assistant' THEN 'v ' || turn END AS n,
    md5(CASE role WHEN 'user' THEN text WHEN 'assistant' THEN trim(translate(text, chr(10) || chr(13), '  '))
      ELSE trim('plain ' || translate(text, chr(10) || chr(13) || '=-{', '     ')) END) AS body_md5 FROM conversations"""
)
def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as transcript entries with metadata and three kinds of payload."""
    role, turn = F.col("role"), _text("turn")
    c = table(spark, sf, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    quoted = F.to_json(F.struct(F.col("turn").cast("string").alias("n"), F.col("text")))
    flat = F.translate("text", "\n\r", "  ")
    head = F.concat(
        F.lit("[2030-01-01T00:00:00.000001] ["), F.when(role == "user", "IN").otherwise("OUT"), F.lit("] "), role
    )
    payload = F.when(role == "user", quoted).when(role == "assistant", F.concat(F.lit("n = v "), turn)).otherwise(
        F.concat(F.lit("plain "), F.translate(flat, "=-{", "   "))
    )
    always = F.lit(True)
    lines = _numbered(
        c,
        [
            (always, head),
            (always, F.concat(F.lit("- who: "), role)),
            (always, F.concat(F.lit("- key: "), F.col("conv_id"), F.lit("/"), turn)),
            (always, F.lit("-- payload begin --")),
            (always, payload),
            (role == "assistant", F.concat(F.lit("text = "), flat)),
            (role != "system", F.lit("-- payload end --")),
        ],
    )
    key = F.split(F.col("metadata")["key"], "/")
    return transcript_entries(lines).select(
        key[0].cast("bigint").alias("conv_id"), key[1].cast("bigint").alias("turn"),
        "direction", "action", F.col("metadata")["who"].alias("who"), "payload_kind",
        F.col("payload_fields")["n"].alias("n"),
        F.md5(F.coalesce(F.col("payload_fields")["text"], F.col("payload_text"))).alias("body_md5"),
    )


_AUDIT_ROWS = """SELECT o_orderkey * 10 AS pos, 0 AS part, strftime(o_orderdate, '%Y-%m-%d 00:00') AS "timestamp", o_orderpriority AS "caseData",
    '' AS "index", o_orderstatus AS "caseResult", 'u' || o_custkey AS "caseUser" FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_orderkey * 10, 1, '', o_orderpriority, '2', '', '' FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_orderkey * 10, 0, strftime(o_orderdate, '%Y-%m-%d 10:00'), 'case ' || o_orderpriority, '', 'ok', 'u' || o_custkey
    FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT o_orderkey * 10, 0, strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority, '', '', 'u' || o_custkey
    FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT'"""


def audit_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as audit lines: JSON, one-line pairs, and blocks of which some are too short."""
    o = table(spark, sf, "orders").withColumn("id", F.col("o_orderkey"))
    status, prio, user = F.col("o_orderstatus"), F.col("o_orderpriority"), F.concat(F.lit("u"), _text("o_custkey"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    json = F.concat(
        F.lit('x AUDIT_PAYLOAD {"rows": [{"logDatetime": "'), day, F.lit('&nbsp;00:00", "caseData": "'), prio,
        F.lit('", "caseResult": "'), status, F.lit('", "caseUser": "'), user, F.lit('"}, {"caseData": "'), prio,
        F.lit('", "index": 2}]} trailing'),
    )
    pairs = F.concat(
        F.lit("timestamp="), day, F.lit(" 10:00 caseData=case "), prio, F.lit(" caseResult=ok caseUser="), user
    )
    is_block = status == "P"
    full = is_block & (prio != "1-URGENT")
    return _numbered(
        o,
        [
            (status == "F", json),
            (status == "O", pairs),
            (is_block, F.concat(F.lit("timestamp="), day)),
            (full, F.concat(F.lit("  caseData="), prio)),
            (full, F.concat(F.lit("caseUser="), user)),
            (is_block & (F.col("o_orderkey") % 2 == 0), F.lit("unrelated line")),
            (is_block & (F.col("o_orderkey") % 2 == 1), F.lit("   ")),
        ],
    )


@query(
    f"""WITH r AS ({_AUDIT_ROWS}) SELECT row_number() OVER (ORDER BY pos, part) AS no, "timestamp", "caseData", "index",
    "caseResult", "caseUser", '' AS "caseType" FROM r"""
)
def audit_case_table(spark: SparkSession, sf: str) -> DataFrame:
    return audit_cases(audit_lines(spark, sf)).drop("source")


@query(
    """SELECT 'json' AS kind, count(*) FILTER (WHERE o_orderstatus = 'F') AS n FROM orders
    UNION ALL SELECT 'pairs', count(*) FILTER (WHERE o_orderstatus <> 'F') FROM orders
    UNION ALL SELECT 'other', count(*) FILTER (WHERE o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT') * 2
      + count(*) FILTER (WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 0) FROM orders"""
)
def audit_format_census(spark: SparkSession, sf: str) -> DataFrame:
    return format_census(audit_lines(spark, sf))


def saml_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as SAML XML: requests, responses, assertions, and some broken text."""
    k, status = _text("o_orderkey"), F.col("o_orderstatus")
    ns = 'xmlns:saml2p="urn:oasis:names:tc:SAML:2.0:protocol" xmlns:saml2="urn:oasis:names:tc:SAML:2.0:assertion"'
    issuer = F.concat(F.lit('<saml2:Issuer SPProvidedID="sp"> '), F.col("o_orderpriority"), F.lit("</saml2:Issuer>"))
    request = F.concat(
        F.lit(f'<?xml version="1.0"?><saml2p:AuthnRequest {ns} ID="r'), k, F.lit('" Version="2.0" Destination="http://d/x">'),
        issuer, F.lit("<saml2p:RequestedAuthnContext><saml2:AuthnContextClassRef>a</saml2:AuthnContextClassRef>"),
        F.lit("<saml2:AuthnContextClassRef>b</saml2:AuthnContextClassRef></saml2p:RequestedAuthnContext></saml2p:AuthnRequest>"),
    )
    response = F.concat(
        F.lit(f'<saml2p:Response {ns} ID="p'), k, F.lit('" InResponseTo="r'), k, F.lit('">'), issuer,
        F.lit('<saml2p:Status><saml2p:StatusCode Value="urn:x:Success"/></saml2p:Status></saml2p:Response>'),
    )
    assertion = F.concat(
        F.lit(f'<saml2:Assertion {ns} ID="a'), k, F.lit('">'), issuer,
        F.lit('<saml2:Subject><saml2:NameID Format="f">n</saml2:NameID><saml2:SubjectConfirmation Method="m">'),
        F.lit('<saml2:SubjectConfirmationData InResponseTo="r'), k, F.lit('"/></saml2:SubjectConfirmation></saml2:Subject>'),
        F.lit('<saml2:AttributeStatement><saml2:Attribute Name="role"><saml2:AttributeValue>admin</saml2:AttributeValue>'),
        F.lit("</saml2:Attribute></saml2:AttributeStatement></saml2:Assertion>"),
    )
    xml = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("<saml2p:Response ID='"), k))
        .when(status == "F", request)
        .when(status == "O", response)
        .otherwise(assertion)
    )
    return table(spark, sf, "orders").select("o_orderkey", xml.alias("xml"))


@query(
    """SELECT o_orderkey, CASE WHEN b THEN NULL WHEN s = 'F' THEN 'AuthnRequest' WHEN s = 'O' THEN 'Response' ELSE 'Assertion' END AS saml_type,
    CASE WHEN NOT b THEN CASE s WHEN 'F' THEN 'r' WHEN 'O' THEN 'p' ELSE 'a' END || o_orderkey END AS saml_id,
    CASE WHEN NOT b THEN o_orderpriority END AS saml_issuer, CASE WHEN NOT b AND s = 'F' THEN 'sp' END AS saml_sp_provided_id,
    CASE WHEN NOT b AND s = 'F' THEN 'http://d/x' END AS saml_destination, CASE WHEN NOT b AND s = 'F' THEN 'a|b' END AS classes,
    CASE WHEN NOT b AND s <> 'F' THEN 'r' || o_orderkey END AS saml_in_response_to,
    CASE WHEN NOT b AND s = 'O' THEN 'Success' END AS saml_status, CASE WHEN NOT b AND s = 'P' THEN 'n' END AS saml_name_id,
    CASE WHEN NOT b AND s = 'P' THEN 'f' END AS saml_name_id_format, CASE WHEN NOT b AND s = 'P' THEN 'role' END AS saml_attribute_name,
    CASE WHEN NOT b AND s = 'P' THEN 'admin' END AS saml_attribute_value,
    CASE WHEN b THEN 'malformed XML' END AS xml_parse_error
    FROM (SELECT *, o_orderstatus AS s, o_orderpriority = '1-URGENT' AS b FROM orders)"""
)
def saml_fields(spark: SparkSession, sf: str) -> DataFrame:
    df = saml_texts(spark, sf).withColumn("x", saml.read_saml(F.col("xml")))
    fields = saml.saml_fields(F.col("xml"), F.col("x"))
    names = (
        "saml_type", "saml_id", "saml_sp_provided_id", "saml_destination", "saml_in_response_to", "saml_status",
        "saml_name_id", "saml_name_id_format", "saml_attribute_name", "saml_attribute_value", "xml_parse_error",
    )
    return df.select(
        "o_orderkey", *[fields[n].alias(n) for n in names],
        text.strip(fields["saml_issuer"]).alias("saml_issuer"),
        F.array_join(fields["saml_auth_context_classes"], "|").alias("classes"),
    )


@query(
    """SELECT s_suppkey, 'id' || s_suppkey AS "ID", '10:00:00' AS "TIME", 'http://h:80/x' AS "ISSUER" FROM supplier"""
)
def tagged_xml(spark: SparkSession, sf: str) -> DataFrame:
    message = F.concat(
        F.lit("got <SAML_AUTHN_REQUEST:ID=id"), _text("s_suppkey"), F.lit(":TIME=10:00:00:ISSUER=http://h:80/x> ok")
    )
    m = tagged_xml_fields(message)
    return table(spark, sf, "supplier").select("s_suppkey", *[m[n].alias(n) for n in ("ID", "TIME", "ISSUER")])


@query(
    """SELECT c_custkey, scope, key, value FROM (
    SELECT c_custkey, 'top' AS scope, 'xid' AS key, 'x' || c_custkey AS value FROM customer
    UNION ALL SELECT c_custkey, 'token.USER', 'NAME', c_name FROM customer
    UNION ALL SELECT c_custkey, 'token.USER', 'MODE', 'a=b' FROM customer)"""
)
def token_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Base64 JSON inside an attribute, its sectioned token as rows."""
    token = F.concat(F.lit("[APP]\nZ=1\n[USER]\nNAME="), F.col("c_name"), F.lit("\nMODE=a=b\n\n[LAST]\nQ=2"))
    doc = F.to_json(F.struct(F.concat(F.lit("x"), _text("c_custkey")).alias("xid"), token.alias("token")))
    xml = F.concat(
        F.lit('<saml2:Attribute Name="AUTHN_INFO"><saml2:AttributeValue t="s">'), F.base64(F.encode(doc, "UTF-8")),
        F.lit("</saml2:AttributeValue></saml2:Attribute>"),
    )
    found = table(spark, sf, "customer").select("c_custkey", F.explode(embedded_json(xml)).alias("json"))
    return token_rows(found, "json", ["c_custkey"])
