"""Payload text of transcripts: JSON, key=value lines, labelled fields, plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.keyvalue import equals_lines, last_wins_map, name_parts
from logloom.functions.text import contains_any, let, strip

# Labels of the verifier's report -> field names.
LABELS = {
    "추출한 서명 원문": "signature_plaintext",
    "서명 검증 성공": "signature_verify_success",
    "인증서 검증 성공": "cert_verify_success",
    "사용자 DN": "user_dn",
    "발급자 DN": "issuer_dn",
    "인증서 SN": "cert_sn",
    "인증서 정책": "cert_policy",
    "본인확인 식별값": "pid_hash",
}
_FLAGS = ("signature_verify_success", "cert_verify_success")
# Actions whose payload holds a nested ``input`` document.
NESTED_ACTIONS = ("opa_anomaly_check", "direct_anomaly_check")


def strip_html(c: Column) -> Column:
    """Line-break tags become line ends, other tags vanish."""
    return F.regexp_replace(F.regexp_replace(c, r"<br\s*/?>", "\n"), r"<[^>]+>", "")


def labelled_fields(text: Column) -> Column:
    """``- label [value]``, ``- label`` with ``[value]`` on the next line, or a bare flag -> map.

    A bare label reads ``true``; known labels are renamed.
    """
    lines = F.filter(F.transform(F.split(strip_html(text), "\n"), strip), lambda x: x != "")
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    inline = r"(?s)^(.+?)\s*\[(.+)\]$"

    def entry(line: Column, below: Column) -> Column:
        body = strip(F.substring(line, F.lit(3), F.length(line)))
        has_value = body.rlike(inline)
        label = strip(F.when(has_value, F.regexp_extract(body, inline, 1)).otherwise(body))
        key = F.coalesce(names[label], label)
        under = below.startswith("[") & below.endswith("]")
        value = (
            F.when(has_value & key.isin(*_FLAGS), F.lit("true"))
            .when(has_value, strip(F.regexp_extract(body, inline, 2)))
            .when(under, F.substring(below, F.lit(2), F.length(below) - 2))
            .otherwise(F.lit("true"))
        )
        return F.when(line.startswith("- "), F.struct(key.alias("k"), value.alias("v")))

    def build(all_lines: Column) -> Column:
        below = F.concat(F.slice(all_lines, F.lit(2), F.size(all_lines)), F.array(F.lit("")))
        return F.filter(F.zip_with(all_lines, below, entry), lambda e: e.isNotNull())

    return let(let(lines, build), lambda found: last_wins_map(found["k"], found["v"]))


def json_object(text: Column) -> Column:
    """Top-level fields of an object written with single or double quotes, else null."""
    looks = text.startswith("{") & text.endswith("}")
    return F.when(looks, F.from_json(text, "map<string,string>", {"allowSingleQuotes": "true"}))


def unescaped(text: Column) -> Column:
    """Escapes like ``\\u00e9`` that are left in a text, decoded; the text itself if that fails."""
    quoted = F.concat(F.lit('["'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"]'))
    decoded = F.from_json(quoted, "array<string>")[0]
    return F.when(F.contains(text, F.lit("\\u")), F.coalesce(decoded, text)).otherwise(text)


def classify_payload(entries: DataFrame, lines: str = "payload_lines", action: str = "action") -> DataFrame:
    """Add kind of the payload, its fields as a map, nested input and name parts.

    Each reading is a column of its own, so that it runs once per entry.
    """
    text = F.col("payload_text")
    tried = (
        entries.withColumn("payload_text", strip(F.array_join(lines, "\n")))
        .withColumns(
            {
                "__json": json_object(text),
                "__label": contains_any(text, tuple(LABELS)),
                "__dash": F.contains(text, F.lit("- ")),
            }
        )
        .withColumn(
            "__pairs",
            F.when(
                F.col("__json").isNull() & ~F.col("__label") & F.contains(text, F.lit("=")),
                equals_lines(F.col(lines)),
            ),
        )
    )
    kind = (
        F.when(F.col(lines).isNull(), None)
        .when(text == "", "empty")
        .when(F.col("__json").isNotNull(), "json")
        .when(F.size("__pairs") > 0, "pairs")
        .when(F.col("__label") | F.col("__dash"), "labelled")
        .otherwise("text")
    )
    read = tried.withColumn("payload_kind", kind)
    kind = F.col("payload_kind")
    read = read.withColumn(
        "payload_fields",
        F.when(kind == "json", F.col("__json"))
        .when(kind == "pairs", F.col("__pairs"))
        .when(kind == "labelled", labelled_fields(text)),
    )
    fields = F.col("payload_fields")
    # an input that is no object survives as it stands
    given = fields["input"]
    nested = F.when(
        F.col(action).isin(*NESTED_ACTIONS) & kind.isin("json", "pairs") & given.isNotNull(),
        F.coalesce(json_object(given), F.create_map(F.lit("raw"), given)),
    )
    read = read.withColumn("payload_input", nested)
    plain = kind != "json"
    return read.withColumns(
        {
            "user_dn": name_parts(
                F.coalesce(unescaped(F.col("payload_input")["user_dn"]), F.when(plain, fields["user_dn"]))
            ),
            "issuer_dn": name_parts(F.when(plain, fields["issuer_dn"])),
        }
    ).drop("__json", "__label", "__dash", "__pairs")


def payload_variant(text: Column) -> Column:
    """The payload as a VARIANT when it is JSON, quotes of either kind."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.translate(text, "'", '"')))
