"""Fields of a structured log record, derived from its message, logger and stack lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.text import DIGIT, SPACE, WORD, contains_any, filled_group, first_group, let, rstrip, strip
from logloom.profiles import LogProfile


def noise_line(c: Column, profile: LogProfile) -> Column:
    """True for lines that belong to no record."""
    regex = "^(?:" + "|".join(r.removeprefix("^") for r in profile.noise_regex) + ")"
    return c.rlike(regex) | contains_any(c, profile.noise_terms)


def stack_line(c: Column) -> Column:
    """True for lines of a stack trace or indented continuation."""
    line = rstrip(c)
    return (
        line.rlike(rf"^[{SPACE}]*(?:at[{SPACE}]+[{WORD}.$]+\(.*\)|Caused by: .+)$")
        | line.startswith("\t")
        | line.startswith("    ")
        | (c.startswith(" ") & (F.contains(c, F.lit("at ")) | F.contains(c, F.lit("..."))))
    )


def xml_like_line(c: Column) -> Column:
    """True for a line that begins with a tag and is or may be a piece of XML."""
    line = strip(c)
    return (line.startswith("<") & line.endswith(">")) | line.rlike(r"^<\?xml.*\?>")


def xml_opens(c: Column) -> Column:
    """True for a line that starts an XML block."""
    return xml_like_line(c) & (
        F.contains(c, F.lit("<?xml")) | F.contains(F.lower(c), F.lit("<saml"))
    )


def xml_closes(c: Column) -> Column:
    """True for a line that ends an XML block."""
    return strip(c).rlike(r"</[^:]*:?(?:AuthnRequest|Response|Assertion)>$")


def exception_type(stack: Column) -> Column:
    """Exception name of an array of stack lines, null for an empty array."""
    lines = F.transform(stack, strip)

    def head(x: Column) -> Column:
        return strip(F.substring_index(x, ":", 1))

    def caused(x: Column) -> Column:
        return x.startswith("Caused by: ")

    def named(x: Column) -> Column:
        colon = F.contains(x, F.lit(":")) & ~F.contains(x, F.lit("("))
        return (colon & F.lower(x).endswith("exception")) | x.endswith("Exception") | x.endswith("Error")

    hit = F.get(F.filter(lines, lambda x: caused(x) | named(x)), F.lit(0))
    first = F.get(lines, F.lit(0))
    return (
        F.when(F.size(stack) < 1, None)
        .when(caused(hit), head(F.substring(hit, F.lit(12), F.length(hit))))
        .when(hit.isNotNull(), head(hit))
        .when(F.contains(first, F.lit(":")), F.substring_index(first, ":", 1))
        .otherwise(F.left(first, F.lit(200)))
    )


def severity_score(level: Column, has_stack: Column) -> Column:
    """Fixed base score per level, plus 20 for a stack trace from WARN upwards."""
    base = (
        F.when(level == "TRACE", 5)
        .when(level == "DEBUG", 10)
        .when(level == "INFO", 20)
        .when(level == "WARN", 40)
        .when(level == "ERROR", 80)
        .when(level == "FATAL", 90)
        .otherwise(20)
    )
    return base + F.when(has_stack & (base >= 40), 20).otherwise(0)


def log_category(logger: Column, message: Column, profile: LogProfile) -> Column:
    """First category rule that fits; UNKNOWN without a logger, OTHER when none fits."""

    def chosen(texts: Column) -> Column:
        out = F.when(logger.isNull() | (logger == ""), F.lit("UNKNOWN"))
        for category, where, terms in profile.categories:
            out = out.when(contains_any(texts[where], terms), F.lit(category))
        return out.otherwise(F.lit("OTHER"))

    return let(F.struct(F.lower(logger).alias("logger"), F.lower(message).alias("message")), chosen)


def error_code(message: Column, timing_aware: bool = False) -> Column:
    """HTTP status 4xx/5xx or an ``AB-123`` code.

    The timing-aware form ignores messages about durations and also accepts the
    name of an exception class.
    """
    left, right = rf"(?<![{WORD}])", rf"(?![{WORD}])"
    http = filled_group(message, rf"(?=[45]){left}([45]{DIGIT}{{2}}){right}")
    tries = [
        F.concat(F.lit("HTTP_"), http),
        filled_group(message, rf"(?=[A-Z]){left}([A-Z]{{2,}}-{DIGIT}{{3,}}){right}"),
    ]
    if not timing_aware:
        return F.coalesce(*tries)
    tries.append(filled_group(message, rf"{left}([{WORD}]+(?:Exception|Error)){right}"))
    timing = message.rlike(r"(?i)\[[0-9]+\]\s*milliseconds?") | contains_any(
        F.lower(message),
        ("initialization", "startup", "took", "elapsed", "duration", "completed in"),
    )
    return F.when(~timing, F.coalesce(*tries))


def processing_time_ms(message: Column) -> Column:
    """Milliseconds a message reports; seconds are not scaled."""
    found = F.coalesce(
        F.when(F.contains(F.lower(message), F.lit("millisecond")), filled_group(message, r"(?i)\[([0-9]+)\]\s*milliseconds?")),
        filled_group(message, r"(?i)(?:took|elapsed|duration)[:=\s]*([0-9]+)\s*m?s"),
    )
    return found.try_cast("int")


def low_value(level: Column, message: Column, logger: Column, profile: LogProfile) -> Column:
    """True for records that are dropped: TRACE, plain DEBUG, and start-up chatter."""

    def dropped(x: Column) -> Column:
        kept = contains_any(x["msg"], profile.keep_debug) | contains_any(x["log"], profile.keep_debug)
        chatter = contains_any(x["msg"], profile.drop_terms)
        if profile.protect_errors:
            chatter = chatter & ~level.isin("ERROR", "FATAL")
        always = contains_any(F.coalesce(logger, F.lit("")), profile.keep_loggers)
        return ~always & F.when(level == "DEBUG", ~kept).when(level == "TRACE", F.lit(True)).otherwise(chatter)

    # a filter works an expression out as often as it is named, and a message is put together from its lines
    return let(F.struct(F.lower(message).alias("msg"), F.lower(F.coalesce(logger, F.lit(""))).alias("log")), dropped)


def sso_fields(message: Column) -> dict[str, Column]:
    """License, SAML message, crypto and pool fields of a message."""
    low = F.lower(message)
    is_license = contains_any(message, ("라이센스",)) | contains_any(low, ("license",))
    is_request = contains_any(message, ("AuthnRequest",))
    is_response = contains_any(message, ("Response",)) & contains_any(low, ("saml",))
    is_init = contains_any(message, ("CryptoAPI",))
    is_test = contains_any(message, ("Self Test",)) & ~is_init
    is_pool = contains_any(message, ("Connection Pool Create Success",))
    issuer = r"<saml2:Issuer[^>]*>([^<]+)</saml2:Issuer>"
    return {
        "license_status": F.when(
            is_license & (contains_any(message, ("만료",)) | contains_any(low, ("expired",))), "EXPIRED"
        ).when(is_license & (contains_any(message, ("체크",)) | contains_any(low, ("check",))), "CHECKING"),
        "saml_message_type": F.when(is_request, "AUTHN_REQUEST").when(is_response, "RESPONSE"),
        "saml_destination": F.when(is_request, filled_group(message, r'Destination="([^"]+)"')),
        "saml_issuer": F.when(is_request, filled_group(message, issuer)),
        "crypto_operation": F.when(is_init, "INIT").when(is_test, "SELF_TEST"),
        "crypto_status": F.when(is_test & contains_any(message, ("OK",)), "SUCCESS"),
        "connection_time_ms": F.when(is_pool, filled_group(message, r"\[ (\d+) ms\.\]")).try_cast("int"),
        "db_operation": F.when(is_pool, "POOL_CREATE"),
    }


def pool_fields(message: Column, logger: Column) -> dict[str, Column]:
    """Connection pool counters and actions of pool loggers."""
    pool = contains_any(F.lower(F.coalesce(logger, F.lit(""))), ("hikari",))
    stats = r"Pool stats \(total=(\d+), active=(\d+), idle=(\d+), waiting=(\d+)\)"
    total, active, idle, waiting = (
        F.when(pool, filled_group(message, stats, i)).try_cast("int") for i in (1, 2, 3, 4)
    )
    added = contains_any(message, ("Added connection",))
    closed = contains_any(message, ("Closing connection",)) & ~added
    return {
        "pool_total": total,
        "pool_active": active,
        "pool_idle": idle,
        "pool_waiting": waiting,
        "pool_utilization": F.when(total > 0, active / total).when(total == 0, F.lit(0.0)),
        "connection_action": F.when(pool & added, "ADDED").when(pool & closed, "CLOSED"),
        "close_reason": F.when(pool & closed & contains_any(message, ("maxLifetime",)), "MAX_LIFETIME"),
    }


def signature_parts(message: Column, logger: Column) -> dict[str, Column]:
    """The raw pieces of a signature verifier message that ``signature_fields`` reads."""
    is_sig = contains_any(logger, ("SignedDataVerifier", "CertificateVerifier"))
    m = F.when(is_sig, message)
    return {
        "__msg": m,
        "__code": filled_group(m, r"responseCode=(\d+)"),
        "__dn": F.coalesce(
            filled_group(m, r"dn=([^,]+,[^,]+.*?),\s*signOrgData"),
            filled_group(m, r"dn=([^,]+,[^,]+.*?),\s*signerInfos"),
        ),
        "__chain": first_group(m, r"userCerts=\[(.*?)\]"),
        "__bytes": F.split(filled_group(m, r"signOrgData=\[([^\]]+)\]"), ", "),
        "__signers": F.regexp_extract_all(
            first_group(m, r"signerInfos=\[(.*?)\]"), F.lit(r"SignerInfo@([a-fA-F0-9]+)"), F.lit(1)
        ),
        "__signed_at": strip(filled_group(m, r"signingTime=([^,)]+)")),
    }


def signature_arrays() -> dict[str, Column]:
    """Second layer: what is read out of the raw pieces."""
    clock = F.get(F.split(F.replace(F.col("__signed_at"), F.lit(" KST"), F.lit("")), r"\s+"), F.lit(3))
    return {
        "__units": F.regexp_extract_all(F.col("__dn"), F.lit(r"ou=([^,]+)"), F.lit(1)),
        "__hashes": F.regexp_extract_all(
            F.col("__chain"), F.lit(r"X509Certificate@([a-fA-F0-9]+)"), F.lit(1)
        ),
        "__numbers": F.transform("__bytes", lambda b: strip(b).try_cast("int")),
        "__hour": F.when(
            contains_any(F.col("__signed_at"), ("KST",)) & F.contains(clock, F.lit(":")),
            F.substring_index(clock, ":", 1).try_cast("int"),
        ),
    }


def signature_fields() -> dict[str, Column]:
    """Certificate, signer, signed-data and timing fields from both layers."""
    m, dn, units, hashes = (F.col(c) for c in ("__msg", "__dn", "__units", "__hashes"))
    numbers, signers, hour = F.col("__numbers"), F.col("__signers"), F.col("__hour")
    code = F.col("__code").try_cast("int")
    whole = ~F.exists(numbers, lambda n: n.isNull())
    total = F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, n: a + n)
    is_vo = contains_any(m, ("SignedDataVO(",))
    return {
        "signature_response_code": code,
        "signature_success": code == 0,
        "signature_msg": strip(filled_group(m, r"msg=([^,]+)")),
        "user_dn": dn,
        "user_name": filled_group(dn, r"cn=([^()]+)"),
        "user_organization": F.when(F.size(units) > 0, F.array_join(units, ",")),
        "user_country": filled_group(dn, r"c=([^,]+)"),
        "primary_cert_hash": filled_group(m, r"userCert=.*@([a-fA-F0-9]+)"),
        "cert_chain_length": F.when(F.col("__chain").isNotNull(), F.size(hashes)),
        "cert_chain_hashes": F.when(F.size(hashes) > 0, hashes),
        "signing_time": F.col("__signed_at"),
        "signing_hour": hour,
        "signing_time_period": F.when((hour < 6) | (hour >= 22), "night")
        .when(hour < 12, "morning")
        .when(hour < 18, "afternoon")
        .when(hour.isNotNull(), "evening"),
        "sign_data_length": F.when(F.col("__bytes").isNotNull(), F.size("__bytes")),
        "sign_data_avg": F.when(whole, total / F.size(numbers)),
        "sign_data_min": F.when(whole, F.array_min(numbers)),
        "sign_data_max": F.when(whole, F.array_max(numbers)),
        "sign_data_ascii_range": F.when(whole, F.forall(numbers, lambda n: n.between(32, 126))),
        "signer_info_hashes": F.when(F.size(signers) > 0, signers),
        "signer_count": F.when(F.size(signers) > 0, F.size(signers)),
        "signed_data_hash": filled_group(m, r"signedData=.*@([a-fA-F0-9]+)"),
        "signature_data_complexity": F.when(is_vo, F.length(m)),
        # a word followed by "=" is counted at its "="
        "signature_field_count": F.when(is_vo, F.regexp_count(m, F.lit(rf"(?<=[{WORD}])="))),
    }
