"""SAML message fields from XML text, by the built-in XML reader."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wanted parts of the three message kinds; name spaces are ignored.
_TEXT = "struct<_VALUE:string,_Format:string,_SPProvidedID:string>"
_SIGNATURE = "struct<SignedInfo:struct<SignatureMethod:struct<_Algorithm:string>>>"
_ASSERTION = (
    f"_ID:string,_IssueInstant:string,_Version:string,Issuer:{_TEXT},Signature:{_SIGNATURE},"
    f"Subject:struct<NameID:{_TEXT},SubjectConfirmation:array<struct<_Method:string,"
    "SubjectConfirmationData:struct<_InResponseTo:string>>>>,"
    "Conditions:struct<_NotBefore:string,_NotOnOrAfter:string>,"
    "AuthnStatement:struct<_AuthnInstant:string,AuthnContext:struct<AuthnContextClassRef:string>>,"
    "AttributeStatement:struct<Attribute:array<struct<_Name:string,"
    "AttributeValue:array<struct<_VALUE:string>>>>>"
)
SAML_SCHEMA = (
    f"struct<{_ASSERTION},_Destination:string,_ProviderName:string,"
    "_AssertionConsumerServiceURL:string,_InResponseTo:string,"
    "RequestedAuthnContext:struct<AuthnContextClassRef:array<string>>,"
    "Status:struct<StatusCode:struct<_Value:string>>,"
    f"Assertion:struct<{_ASSERTION}>,"
    "EncryptedAssertion:struct<EncryptedData:struct<_Type:string>>,"
    "EncryptedData:struct<_Type:string>,_corrupt_record:string>"
)


def xml_kind(xml: Column) -> Column:
    """Kind of an XML block by the names it contains."""
    return (
        F.when(F.contains(xml, F.lit("AuthnRequest")), "SAML_AUTHN_REQUEST")
        .when(F.contains(xml, F.lit("Response")), "SAML_RESPONSE")
        .when(F.contains(xml, F.lit("Assertion")), "SAML_ASSERTION")
        .when(xml.isNotNull(), "XML_OTHER")
    )


def read_saml(xml: Column) -> Column:
    """The XML as a struct, read once per record.

    Text with a document type declaration is refused, so no entity is ever expanded.
    """
    return F.from_xml(
        F.when(~_has_dtd(xml), xml),
        SAML_SCHEMA,
        {
            "ignoreNamespace": "true",
            "mode": "PERMISSIVE",
            "columnNameOfCorruptRecord": "_corrupt_record",
            "attributePrefix": "_",
            "valueTag": "_VALUE",
        },
    )


def _has_dtd(xml: Column) -> Column:
    return F.contains(F.upper(xml), F.lit("<!DOCTYPE"))


_SKIPPED = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>"
_NAMED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


def plain_markup(xml: Column) -> Column:
    """The text without comments and processing instructions, CDATA as escaped text.

    What is left holds ``<`` only where a tag begins, so patterns see tags as a reader does.
    """

    def shown(token: Column) -> Column:
        inner = F.substring(token, F.lit(10), F.length(token) - 12)
        for char, name in (("&", "amp"), ("<", "lt"), (">", "gt")):
            inner = F.replace(inner, F.lit(char), F.lit(f"&{name};"))
        return F.when(token.startswith("<![CDATA["), inner).otherwise(F.lit(""))

    tokens = F.regexp_extract_all(xml, F.lit(_SKIPPED), F.lit(0))
    parts = F.zip_with(F.split(xml, _SKIPPED, -1), tokens, lambda b, t: F.concat(b, F.coalesce(shown(t), F.lit(""))))
    some = F.contains(xml, F.lit("<!")) | F.contains(xml, F.lit("<?"))
    return F.when(some, F.array_join(parts, "")).otherwise(xml)


def resolved(text: Column) -> Column:
    """Text with the five named and all numeric character references resolved."""

    def one(piece: Column) -> Column:
        name = F.substring_index(piece, ";", 1)
        digits = F.when(name.startswith("#x"), F.substring(name, F.lit(3), F.length(name))).otherwise(
            F.conv(F.substring(name, F.lit(2), F.length(name)), 10, 16)
        )
        number = F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")
        char = F.when(name.rlike("^#(?:x[0-9A-Fa-f]{1,6}|[0-9]{1,7})$"), number)
        for known, c in _NAMED.items():
            char = F.when(name == known, F.lit(c)).otherwise(char)
        rest = F.substring(piece, F.length(name) + 2, F.length(piece))
        ended = F.contains(piece, F.lit(";")) & char.isNotNull()
        return F.when(ended, F.concat(char, rest)).otherwise(F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&", -1)
    read = F.concat(F.slice(pieces, 1, 1), F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), one))
    return F.when(F.contains(text, F.lit("&")), F.array_join(read, "")).otherwise(text)


def _has_tag(plain: Column, name: str) -> Column:
    """Whether an element of this name stands anywhere in the markup, in any name space."""
    return plain.rlike(rf"<(?:[\w.\-]+:)?{name}[\s/>]")


_ATTRIBUTES = r"""(?:\s+[^\s=<>/]+\s*=\s*(?:"[^"]*"|'[^']*'))*\s*"""


def saml_fields(xml: Column, x: Column) -> dict[str, Column]:
    """The fields of an AuthnRequest, Response or Assertion; ``x`` is ``read_saml(xml)``.

    Malformed text sets ``xml_parse_error`` and nothing else.
    """
    has_dtd = _has_dtd(xml)
    plain = plain_markup(xml)
    root = F.regexp_extract(plain, r"\A\s*<(?:[\w.\-]+:)?([\w.\-]+)", 1)
    broken = has_dtd | (xml.isNotNull() & (x.isNull() | x["_corrupt_record"].isNotNull()))
    kind = F.when(
        ~broken,
        F.when(root.endswith("AuthnRequest"), "AuthnRequest")
        .when(root.endswith("Response"), "Response")
        .when(root.endswith("Assertion"), "Assertion"),
    )
    req, resp, asrt = kind == "AuthnRequest", kind == "Response", kind == "Assertion"
    any_kind = kind.isNotNull()
    inner = x["Assertion"]
    issuer = F.coalesce(x["Issuer"], F.when(resp, inner["Issuer"]))
    name_id = x["Subject"]["NameID"]
    deep_id = resolved(F.nullif(F.regexp_extract(plain, rf"<(?:[\w.\-]+:)?NameID{_ATTRIBUTES}>([^<]*)<", 1), F.lit("")))
    classes = x["RequestedAuthnContext"]["AuthnContextClassRef"]
    status = x["Status"]["StatusCode"]["_Value"]
    confirm = F.get(x["Subject"]["SubjectConfirmation"], F.lit(0))
    attribute = F.get(x["AttributeStatement"]["Attribute"], F.lit(0))
    attr_value = F.get(attribute["AttributeValue"], F.lit(0))
    attr_text = attr_value["_VALUE"]
    attr_ok = asrt & attribute["_Name"].isNotNull() & attr_value.isNotNull()
    long_attr = F.length(F.coalesce(attr_text, F.lit(""))) > 100
    signature = F.coalesce(x["Signature"], inner["Signature"])

    def flag(name: str) -> Column:
        return F.when(~broken & _has_tag(plain, name), F.lit(True))

    return {
        "saml_type": kind,
        "saml_id": F.when(any_kind, x["_ID"]),
        "saml_destination": F.when(req, x["_Destination"]),
        "saml_issue_instant": F.when(any_kind, x["_IssueInstant"]),
        "saml_provider_name": F.when(req, x["_ProviderName"]),
        "saml_version": F.when(any_kind, x["_Version"]),
        "saml_assertion_consumer_url": F.when(req, x["_AssertionConsumerServiceURL"]),
        "saml_issuer": F.when(any_kind, issuer["_VALUE"]),
        "saml_sp_provided_id": F.when(req, x["Issuer"]["_SPProvidedID"]),
        "saml_name_id": F.when(req | asrt, F.coalesce(name_id["_VALUE"], deep_id)),
        "saml_name_id_format": F.when(req | asrt, name_id["_Format"]),
        "saml_auth_context_classes": F.when(req & (F.size(classes) > 0), classes),
        "saml_in_response_to": F.when(resp, x["_InResponseTo"]).when(
            asrt, confirm["SubjectConfirmationData"]["_InResponseTo"]
        ),
        "saml_status_code": F.when(resp, status),
        "saml_status": F.when(
            resp & status.isNotNull(),
            F.when(F.contains(status, F.lit("Success")), "Success").otherwise("Failed"),
        ),
        "saml_subject_confirmation_method": F.when(asrt, confirm["_Method"]),
        "saml_not_before": F.when(asrt, x["Conditions"]["_NotBefore"]),
        "saml_not_on_or_after": F.when(asrt, x["Conditions"]["_NotOnOrAfter"]),
        "saml_authn_instant": F.when(asrt, x["AuthnStatement"]["_AuthnInstant"]),
        "saml_auth_context_class": F.when(
            asrt, x["AuthnStatement"]["AuthnContext"]["AuthnContextClassRef"]
        ),
        "saml_attribute_name": F.when(attr_ok, attribute["_Name"]),
        "saml_attribute_value": F.when(attr_ok & ~long_attr, attr_text),
        "saml_attribute_value_length": F.when(attr_ok & long_attr, F.length(attr_text)),
        "saml_has_encrypted_assertion": flag("EncryptedAssertion"),
        "saml_has_encrypted_data": flag("EncryptedData"),
        "saml_has_signature": flag("Signature"),
        "saml_signature_algorithm": F.when(
            ~broken, signature["SignedInfo"]["SignatureMethod"]["_Algorithm"]
        ),
        "xml_parse_error": F.when(has_dtd, "document type declaration refused").when(
            broken, "malformed XML"
        ),
    }
