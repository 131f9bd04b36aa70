"""Nested and encoded content: base64 JSON attributes, section text, flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.keyvalue import last_wins_map
from logloom.functions.text import strip
from logloom.sources.readers import EVENT_COLUMNS

_ATTRIBUTE = (
    r'(?s)<saml2:Attribute Name="AUTHN_INFO">.*?<saml2:AttributeValue.*?>(.*?)</saml2:AttributeValue>'
)


def embedded_json(xml: Column) -> Column:
    """Decoded JSON texts of all encoded attributes in a record's XML."""
    found = F.regexp_extract_all(xml, F.lit(_ATTRIBUTE), F.lit(1))
    return F.transform(
        found, lambda b: F.decode(F.try_to_binary(strip(b), F.lit("base64")), "UTF-8")
    )


def section_pairs(text: Column, section: str = "USER") -> Column:
    """``k=v`` lines of one ``[SECTION]``, up to a blank line or the next section, as a map."""
    body = F.regexp_extract(
        F.regexp_replace(text, r"\r\n?", "\n"),
        rf"(?is)(?:^|\n)\s*\[{section}\]\s*?\n(.*?)(?=\n[ \t]*\n|\n\s*\[[^\n]*\]\s*?(?:\n|$)|\z)",
        1,
    )
    pairs = F.transform(
        F.filter(F.split(body, "\n"), lambda x: F.contains(x, F.lit("="))),
        lambda x: F.split(strip(x), "=", 2),
    )
    keys = F.transform(pairs, lambda p: strip(p[0]))
    values = F.transform(pairs, lambda p: strip(p[1]))
    return last_wins_map(keys, values)


def token_rows(df: DataFrame, json: str, id_columns: list[str]) -> DataFrame:
    """``(scope, key, value)`` rows of a decoded token: top-level fields and its USER section."""
    read = df.select(*id_columns, F.from_json(json, "map<string,string>").alias("top"))
    top = F.transform(
        F.map_entries(F.map_filter("top", lambda k, _: k != "token")),
        lambda e: F.struct(F.lit("top").alias("scope"), e["key"].alias("key"), e["value"].alias("value")),
    )
    user = F.transform(
        F.map_entries(section_pairs(F.col("top")["token"])),
        lambda e: F.struct(F.lit("token.USER").alias("scope"), e["key"].alias("key"), e["value"].alias("value")),
    )
    rows = F.concat(top, F.coalesce(user, F.array().cast(T.ArrayType(_ENTRY))))
    return read.select(*id_columns, F.inline(rows))


_ENTRY = T.StructType(
    [
        T.StructField("scope", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs as columns joined with ``sep``; arrays and maps as JSON text."""
    out: list[Column] = []

    def walk(path: str, name: str, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f"{path}.`{f.name}`", f"{name}{sep}{f.name}" if name else f.name, f.dataType)
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            out.append(F.to_json(path).alias(name))
        else:
            out.append(F.col(path).alias(name))

    for f in df.schema.fields:
        walk(f"`{f.name}`", f.name, f.dataType)
    return df.select(*out)


def primary_first(df: DataFrame, primary: tuple[str, ...] = EVENT_COLUMNS) -> DataFrame:
    """The primary columns in their order, then all others by name."""
    first = [c for c in primary if c in df.columns]
    return df.select(*first, *sorted(c for c in df.columns if c not in first))
