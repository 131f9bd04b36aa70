"""Key/value text: ``k: "v", ...``, ``k=v`` on one or several lines, name parts, headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.text import WORD, let, strip

_PAIR = r"\s*([A-Za-z0-9_\-]+)\s*:\s*(\"(?:[^\"\\]|\\.)*\"|[^,]+?)\s*(?:,|$)"
_QUOTED = r'(?s)^"(?:[^"\\]|\\.)*"$'


def last_wins_map(keys: Column, values: Column) -> Column:
    """Map of two arrays in which the last of several equal keys wins, at the place of the first.

    The session's rule for repeated keys, which ``session.prepare`` sets, makes it so.
    """
    return F.map_from_arrays(keys, values)


def unescape(inner: Column) -> Column:
    """Resolve backslash escapes of a quoted value."""
    slash, quote = F.lit("\\"), F.lit('\\"')

    def read(text: Column) -> Column:
        doc = F.concat(F.lit('{"v":"'), text, F.lit('"}'))
        options = {"allowBackslashEscapingAnyCharacter": "true", "allowUnquotedControlChars": "true"}
        # escaped quotes alone, the usual case, need no JSON reader
        only_quotes = ~F.contains(F.replace(text, quote, F.lit("")), slash) & ~F.replace(text, quote, F.lit("")).contains('"')
        return (
            F.when(~F.contains(text, slash), text)
            .when(only_quotes, F.replace(text, quote, F.lit('"')))
            .otherwise(F.coalesce(F.from_json(doc, "v string", options)["v"], text))
        )

    return let(inner, read)


def _clean_value(raw: Column) -> Column:
    # the first character turns most values down before a pattern is tried
    quoted = raw.startswith('"') & raw.rlike(_QUOTED)
    plain = F.when(quoted, unescape(F.substring(raw, F.lit(2), F.length(raw) - 2))).otherwise(strip(raw))

    def unwrapped(text: Column) -> Column:
        edged = (text.startswith('"') & text.endswith('"')) | (text.startswith("'") & text.endswith("'"))
        wrapped = edged & (F.length(text) >= 2)
        return F.when(wrapped, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)

    return let(plain, unwrapped)


def _between(c: Column, left: str, right: str) -> Column:
    return F.substring_index(F.substring_index(c, right, 1), left, -1)


def colon_pairs(line: Column) -> Column:
    """``key: value, key: "quoted, value"`` -> map; the last duplicate wins."""
    return colon_parts(line)["pairs"]


def colon_pairs_rest(line: Column) -> Column:
    """What is left of the line after its last pair, null when nothing is."""
    return colon_parts(line)["rest"]


def colon_parts(line: Column) -> Column:
    """Struct of ``pairs``, the map of a line, and ``rest``, what stands behind its last pair.

    One pass of the pattern puts marks around keys and values; marks that are in the line
    already are no text a log can mean and are dropped first.
    """
    marks = "\u0001\u0002\u0003"
    held = F.contains(line, F.lit(marks[0])) | F.contains(line, F.lit(marks[1])) | F.contains(line, F.lit(marks[2]))
    clean = F.when(held, F.translate(line, marks, "")).otherwise(line)
    marked = F.split(F.regexp_replace(clean, _PAIR, "\u0001$1\u0002$2\u0003"), "\u0001")

    def parts(pieces: Column) -> Column:
        found = F.slice(pieces, F.lit(2), F.size(pieces))
        last = F.element_at(pieces, -1)
        rest = strip(F.when(F.size(pieces) > 1, F.substring_index(last, "\u0003", -1)).otherwise(last))
        return F.struct(
            last_wins_map(
                F.transform(found, lambda p: F.substring_index(p, "\u0002", 1)),
                F.transform(found, lambda p: _clean_value(_between(p, "\u0002", "\u0003"))),
            ).alias("pairs"),
            F.when(rest != "", rest).alias("rest"),
        )

    return let(marked, parts)

_EQUALS = rf"([{WORD}]+)=([^=]*?)(?=\s+[{WORD}]+=|$)"


def equals_pairs(line: Column) -> Column:
    """``k=v with blanks k2=v2`` on one line -> map."""
    keys = F.regexp_extract_all(line, F.lit(_EQUALS), F.lit(1))
    values = F.regexp_extract_all(line, F.lit(_EQUALS), F.lit(2))
    return last_wins_map(keys, F.transform(values, strip))


def equals_lines(lines: Column) -> Column:
    """Array of lines, each ``k=v`` (first ``=`` splits) -> map; other lines are skipped."""
    pairs = F.transform(
        F.filter(lines, lambda x: F.contains(x, F.lit("="))), lambda x: F.split(strip(x), "=", 2)
    )
    return last_wins_map(
        F.transform(pairs, lambda p: strip(p[0])), F.transform(pairs, lambda p: strip(p[1]))
    )


def name_parts(dn: Column) -> Column:
    """Distinguished name -> map of lower-case part name to the array of its values."""
    parts = F.transform(
        F.filter(F.split(dn, ","), lambda p: F.contains(p, F.lit("="))),
        lambda p: F.split(strip(p), "=", 2),
    )
    entries = F.transform(
        parts, lambda p: F.struct(F.lower(strip(p[0])).alias("k"), strip(p[1]).alias("v"))
    )

    def build(all_parts: Column) -> Column:
        keys = F.array_distinct(all_parts["k"])
        values = F.transform(
            keys, lambda k: F.transform(F.filter(all_parts, lambda e: e["k"] == k), lambda e: e["v"])
        )
        return F.map_from_arrays(keys, values)

    return F.when(dn.isNotNull(), let(entries, build))


def metadata_pair(line: Column) -> Column:
    """``- key: value`` -> struct(k, v), null for other lines."""
    pair = F.split(F.substring(line, F.lit(3), F.length(line)), ": ", 2)
    fits = line.startswith("- ") & (F.size(pair) == 2)
    return F.when(
        fits,
        F.struct(
            strip(F.try_element_at(pair, F.lit(1))).alias("k"),
            strip(F.try_element_at(pair, F.lit(2))).alias("v"),
        ),
    )


def header_map(raw: Column) -> Column:
    """Dictionary text with single or double quotes -> map; ``{"raw": ...}`` when unreadable."""
    read = F.when(
        raw.startswith("{") & raw.endswith("}"),
        F.from_json(raw, "map<string,string>", {"allowSingleQuotes": "true"}),
    )
    return F.coalesce(read, F.create_map(F.lit("raw"), raw))


def _attributes(parts: Column) -> Column:
    pairs = F.transform(parts, lambda p: F.split(strip(p), "=", 2))
    return last_wins_map(
        F.transform(pairs, lambda p: strip(p[0])),
        F.transform(pairs, lambda p: F.coalesce(strip(F.get(p, F.lit(1))), F.lit("true"))),
    )


def set_cookie(raw: Column) -> Column:
    """Cookie header -> struct(name, value, attributes, raw); name is null without ``=``."""
    parts = F.split(raw, ";")
    head = F.split(strip(parts[0]), "=", 2)
    named = F.size(head) == 2
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.struct(
        F.when(named, strip(head[0])).alias("name"),
        F.when(named, strip(F.get(head, F.lit(1)))).alias("value"),
        F.when(named, _attributes(rest)).alias("attributes"),
        raw.alias("raw"),
    )


def content_type(raw: Column) -> Column:
    """Content-Type header -> struct(type, params, raw)."""
    parts = F.split(raw, ";")
    rest = F.filter(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.contains(p, F.lit("=")),
    )
    return F.struct(
        strip(parts[0]).alias("type"), _attributes(rest).alias("params"), raw.alias("raw")
    )


def keep_alive(raw: Column) -> Column:
    """Keep-Alive header ``timeout=20, max=100`` -> map."""
    parts = F.filter(F.split(raw, ","), lambda p: F.contains(p, F.lit("=")))
    return _attributes(parts)
