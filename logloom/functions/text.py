"""Message text: whitespace, templates, complexity and keyword flags."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, word characters and digits as Python's str and re see them. Java's own
# Unicode mode (?U) means nearly the same but is many times slower than these classes.
_BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"\w\p{L}\p{N}"
DIGIT = r"[0-9\p{Nd}]"
# Word edges. The plain ASCII test comes first and turns most places down at once.
_LEFT, _RIGHT = rf"(?<!\w)(?<![{WORD}])", rf"(?![{WORD}])"
_EDGE = rf"(?:(?<!\w)|(?!\w))(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(c, F.lit(_BLANKS))


def rstrip(c: Column) -> Column:
    """Remove white space of any kind at the end."""
    return F.rtrim(c, F.lit(_BLANKS))


def squeeze(c: Column) -> Column:
    """One blank between words, none at the ends. Single blanks are left alone."""
    return F.trim(F.regexp_replace(c, rf"[{SPACE}&&[^ ]][{SPACE}]*| [{SPACE}]+", " "))


def words(c: Column) -> Column:
    """Array of words; empty text gives an empty array."""
    # one kind of blank first: a single character is split at without a pattern
    odd = c.rlike(rf"[{SPACE}&&[^ ]]")
    plain = F.when(odd, F.translate(c, _BLANKS, " " * len(_BLANKS))).otherwise(c)
    return F.array_remove(F.split(plain, " "), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    A column used twice is computed twice, and inside a lambda once per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    """True when the text holds one of the literal terms; false for null."""

    def hit(text: Column) -> Column:
        found = F.lit(False)
        for term in terms:
            found = found | F.contains(text, F.lit(term))
        return found

    return F.coalesce(let(c, hit) if len(terms) > 1 else hit(c), F.lit(False))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """Capture group of the first match, null when nothing matches."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def filled_group(c: Column, pattern: str, group: int = 1) -> Column:
    """``first_group`` of a group that is never empty: one run of the pattern tells whether it matches."""
    return let(F.regexp_extract(c, pattern, group), lambda found: F.when(found != "", found))


# The order-sensitive rewriting chain that turns a message into its
# template. Each profile names the steps it uses; the order below is the order of use.
TEMPLATE_STEPS: dict[str, tuple[str, str]] = {
    "SAML_ID": (r'ID="[^"]+"', 'ID="<SAML_ID>"'),
    "TIMESTAMP": (r'IssueInstant="[^"]+"', 'IssueInstant="<TIMESTAMP>"'),
    "URL": (rf"https?://[^{SPACE}<>\"']+", "<URL>"),
    "COOKIE": (r"JSESSIONID=[A-Z0-9]+", "JSESSIONID=<ID>"),
    "EMAIL": (
        rf"(?=[A-Za-z0-9._%+\-]){_EDGE}[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}{_RIGHT}",
        "<EMAIL>",
    ),
    "UUID": (
        rf"(?=[0-9a-fA-F]{{8}}-){_LEFT}[0-9a-fA-F]{{8}}(?:-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}{_RIGHT}",
        "<UUID>",
    ),
    "IP": (
        rf"(?={DIGIT}{{1,3}}\.){_LEFT}{DIGIT}{{1,3}}(?:\.{DIGIT}{{1,3}}){{3}}{_RIGHT}",
        "<IP>",
    ),
    "CONN_HASH": (r"@[a-fA-F0-9]+", "@<HASH>"),
    "HEX": (rf"(?=[0-9a-fA-F]{{16}}){_LEFT}[0-9a-fA-F]{{16,}}{_RIGHT}", "<HEX>"),
    "PATH": (r"(?:/[^ \t\n\r\f\x0B:]+)+", "<PATH>"),
    "QUOTE": (r"\"[^\"]+\"|'[^']+'", "<QUOTE>"),
    "NUM": (rf"(?={DIGIT}){_LEFT}{DIGIT}+{_RIGHT}", "<NUM>"),
}
BASE_STEPS = ("COOKIE", "EMAIL", "UUID", "IP", "HEX", "PATH", "QUOTE", "NUM")
POOL_STEPS = ("COOKIE", "EMAIL", "UUID", "IP", "CONN_HASH", "HEX", "PATH", "QUOTE", "NUM")
SSO_STEPS = tuple(TEMPLATE_STEPS)
# Text without which a step finds nothing; most messages lack most of it and pass the pattern by.
_HINTS = {
    "SAML_ID": 'ID="', "TIMESTAMP": 'IssueInstant="', "URL": "://", "COOKIE": "JSESSIONID=", "EMAIL": "@",
    "UUID": "-", "IP": ".", "CONN_HASH": "@", "PATH": "/",
}
# any address has this, and it is cheap to look for
_ADDRESS = r"@[A-Za-z0-9.\-]+\.[A-Za-z]{2}"


def message_template(c: Column, steps: Sequence[str] = BASE_STEPS) -> Column:
    """Replace the variable parts of a message by placeholders."""
    out = c
    for step in steps:
        pattern, label = TEMPLATE_STEPS[step]
        if step in _HINTS:
            out = let(out, _replace_if(_HINTS[step], pattern, label, _ADDRESS if step == "EMAIL" else None))
        else:
            out = F.regexp_replace(out, pattern, label)
    return squeeze(out)


def _replace_if(hint: str, pattern: str, label: str, needs: str | None = None) -> Callable[[Column], Column]:
    def body(c: Column) -> Column:
        found = F.contains(c, F.lit(hint))
        if needs:
            found = found & c.rlike(needs)
        return F.when(found, F.regexp_replace(c, pattern, label)).otherwise(c)

    return body


def complexity(c: Column) -> dict[str, Column]:
    """Word, character, distinct word, punctuation and digit-run counts."""
    tokens = words(c)
    return {
        "word_count": F.size(tokens),
        "char_count": F.length(c),
        "unique_words": F.size(F.array_distinct(F.transform(tokens, F.lower))),
        "punctuation_count": F.regexp_count(c, F.lit("[.,;:!?]")),
        "number_count": F.regexp_count(c, F.lit(rf"{DIGIT}+")),
    }


def error_keyword_flag(c: Column) -> Column:
    """1 when the message mentions an error word, 0 otherwise and for null."""
    return F.coalesce(c.rlike(r"(?i)(error|fail|invalid|denied|timeout)"), F.lit(False)).cast(
        "tinyint"
    )


def unusual_length_flag(c: Column, low: int = 10, high: int = 200) -> Column:
    """1 when the message is shorter than ``low`` or longer than ``high``; null counts as 0 long."""
    size = F.coalesce(F.length(c), F.lit(0))
    return ((size < low) | (size > high)).cast("tinyint")


def suffix(c: Column, n: int = 8) -> Column:
    """The last ``n`` characters."""
    return F.right(c, F.lit(n))


def label(c: Column, names: dict[str, str]) -> Column:
    """Display name of a code, or the code itself when it has none."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(table[c], c)
