"""IP addresses as numbers and as sortable text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from logloom.functions.text import let

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

# Networks counted as internal.
INTERNAL_NETWORKS = (
    "203.0.113.0/24",
    "192.0.2.0/24",
    "198.51.100.0/24",
    "127.0.0.0/8",
    "10.0.0.0/8",
    "172.16.0.0/12",
    "192.168.0.0/16",
)


def ipv4_to_int(c: Column) -> Column:
    """Number of an IPv4 address; null for anything else."""
    octets = F.split(c, r"\.")
    number = F.aggregate(
        octets, F.lit(0).cast("bigint"), lambda total, octet: total * 256 + octet.cast("bigint")
    )
    return F.when(c.rlike(IPV4), number)


def int_to_ipv4(c: Column) -> Column:
    """Dotted form of an IPv4 number."""
    return F.concat_ws(".", *[F.shiftright(c, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def _network(cidr: str) -> tuple[int, int]:
    address, bits = cidr.split("/")
    a, b, c, d = (int(x) for x in address.split("."))
    first = (a << 24) + (b << 16) + (c << 8) + d
    return first, first + (1 << (32 - int(bits))) - 1


def internal_flag(c: Column, networks: tuple[str, ...] = INTERNAL_NETWORKS) -> Column:
    """1 for an address inside one of the networks; 0 for others, errors and null."""

    def in_any(number: Column) -> Column:
        inside = F.lit(False)
        for first, final in map(_network, networks):
            inside = inside | number.between(first, final)
        return inside

    return F.coalesce(let(ipv4_to_int(c), in_any), F.lit(False)).cast("tinyint")


_HEXTETS = r"[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"
_IPV6 = rf"^(?:{_HEXTETS})?(?:::(?:{_HEXTETS})?)?$"


def ipv6_to_hex(c: Column) -> Column:
    """32 hex digits of an IPv6 address; null for anything else."""

    def plain(low: Column) -> Column:
        # a dotted tail stands for the last two groups
        tail = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"
        number = ipv4_to_int(F.regexp_extract(low, tail, 0))
        groups = F.concat_ws(
            ":", F.lower(F.hex(F.shiftright(number, 16))), F.lower(F.hex(number.bitwiseAND(0xFFFF)))
        )
        return F.when(low.contains("."), F.concat(F.regexp_replace(low, tail, ""), groups)).otherwise(low)

    def groups_of(c: Column) -> Column:
        return F.array_remove(F.split(c, ":"), "")

    def expand(address: Column) -> Column:
        gap = F.contains(address, F.lit("::"))
        head = groups_of(F.substring_index(address, "::", 1))
        rest = F.when(gap, groups_of(F.substring_index(address, "::", -1))).otherwise(
            F.array().cast("array<string>")
        )

        def fill(p: Column) -> Column:
            given = F.size(p["head"]) + F.size(p["rest"])
            zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - given, F.lit(0)))
            full = F.concat(p["head"], zeros, p["rest"])
            fits = F.when(gap, given < 8).otherwise(given == 8)
            return F.when(fits, F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))

        whole = let(F.struct(head.alias("head"), rest.alias("rest")), fill)
        return F.when(address.rlike(_IPV6), whole)

    return F.when(c.contains(":"), let(let(F.lower(c), plain), expand))


def ip_family(c: Column) -> Column:
    """``4``, ``6``, or null for an invalid address."""
    return F.when(c.rlike(IPV4), F.lit("4")).when(ipv6_to_hex(c).isNotNull(), F.lit("6"))


def ip_sort_key(c: Column) -> Column:
    """Fixed-width hex text that sorts like the address inside its family."""
    v4 = ipv4_to_int(c)
    return F.when(v4.isNotNull(), F.lower(F.lpad(F.hex(v4), 8, "0"))).otherwise(ipv6_to_hex(c))


# Further networks that are not public, and v6 prefixes as hex digits.
LOCAL_NETWORKS = (
    "0.0.0.0/8",
    "169.254.0.0/16",
    "192.0.0.0/29",
    "192.0.0.170/31",
    "198.18.0.0/15",
    "240.0.0.0/4",
)
LOCAL_PREFIXES_V6 = (
    "00000000000000000000000000000000",
    "00000000000000000000000000000001",
    "00000000000000000000ffff",
    "0064ff9b0001",
    "0100000000000000",
    "200100",
    "200101",
    "20010db8",
    "fc",
    "fd",
    "fe8",
    "fe9",
    "fea",
    "feb",
)


def simple_country(c: Column, known: dict[str, str] | None = None) -> Column:
    """Country rule without a range table: private and test addresses are local."""

    def is_local(number: Column, wide: Column) -> Column:
        inside = F.lit(False)
        for first, final in map(_network, INTERNAL_NETWORKS + LOCAL_NETWORKS):
            inside = inside | number.between(first, final)
        for prefix in LOCAL_PREFIXES_V6:
            inside = inside | wide.startswith(prefix)
        return inside

    # the address is read once, not once for each network
    parsed = F.struct(ipv4_to_int(c).alias("v4"), ipv6_to_hex(c).alias("v6"))
    local = let(parsed, lambda p: F.coalesce(is_local(F.coalesce(p["v4"], F.lit(-1)), F.coalesce(p["v6"], F.lit("-"))), F.lit(False)))
    out = F.when(local, F.lit("KR"))
    for address, code in (known or {}).items():
        out = out.when(c == address, F.lit(code))
    return out.otherwise(F.lit("Unknown"))
