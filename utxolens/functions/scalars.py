"""Parsing and validating columns; every function maps null and blank text to null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most satoshi that can exist: fixed value.
MAX_SATS = 2_100_000_000_000_000


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def parse_sats(c: Column, btc: bool = True) -> Column:
    """struct(value, error): a decimal amount in satoshi, or why it is none."""
    raw = blank_to_null(c)
    number = raw.try_cast("decimal(38,18)")
    sats = number * (100_000_000 if btc else 1)
    error = (F.when(raw.isNull(), F.lit(None)).when(number.isNull(), "not a number").when(number < 0, "negative amount")
             .when(sats != F.floor(sats), "fraction of a satoshi").when(sats > MAX_SATS, "more than can exist"))
    return F.struct(F.when(error.isNull(), sats.cast("long")).alias("value"), error.alias("error"))


def parse_timestamp(c: Column) -> Column:
    """struct(us, error): epoch seconds or milliseconds (9 to 13 digits), or ISO text with a zone; text without one is refused."""
    raw = blank_to_null(c)
    digits = raw.rlike(r"^\d{9,13}(\.\d+)?$")
    number = F.when(digits, raw.try_cast("decimal(30,9)"))
    epoch = F.when(number >= 100_000_000_000, number * 1000).otherwise(number * 1_000_000).cast("long")
    zoned = raw.rlike(r"(?i)(Z|[+-]\d\d:?\d\d|\s(UTC|GMT))$")
    iso = F.unix_micros(F.try_to_timestamp(F.regexp_replace(raw, r"(?i)\s+(UTC|GMT)$", "Z")))
    us = F.when(digits, epoch).when(zoned, iso)
    error = F.when(raw.isNull(), F.lit(None)).when(~digits & ~zoned, "no time zone").when(us.isNull(), "not a time")
    return F.struct(us.alias("us"), error.alias("error"))


def parse_port(c: Column) -> Column:
    raw = blank_to_null(c)
    n = raw.try_cast("int")
    error = F.when(raw.isNull(), F.lit(None)).when(n.isNull() | ~n.between(0, 65535), "not a port")
    return F.struct(F.when(error.isNull(), n).alias("value"), error.alias("error"))


def list_cell(c: Column) -> Column:
    """struct(items, error): a JSON array, a bracketed literal with single quotes, or text parted by ; | , or blanks.

    Null and blank cells are empty lists; a cell that opens a bracket and is no array is an error.
    """
    raw = blank_to_null(c)
    bracket = raw.startswith("[")
    array = F.coalesce(F.from_json(raw, "array<string>"), F.from_json(F.translate(raw, "'", '"'), "array<string>"))
    parted = F.filter(F.split(raw, r"\s*[;|]\s*|\s*,\s*|\s+"), lambda x: x != "")
    items = F.when(raw.isNull(), F.array().cast("array<string>")).when(bracket, array).otherwise(parted)
    error = F.when(bracket & array.isNull(), "not an array")
    return F.struct(F.coalesce(items, F.array().cast("array<string>")).alias("items"), error.alias("error"))


def parse_list_cell(c: Column) -> Column:
    """The items of a list in a cell; see list_cell()."""
    return list_cell(c)["items"]


def asn_number(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(c)), "^AS", "").try_cast("long")


def ipv4_number(c: Column) -> Column:
    """The 32-bit value of a dotted IPv4 address; null for anything else."""
    parts = F.split(F.trim(c), r"\.")
    part = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("int")
    ok = F.trim(c).rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (F.greatest(*[part(i) for i in range(1, 5)]) <= 255)
    return F.when(ok, part(1).cast("long") * 16777216 + part(2) * 65536 + part(3) * 256 + part(4))


def ip_scope(c: Column) -> Column:
    """Scope of an IPv4 address, the first that applies in this order."""
    n = ipv4_number(c)
    net = lambda a, b, d, e, bits: n.between(((a * 256 + b) * 256 + d) * 256 + e, ((a * 256 + b) * 256 + d) * 256 + e + 2 ** (32 - bits) - 1)
    # Address blocks set aside for each purpose.
    documentation = net(192, 0, 2, 0, 24) | net(198, 51, 100, 0, 24) | net(203, 0, 113, 0, 24)
    private = net(10, 0, 0, 0, 8) | net(172, 16, 0, 0, 12) | net(192, 168, 0, 0, 16)
    return (F.when(blank_to_null(c).isNull(), "missing").when(n.isNull(), "invalid").when(documentation, "documentation").when(n == 0, "unspecified").when(net(127, 0, 0, 0, 8), "loopback")
            .when(net(169, 254, 0, 0, 16), "link_local").when(net(224, 0, 0, 0, 4), "multicast").when(private, "private").when(net(240, 0, 0, 0, 4) | net(0, 0, 0, 0, 8), "reserved").otherwise("public"))


def ip_scope_any(c: Column) -> Column:
    """Scope of an IPv4 or IPv6 address, mapped IPv4 unwrapped; meant for distinct addresses, in Arrow batches."""

    @F.pandas_udf("string")
    def scope(values):
        from ipaddress import ip_address, ip_network

        # Networks set aside for documentation.
        papers = [ip_network(n) for n in ("192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "2001:db8::/32", "3fff::/20")]

        def one(v):
            if not v or not v.strip():
                return "missing"
            try:
                a = ip_address(v.strip())
            except ValueError:
                return "invalid"
            a = getattr(a, "ipv4_mapped", None) or a
            if any(a in n for n in papers if n.version == a.version):
                return "documentation"
            kinds = (("unspecified", a.is_unspecified), ("loopback", a.is_loopback), ("link_local", a.is_link_local), ("multicast", a.is_multicast), ("private", a.is_private), ("reserved", a.is_reserved or not a.is_global))
            return next((k for k, is_it in kinds if is_it), "public")

        return values.map(one)

    return scope(c)


def ip_key(c: Column, unwrap: bool = False) -> Column:
    """An address or whole number as 17 bytes that sort like addresses: the version, then the 128-bit value; null for anything else.

    Numbers below 2 to the 32nd are IPv4. With `unwrap` an IPv6 address that maps an IPv4 one is that. Meant for distinct values, in Arrow batches.
    """

    @F.pandas_udf("binary")
    def key(values):
        from ipaddress import ip_address

        def one(v):
            v = (v or "").strip()
            try:
                if v.isascii() and v.isdigit():
                    n = int(v)
                    return bytes([4 if n < 1 << 32 else 6]) + n.to_bytes(16, "big")
                a = ip_address(v)
            except (ValueError, OverflowError):
                return None
            a = (getattr(a, "ipv4_mapped", None) or a) if unwrap else a
            return bytes([a.version]) + int(a).to_bytes(16, "big")

        return values.map(one)

    return key(c)


def ip_number(key: Column) -> Column:
    """The value of an IPv4 key; null for an IPv6 one."""
    return F.when(F.substring(F.hex(key), 1, 2) == "04", F.conv(F.substring(F.hex(key), 27, 8), 16, 10).cast("long"))
