"""SRC-28: whether the host of an address is public: literal IPv4 and IPv6 hosts as numbers against reserved ranges."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Address ranges that aren't reachable from everywhere, and exceptions within them (registries of special addresses).
RESERVED = (
    "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 "
    "198.51.100.0/24 203.0.113.0/24 240.0.0.0/4 ::/128 ::1/128 ::ffff:0:0/96 64:ff9b:1::/48 100::/64 2001::/23 2001:db8::/32 2002::/16 3fff::/20 "
    "5f00::/16 fc00::/7 fe80::/10"
).split()
EXCEPTED = "192.0.0.9/32 192.0.0.10/32 2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28".split()

_NUMBER = r"0[xX][0-9a-fA-F]*|[0-9]+"


def host(url: Column) -> Column:
    """The host of a web address in lower case, IPv6 without brackets; null for anything but http and https."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?i:https?)://(?:[^/?#\\]*@)?(\[[^\]/?#]*\]|[^:/?#\\]+)", 1)
    return F.nullif(F.lower(F.translate(found, "[]", "")), F.lit(""))


def _part(text: Column) -> Column:
    """One number of an IPv4 address: decimal, octal with a leading 0, or hexadecimal with 0x."""
    digits = F.when(text.startswith("0x"), F.conv(F.concat(F.lit("0"), F.substring(text, F.lit(3), F.lit(16))), 16, 10))
    octal = F.when(text.rlike("^0[0-7]*$"), F.conv(text, 8, 10))
    return F.coalesce(digits, octal, F.when(text.rlike("^[1-9][0-9]{0,9}$"), text)).try_cast("long")


def ipv4_number(name: Column) -> Column:
    """A host of one to four numbers as a number; the last one fills what is left, as resolvers have it: 127.1, 2130706433 and
    0x7f.0.0.1 are 127.0.0.1. Null for other hosts."""

    def value(parts: Column) -> Column:
        n = F.size(parts)
        lead, last = F.slice(parts, F.lit(1), n - 1), F.try_element_at(parts, F.lit(-1))
        room = F.pow(F.lit(256.0), 5 - n).cast("long")
        fits = F.forall(lead, lambda x: (x >= 0) & (x <= 255)) & (last >= 0) & (last < room)
        return F.when(fits, F.aggregate(lead, F.lit(0).cast("long"), lambda a, x: a * 256 + x) * room + last)

    def read(plain: Column) -> Column:
        literal = plain.rlike(rf"^(?:{_NUMBER})(?:\.(?:{_NUMBER})){{0,3}}$")
        return F.when(literal, let(F.transform(F.split(plain, r"\."), _part), value))

    return let(F.rtrim(name, F.lit(".")), read)


def _hex(number: Column) -> Column:
    return F.lpad(F.lower(F.hex(number)), 8, "0")


def _spelled(plain: Column) -> Column:
    """An IPv6 host with the dotted numbers that may end it as two groups."""

    def put(tail: Column) -> Column:
        groups = let(_hex(ipv4_number(tail)), lambda v4: F.concat(F.left(v4, F.lit(4)), F.lit(":"), F.right(v4, F.lit(4))))
        return F.when(tail == "", plain).otherwise(F.concat(F.substring(plain, F.lit(1), F.length(plain) - F.length(tail)), groups))

    return let(F.regexp_extract(plain, r"(?:^|:)((?:[0-9]{1,3}\.){3}[0-9]{1,3})$", 1), put)


def ipv6_digits(name: Column) -> Column:
    """An IPv6 host as 32 hexadecimal digits; null for other hosts. A zone behind % doesn't count."""
    groups = lambda h: F.filter(F.split(F.coalesce(h, F.lit("")), ":", -1), lambda x: x != "")

    def read(spelled: Column) -> Column:
        def fill(x: Column) -> Column:
            left, right, n = x["left"], x["right"], x["halves"]
            missing = 8 - F.size(left) - F.size(right)
            full = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
            single = (n == 1) & (missing == 0) & ~spelled.rlike("^:|:$")
            short = (n == 2) & (missing >= 1) & ~spelled.rlike("^:[^:]|[^:]:$|:::")
            valid = (single | short) & F.forall(left, _is_group) & F.forall(right, _is_group)
            return F.when(valid, F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))

        parts = lambda halves: F.struct(groups(halves[0]).alias("left"), groups(F.get(halves, F.lit(1))).alias("right"), F.size(halves).alias("halves"))
        return let(let(F.split(spelled, "::", -1), parts), fill)

    return let(F.split(name, "%")[0], lambda plain: F.when(plain.contains(":"), let(_spelled(plain), read)))


def _is_group(g: Column) -> Column:
    return g.rlike("^[0-9a-f]{1,4}$")


def digits(name: Column) -> Column:
    """A literal host as hexadecimal digits: 8 of IPv4, 32 of IPv6; null for a name."""
    return let(name, lambda x: F.when(x.contains(":"), ipv6_digits(x)).otherwise(_hex(ipv4_number(x))))


def _within(address: Column, ranges: list[str]) -> Column:
    """Whether digits lie in one of the ranges: those of the address's kind in order, and the last that begins before it."""

    def bounds(version: int) -> Column:
        nets = sorted(n for n in map(ipaddress.ip_network, ranges) if n.version == version)
        width = 8 if version == 4 else 32
        pair = lambda n: F.struct(F.lit(f"{int(n.network_address):0{width}x}").alias("a"), F.lit(f"{int(n.broadcast_address):0{width}x}").alias("b"))
        return F.array(*[pair(n) for n in nets])

    known = F.when(F.length(address) == 8, bounds(4)).otherwise(bounds(6))
    last = F.try_element_at(F.filter(known, lambda r: r["a"] <= address), F.lit(-1))
    return F.coalesce(address <= last["b"], F.lit(False))


def is_public_address(address: Column) -> Column:
    """Of digits as in ``digits``."""
    return ~_within(address, RESERVED) | _within(address, EXCEPTED)


def is_public_url(url: Column, resolved: Column | None = None) -> Column:
    """Whether a web address may be asked: its host is a public literal address, or a name all of whose ``resolved`` addresses (an
    array of literals, looked up by the caller) are public. Without them, a name counts as public if it has a dot and isn't
    one of the local ones. False for other schemes, no host, and names that resolve to nothing."""

    def judge(name: Column) -> Column:
        if resolved is None:
            named = name.contains(".") & ~name.rlike(r"(?:^|\.)(?:localhost|local|internal|home\.arpa)\.?$") & ~name.contains(":")
        else:
            public = lambda a: F.coalesce(let(digits(F.lower(a)), is_public_address), F.lit(False))
            named = (F.size(resolved) > 0) & F.forall(resolved, public)
        return let(digits(name), lambda d: F.when(d.isNotNull(), is_public_address(d)).otherwise(named))

    return F.coalesce(let(host(url), judge), F.lit(False))
