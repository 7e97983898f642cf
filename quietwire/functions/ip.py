"""Address columns: parsing, ranges, categories. IPv4 first; what holds a colon may be IPv6."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

from quietwire.config import KNOWN_IPS

OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DOTTED_QUAD = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}\z"

_H = "[0-9A-Fa-f]{1,4}"
_QUAD = rf"{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}"
_LAST = f"({_H}:{_H}|{_QUAD})"
# Eight groups, or fewer around one "::"; the last two may be a dotted quad; a zone may follow.
IPV6 = (
    f"^(({_H}:){{6}}{_LAST}|::({_H}:){{5}}{_LAST}|({_H})?::({_H}:){{4}}{_LAST}"
    f"|(({_H}:){{0,1}}{_H})?::({_H}:){{3}}{_LAST}|(({_H}:){{0,2}}{_H})?::({_H}:){{2}}{_LAST}"
    f"|(({_H}:){{0,3}}{_H})?::{_H}:{_LAST}|(({_H}:){{0,4}}{_H})?::{_LAST}"
    f"|(({_H}:){{0,5}}{_H})?::{_H}|(({_H}:){{0,6}}{_H})?::)(%[^%]+)?\\z"
)

LOOPBACK = ("127.0.0.0/8",)
LINK_LOCAL = ("169.254.0.0/16",)
MULTICAST = ("224.0.0.0/4",)
RESERVED = ("240.0.0.0/4",)
# The networks counted as private, and the two hosts taken out of 192.0.0.0/24.
PRIVATE = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.0.170/31",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "240.0.0.0/4",
)
PRIVATE_EXCEPTIONS = ("192.0.0.9/32", "192.0.0.10/32")
LOOPBACK6 = ("::1/128",)
LINK_LOCAL6 = ("fe80::/10",)
MULTICAST6 = ("ff00::/8",)
# The IPv6 networks counted as private, what is taken out of them, and the reserved ones.
PRIVATE6 = (
    "::1/128",
    "::/128",
    "64:ff9b:1::/48",
    "100::/64",
    "2001::/23",
    "2001:db8::/32",
    "2002::/16",
    "3fff::/20",
    "fc00::/7",
    "fe80::/10",
)
PRIVATE6_EXCEPTIONS = (
    "2001:1::1/128",
    "2001:1::2/128",
    "2001:3::/32",
    "2001:4:112::/48",
    "2001:20::/28",
    "2001:30::/28",
)
RESERVED6 = (
    "::/8",
    "100::/8",
    "200::/7",
    "400::/6",
    "800::/5",
    "1000::/4",
    "4000::/3",
    "6000::/3",
    "8000::/3",
    "a000::/3",
    "c000::/3",
    "e000::/4",
    "f000::/5",
    "f800::/6",
    "fe00::/9",
)


def leading_octets(cidr: str) -> tuple[int, list[str]] | None:
    """A network as the texts its addresses start with: (octets, texts), at most 256 texts.

    172.16.0.0/12 gives 2 octets and 172.16 .. 172.31. None where the text is no IPv4 network.
    """
    try:
        net = ipaddress.IPv4Network(cidr)
    except ValueError:
        return None
    octets = max(1, -(-net.prefixlen // 8))
    step = 1 << (32 - 8 * octets)
    first, last = int(net.network_address), int(net.broadcast_address)
    texts = [
        ".".join(str(ipaddress.IPv4Address(n)).split(".")[:octets]) for n in range(first, last + 1, step)
    ]
    return octets, texts


def is_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(DOTTED_QUAD), F.lit(False))


def is_ipv6(ip: Column) -> Column:
    return F.coalesce(F.contains(ip, F.lit(":")) & ip.rlike(IPV6), F.lit(False))


def is_ip(ip: Column) -> Column:
    """An IPv4 or IPv6 address."""
    return is_ipv4(ip) | is_ipv6(ip)


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often it stands in the body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ipv6_halves(ip: Column) -> Column:
    """struct(hi, lo) of an IPv6 text: its 128 bits as two longs."""
    bare = F.lower(F.substring_index(ip, "%", 1))

    def spelled(text: Column) -> Column:
        """The text with a dotted quad at its end as two groups."""
        head = F.regexp_replace(text, r"[^:]*\z", "")
        high = lambda quad: F.lower(F.hex(F.shiftright(quad, 16)))
        low = lambda quad: F.lower(F.hex(quad.bitwiseAND(F.lit(0xFFFF))))
        words = lambda quad: F.coalesce(F.concat(head, high(quad), F.lit(":"), low(quad)), text)
        dotted = _bound(ip_to_long(F.substring_index(text, ":", -1)), words)
        return F.when(F.contains(text, F.lit(".")), dotted).otherwise(text)

    groups = lambda text: F.filter(F.split(text, ":"), lambda g: g != "")

    def full(sides: Column) -> Column:
        left, right = groups(F.get(sides, F.lit(0))), groups(F.get(sides, F.lit(1)))
        some = F.struct(left.alias("left"), F.coalesce(right, F.array().cast("array<string>")).alias("right"))
        return _bound(some, lambda s: F.concat(s.getField("left"), zeros(s), s.getField("right")))

    def zeros(s: Column) -> Column:
        missing = F.lit(8) - F.size(s.getField("left")) - F.size(s.getField("right"))
        return F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))

    digits = lambda all_: F.array_join(F.transform(all_, lambda g: F.lpad(g, 4, "0")), "")
    half = lambda text, a: F.conv(F.substring(text, a, 16), 16, -10).cast("bigint")  # signed
    halves = lambda all_: _bound(digits(all_), lambda text: F.struct(half(text, 1).alias("hi"), half(text, 17).alias("lo")))
    return _bound(_bound(F.split(_bound(bare, spelled), "::", 2), full), halves)


def in_networks6(ip: Column, cidrs: Iterable[str]) -> Column:
    """Whether an IPv6 address lies in one of the networks. Texts that are none: false."""
    nets = []
    for cidr in cidrs:
        try:
            nets.append(ipaddress.IPv6Network(cidr))
        except ValueError:
            continue

    def inside(h: Column) -> Column:
        tests = []
        for net in nets:
            first, bits = int(net.network_address), net.prefixlen
            hi, lo = _signed(first >> 64), _signed(first & ((1 << 64) - 1))
            shift = lambda c, n: F.shiftright(c, n) if n < 64 else F.lit(0).cast("bigint")
            if bits <= 64:
                tests.append(shift(h.getField("hi"), 64 - bits) == F.lit(hi >> (64 - bits) if bits else 0))
            else:
                tests.append((h.getField("hi") == hi) & (shift(h.getField("lo"), 128 - bits) == F.lit(lo >> (128 - bits))))
        return reduce(lambda a, b: a | b, tests, F.lit(False))

    found = _bound(ipv6_halves(ip), inside)
    return F.when(is_ipv6(ip), F.coalesce(found, F.lit(False))).otherwise(F.lit(False))


def mapped_ipv4(ip: Column) -> Column:
    """The IPv4 address inside an IPv4-mapped IPv6 address (``::ffff:a.b.c.d``), else the text as it is."""
    h = ipv6_halves(ip)
    number = h.getField("lo").bitwiseAND(F.lit(0xFFFFFFFF))
    octet = lambda n: F.shiftright(number, n).bitwiseAND(F.lit(255)).cast("string")
    mapped = is_ipv6(ip) & (h.getField("hi") == 0) & (F.shiftright(h.getField("lo"), 32) == 0xFFFF)
    return F.when(mapped, F.concat_ws(".", octet(24), octet(16), octet(8), octet(0))).otherwise(ip)


def ip_to_long(ip: Column) -> Column:
    """Numeric address, null for anything but a strict dotted quad."""
    value = F.aggregate(
        F.split(ip, r"\."),
        F.lit(0).cast("bigint"),
        lambda number, octet: number * 256 + octet.try_cast("bigint"),
    )
    return F.when(is_ipv4(ip), value)


def in_networks(ip: Column, cidrs: Iterable[str]) -> Column:
    """Whether a strict dotted quad lies in one of the networks.

    Strict addresses have one spelling, so their leading octets are looked up as text: no join,
    no number parsing, and all networks with the same number of octets share one lookup.
    """
    by_octets: dict[int, list[str]] = {}
    for found in map(leading_octets, cidrs):
        if found is not None:
            by_octets.setdefault(found[0], []).extend(found[1])
    tests = [
        (ip if octets == 4 else F.substring_index(ip, ".", octets)).isin(texts)
        for octets, texts in sorted(by_octets.items())
    ]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def is_loopback(ip: Column) -> Column:
    return in_networks(ip, LOOPBACK)


def is_link_local(ip: Column) -> Column:
    return in_networks(ip, LINK_LOCAL)


def is_private(ip: Column) -> Column:
    return in_networks(ip, PRIVATE) & ~in_networks(ip, PRIVATE_EXCEPTIONS)


def safe_ip(ip: Column) -> Column:
    return F.when(is_ip(ip), ip).otherwise(F.lit("<invalid_ip>"))


def network_category(ip: Column) -> Column:
    """Category of an address that is not a known one; an IPv4-mapped one has that of its IPv4 address."""
    return F.when(F.contains(ip, F.lit(":")), _category6(ip)).otherwise(_category4(ip))


def _category6(ip: Column) -> Column:
    plain = mapped_ipv4(ip)
    private = in_networks6(ip, PRIVATE6) & ~in_networks6(ip, PRIVATE6_EXCEPTIONS)
    return (
        F.when(~is_ipv6(ip), F.lit("Unknown/Invalid"))
        .when(plain != ip, _category4(plain))
        .when(in_networks6(ip, LOOPBACK6), F.lit("Localhost (Loopback)"))
        .when(private, F.lit("Local Network (Private)"))
        .when(in_networks6(ip, MULTICAST6), F.lit("Multicast"))
        .when(in_networks6(ip, RESERVED6), F.lit("Reserved"))
        .otherwise(F.lit("Public Internet"))
    )


def _category4(ip: Column) -> Column:
    return (
        F.when(~is_ipv4(ip), F.lit("Unknown/Invalid"))
        .when(is_loopback(ip), F.lit("Localhost (Loopback)"))
        .when(is_private(ip), F.lit("Local Network (Private)"))
        .when(in_networks(ip, MULTICAST), F.lit("Multicast"))
        .when(in_networks(ip, RESERVED), F.lit("Reserved"))
        .otherwise(F.lit("Public Internet"))
    )


def known_name(ip: Column) -> Column:
    """Name of a well-known address, else null; the list is short and constant."""
    pairs = [F.lit(text) for pair in KNOWN_IPS for text in pair]
    return F.try_element_at(F.create_map(*pairs), ip)


def ip_category(ip: Column) -> Column:
    return F.coalesce(known_name(ip), network_category(ip))
