"""IP addresses as bit strings: 32 characters for IPv4, 128 for IPv6, NULL if invalid.

Prefix containment becomes equality of leading characters, which Spark can hash.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import let

OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = rf"^{OCTET}(\.{OCTET}){{3}}$"
V4_TAIL = rf"^([0-9a-fA-F:]*:){OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"
GROUP = r"^[0-9a-fA-F]{1,4}$"


def _v4_bits(text: Column) -> Column:
    parts = F.split(text, r"\.")
    octets = [F.lpad(F.bin(F.element_at(parts, i + 1).cast("long")), 8, "0") for i in range(4)]
    return F.when(text.rlike(V4), F.concat(*octets))


def _groups(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))


def _plain_v6(text: Column) -> Column:
    """Colon form only: a dotted tail becomes two groups."""
    tail = [F.regexp_extract(text, V4_TAIL, i + 2).try_cast("int") for i in range(4)]
    groups = F.concat(F.regexp_extract(text, V4_TAIL, 1), F.hex(tail[0] * 256 + tail[1]), F.lit(":"),
                      F.hex(tail[2] * 256 + tail[3]))
    return F.when(text.rlike(V4_TAIL), groups).otherwise(text)


def _expanded(halves: Column) -> Column:
    """The eight groups around at most one `::` (NULL when the count is wrong)."""
    head = _groups(F.element_at(halves, 1))
    rest = F.when(F.size(halves) == 2, _groups(F.element_at(halves, -1))).otherwise(_groups(F.lit("")))
    missing = F.lit(8) - F.size(head) - F.size(rest)
    return (F.when((F.size(halves) == 1) & (missing == 0), head)
            .when((F.size(halves) == 2) & (missing >= 1),
                  F.concat(head, F.array_repeat(F.lit("0"), missing), rest)))


def _v6_bits(text: Column) -> Column:
    halves = F.split(_plain_v6(text), "::")
    full = let(halves, _expanded)
    return let(full, lambda g: F.when(
        F.coalesce(F.forall(g, lambda x: x.rlike(GROUP)), F.lit(False)),
        F.array_join(F.transform(g, lambda x: F.lpad(F.conv(x, 16, 2), 16, "0")), "")))


MAPPED = "0" * 80 + "1" * 16


def address_bits(text: Column | str) -> Column:
    """Bits of a plain address; IPv4-mapped IPv6 counts as IPv4; zones are invalid."""
    text = F.trim(F.col(text) if isinstance(text, str) else text)
    v6 = let(_v6_bits(text), lambda b: F.when(
        F.startswith(b, F.lit(MAPPED)), F.substring(b, 97, 32)).otherwise(b))
    return F.when(text.contains(":"), v6).otherwise(_v4_bits(text))


def peer_address(text: Column | str) -> Column:
    """Address part of `a.b.c.d`, `a.b.c.d:port`, `[v6]:port` or `v6`."""
    text = F.col(text) if isinstance(text, str) else text
    return (F.when(text.rlike(r"^\[[^\]]*\]:\d{1,5}$"), F.regexp_extract(text, r"^\[([^\]]*)\]", 1))
            .when(text.rlike(r"^[^:]*:\d{1,5}$"), F.regexp_extract(text, r"^([^:]*):", 1))
            .otherwise(text))


def prefix_bits(cidr: str) -> tuple[int, str]:
    """(address width, leading bits) of a canonical CIDR."""
    net = ipaddress.ip_network(cidr.strip(), strict=True)
    width = net.max_prefixlen
    return width, f"{int(net.network_address):0{width}b}"[: net.prefixlen]


def within(bits: Column, cidrs: list[str]) -> Column:
    """Whether an address lies in one of the prefixes: one hash set per prefix length."""
    groups: dict[tuple[int, int], list[str]] = {}
    for c in cidrs:
        width, head = prefix_bits(c)
        groups.setdefault((width, len(head)), []).append(head)
    hit = F.lit(False)
    for (width, length), heads in sorted(groups.items()):
        hit = hit | ((F.length(bits) == width) & F.substring(bits, 1, length).isin(*heads))
    return F.coalesce(hit, F.lit(False))
