"""IPv4 addresses and networks as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ip_to_long(ip: Column) -> Column:
    """Dotted quad as a number; octets missing after the first are zeros put before the last ones given.

    Null if an octet is no number from 0 to 255 or there are not 1 to 4 of them.
    """

    def number(parts: Column) -> Column:
        full = F.concat(F.slice(parts, 1, 1), F.array_repeat(F.lit("0"), F.lit(4) - F.size(parts)), F.slice(parts, F.lit(2), F.lit(3)))
        octets = F.transform(full, lambda x: F.when(x.rlike(r"^\d{1,3}$") & (x.try_cast("int") <= 255), x.try_cast("long")))
        return F.when(F.size(parts) <= 4, F.aggregate(octets, F.lit(0).cast("long"), lambda n, x: n * 256 + x))

    return let(F.split(ip, r"\.", -1), number)


def quad(text: str) -> int | None:
    """The number of a full dotted quad, or None."""
    parts = text.split(".")
    if len(parts) != 4 or not all(p.isdigit() and int(p) < 256 for p in parts):
        return None
    return sum(int(p) << (24 - 8 * k) for k, p in enumerate(parts))


def mask(bits: int) -> int:
    return (0xFFFFFFFF << (32 - bits)) & 0xFFFFFFFF


def parse_network(rule: str) -> tuple[int, int] | None:
    """(network address, prefix length) of "a.b.c.d/n"; text after it is ignored."""
    m = re.match(r"(\d{1,3}(?:\.\d{1,3}){3})/(\d{1,2})", rule)
    if not m or int(m[2]) > 32 or (address := quad(m[1])) is None:
        return None
    return address & mask(int(m[2])), int(m[2])


def collapse(networks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same addresses in as few disjoint (first, last) ranges as possible."""
    out: list[tuple[int, int]] = []
    for low, high in sorted((net, net | ~mask(bits) & 0xFFFFFFFF) for net, bits in networks):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def in_ranges(number: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a number lies in one of disjoint sorted ranges, by a balanced tree of comparisons."""
    if not ranges:
        return F.lit(False)

    def tree(low: int, high: int) -> Column:
        if high - low == 1:
            return number.between(*ranges[low])
        middle = (low + high) // 2
        return F.when(number < ranges[middle][0], tree(low, middle)).otherwise(tree(middle, high))

    return F.coalesce(tree(0, len(ranges)), F.lit(False))


def ip_in(ip: Column, networks: list[tuple[int, int]]) -> Column:
    """Whether an address lies in one of the networks (address, prefix length)."""
    ranges = collapse(networks)
    return let(ip_to_long(ip), lambda n: in_ranges(n, ranges)) if ranges else F.lit(False)


def network_address(number: Column, bits: Column | int) -> Column:
    """Address with all but the first `bits` bits cleared."""
    bits = F.lit(bits) if isinstance(bits, int) else bits
    step = F.pow(F.lit(2.0), F.lit(32) - bits).cast("long")
    return number - F.pmod(number, step)
