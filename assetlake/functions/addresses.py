"""IP addresses as expressions: text to 32 hex digits (IPv4 in its mapped form), networks, and back."""

from __future__ import annotations

import ipaddress
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetlake.functions.binding import let

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_MAPPED = "0" * 20 + "ffff"


def _v4_hex(c: Column) -> Column:
    return F.array_join(
        F.transform(F.split(c, r"\."), lambda o: F.lpad(F.lower(F.conv(o, 10, 16)), 2, "0")),
        "",
    )


def _groups(c: Column) -> Column:
    return F.filter(F.split(c, ":"), lambda g: g != "")


def _padded(groups: Column) -> Column:
    return F.array_join(F.transform(groups, lambda g: F.lpad(F.lower(g), 4, "0")), "")


_GROUP = r"[0-9A-Fa-f]{1,4}"
_FULL = rf"\A{_GROUP}(?::{_GROUP}){{7}}\z"
_SHORT = rf"\A(?:{_GROUP}(?::{_GROUP})*)?::(?:{_GROUP}(?::{_GROUP})*)?\z"


def _six_hex(six: Column) -> Column:
    """IPv6 text without an embedded IPv4 part."""
    left = _groups(F.substring_index(six, "::", 1))
    right = _groups(F.substring_index(six, "::", -1))

    def filled(sides: Column) -> Column:
        gap = 8 - F.size(sides["a"]) - F.size(sides["b"])
        return F.when(
            gap >= 1, F.concat(_padded(sides["a"]), F.repeat(F.lit("0000"), gap.cast("int")), _padded(sides["b"]))
        )

    return F.when(six.rlike(_FULL), _padded(_groups(six))).when(
        six.rlike(_SHORT), let(F.struct(left.alias("a"), right.alias("b")), filled)
    )


def _mixed_hex(text: Column) -> Column:
    """IPv6 text whose last two groups may be written as an IPv4 address."""
    tail = F.regexp_extract(text, rf":({_V4})\z", 1)

    def joined(t: Column) -> Column:
        h = _v4_hex(t)
        head = F.substring(text, F.lit(1), F.length(text) - F.length(t))
        return F.when(
            t != "", F.concat(head, F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4))
        ).otherwise(text)

    return let(let(tail, joined), _six_hex)


def ip_hex(c: Column) -> Column:
    """32 hex digits, or null when the text is not an address. IPv4 and mapped IPv6 give the same value."""
    return let(
        c, lambda x: F.when(x.rlike(rf"\A{_V4}\z"), F.concat(F.lit(_MAPPED), _v4_hex(x))).otherwise(_mixed_hex(x))
    )


def _v4_text(h: Column) -> Column:
    return F.concat_ws(".", *[F.conv(F.substring(h, 25 + 2 * i, 2), 16, 10) for i in range(4)])


def _six_text(h: Column) -> Column:
    groups = [F.regexp_replace(F.substring(h, 1 + 4 * i, 4), r"\A0{1,3}", "") for i in range(8)]
    joined = F.concat(F.lit(":"), F.concat_ws(":", *groups), F.lit(":"))

    def shortened(text: Column) -> Column:
        out = text
        for n in range(2, 9):
            run = ":0" * n + ":"
            pos = F.instr(text, run)
            out = F.when(
                pos > 0,
                F.concat(F.substring(text, F.lit(1), pos - 1), F.lit("::"), F.substring(text, pos + len(run), F.lit(64))),
            ).otherwise(out)
        # Drop the helper colons at both ends, keeping a real "::".
        return F.regexp_replace(out, r"\A:(?!:)|(?<!:):\z", "")

    return let(joined, shortened)


def ip_text(h: Column) -> Column:
    """Canonical text of a 32-digit address: dotted for IPv4, shortest form for IPv6."""
    return let(h, lambda x: F.when(x.startswith(_MAPPED), _v4_text(x)).otherwise(_six_text(x)))


def in_networks(h: Column, networks: Sequence[str]) -> Column:
    """Whether a 32-digit address lies in any of the (configured, few) networks."""
    result = F.lit(False)
    for text in networks:
        net = ipaddress.ip_network(text, strict=False)
        v4 = net.version == 4
        digits = (_MAPPED if v4 else "") + f"{int(net.network_address):0{8 if v4 else 32}x}"
        bits = net.prefixlen + (96 if v4 else 0)
        whole, rest = divmod(bits, 4)
        test = h.startswith(digits[:whole])
        if rest:
            first = int(digits[whole], 16) & ~((1 << (4 - rest)) - 1)
            nibbles = [f"{first + i:x}" for i in range(1 << (4 - rest))]
            test = test & F.substring(h, whole + 1, 1).isin(nibbles)
        if not v4:
            test = test & ~h.startswith(_MAPPED)
        result = result | test
    return result
