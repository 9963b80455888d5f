"""IP address syntax."""

from __future__ import annotations

from pyspark.sql import Column

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"{_OCTET}(\.{_OCTET}){{3}}"
_H = r"[0-9A-Fa-f]{1,4}"
_ZONE = r"(%[^%]+)?"


def _v6_body() -> str:
    """Every legal IPv6 spelling: eight groups, or fewer around one ``::``, the last two perhaps as IPv4."""
    full = [rf"({_H}:){{7}}{_H}", rf"({_H}:){{6}}{_V4}"]
    squeezed = []
    for left in range(8):
        head = "" if left == 0 else rf"{_H}(:{_H}){{{left - 1}}}"
        room = 7 - left
        squeezed.append(rf"{head}::" + (rf"({_H}(:{_H}){{0,{room - 1}}})?" if room else ""))
        if room >= 2:
            squeezed.append(rf"{head}::({_H}:){{0,{room - 2}}}{_V4}")
    return "|".join(full + squeezed)


IP_PATTERN = rf"\A({_V4}|({_v6_body()}){_ZONE})\z"


def is_valid_ip(c: Column) -> Column:
    """Whether the text is an IPv4 or IPv6 address."""
    return c.rlike(IP_PATTERN)
