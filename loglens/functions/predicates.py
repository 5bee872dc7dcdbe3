"""Conditions on fields; each returns a Column for filter(), to be combined with &, | and ~."""

from __future__ import annotations

import ipaddress
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fields import num0


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def eq(c: Column, *values) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def ne(c: Column, *values) -> Column:
    """A missing field counts as different."""
    return ~eq(c, *values)


def exists(c: Column) -> Column:
    return F.coalesce(c.cast("string") != "", F.lit(False))


def missing(c: Column) -> Column:
    return ~exists(c)


def gt(c: Column, v: float) -> Column:
    return num0(c) > v


def ge(c: Column, v: float) -> Column:
    return num0(c) >= v


def lt(c: Column, v: float) -> Column:
    return num0(c) < v


def le(c: Column, v: float) -> Column:
    return num0(c) <= v


def matches(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    """A regular expression anywhere in the field; a dot also matches the end of a line."""
    return F.coalesce(c.rlike(("(?si)" if ignore_case else "(?s)") + pattern), F.lit(False))


def contains_any(c: Column, *parts: str) -> Column:
    """Any of the parts, whatever the case; many parts are one pattern, so the text is read once."""
    if len(parts) > 4:
        return F.coalesce(F.lower(c).rlike("|".join(re.escape(p.lower()) for p in parts)), F.lit(False))
    return F.coalesce(any_of([F.contains(F.lower(c), F.lit(p.lower())) for p in parts]), F.lit(False))


def starts_with_any(c: Column, *parts: str) -> Column:
    return F.coalesce(any_of([F.startswith(F.lower(c), F.lit(p.lower())) for p in parts]), F.lit(False))


def ends_with_any(c: Column, *parts: str) -> Column:
    return F.coalesce(any_of([F.endswith(F.lower(c), F.lit(p.lower())) for p in parts]), F.lit(False))


def text_search(text: Column, words: str) -> Column:
    return contains_any(text, words)


OCTET = r"(25[0-5]|2[0-4]\d|[01]?\d?\d)"


def ipv4(c: Column) -> Column:
    """An IPv4 address as a number, null where it is none."""
    part = lambda i: F.split_part(c, F.lit("."), F.lit(i)).cast("long")
    return F.when(c.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"), ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4))


def ipv6_hex(c: Column) -> Column:
    """An IPv6 address as 32 hex digits, null where it is none; '::' is filled up with zeros."""
    text = F.lower(c)
    halves = F.split(text, "::")
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    left, right = groups(F.get(halves, F.lit(0))), F.coalesce(groups(F.get(halves, F.lit(1))), F.array().cast("array<string>"))
    gap = 8 - F.size(left) - F.size(right)
    whole = F.concat(left, F.when(F.size(halves) > 1, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0)))).otherwise(F.array().cast("array<string>")), right)
    good = text.rlike(r"^[0-9a-f:]*:[0-9a-f:]*$") & (F.size(whole) == 8) & ~F.exists(whole, lambda g: F.length(g) > 4)
    return F.when(good, F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))


def in_cidr(c: Column, cidr: str) -> Column:
    """In the network; a missing or invalid address is not."""
    net = ipaddress.ip_network(cidr, strict=False)
    if net.version == 4:
        return F.coalesce(ipv4(c).between(int(net.network_address), int(net.broadcast_address)), F.lit(False))
    return F.coalesce(ipv6_hex(c).between(f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}"), F.lit(False))


def commented(df: DataFrame, comments: DataFrame, id_col: str, tags: tuple[str, ...] = (), keyword: str = "") -> DataFrame:
    """The rows whose id has a comment with one of the tags and the keyword in its text."""
    own = comments
    if tags:
        own = own.where(F.arrays_overlap("tags", F.array(*(F.lit(t) for t in tags))))
    if keyword:
        own = own.where(contains_any(F.col("text"), keyword))
    return df.join(own.select(id_col), id_col, "left_semi")
