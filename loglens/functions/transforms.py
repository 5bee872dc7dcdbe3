"""Row transforms: Column -> Column unless said otherwise."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fields import numn

# Specifiers of time formats and Spark's patterns for them.
SPECIFIERS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%a": "EEE", "%b": "MMM", "%R": "HH:mm"}


def strftime(c: Column, fmt: str, tz: str = "UTC") -> Column:
    """A time under a format of % specifiers; text between them is kept; '' where there is no time."""
    out = ""
    for part in re.split(r"(%.)", fmt):
        out += SPECIFIERS.get(part, "'" + part.replace("'", "''") + "'" if part else "")
    return F.coalesce(F.date_format(F.from_utc_timestamp(c, tz), out), F.lit(""))


def divide(a: Column, b: Column) -> Column:
    """Null where the divisor is 0 or either is no number."""
    return F.try_divide(numn(a), numn(b))


def case_when(branches: list[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first branch that holds; values may be Columns."""
    out = F.lit(None) if default is None else default if isinstance(default, Column) else F.lit(default)
    for condition, value in reversed(branches):
        out = F.when(condition, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


#: An escaped character, a character class, or the start of a group without a name.
_PARTS = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\((?!\?)")


def regex_groups(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Adds a column for each named group; names with any letters are read by position."""
    names = re.findall(r"\(\?P?<([A-Za-z_]\w*)>", pattern)
    plain = _PARTS.sub(lambda m: "(?:" if m.group() == "(" else m.group(), pattern)
    plain = "(?s)" + re.sub(r"\(\?P?<[A-Za-z_]\w*>", "(", plain)
    return df.withColumns({n: F.regexp_extract(column, plain, i + 1) for i, n in enumerate(names)})


def regex_all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit("(?s)" + pattern), F.lit(1 if "(" in _PARTS.findall(pattern) else 0))


def regex_replace(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, "(?s)" + pattern, by)


def concat_fields(*columns: Column) -> Column:
    return F.concat(*(F.coalesce(c.cast("string"), F.lit("")) for c in columns))


def hash_key(*columns: Column) -> Column:
    """Equal fields, equal keys; a null is a value of its own. Digests are this engine's own."""
    return F.lower(F.hex(F.xxhash64(*columns, *(c.isNull() for c in columns))))


def byte_length(c: Column) -> Column:
    return F.octet_length(c)


def log_size(c: Column, overhead: int = 16) -> Column:
    """Bytes that a value takes, with a constant for its bookkeeping."""
    return F.coalesce(F.octet_length(c), F.lit(0)) + overhead


def damerau_levenshtein(a: str, b: str) -> int:
    """Edits with adjacent transpositions, in any order (the unrestricted distance)."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            cost = x != y
            if not cost:
                match = j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return d[-1][-1]


def _distances(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """damerau_levenshtein() of many pairs of code points: the table's cells in order, all pairs at once."""
    n, wide, high = len(a), max(map(len, a)), max(map(len, b))
    x, y = np.full((n, wide), -1, np.int64), np.full((n, high), -2, np.int64)
    for r, (p, q) in enumerate(zip(a, b, strict=True)):
        x[r, : len(p)], y[r, : len(q)] = p, q
    d = np.zeros((wide + 1, high + 1, n), np.int32)
    d[:, 0], d[0] = np.arange(wide + 1)[:, None], np.arange(high + 1)[:, None]
    before, every = np.zeros((high, n), np.int64), np.arange(n)
    for i in range(1, wide + 1):
        match = np.zeros(n, np.int64)
        for j in range(1, high + 1):
            same, k = x[:, i - 1] == y[:, j - 1], before[j - 1]
            turned = np.where((k > 0) & (match > 0), d[k - 1, match - 1, every] + (i - k - 1) + 1 + (j - match - 1), wide + high)
            d[i, j] = np.minimum(np.minimum(d[i - 1, j - 1] + ~same, turned), np.minimum(d[i - 1, j], d[i, j - 1]) + 1)
            match = np.where(same, j, match)
            before[j - 1] = np.where(same, i, k)
    return d[[len(p) for p in a], [len(q) for q in b], every]


#: Cells of the tables that are filled together, and pairs from which that is faster than one by one.
CELLS, TOGETHER = 4_000_000, 24


@F.pandas_udf(T.IntegerType())
def _edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.full(len(a), -1, np.int64)
    rows = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    points = [[np.frombuffer(x.encode("utf-32-le"), "<u4") for x in s.iloc[rows]] for s in (a, b)]
    order = np.argsort([max(len(p), len(q)) for p, q in zip(*points, strict=True)], kind="stable") if len(rows) else []
    at = 0
    while at < len(order):
        to, cells = at, 0
        while to < len(order) and (to == at or cells <= CELLS):  # ordered by length, so the last one bounds the table
            i = order[to]
            longest = max(len(points[0][i]), len(points[1][i])) + 1
            to, cells = to + 1, (to + 1 - at) * longest * longest
        own = order[at:to]
        if len(own) >= TOGETHER:
            out[rows[own]] = _distances([points[0][i] for i in own], [points[1][i] for i in own])
        else:
            for i in own:
                out[rows[i]] = damerau_levenshtein(a.iloc[rows[i]], b.iloc[rows[i]])
        at = to
    return pd.Series(out, dtype="Int32").mask(out < 0)


def edit_distance(a: Column, b: Column) -> Column:
    """Damerau-Levenshtein. Where no transposition can help (native distance below 2), Python gets nulls only."""
    native = F.levenshtein(a, b)
    asked = lambda c: F.when(native >= 2, c)
    return F.coalesce(_edit_distance(asked(a), asked(b)), native)


def base64_decode(c: Column) -> Column:
    return F.coalesce(F.try_to_binary(c, F.lit("base64")).cast("string"), F.lit(""))


def split_part(c: Column, by: str, n: int) -> Column:
    return F.split_part(c, F.lit(by), F.lit(n))


def substr(c: Column, start: int, length: int | None = None) -> Column:
    return F.substr(c, F.lit(start), F.lit(length)) if length is not None else F.substr(c, F.lit(start))


def url_decode(c: Column) -> Column:
    """Percent decoding; a plus stays a plus."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def coalesce_nonempty(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in columns), F.lit(""))


def sprintf(fmt: str, *columns: Column) -> Column:
    """printf with % specifiers. Null texts (%s) print as '' and null numbers as 0."""
    kinds = [k for k in re.findall(r"%[-+# 0,(]*\d*(?:\.\d+)?([a-zA-Z%])", fmt) if k not in "%n"]
    filled = [F.coalesce(c.cast("string"), F.lit("")) if k in "sS" else F.coalesce(c, F.lit(0)) for k, c in zip(kinds, columns, strict=True)]
    return F.format_string(fmt, *filled)


def attack_tags(*columns: Column) -> Column:
    """Distinct technique tags in the fields, lower case: attack.x, mitre.x and bare tNNNN(.NNN)."""
    text = F.lower(F.concat_ws(" ", *columns))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b((?:attack|mitre)\.[a-z0-9_.-]+|t\d{4}(?:\.\d{3})?)\b"), F.lit(1)))


INTERNAL_V4 = r"^(10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|127\.|169\.254\.)"


def abstract_path(c: Column) -> Column:
    """A path without what differs between users and runs: user folders, GUIDs, long numbers."""
    out = F.lower(c)
    out = F.regexp_replace(out, r"(users|home)([\\/])[^\\/]+", "$1$2*")
    out = F.regexp_replace(out, r"\{?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\}?", "*")
    return F.regexp_replace(out, r"[0-9]{6,}", "*")


def abstract_ip(c: Column) -> Column:
    """Internal IPv4 addresses as their /24, internal IPv6 ones as 'internal', others unchanged."""
    v6 = F.lower(c).rlike(r"^(fe80:|f[cd][0-9a-f]{2}:|::1$)")
    return F.when(c.rlike(INTERNAL_V4), F.regexp_replace(c, r"\.\d+$", ".0/24")).when(v6, F.lit("internal")).otherwise(c)


def abstract_domain(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"\.$", "")
