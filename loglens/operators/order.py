"""Sort, limit and dedup. Rows are told apart by (time, id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sort(df: DataFrame, *columns: tuple[str, bool]) -> DataFrame:
    """(name, descending) pairs; the order starts with the first."""
    return df.orderBy(*(F.col(c).desc() if desc else F.col(c).asc() for c, desc in columns))


def limit(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def head(df: DataFrame, n: int = 200, time: str = "timestamp", key: str = "log_id") -> DataFrame:
    return df.orderBy(time, key).limit(n)


def tail(df: DataFrame, n: int = 200, time: str = "timestamp", key: str = "log_id") -> DataFrame:
    return df.orderBy(F.col(time).desc(), F.col(key).desc()).limit(n)


def newest_first(df: DataFrame, time: str = "timestamp", key: str = "log_id") -> DataFrame:
    return df.orderBy(F.col(time).desc(), F.col(key).desc())


def dedup(df: DataFrame, keys: list[str], time: str = "timestamp", key: str = "log_id", newest: bool = True) -> DataFrame:
    """One whole row for each key, the newest; an aggregate, so duplicates go before the shuffle."""
    pick = F.max_by if newest else F.min_by
    return df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(pick(F.struct(*df.columns), F.struct(time, key)).alias("_r")).select("_r.*")


def dedup_ids(df: DataFrame, key: str = "log_id") -> DataFrame:
    """At-least-once delivery: one row for each id."""
    return df.dropDuplicates([key])


def page_after(df: DataFrame, n: int, cursor: tuple | None = None, time: str = "timestamp", key: str = "log_id") -> DataFrame:
    """The next n rows, newest first, after the (time, id) of the last one seen."""
    if cursor is not None:
        t, k = F.lit(cursor[0]), F.lit(cursor[1])
        df = df.where((F.col(time) < t) | ((F.col(time) == t) & (F.col(key) < k)))
    return tail(df, n, time, key)


def table(df: DataFrame, *columns: str, aggs: tuple[Column, ...] = (), n: int | None = None) -> DataFrame:
    """Choose and reorder columns; with aggregates, the plain columns are the keys."""
    out = df.groupBy(*columns).agg(*aggs) if aggs else df.select(*columns)
    return out if n is None else out.limit(n)
