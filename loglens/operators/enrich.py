"""Joins with results, dictionaries, address ranges and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import ipv4

#: Rows up to which a side with a stated limit is broadcast; Spark decides about all others from their size.
BROADCAST_ROWS = 10_000


def correlate(df: DataFrame, sub: DataFrame, keys: list[str], how: str = "inner", include: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Inner or left join with a result on keys; its columns get the prefix _join_.

    All rows of the result are joined. With a limit, rows of the result are taken by key, so that reruns agree, and the side is bounded.
    """
    own = sub.select(*keys, *((F.col(c).alias(f"_join_{c}") for c in include or [c for c in sub.columns if c not in keys])))
    if most is not None:
        own = own.orderBy(*own.columns).limit(most)
        own = F.broadcast(own) if most <= BROADCAST_ROWS else own
    return df.join(own, keys, how)


def load_dictionary(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows to a lookup table: blank keys are skipped, the last write of a key wins."""
    for k in keys:
        rows = rows.where(F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")) != "")
    columns = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in columns))


def lookup(df: DataFrame, dictionary: DataFrame, field: str, column: str, include: list[str], strict: bool = False) -> DataFrame:
    """Adds the included columns of the dictionary as text, '' where there is no match, or matches only."""
    own = dictionary.select(F.col(column).alias("_key"), *(F.col(c).cast("string").alias(f"_v_{c}") for c in include))
    out = df.join(own, df[field] == F.col("_key"), "inner" if strict else "left")
    return out.select(*df.columns, *(F.coalesce(f"_v_{c}", F.lit("")).alias(c) for c in include))


def cidr_ranges(df: DataFrame, network: str) -> DataFrame:
    """Adds lo, hi and prefix of IPv4 networks."""
    base, bits = F.split_part(F.col(network), F.lit("/"), F.lit(1)), F.split_part(F.col(network), F.lit("/"), F.lit(2)).try_cast("int")
    size = F.pow(F.lit(2.0), 32 - bits).cast("long")
    lo = ipv4(base) - ipv4(base) % size
    return df.withColumns({"lo": lo, "hi": lo + size - 1, "prefix": bits}).where("lo is not null and prefix is not null")


def geo_lookup(df: DataFrame, ranges: DataFrame, field: str, include: list[str]) -> DataFrame:
    """Adds the attributes, as text, of the longest network that holds an address.

    Networks are written once for each /16 that they touch, or once for each /8 if they are wider, so
    the range join is an equality join on the leading bits and a comparison; each address then keeps its
    longest prefix. Addresses are matched once, however many rows have them.
    """
    wide = ranges.where("prefix < 16").withColumn("_b", F.explode(F.sequence(F.shiftright("lo", 24), F.shiftright("hi", 24)))).withColumn("_w", F.lit(8))
    fine = ranges.where("prefix >= 16").withColumn("_b", F.shiftright("lo", 16)).withColumn("_w", F.lit(16))
    buckets = wide.unionByName(fine)
    addresses = df.select(F.col(field).alias("_a")).distinct().withColumn("_ip", ipv4(F.col("_a"))).where("_ip is not null")
    keyed = addresses.withColumn("_k", F.explode(F.array(F.struct(F.lit(8).alias("_w"), F.shiftright("_ip", 24).alias("_b")), F.struct(F.lit(16).alias("_w"), F.shiftright("_ip", 16).alias("_b"))))).select("_a", "_ip", "_k.*")
    hits = keyed.join(buckets, ["_w", "_b"]).where("_ip between lo and hi").groupBy("_a").agg(F.max_by(F.struct(*include), "prefix").alias("_g"))
    out = df.join(hits, df[field] == F.col("_a"), "left")
    return out.select(*df.columns, *(F.coalesce(F.col(f"_g.{c}").cast("string"), F.lit("")).alias(c) for c in include))


def model_lookup(df: DataFrame, scores: DataFrame, keys: dict[str, str], include: list[str], prefix: str = "model_") -> DataFrame:
    """Left join with a baseline's scores on {column: key of the baseline}; no match keeps empty columns."""
    own = scores.select(*(F.col(k).alias(f"_{k}") for k in keys.values()), *(F.col(c).alias(f"{prefix}{c}") for c in include))
    on = [df[c] == F.col(f"_{k}") for c, k in keys.items()]
    return df.join(own, on, "left").drop(*(f"_{k}" for k in keys.values()))


def hydrate(df: DataFrame, ids: DataFrame, key: str = "log_id", dates: tuple | None = None, date_col: str = "event_date") -> DataFrame:
    """Whole rows of given ids, read from the partitions of their dates only."""
    if dates is not None:
        df = df.where(F.col(date_col).between(*dates))
    return df.join(ids.select(key).distinct(), key, "left_semi")
