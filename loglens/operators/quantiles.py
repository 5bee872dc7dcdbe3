"""Exact quantiles of groups of any size, by radix selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import numn
from ..plans.shared import written

#: Rows of a group that one aggregation buffer may hold; larger groups are selected from in passes.
BOUND = 1_000_000
#: Bits that a pass looks at, of 64.
BITS = 16


def _same(a: DataFrame, b: DataFrame, keys: list[str], more: Column | None = None, how: str = "inner") -> DataFrame:
    """Join on keys, where nulls are equal, as they are in groups; the columns of a, then those of b."""
    on = [a[k].eqNullSafe(b[k]) for k in keys] + ([] if more is None else [more])
    both = a.join(b, reduce(lambda x, y: x & y, on), how) if on else a.crossJoin(b)  # without keys, b has a row for each rank
    return both if how in ("left_semi", "left_anti") else both.select(*(a[c] for c in a.columns), *(b[c] for c in b.columns if c not in keys))


def ordered_bits(x: Column) -> Column:
    """A long whose 64 bits, read without sign, are in the order of the doubles."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(-1).cast("long"))).otherwise(bits.bitwiseXOR(F.lit(-(1 << 63)).cast("long")))


def _selected(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """wanted (keys, rank) with the value of that rank (from 0) among the rows (keys, _x) of its key.

    A pass counts the rows that share a wanted value's leading bits by their next ones, which Spark does partly
    in each task, and keeps the bin that holds the rank. So what a task or a group holds is bounded by the number of
    bins, whatever the number of values; rows themselves are read, but never dealt or sorted.
    """
    own = written(rows.select(*keys, "_x").withColumn("_u", ordered_bits(F.col("_x"))), "values")
    now = wanted.withColumns({"_rest": F.col("rank"), "_prefix": F.lit(0).cast("long")})
    for shift in range(64 - BITS, -1, -BITS):
        head = F.shiftrightunsigned("_u", shift + BITS) if shift + BITS < 64 else F.lit(0).cast("long")
        placed = own.withColumns({"_head": head, "_bin": F.shiftrightunsigned("_u", shift).bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))})
        open_ = now.select(*keys, "_prefix").distinct()
        counts = _same(placed, open_, keys, placed["_head"] == open_["_prefix"]).groupBy(*keys, "_prefix", "_bin").agg(F.count("*").alias("_n"), F.min("_x").alias("_value"))
        upto = F.sum("_n").over(Window.partitionBy(*keys, "_prefix").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.withColumn("_upto", upto).withColumnRenamed("_prefix", "_of")  # at most 2**BITS bins
        if "_value" in now.columns:
            now = now.drop("_value")
        here = (now["_prefix"] == counts["_of"]) & (now["_rest"] < counts["_upto"]) & (now["_rest"] >= counts["_upto"] - counts["_n"])
        found = _same(now, counts, keys, here)
        deeper = F.shiftleft("_prefix", BITS).bitwiseOR(F.col("_bin"))
        now = written(found.select(*keys, "rank", (F.col("_rest") - F.col("_upto") + F.col("_n")).alias("_rest"), deeper.alias("_prefix"), "_value"), "ranks")
    return now.select(*keys, "rank", F.col("_value").alias("value"))


def quantiles(df: DataFrame, column: Column, keys: list[str] | None = None, shares: tuple[float, ...] = (0.5,), bound: int = BOUND) -> DataFrame:
    """(keys..., q): the exact quantiles of the numbers of each key, between the two nearest ones where a rank is not whole.

    Values that are no numbers are left out, and so are keys without any; without keys there is one row, with nulls
    for no values. Groups of up to bound rows go to one aggregation each, larger ones through _selected(). Both give the same.
    """
    keys = keys or []
    own = df.select(*keys, numn(column).alias("_x")).where("_x is not null")
    small = lambda rows: rows.groupBy(*keys).agg(F.percentile("_x", F.array(*(F.lit(float(s)) for s in shares))).alias("q"))
    large = written(own.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > bound), "large")  # its size is known: few groups are
    if large.isEmpty():
        return small(own)
    at = [(F.col("_n") - 1) * F.lit(float(s)) for s in shares]
    ranks = F.array_distinct(F.array(*(f(a).cast("long") for a in at for f in (F.floor, F.ceil))))
    wanted = large.select(*keys, F.explode(ranks).alias("rank"))
    names = large.drop("_n")
    found = _selected(_same(own, names, keys, how="left_semi") if keys else own, keys, wanted)
    found = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_m"))  # two for each share
    value = lambda a: F.col("_m")[F.floor(a).cast("long")] + (F.col("_m")[F.ceil(a).cast("long")] - F.col("_m")[F.floor(a).cast("long")]) * (a - F.floor(a))
    out = _same(large, found, keys).select(*keys, F.array(*(value(a) for a in at)).alias("q"))
    return out.unionByName(small(_same(own, names, keys, how="left_anti"))) if keys else out
