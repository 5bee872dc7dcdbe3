"""Aggregations. Numbers are read as number-or-null; every order ends with a unique key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import numn
from ..plans.shared import written
from .quantiles import BOUND, quantiles


def group_by(df: DataFrame, keys: list[str], *aggs: Column, limit: int | None = None) -> DataFrame:
    """One row for each key with the aggregates, or with _count."""
    out = df.groupBy(*keys).agg(*(aggs or (F.count("*").alias("_count"),)))
    return out.orderBy(*keys).limit(limit) if limit is not None else out


def number_of_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct().agg(F.count("*").alias("_count"))


def percentiles(c: Column, *shares: float) -> Column:
    """As an aggregate, which holds a group's different values at once; quantiles() has no such limit."""
    return F.percentile(numn(c), F.array(*(F.lit(s) for s in shares or (0.5, 0.75, 0.99))))


def kurtosis(c: Column, excess: bool = True) -> Column:
    return F.kurtosis(numn(c)) + (0.0 if excess else 3.0)


def iqr(df: DataFrame, column: str, keys: list[str] | None = None, bound: int = BOUND) -> DataFrame:
    q = quantiles(df, F.col(column), keys, (0.25, 0.75), bound)
    return q.select(*(keys or []), F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"), (F.col("q")[1] - F.col("q")[0]).alias("iqr"))


def mad(df: DataFrame, column: str, keys: list[str] | None = None, bound: int = BOUND) -> DataFrame:
    """Median and median absolute deviation, over all rows or for each key: two selections and a join."""
    keys = keys or []
    own = df.select(*keys, numn(F.col(column)).alias("_x")).where("_x is not null")
    centre = quantiles(own, F.col("_x"), keys, (0.5,), bound).select(*keys, F.col("q")[0].alias("median"))
    centre = written(centre, "medians")
    same = reduce(lambda a, b: a & b, (own[k].eqNullSafe(centre[k]) for k in keys)) if keys else None
    both = own.join(centre, same).select(*(own[c] for c in own.columns), "median") if keys else own.crossJoin(F.broadcast(centre))  # one row
    off = quantiles(both, F.abs(F.col("_x") - F.col("median")), keys, (0.5,), bound).select(*keys, F.col("q")[0].alias("mad"))
    if not keys:
        return centre.crossJoin(F.broadcast(off))  # one row each
    same = reduce(lambda a, b: a & b, (centre[k].eqNullSafe(off[k]) for k in keys))
    return centre.join(off, same).select(*(centre[k] for k in keys), "median", "mad")


def first_by_time(c: Column, time: str, key: str) -> Column:
    return F.min_by(c, F.struct(time, key))


def last_by_time(c: Column, time: str, key: str) -> Column:
    return F.max_by(c, F.struct(time, key))


def top(df: DataFrame, column: str, keys: list[str] | None = None, limit: int = 10) -> DataFrame:
    """The most frequent values of each key with count and share of the key's rows; ties by value.

    The ranks are cut on counted values, so a key's window holds its distinct values only, and Spark
    drops all but the first ones of each task before they are shuffled.
    """
    keys = keys or []
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("n"))
    order = (F.col("n").desc(), F.col(column))
    if not keys:
        best = counts.orderBy(*order).limit(limit)
        return best.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_total")))).select(column, "n", F.round(100.0 * F.col("n") / F.col("_total"), 2).alias("pct"))
    best = counts.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= limit)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    return best.join(totals, keys).select(*keys, column, "n", F.round(100.0 * F.col("n") / F.col("_total"), 2).alias("pct"))


def running_total(df: DataFrame, value: str, order: list[Column], out: str, parts: int | None = None) -> DataFrame:
    """A running sum over all rows without one task for them: rows are dealt by ranges of the order,
    summed within each range, and the sums of the ranges before are added."""
    ranged = df.repartitionByRange(*([parts] if parts else []), *order).withColumn("_p", F.spark_partition_id())
    inner = ranged.withColumn(out, F.sum(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    sums = inner.groupBy("_p").agg(F.sum(value).alias("_s"))
    before = sums.withColumn("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    return inner.join(F.broadcast(before), "_p").withColumn(out, F.col(out) + F.col("_b")).drop("_p", "_b")  # a row for each partition


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Each value with count, share and running share by falling count."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    run = running_total(counts, "n", [F.col("n").desc(), F.col(column).asc_nulls_first()], "_run")
    return run.crossJoin(F.broadcast(total)).select(column, "n", F.round(100.0 * F.col("n") / F.col("_t"), 2).alias("pct"), F.round(100.0 * F.col("_run") / F.col("_t"), 2).alias("cum_pct"))


def head_tail(df: DataFrame, column: str, threshold: float = 80) -> DataFrame:
    return frequency(df, column).withColumn("segment", F.when(F.col("cum_pct") <= threshold, "head").otherwise("tail"))


def heatmap(df: DataFrame, x: str, y: str, value: Column | None = None, limit: int | None = None) -> DataFrame:
    """A value for each pair of x and y, the largest first; all cells unless a limit of limit * limit is given."""
    out = df.groupBy(x, y).agg((value if value is not None else F.count("*")).alias("value"))
    out = out.orderBy(F.col("value").desc(), x, y)
    return out if limit is None else out.limit(limit * limit)


def histogram(df: DataFrame, column: str, buckets: int = 20) -> DataFrame:
    """Equal bins from the smallest to the largest value; the last one is closed."""
    own = df.select(numn(F.col(column)).alias("x")).where("x is not null")
    edge = own.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / buckets
    both = own.crossJoin(F.broadcast(edge)).withColumn("w", width)  # one row
    at = F.when(F.col("w") > 0, F.least(F.floor((F.col("x") - F.col("lo")) / F.col("w")), F.lit(buckets - 1))).otherwise(0)
    out = both.groupBy(at.cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("w").alias("w"))
    return out.select("bucket", F.round(F.col("lo") + F.col("bucket") * F.col("w"), 4).alias("from"), F.round(F.col("lo") + (F.col("bucket") + 1) * F.col("w"), 4).alias("to"), "n")


def modified_zscore(df: DataFrame, column: str, threshold: float | None = None, bound: int = BOUND) -> DataFrame:
    """Adds zscore from median and MAD over all rows (0 where MAD is 0), and outlier with a threshold."""
    stats = mad(df, column, bound=bound)
    z = F.when(F.col("_mad") == 0, 0.0).otherwise(F.round(0.6745 * (numn(F.col(column)) - F.col("_median")) / F.col("_mad"), 4))
    out = df.crossJoin(F.broadcast(stats.select(F.col("median").alias("_median"), F.col("mad").alias("_mad")))).withColumn("zscore", z).drop("_median", "_mad")  # one row
    return out if threshold is None else out.withColumn("outlier", F.abs("zscore") > threshold)


def edge_list(df: DataFrame, src: str, dst: str, weight: Column | None = None, limit: int | None = None) -> DataFrame:
    out = df.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg((weight if weight is not None else F.count("*")).alias("weight"))
    return out.orderBy(F.col("weight").desc(), "src", "dst").limit(limit) if limit else out


def node_weights(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").cast("string").alias("node"), "weight").unionAll(edges.select(F.col("dst").cast("string").alias("node"), "weight"))
    return ends.groupBy("node").agg(F.sum("weight").alias("weight"))
