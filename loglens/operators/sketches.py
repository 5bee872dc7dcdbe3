"""Distinct and frequent values as sketches that are stored for a day or batch and merged when read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import written

#: Binary logarithm of a distinct sketch's registers (16 KB at most), and values that a sketch of frequent ones follows.
REGISTERS, FOLLOWED = 14, 8192


def sketch_state(df: DataFrame, value: str, keys: list[str] | None = None, span: Column | None = None, registers: int = REGISTERS, followed: int = FOLLOWED) -> DataFrame:
    """Partials (keys..., span, n, values, frequent) of each group and span: rows, and sketches of their values as text.

    A span is such as a date, or null where none is given. Null values count nowhere; a group of nulls alone gives no row.
    Sketches are bounded whatever the number of values, and are made in each task before rows are shuffled. Equal
    registers and followed values are needed of states that are to be merged.
    """
    own = df.select(*(keys or []), (F.lit(None).cast("date") if span is None else span).alias("span"), F.col(value).cast("string").alias("__value")).where("__value is not null")
    return own.groupBy(*(keys or []), "span").agg(
        F.count("*").alias("n"), F.hll_sketch_agg("__value", registers).alias("values"), F.expr(f"approx_top_k_accumulate(__value, {int(followed)})").alias("frequent")
    )


def merge_sketches(state: DataFrame, keys: list[str] | None = None, span: Column | None = None) -> DataFrame:
    """States of spans that don't overlap as one of each group, or of each wider span; it can be merged again.

    Keys may be fewer than those of the state.
    """
    wide = (F.lit(None).cast("date") if span is None else span).alias("span")
    own = state.select(*(keys or []), wide, "n", "values", "frequent")
    return own.groupBy(*(keys or []), "span").agg(F.sum("n").alias("n"), F.hll_union_agg("values").alias("values"), F.expr("approx_top_k_combine(frequent)").alias("frequent"))


def sketch_report(state: DataFrame, top: int = 10, registers: int = REGISTERS, followed: int = FOLLOWED) -> DataFrame:
    """(keys..., span, n, distinct, distinct_error, top, top_error) of each row of a state.

    distinct_error is the standard error of the number of distinct values; top are structs (item, count) of the most frequent
    ones, whose counts are off by at most top_error: 0 where a group has clearly no more distinct values than are followed.
    Elsewhere top has only values that stand out from that error, none if all are about equally frequent: see exact_top.
    """
    cells = 1 << (max(1, -(-4 * followed // 3)) - 1).bit_length()  # of the sketch's table, which is filled to three quarters
    kept = [c for c in state.columns if c not in ("values", "frequent")]
    out = state.select(*kept, F.hll_sketch_estimate("values").alias("distinct"), F.expr(f"approx_top_k_estimate(frequent, {int(top)})").alias("top"))
    error = F.ceil(F.col("distinct") * (1.04 / 2 ** (registers / 2)))
    off = F.when(F.col("distinct") + 6 * error > followed, F.ceil(F.col("n") * (3.5 / cells))).otherwise(F.lit(0))
    return out.select(*kept, "distinct", error.cast("long").alias("distinct_error"), "top", off.cast("long").alias("top_error"))


def exact_top(report: DataFrame, df: DataFrame, value: str, keys: list[str] | None = None, span: Column | None = None, top: int = 10) -> DataFrame:
    """A report whose top is right everywhere: groups that are in doubt are counted again in df, and top_error is 0.

    df holds the rows that the report's sketches were made of; keys and span are those of the report. Groups whose sketches
    followed all values keep what these tell; rows of the others are counted by value, and each task drops all but
    a group's first ones before they meet. Ties of counted values go to the smaller text.
    """
    own = [*(keys or []), "span"]
    held = written(report, "reports")  # of known size, so that Spark can send a few groups to all tasks
    same = lambda a, b: reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in own))
    rows = df.select(*(keys or []), (F.lit(None).cast("date") if span is None else span).alias("span"), F.col(value).cast("string").alias("__value")).where("__value is not null")
    doubt = held.where("top_error > 0").select(*own)
    counts = rows.join(doubt, same(rows, doubt), "left_semi").groupBy(*own, "__value").agg(F.count("*").alias("__n"))
    best = counts.withColumn("__r", F.row_number().over(Window.partitionBy(*own).orderBy(F.col("__n").desc(), "__value"))).where(F.col("__r") <= top)
    found = best.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("__r", "__value", "__n"))).alias("__found"))
    counted = F.transform("__found", lambda x: F.struct(x["__value"].alias("item"), x["__n"].alias("count")))
    error = F.when(F.col("__found").isNotNull(), F.lit(0)).otherwise(F.col("top_error"))
    kept = [held[c] for c in held.columns if c not in ("top", "top_error")]
    return held.join(found, same(held, found), "left").select(*kept, F.coalesce(counted, "top").alias("top"), error.alias("top_error"))
