"""What fields hold: statistics, samples and advice."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import numn


def unpivoted(df: DataFrame, fields: list[str] | None = None, entries: str | None = None) -> DataFrame:
    """(field, value): the columns, or the entries of a map column, one row each."""
    if entries:
        out = df.select(F.explode(F.map_entries(entries)).alias("e")).select(F.col("e.key").alias("field"), F.col("e.value").alias("value"))
        return out.where(F.col("field").isin(fields)) if fields else out
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields or df.columns))
    return df.select(F.explode(pairs).alias("e")).select("e.field", "e.value")


def analyze_fields(df: DataFrame, fields: list[str] | None = None, entries: str | None = None) -> DataFrame:
    """Rows, distinct values and number statistics of each field: distinct values are aggregated first."""
    values = unpivoted(df, fields, entries).where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))
    x = numn(F.col("value"))
    n = F.sum(F.when(x.isNotNull(), F.col("n")))
    mean = F.sum(x * F.col("n")) / n
    spread = F.when(n > 0, F.sqrt(F.greatest(F.sum(x * x * F.col("n")) / n - mean * mean, F.lit(0.0))))
    return values.groupBy("field").agg(F.sum("n").alias("events"), F.count("*").alias("distinct"), F.round(mean, 4).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), F.round(spread, 4).alias("stdev"))


def field_stats(df: DataFrame, newest: int, top: int = 5, fields: list[str] | None = None, time: str = "timestamp", key: str = "log_id", entries: str | None = None) -> DataFrame:
    """Of the newest rows: populated rows, distinct values and the most frequent values of each field."""
    rows = df.orderBy(F.col(time).desc(), F.col(key).desc()).limit(newest)
    counts = unpivoted(rows, fields, entries).where("value <> ''").groupBy("field", "value").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("field").orderBy(F.col("n").desc(), "value"))).where(F.col("r") <= top)
    best = ranked.groupBy("field").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "value", "n"))), lambda s: F.concat_ws("=", s["value"], s["n"].cast("string"))), ",").alias("top"))
    return counts.groupBy("field").agg(F.sum("n").alias("populated"), F.count("*").alias("distinct")).join(best, "field")


def newest_span(df: DataFrame, rows: int, time: str, as_of: datetime, probe: timedelta = timedelta(hours=1), most: timedelta = timedelta(days=30)) -> timedelta:
    """How far back the newest rows reach, at the rate of the last probe: a time filter that prunes, not a sort."""
    seen = df.where((F.col(time) > F.lit(as_of - probe)) & (F.col(time) <= F.lit(as_of))).count()
    return most if not seen else min(most, max(probe, probe * rows / seen))


def field_sample(df: DataFrame, fields: list[str] | None = None, entries: str | None = None, top: int = 5) -> DataFrame:
    """As field_stats() with bounded memory for each field: approximate distinct and frequent values.

    Rows come from the caller, who keeps recent ones by a filter on time (see newest_span()).
    """
    rows = unpivoted(df, fields, entries).where("value <> ''")
    return rows.groupBy("field").agg(F.count("*").alias("populated"), F.approx_count_distinct("value").alias("distinct"), F.expr(f"approx_top_k(value, {top})").alias("top"))


def field_advice(stats: DataFrame, usage: DataFrame, rows: int) -> DataFrame:
    """Whether a field should be a column of its own: used and well filled ones are promoted."""
    both = stats.join(usage, "field", "left").withColumn("weight", F.coalesce("weight", F.lit(0))).withColumn("coverage", F.round(F.col("populated") / rows, 4))
    verdict = F.when((F.col("weight") > 0) & (F.col("coverage") >= 0.05), "promote").when(F.col("weight") > 0, "keep").when((F.col("coverage") >= 0.5) & (F.col("distinct") > 1), "reserve").otherwise("unused")
    return both.select("field", "populated", "distinct", "coverage", "weight", verdict.alias("verdict"))
