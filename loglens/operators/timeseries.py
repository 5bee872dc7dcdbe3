"""Time buckets, charts and calendars. All times are UTC."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import written

SPANS = (30, 60, 300, 900, 1800, 3600, 10_800, 21_600, 43_200, 86_400, 604_800)
WEEK = 604_800
#: The epoch was a Thursday: Monday comes four days later, Sunday three.
WEEK_STARTS = {"monday": 4 * 86_400, "sunday": 3 * 86_400}


def bucket(time: str, seconds: int, week_start: str = "monday") -> Column:
    """The start of the bucket in which a time lies."""
    shift = WEEK_STARTS[week_start] if seconds == WEEK else 0
    at = F.unix_seconds(F.col(time)) - shift
    return F.timestamp_seconds(F.floor(at / seconds) * seconds + shift)


def timechart(df: DataFrame, time: str, seconds: int = 3600, value: Column | None = None, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(bucket(time, seconds).alias("bucket"), *(by or [])).agg(value if value is not None else F.count("*").alias("_count"))


def percent_true(*conditions: tuple[str, Column]) -> list[Column]:
    return [F.round(100.0 * F.count_if(c) / F.count("*"), 2).alias(name) for name, c in conditions]


def span_for(start: datetime, end: datetime, most: int = 120) -> int:
    """The smallest span with at most so many buckets in the range; beyond a week it doubles."""
    seconds = max(1, int((end - start).total_seconds()))
    found = next((s for s in SPANS if seconds / s <= most), SPANS[-1])
    while seconds / found > most:
        found *= 2
    return found


def event_histogram(df: DataFrame, time: str, start: datetime, end: datetime, most: int = 120) -> DataFrame:
    """Counts of all buckets of a range that is snapped outward to their edges; empty ones are 0."""
    span = span_for(start, end, most)
    epoch = datetime(1970, 1, 1)
    lo = int((start - epoch).total_seconds()) // span * span
    hi = -(-int((end - epoch).total_seconds()) // span) * span
    own = df.where((F.col(time) >= F.timestamp_seconds(F.lit(lo))) & (F.col(time) < F.timestamp_seconds(F.lit(hi))))
    counts = own.groupBy(F.timestamp_seconds(F.floor(F.unix_seconds(time) / span) * span).alias("bucket")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(lo, hi, span).select(F.timestamp_seconds("id").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def minute_rollup(df: DataFrame, time: str, tenant: str) -> DataFrame:
    """Partial counts for each tenant and minute, to be appended batch by batch."""
    return df.groupBy(F.col(tenant).alias("tenant_id"), F.date_trunc("minute", time).alias("minute")).agg(F.count("*").alias("cnt"))


def read_rollup(rollup: DataFrame, seconds: int) -> DataFrame:
    return rollup.groupBy(bucket("minute", seconds).alias("bucket")).agg(F.sum("cnt").alias("_count"))


def daily_volume(df: DataFrame, time: str, tenant: str, size: Column, as_of: datetime, days: int = 30, tenants: DataFrame | None = None) -> DataFrame:
    """Events and bytes of each tenant for each of the last days, zeros included; later times count as now.

    tenants (tenant) names those to list; without it, those with an event in these days. The one scan is
    pruned by time.
    """
    last = as_of.date()
    first = last - timedelta(days=days - 1)
    day = F.least(F.to_date(time), F.lit(last))
    own = df.where(F.col(time) >= F.lit(datetime.combine(first, datetime.min.time()))).groupBy(F.col(tenant).alias("tenant"), day.alias("day")).agg(F.count("*").alias("events"), F.sum(size).alias("bytes"))
    own = written(own, "volume")  # a row for each tenant and day
    every = (own if tenants is None else tenants).select("tenant").distinct().withColumn("day", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return every.join(own, ["tenant", "day"], "left").select("tenant", "day", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def same_hour_spike(df: DataFrame, time: str, metric: str, value: Column, as_of: datetime, factor: float = 1.5, least: float = 25, days: int = 3) -> DataFrame:
    """Each metric's mean of the last 30 minutes against the same hour of the last 7 days."""
    t, now = F.col(time), F.lit(as_of)
    recent = (t > now - F.expr("INTERVAL 30 MINUTES")) & (t <= now)
    past = (F.to_date(t) < F.to_date(now)) & (t > now - F.expr("INTERVAL 7 DAYS")) & (F.hour(t) == F.hour(now))
    out = df.where((t > now - F.expr("INTERVAL 7 DAYS")) & (t <= now)).groupBy(metric).agg(F.avg(F.when(recent, value)).alias("recent"), F.avg(F.when(past, value)).alias("usual"), F.count_distinct(F.when(past, F.to_date(t))).alias("days"))
    spike = (F.col("days") >= days) & (F.col("recent") >= least) & (F.col("recent") >= factor * F.col("usual"))
    return out.withColumn("spike", F.coalesce(spike, F.lit(False)))
