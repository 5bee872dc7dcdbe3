"""Structured Streaming: ingest, baselines and alerts. Cursors run on arrival time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sequence import spaced
from ..sources.normalize import normalized
from ..sources.readers import parse_json


def normalized_stream(rows: DataFrame, text: str, arrival: str, tenant: str, parse: Callable[[DataFrame, str], DataFrame] = parse_json, **how) -> DataFrame:
    """Arriving texts as log rows: parsed, normalized and stamped; how goes to normalized(). Batches or streams."""
    return normalized(parse(rows, text), F.col(arrival), F.col(tenant), F.col(text), **how)


def ingest_stream(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Normalized rows, appended to the archive's layout exactly once."""
    out = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("tenant_id", "ingest_date")
    return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime="1 minute")).start()


def baseline_stream(rows: DataFrame, states: dict[str, tuple[Callable[[DataFrame], DataFrame], str]], checkpoint: str) -> StreamingQuery:
    """Every batch feeds each state table {name: (partials, path)}; a batch that runs again replaces its own partials."""

    def feed(batch: DataFrame, number: int) -> None:
        batch.persist()
        for partials, path in states.values():
            partials(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return rows.writeStream.foreachBatch(feed).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_alerts(rows: DataFrame, match: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Hits of rules that look at single events; the stream's offsets are the cursor, so each row counts once."""

    def hit(batch: DataFrame, number: int) -> None:
        match(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(hit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_alert(rows: DataFrame, time: str, window: str, keys: list[str], least: int, late: str = "0 seconds") -> DataFrame:
    """Groups with enough rows in a complete tumbling window; on a stream, windows close at the watermark."""
    own = rows.withWatermark(time, late) if rows.isStreaming else rows
    out = own.groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def scheduled_alert(rows: DataFrame, time: str, as_of: datetime, look_back: timedelta, keys: list[str], least: int) -> DataFrame:
    """Groups with enough rows in the span before as_of."""
    own = rows.where((F.col(time) > F.lit(as_of - look_back)) & (F.col(time) <= F.lit(as_of)))
    return own.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def sliding_alert(rows: DataFrame, time: str, look_back: str, every: str, keys: list[str], least: int, late: str = "0 seconds") -> DataFrame:
    """scheduled_alert() as a stream: overlapping windows, one for each time it would run; they close at the watermark."""
    own = rows.withWatermark(time, late) if rows.isStreaming else rows
    out = own.groupBy(F.window(time, look_back, every).alias("w"), *keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return out.select(F.col("w.end").alias("as_of"), *keys, "n")


def new_completions(rows: DataFrame, time: str, start: datetime, end: datetime, within: timedelta, find: Callable[[DataFrame], DataFrame], done: str = "done") -> DataFrame:
    """A sequence needs history before its window; what was complete before the window was reported already."""
    read = rows.where((F.col(time) > F.lit(start - within)) & (F.col(time) <= F.lit(end)))
    return find(read).where(F.col(done) >= F.lit(start))


def throttle(firings: DataFrame, keys: list[str], time: str, seconds: int) -> DataFrame:
    """The firings of each key that aren't within the span after one that was kept: one row for each kept second.

    Firings of one second are one row before they are dealt, so a key has no more rows than its history has seconds.
    """
    at = firings.where(F.col(time).isNotNull()).select(*keys, F.unix_seconds(time).alias("_s")).distinct()
    return spaced(at, keys, "_s", seconds).select(*keys, F.timestamp_seconds("_s").alias(time))


def throttle_stream(firings: DataFrame, keys: list[str], time: str, seconds: int) -> DataFrame:
    """throttle() on a stream: the state of a key is the second of its last kept firing.

    It expires a span after the key last had a firing, by the clock of arrival, so keys that fall silent are
    forgotten. A firing that is older than the last kept one of its key counts as within its span. Run it with a
    processing-time trigger: as time alone brings work, a query that is to end with its input would not.
    """

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(t for b in batches for t in b["_s"].dropna()):
            if last is None or t - last >= seconds:
                out.append(t)
                last = t
        if last is not None:
            state.update((int(last),))
            state.setTimeoutDuration(seconds * 1000)
        yield pd.DataFrame([(*key, pd.Timestamp(t, unit="s")) for t in out], columns=[*keys, time])

    own = firings.select(*keys, F.unix_seconds(time).alias("_s"), time)
    schema = own.select(*keys, time).schema
    return own.groupBy(*keys).applyInPandasWithState(keep, schema, "last long", "append", "ProcessingTimeTimeout")


def alert_firings(hits: DataFrame, alert: str, time: str, field: str | None = None, order: list[str] | None = None) -> DataFrame:
    """(alert, value, time): one firing of an alert for all its hits of a run, at the newest, known by the field of its first row.

    Throttling these by (alert, value) holds back an alert whose first row repeats; without a field, or
    with one that the first row lacks, value is null, so the alert is throttled as a whole.
    """
    value = F.lit(None).cast("string") if field is None else F.min_by(F.col(field).cast("string"), F.struct(*(order or [time])))
    return hits.groupBy(F.lit(alert).alias("alert")).agg(value.alias("value"), F.max(time).alias(time))


def forward_hits(hits: DataFrame, tenant: str, alert: str, renames: dict[str, str] | None = None, now: Column | None = None) -> DataFrame:
    """Hits as new events of another tenant, with the alert and the source's id among their fields."""
    from ..functions.fields import log_id

    fields = F.map_zip_with(F.col("fields"), F.create_map(F.lit("alert_name"), F.lit(alert), F.lit("source_log_id"), F.col("log_id")), lambda _, a, b: F.coalesce(b, a))
    if renames:
        names = F.create_map(*(F.lit(x) for pair in renames.items() for x in pair))
        fields = F.transform_keys(fields, lambda k, _: F.coalesce(F.try_element_at(names, k), k))
    when = F.col("timestamp") if now is None else now
    return hits.select(when.alias("timestamp"), log_id(when, F.concat_ws(":", F.lit(alert), "log_id")).alias("log_id"), F.lit(tenant).alias("tenant_id"), fields.alias("fields"))


def hits_to_dictionary(hits: DataFrame, columns: list[str], most: int | None = None) -> DataFrame:
    """Keys with their row, to replace a lookup table; the first column is the key. most keeps so many, by key."""
    rows = hits.select(*columns).where(F.col(columns[0]).isNotNull())
    rest = columns[1:]
    out = rows.groupBy(columns[0]).agg(*(F.max(F.struct(*rest)).alias("r"),) if rest else (F.count("*").alias("r"),))
    out = out.select(columns[0], *(F.col(f"r.{c}").alias(c) for c in rest))
    return out if most is None else out.orderBy(columns[0]).limit(most)
