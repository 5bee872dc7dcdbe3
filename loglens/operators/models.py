"""Learned baselines. A state is partials for each day that are appended and summed when read."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import let
from ..functions.predicates import all_of
from ..plans.shared import written

DAY, HOUR = 86_400, 3_600


def model_source(df: DataFrame, filters: list[Column], extractions: list[tuple[str, str, str, int]] = ()) -> DataFrame:
    """Rows that pass all filters, with (out, field, pattern, least length) extracted in lower case; rows without one go."""
    out = df.where(all_of([F.coalesce(f, F.lit(False)) for f in filters]))
    for name, field, pattern, least in extractions:
        out = out.withColumn(name, F.lower(F.regexp_extract(field, "(?s)" + pattern, 1))).where((F.length(name) >= max(1, least)))
    return out


def rarity_state(df: DataFrame, partition: str, value: str, time: str) -> DataFrame:
    own = df.where(F.coalesce(F.col(value).cast("string"), F.lit("")) != "")
    return own.groupBy(F.col(partition).alias("part"), F.col(value).alias("value"), F.to_date(time).alias("day")).agg(F.count("*").alias("n"))


def rarity_score(state: DataFrame, min_sample: int = 1) -> DataFrame:
    """Each value's share of its partition's observations (distinct days), and how far the partition repeats itself."""
    values = state.groupBy("part", "value").agg(F.count_distinct("day").alias("n"))
    totals = values.groupBy("part").agg(F.sum("n").alias("total"), F.count("*").alias("uniq")).where(F.col("total") >= min_sample)
    return values.join(totals, "part").select("part", "value", "n", "total", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("percent"), F.round(0.95 * (F.col("total") - F.col("uniq")) / F.col("total"), 4).alias("confidence"))


def first_seen_state(df: DataFrame, entity: str, time: str) -> DataFrame:
    return df.where(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("entity"), F.to_date(time).alias("day")).agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count("*").alias("n"))


def first_seen_score(state: DataFrame, as_of: datetime) -> DataFrame:
    out = state.groupBy("entity").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("n").alias("n"), F.count_distinct("day").alias("days"))
    return out.withColumn("is_new", F.unix_seconds("first_seen") >= F.unix_seconds(F.lit(as_of)) - HOUR)


def volume_state(df: DataFrame, entity: str, time: str, seconds: int = DAY) -> DataFrame:
    at = F.timestamp_seconds(F.floor(F.unix_seconds(time) / seconds) * seconds)
    return df.where(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("entity"), at.alias("bucket")).agg(F.count("*").alias("n"))


def _upper_median(a: Column) -> Column:
    """An element of the data: the upper one of two in the middle."""
    return let(F.sort_array(a), lambda v: F.element_at(v, (F.floor(F.size(v) / 2) + 1).cast("int")))


def volume_score(state: DataFrame, as_of: datetime, seconds: int = DAY, history: int = 90 * DAY, least: int = 7) -> DataFrame:
    """Latest complete bucket against the median and MAD of the complete buckets of the history, which bound the arrays."""
    end = F.floor(F.unix_seconds(F.lit(as_of)) / seconds) * seconds
    at = F.unix_seconds("bucket")
    counts = state.where((at < end) & (at >= end - history)).groupBy("entity", "bucket").agg(F.sum("n").alias("n"))
    out = counts.groupBy("entity").agg(F.collect_list(F.col("n").cast("double")).alias("c"), F.max_by("n", "bucket").alias("latest"), F.count("*").alias("buckets")).where(F.col("buckets") >= least)
    both = let(_upper_median(F.col("c")), lambda m: F.struct(m.alias("median"), _upper_median(F.transform("c", lambda x: F.abs(x - m))).alias("mad")))
    out = out.withColumn("_m", both).select("*", "_m.*")
    return out.select("entity", "latest", "buckets", "median", "mad", F.when(F.col("mad") == 0, 0.0).otherwise(F.round(0.6745 * (F.col("latest") - F.col("median")) / F.col("mad"), 4)).alias("zscore"))


PAIR = ("src", "dst", "port")
#: Different gaps or sizes of a pair that are scored within one row; pairs with more are scored over many.
FEW = 256


def network_state(df: DataFrame, src: str, dst: str, port: str, time: str, size: str, duration: str, every: int | None = DAY) -> DataFrame:
    """Partials of each connection pair (src, dst, port) and span of time: every seconds, or with None all rows as one span.

    Rows of (kind, v, n): of kind "pair" one with the number of connections, their duration and the first and last
    second; "gap": how often v seconds lay between neighbouring times; "size" and "hour" (of the day): how often each was there. So a
    regular pair takes a few rows whatever its number of connections, and a hot one isn't a single group. Every connection counts.
    """
    at = F.unix_seconds(time)
    span = F.lit(None).cast("timestamp") if every is None else F.timestamp_seconds(F.floor(at / every) * every)
    own = df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(port).alias("port"), span.alias("span"), at.alias("at"), F.col(size).cast("double").alias("size"), F.col(duration).cast("double").alias("duration"))
    keys = [*PAIR, "span"]
    hours = F.array(*(F.struct(F.lit(float(h)).alias("v"), F.count_if(F.floor(F.pmod(F.col("at"), F.lit(DAY)) / HOUR) == h).alias("n")) for h in range(24)))
    pairs = own.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("duration").alias("duration"), F.min("at").alias("first"), F.max("at").alias("last"), hours.alias("hours"))
    none = lambda kind: {"duration": F.lit(None).cast("double"), "first": F.lit(None).cast("long"), "last": F.lit(None).cast("long")} | {"kind": F.lit(kind)}
    columns = [*keys, "kind", "v", "n", "duration", "first", "last"]
    # one pass over pairs gives their own rows and those of their hours
    whole = F.array(F.struct(F.lit("pair").alias("kind"), F.lit(None).cast("double").alias("v"), F.col("n"), F.col("duration"), F.col("first"), F.col("last")))
    of_hours = F.transform(F.filter("hours", lambda x: x["n"] > 0), lambda x: F.struct(F.lit("hour").alias("kind"), x["v"].alias("v"), x["n"].alias("n"), F.lit(None).cast("double").alias("duration"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last")))
    heads = pairs.select(*keys, F.explode(F.concat(whole, of_hours)).alias("_r")).select(*keys, "_r.*")
    sizes = own.where("size is not null").groupBy(*keys, F.col("size").alias("v")).agg(F.count("*").alias("n")).withColumns(none("size"))
    # gaps within days, then those between a span's days: a pair's days are dealt over the cluster
    day = F.floor(F.col("at") / DAY).alias("day")
    seconds = own.where("at is not null").select(*keys, day, "at").distinct()
    inner = seconds.withColumn("v", F.col("at") - F.lag("at").over(Window.partitionBy(*keys, "day").orderBy("at")))
    gaps = inner.where("v is not null").select(*keys, "v")
    if every is None or every > DAY:
        days = seconds.groupBy(*keys, "day").agg(F.min("at").alias("first"), F.max("at").alias("last"))
        gaps = gaps.unionByName(_seams(days, keys).select(*keys, "v"))
    gaps = gaps.groupBy(*keys, F.col("v").cast("double").alias("v")).agg(F.count("*").alias("n")).withColumns(none("gap"))
    return heads.select(*columns).unionByName(sizes.select(*columns)).unionByName(gaps.select(*columns))


def _seams(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The gaps v from the last second of each of the spans (keys, first, last) to the first one of the next."""
    before = F.lag("last").over(Window.partitionBy(*keys).orderBy("first"))
    return spans.where("first is not null").withColumn("v", F.col("first") - before).where("v > 0")


def merge_network(state: DataFrame) -> DataFrame:
    """States of spans that don't overlap, such as days or the batches of a history, as one: sums, and a gap for each seam between two spans.

    It is what network_state() makes of all rows as one span, so it can be merged again.
    """
    seams = _seams(state.where("kind = 'pair'"), list(PAIR)).select(*PAIR, F.lit("gap").alias("kind"), F.col("v").cast("double").alias("v"), F.lit(1).cast("long").alias("n"))
    own = state.drop("span").unionByName(seams, allowMissingColumns=True)
    out = own.groupBy(*PAIR, "kind", "v").agg(*(F.sum(c).alias(c) for c in ("n", "duration")), F.min("first").alias("first"), F.max("last").alias("last"))
    return out.withColumn("span", F.lit(None).cast("timestamp")).select(*state.columns)


def network_context(state: DataFrame) -> DataFrame:
    """Distinct sources of each destination and of all."""
    by = state.groupBy("dst").agg(F.count_distinct("src").alias("sources"))
    return by.crossJoin(F.broadcast(state.agg(F.count_distinct("src").alias("all_sources"))))  # one row


def _unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def _quantile(sorted_values: Column, q: float) -> Column:
    at = (F.size(sorted_values) - 1) * F.lit(q)
    low = F.element_at(sorted_values, (F.floor(at) + 1).cast("int"))
    high = F.element_at(sorted_values, (F.ceil(at) + 1).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def _evenness(q: Column, deviation: Column) -> Column:
    """The score of quartiles a, b, c and the median of absolute deviations from b."""
    spread = q["c"] - q["a"]
    weight = F.when(q["b"] >= 1, _unit(spread / q["b"] / 0.1)).otherwise(1.0)
    even = F.when(spread == 0, 1.0).otherwise(_unit(1 - F.abs((q["c"] + q["a"] - 2 * q["b"]) / spread) * weight))
    tight = F.when(q["b"] >= 1, _unit((q["b"] - deviation) / q["b"])).otherwise(0.0)
    return (even + tight) / 2


def _dispersion(values: Column) -> Column:
    """How tightly and evenly values lie together, 0 to 1: quartile skewness, damped for a narrow spread,
    and the absolute deviation relative to the median, averaged; 0 for fewer than three."""

    def scored(v: Column, q: Column) -> Column:
        off = F.sort_array(F.transform(v, lambda x: F.abs(x - q["b"])))
        return let(off, lambda d: _evenness(q, _quantile(d, 0.5)))

    quartiles = lambda v: F.struct(_quantile(v, 0.25).alias("a"), _quantile(v, 0.5).alias("b"), _quantile(v, 0.75).alias("c"))
    return let(F.sort_array(values), lambda v: F.when(F.size(v) < 3, 0.0).otherwise(let(quartiles(v), lambda q: scored(v, q))))


def beacon_score(pairs: DataFrame, window: int, weights: tuple[float, float, float, float] = (0.25, 0.25, 0.25, 0.25), least: int = 4) -> DataFrame:
    """pairs (src, dst, port, n, ts sorted, sizes, first_ts, last_ts) with ts, ds, dur and hist scores and their sum.

    Regular gaps, regular sizes, a span that fills the window or the day's hours, and an even spread over
    the hours. Fewer than four points score 0.
    """
    gaps = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size("ts") - 1, F.lit(1))), lambda i: (F.try_element_at("ts", i + 1) - F.try_element_at("ts", i)).cast("double")), lambda g: g > 0)
    hours = F.transform("ts", lambda t: F.floor(F.pmod(t, F.lit(DAY)) / HOUR))
    bins = let(hours, lambda hs: F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.size(F.filter(hs, lambda x: x == h)).cast("double")))
    return _combined(pairs, _dispersion(gaps), _dispersion(F.col("sizes")), bins, F.size("ts"), window, weights, least)


def _combined(pairs: DataFrame, ts: Column, ds: Column, bins: Column, points: Column, window: int, weights: tuple[float, float, float, float], least: int) -> DataFrame:
    """The scores from those of gaps and sizes, 24 hour counts and the number of times."""
    span = _unit((F.col("last_ts") - F.col("first_ts")) / F.lit(float(window)))
    mean = points / 24.0
    cv = lambda h: F.sqrt(F.aggregate(h, F.lit(0.0), lambda a, c: a + (c - mean) * (c - mean)) / 24.0) / mean
    even = lambda c: F.when((points == 0) | (c > 1), 0.0).otherwise(_unit(1 - c))
    of_hours = let(bins, lambda h: F.struct(F.greatest(span, F.size(F.filter(h, lambda c: c > 0)) / 24.0).alias("dur"), let(cv(h), even).alias("hist")))
    out = pairs.withColumn("_s", F.struct(ts.alias("ts"), ds.alias("ds"), of_hours.alias("h")))
    enough = (points >= 4) & (F.col("n") >= least)
    parts = {"ts_score": "_s.ts", "ds_score": "_s.ds", "dur_score": "_s.h.dur", "hist_score": "_s.h.hist"}
    total = sum((F.col(c) * w for c, w in zip(parts.values(), weights, strict=True)), F.lit(0.0))
    out = out.withColumn("beacon", F.when(enough, F.round(_unit(total), 3)).otherwise(0.0))
    out = out.withColumns({k: F.when(enough, F.round(F.col(c), 3)).otherwise(0.0) for k, c in parts.items()})
    return out.drop("_s")


def long_conn_score(duration: Column, base: float = 3_600, low: float = 14_400, med: float = 28_800, high: float = 43_200) -> Column:
    """A connection's total seconds on a scale of tiers, straight within each, 1 at twice the highest."""
    part = lambda a, b: (duration - a) / (b - a)
    tiers = F.when(duration < base, 0.0).when(duration < low, 0.25 * part(base, low)).when(duration < med, 0.25 + 0.25 * part(low, med)).when(duration < high, 0.5 + 0.25 * part(med, high)).otherwise(_unit(0.75 + 0.25 * part(high, 2 * high)))
    return F.round(tiers, 3)


def prevalence_modifier(score: Column, share: Column, low: float = 0.02, high: float = 0.5, step: float = 0.15) -> Column:
    """Rare destinations raise a score, those of most sources lower it."""
    return F.round(_unit(score + F.when((share > 0) & (share <= low), step).when(share >= high, -step).otherwise(0.0)), 3)


def severity_tier(score: Column) -> Column:
    return F.when(score > 0.8, "critical").when(score > 0.6, "high").when(score > 0.4, "medium").when(score > 0.2, "low").otherwise("none")


def _of_pairs(df: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Join on the pair, where nulls are equal, as they are in groups."""
    own = other.withColumnsRenamed({k: f"_{k}" for k in PAIR})
    return df.join(own, all_of([F.col(k).eqNullSafe(F.col(f"_{k}")) for k in PAIR]), how).drop(*(f"_{k}" for k in PAIR))


def _weighted_dispersion(values: DataFrame) -> DataFrame:
    """_dispersion() of values (src, dst, port, kind, v, n), n copies of v, as ts and ds of each pair.

    Quartiles are found at their ranks in running counts; windows spill, so no pair has to fit in memory.
    """
    part = Window.partitionBy(*PAIR, "kind")
    upto = lambda c: part.orderBy(c).rowsBetween(Window.unboundedPreceding, 0)

    def quantile(q: float, v: str, below: str, over: Callable[[Column], Column]) -> Column:
        at = (F.col("all") - 1) * F.lit(q)
        low, high = (over(F.min(F.when(F.col(below) > r, F.col(v)))) for r in (F.floor(at), F.ceil(at)))
        return low + (high - low) * (over(F.first(at)) - over(F.first(F.floor(at))))

    whole = lambda c: c.over(part)
    own = values.withColumns({"all": F.sum("n").over(part), "upto": F.sum("n").over(upto("v"))})
    own = own.withColumns({k: quantile(q, "v", "upto", whole) for k, q in (("a", 0.25), ("b", 0.5), ("c", 0.75))})
    own = own.withColumn("off", F.abs(F.col("v") - F.col("b"))).withColumn("near", F.sum("n").over(upto("off")))
    out = own.groupBy(*PAIR, "kind").agg(F.first("all").alias("all"), F.first(F.struct("a", "b", "c")).alias("q"), quantile(0.5, "off", "near", lambda c: c).alias("mad"))
    score = F.when(F.col("all") < 3, 0.0).otherwise(_evenness(F.col("q"), F.col("mad")))
    return out.groupBy(*PAIR).agg(*(F.max(F.when(F.col("kind") == k, score)).alias(k) for k in ("ts", "ds")))


def _at_ranks(entries: Column, ranks: list[Column]) -> Column:
    """A struct r0, r1, ...: the values at these ranks, from 0, of sorted entries (v, n), n copies of v each."""
    names = [f"r{i}" for i in range(len(ranks))]
    start = F.struct(F.lit(0).cast("long").alias("upto"), *(F.lit(None).cast("double").alias(r) for r in names))

    def step(a: Column, e: Column) -> Column:
        upto = a["upto"] + e["n"]
        return F.struct(upto.alias("upto"), *(F.coalesce(a[r], F.when(upto > at, e["v"])).alias(r) for r, at in zip(names, ranks, strict=True)))

    return F.aggregate(entries, start, step)


def _dispersion_of(entries: Column) -> Column:
    """_dispersion() of entries (v, n), n copies of v each."""
    between = lambda at, low, high: low + (high - low) * (at - F.floor(at))

    def scored(x: Column) -> Column:
        places = [(x["all"] - 1) * F.lit(q) for q in (0.25, 0.5, 0.75)]
        found = _at_ranks(x["e"], [r for at in places for r in (F.floor(at), F.ceil(at))])
        quartiles = lambda r: F.struct(*(between(at, r[f"r{2 * i}"], r[f"r{2 * i + 1}"]).alias(k) for i, (at, k) in enumerate(zip(places, "abc", strict=True))))

        def whole(q: Column) -> Column:
            off = F.sort_array(F.transform(x["e"], lambda e: F.struct(F.abs(e["v"] - q["b"]).alias("v"), e["n"].alias("n"))))
            middle = _at_ranks(off, [F.floor(places[1]), F.ceil(places[1])])
            return let(middle, lambda r: _evenness(q, between(places[1], r["r0"], r["r1"])))

        return F.when(x["all"] < 3, 0.0).otherwise(let(let(found, quartiles), whole))

    total = F.aggregate(entries, F.lit(0).cast("long"), lambda a, e: a + e["n"])
    return let(F.struct(F.sort_array(entries).alias("e"), total.alias("all")), scored)


def score_pairs(state: DataFrame, window: int) -> DataFrame:
    """The network job: partials merged to pairs, scored, adjusted by prevalence. No cap on pairs, times or sizes.

    Reads the state alone. Pairs with a connection a second or more in the window are strobes and left out.
    """
    merged = written(merge_network(state), "pairs")
    values = F.col("kind").isin("gap", "size")
    # written, so that its size is known: few pairs have so many different values
    many = written(merged.where(values).groupBy(*PAIR).agg(F.count("*").alias("_k")).where(F.col("_k") > FEW).select(*PAIR), "many")
    some = not many.isEmpty()
    apart = merged.where(~values).unionByName(_of_pairs(merged.where(values), many, "left_anti")) if some else merged
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.struct("v", "n"))).alias(kind)
    own = lambda f, c: f(F.when(F.col("kind") == "pair", F.col(c)))
    pairs = apart.groupBy(*PAIR).agg(own(F.sum, "n").alias("n"), own(F.sum, "duration").alias("duration"), own(F.min, "first").alias("first_ts"), own(F.max, "last").alias("last_ts"), F.coalesce(F.sum(F.when(F.col("kind") == "hour", F.col("n").cast("double"))), F.lit(0.0)).alias("points"), of("hour"), of("gap"), of("size"))
    pairs = pairs.where(F.col("n") < window)
    if some:
        large = _of_pairs(merged.where(values), many, "left_semi").select(*PAIR, F.when(F.col("kind") == "gap", "ts").otherwise("ds").alias("kind"), "v", "n")
        pairs = _of_pairs(pairs, _weighted_dispersion(large), "left")
    else:
        pairs = pairs.withColumns({k: F.lit(None).cast("double") for k in ("ts", "ds")})
    counts = let(F.map_from_entries("hour"), lambda m: F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.try_element_at(m, h.cast("double")), F.lit(0)).cast("double")))
    scored = _combined(pairs, F.coalesce("ts", _dispersion_of(F.col("gap"))), F.coalesce("ds", _dispersion_of(F.col("size"))), counts, F.col("points"), window, (0.25, 0.25, 0.25, 0.25), 4)
    scored = scored.withColumn("long_conn", long_conn_score(F.col("duration"))).join(network_context(merged.where("kind = 'pair'")), "dst")
    share = F.col("sources") / F.col("all_sources")
    out = scored.withColumn("score", prevalence_modifier(F.greatest("beacon", "long_conn"), share)).withColumn("severity", severity_tier(F.col("score")))
    return out.select("src", "dst", "port", "n", "beacon", "ts_score", "ds_score", "dur_score", "hist_score", "long_conn", F.round(share, 4).alias("prevalence"), "score", "severity")


# Bands of score distributions.
BANDS = {
    "confidence": ("0.0-0.1", "0.1-0.2", "0.2-0.3", "0.3-0.4", "0.4-0.5", "0.5-0.6", "0.6-0.7", "0.7-0.8", "0.8-0.9", "0.9-1.0"),
    "count": ("1-9", "10-99", "100-999", "1K-9.9K", "10K-99K", "100K+"),
    "zscore": ("0-1", "1-2", "2-3", "3-4", "4-5", "5+"),
}


def score_distribution(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Rows in each band, empty bands included."""
    labels, c = BANDS[kind], F.col(column)
    at = {"confidence": F.floor(c * 10 + 1e-9), "count": F.floor(F.log10(c.cast("double")) + 1e-12), "zscore": F.floor(F.abs(c))}[kind]
    counts = df.groupBy(F.greatest(F.least(at, F.lit(len(labels) - 1)), F.lit(0)).cast("int").alias("band")).agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame(list(enumerate(labels)), "band int, label string")
    return every.join(counts, "band", "left").select("band", "label", F.coalesce("n", F.lit(0)).alias("n"))


def model_alert(kind: str, threshold: float) -> Column:
    """The rows of a scored model that are worth an alert."""
    return {"rarity": (F.col("percent") <= threshold) & (F.col("confidence") > 0), "first_seen": F.col("is_new"), "volume": F.col("zscore") > threshold, "network": F.col("score") > threshold}[kind]


def backfill(rows: DataFrame, time: str, path: str, state: Callable[[DataFrame], DataFrame], first: date, last: date, again: bool = False) -> list[date]:
    """Write the state of history, a folder for each UTC day, oldest first; return the days that were written.

    A day whose folder is complete is passed over, so a run that stopped is called again with the same
    days and goes on; with again, days are replaced. Each day reads its own rows only.
    """
    spark = rows.sparkSession
    done, at = [], first
    while at <= last:
        out = f"{path}/day={at}"
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/_SUCCESS")
        if again or not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
            start, end = (F.lit(f"{d} 00:00:00 UTC").cast("timestamp") for d in (at, at + timedelta(days=1)))
            partials = state(rows.where((F.col(time) >= start) & (F.col(time) < end)))
            partials.drop("day").write.mode("overwrite").parquet(out)
            done.append(at)
        at += timedelta(days=1)
    return done
