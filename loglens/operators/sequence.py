"""Sequences of events of an entity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import written


def identities(df: DataFrame, columns: list[str], out: str = "entity") -> DataFrame:
    """Each row once for each of its non-empty aliases."""
    values = F.array_distinct(F.filter(F.array(*(F.col(c).cast("string") for c in columns)), lambda x: x.isNotNull() & (x != "")))
    return df.withColumn(out, F.explode(values))


def _runs(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    """Where rows of other keys than the row before begin, and the end; nulls are equal."""
    new = np.zeros(batch.num_rows, bool)
    for k in keys:
        c = batch[k]
        differ = pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False) | (np.diff(c.is_null().to_numpy(zero_copy_only=False).astype(np.int8)) != 0)
        new[1:] |= differ
    return [0, *np.flatnonzero(new).tolist(), batch.num_rows]


def _kept(values: np.ndarray, last: int | None, gap: int) -> tuple[list[int], int | None]:
    """The places of the sorted values that are kept after last, and the last one kept."""
    good, i = [], 0 if last is None else int(np.searchsorted(values, last + gap))
    while i < len(values):
        good.append(i)
        last = int(values[i])
        i = int(np.searchsorted(values, last + gap))
    return good, last


def _ends(values: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(entries, ends): the values at which a chain of kept ones may enter this sorted run, if all before the run are smaller than
    its first value, and the last one kept for each."""
    n = int(np.searchsorted(values, values[0] + gap)) + 1
    at, end = np.arange(min(n, len(values))), np.zeros(min(n, len(values)), np.int64)
    chains = at.copy()
    while True:  # chains that meet go on as one
        at, back = np.unique(at, return_inverse=True)
        chains = back[chains] if len(chains) == len(end) else back
        after = np.searchsorted(values, values[at] + gap)
        if (after >= len(values)).all():
            return values[: len(end)], values[at][chains]
        at = np.where(after < len(values), after, at)


def spaced(df: DataFrame, keys: list[str], at: str, gap: int, parts: int | None = None) -> DataFrame:
    """Of the rows of each key, by rising at (a long, once for each key): the first, and then each one gap or more after the last one kept.

    Rows are dealt by ranges of (key, at), so a hot key, or no key at all, is spread over tasks. A range
    tells, for each row at which a chain may enter it (those less than gap after its first one, and one more), where the chain leaves it;
    these few rows are followed from range to range; then each range keeps its rows on from its entry.
    """
    if gap <= 0:
        return df
    names = df.columns
    order = [*keys, at]
    ranged = df.repartitionByRange(*([parts] if parts else []), *order)
    placed = written(ranged.select(*names, F.spark_partition_id().alias("_part")), "ranges")
    sorted_ = lambda rows: rows.repartition("_part").sortWithinPartitions("_part", *order)
    of = ["_part", *keys]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, head, last, opened, slots = None, None, [], None, None, None

        def row(slot: pa.RecordBatch, first: bool, entries: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
            same = slot.select(of).take(pa.array(np.zeros(len(entries), np.int64)))
            return pa.RecordBatch.from_arrays([*same.columns, pa.array(np.full(len(entries), first)), pa.array(entries), pa.array(ends)], names=[*of, "_first", "_entry", "_end"])

        def done() -> Iterator[pa.RecordBatch]:
            if head:
                yield row(slots[0], True, *_ends(np.concatenate(head), gap))
            if last is not None:
                yield row(slots[1], False, np.array([opened]), np.array([last]))

        for batch in batches:
            values = batch[at].to_numpy()
            cut = _runs(batch, of) if batch.num_rows else []
            for s, e in zip(cut, cut[1:], strict=False):
                own = tuple(batch[k][s].as_py() for k in of)
                if own[0] != part:
                    yield from done()
                    part, key, head, last, slots = own[0], own, [], None, [batch.slice(s, 1), None]
                if own == key and slots[1] is None:  # of the range's first key all rows are looked at
                    head.append(values[s:e])
                    continue
                if own != key:
                    key, last, opened, slots[1] = own, None, int(values[s]), batch.slice(s, 1)
                last = _kept(values[s:e], last, gap)[1]
        yield from done()

    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in of)
    ends = sorted_(placed.select(*of, at)).mapInArrow(summed, schema + ", _first boolean, _entry long, _end long")
    ends = written(ends, "entries")

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, part, found, row = None, None, None, True, None

        def out() -> Iterator[pa.RecordBatch]:
            if row is not None and not found:  # nothing of that range is kept: its rows are all too early
                yield pa.RecordBatch.from_arrays([*row.select(of).columns, pa.array([None], pa.int64())], names=[*of, "_start"])

        for batch in batches:
            own_keys = list(zip(*(batch[k].to_pylist() for k in keys), strict=True)) if keys else [()] * batch.num_rows
            for i, (own, p, first, entry, end) in enumerate(zip(own_keys, *(batch[c].to_pylist() for c in ("_part", "_first", "_entry", "_end")), strict=True)):
                if (own, p) != (key, part):
                    yield from out()
                    last, key, part, found, row = last if own == key else None, own, p, False, batch.slice(i, 1) if first else None
                if not found and (last is None or entry >= last + gap):
                    found, last = True, end
                    if first:
                        yield pa.RecordBatch.from_arrays([*row.select(of).columns, pa.array([entry], pa.int64())], names=[*of, "_start"])
        yield from out()

    chained = (ends.repartition(*keys) if keys else ends.coalesce(1)).sortWithinPartitions(*keys, "_part", "_entry")
    starts = written(chained.mapInArrow(followed, schema + ", _start long"), "starts")  # a row for each range
    starts = starts.select(*(F.col(k).alias(f"_of_{k}") for k in of), "_start", F.lit(True).alias("_headed"))
    same = reduce(lambda a, b: a & b, (placed[k].eqNullSafe(starts[f"_of_{k}"]) for k in of))
    headed = placed.join(F.broadcast(starts), same, "left").select(*names, "_part", "_start", "_headed")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, never = None, None, False
        for batch in batches:
            values, good = batch[at].to_numpy(), []
            cut = _runs(batch, of) if batch.num_rows else []
            for s, e in zip(cut, cut[1:], strict=False):
                own = tuple(batch[k][s].as_py() for k in of)
                if own != key:
                    start, is_headed = batch["_start"][s].as_py(), batch["_headed"][s].as_py()
                    key, last, never = own, None if start is None else start - gap, bool(is_headed) and start is None
                if not never:
                    found, last = _kept(values[s:e], last, gap)
                    good += [s + i for i in found]
            yield batch.take(pa.array(good, pa.int64())).select(names)

    return sorted_(headed).mapInArrow(keep, df.schema)


def chain(df: DataFrame, entity: str, steps: list[Column], time: str, key: str, within: float | None = None) -> DataFrame:
    """(entity, chain_count, first_time, done): non-overlapping runs of the steps, in order.

    Rows that match no step are ignored; a row that matches another step breaks a run. within bounds the
    seconds between neighbours. Rows are read at millisecond precision, ties go by the key. Only matching
    rows are shuffled; a start is found with lead(), then overlapping ones are passed over from left to right.
    """
    k = len(steps)
    match = F.array(*(F.coalesce(s, F.lit(False)) for s in steps))
    own = df.select(F.col(entity).alias("entity"), F.unix_millis(time).alias("t"), F.col(key).alias("key"), match.alias("m")).where(F.col("entity").isNotNull() & F.array_contains("m", True))
    order = Window.partitionBy("entity").orderBy("t", "key")
    own = own.withColumn("pos", F.row_number().over(order))
    good, previous = F.col("m")[0], F.col("t")
    for i in range(1, k):
        at = F.lead("t", i).over(order)
        good = good & F.coalesce(F.lead("m", i).over(order)[i], F.lit(False))
        if within is not None:
            good = good & (at - previous <= within * 1000)
        previous = at
    marked = own.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("end", F.lead("t", k - 1).over(order) if k > 1 else F.col("t")).where("good")
    kept = spaced(marked.select("entity", F.col("pos").cast("long").alias("pos"), "t", "end"), ["entity"], "pos", k)
    out = kept.groupBy("entity").agg(F.count("*").cast("int").alias("n"), F.min("t").alias("t"), F.max("end").alias("done"))
    return out.select(F.col("entity").alias(entity), F.col("n").alias("chain_count"), F.timestamp_millis("t").alias("first_time"), F.timestamp_millis("done").alias("done"))


def chain_any_order(df: DataFrame, entity: str, steps: list[Column], time: str) -> DataFrame:
    """Entities with every step, whatever their order: one aggregation."""
    counts = [F.count_if(s).alias(f"n{i}") for i, s in enumerate(steps)]
    firsts = [F.min(F.when(s, F.col(time))).alias(f"t{i}") for i, s in enumerate(steps)]
    out = df.groupBy(entity).agg(*counts, *firsts)
    names = [F.col(f"n{i}") for i in range(len(steps))]
    least = F.least(*names) if len(names) > 1 else names[0]
    return out.where(reduce(lambda a, b: a & b, [n > 0 for n in names])).select(F.col(entity), least.alias("chain_count"), *(F.col(f"t{i}").alias(f"step{i}_time") for i in range(len(steps))))


def chain_evidence(df: DataFrame, found: DataFrame, entity: str, time: str, done: str, steps: list[Column], seconds: float) -> DataFrame:
    """Whole rows that match a step within the given time before an entity's last completion."""
    own = df.where(F.coalesce(reduce(lambda a, b: a | b, steps), F.lit(False)))
    both = own.join(found.select(F.col(entity).alias("_e"), F.col(done).alias("_done")), F.col(entity) == F.col("_e"))
    return both.where((F.unix_millis(time) <= F.unix_millis("_done")) & (F.unix_millis(time) >= F.unix_millis("_done") - int(seconds * 1000))).drop("_e", "_done")
