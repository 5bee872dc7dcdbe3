"""Intermediate tables in the shared folder of the cluster, and connected components on them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shared import written


#: Bounds of an Arrow batch while a table is written: texts are long, and a batch is held by the executor and by its Python worker.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextmanager
def bounded(spark: SparkSession) -> Iterator[None]:
    """The session with BATCHES set, and afterwards as it was."""
    before = {k: spark.conf.get(k, None) for k in BATCHES}
    for k, v in BATCHES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder, in bounded batches, and read it again: cuts lineage and survives lost executors."""
    with bounded(df.sparkSession):
        return written(df, name)


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(v, c): each vertex of the undirected edges with the smallest vertex it reaches.

    Minimum labels along edges, then one pointer jump, until nothing changes: long paths halve each
    round. Labels are partially aggregated before each shuffle and hot vertices are dealt by skew joins.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    turned = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # each vertex is its own neighbour, so that one aggregation sees its label, too
    both = table(turned.unionByName(turned.select("u", F.col("u").alias("v"))).distinct(), "edges")
    labels = both.groupBy("v").agg(F.min("u").alias("c"))
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), F.col("c")), "u")
        step = near.groupBy("v").agg(F.max(F.when(F.col("u") == F.col("v"), F.col("c"))).alias("old"), F.min("c").alias("c"))
        jump = step.select(F.col("v").alias("c"), F.col("c").alias("root"))
        labels = table(step.join(jump, "c").select("v", "old", F.least("c", "root").alias("c")), "labels")
        done = labels.where("c <> old").isEmpty()
        labels = labels.select("v", "c")
        if done:
            return labels


def numbered(df: DataFrame, group: str, order: list[Column], out: str) -> DataFrame:
    """df with each row's place, from 0, within its group (a string column without nulls) in the given order.

    Rows are dealt by ranges of (group, order), so a large group is spread over tasks, and numbered within a range
    as they pass; the ranges' counts are summed. The order should leave no ties of rows that differ, and df should be slim.
    """
    names = df.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            # runs of equal groups: rows are sorted
            run = batch[group].dictionary_encode() if not pa.types.is_dictionary(batch[group].type) else batch[group]
            code = run.indices.to_numpy()
            starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            at = np.arange(len(code)) - np.repeat(starts, np.diff(np.append(starts, len(code))))
            first, end = batch[group][0].as_py(), batch[group][-1].as_py()
            if first == last:
                at[: starts[1] if len(starts) > 1 else None] += n
            last, n = end, int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, out])

    dealt = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).select(*names, F.spark_partition_id().alias("_range"))
    placed = table(dealt.mapInArrow(count, dealt.withColumn(out, F.lit(0).cast("long")).schema), "numbered")
    counts = placed.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = counts.select(group, "_range", F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # only groups that begin in an earlier range have rows before
    joined = placed.join(before.where("_before > 0"), [group, "_range"], "left")
    return joined.select(*names, (F.col(out) + F.coalesce("_before", F.lit(0))).alias(out))
