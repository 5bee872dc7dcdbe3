"""The Parquet archive of log rows: partitions by tenant and arrival date."""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shared import written

#: Fields that get a column of their own, so that Parquet's statistics and filters work on them.
PROMOTED = ("computer_name", "user", "src_ip", "dst_ip", "image")


def scan_logs(df: DataFrame, tenants: list[str] | None, start, end, time: str = "timestamp", closed: bool = True, tenant: str = "tenant_id") -> DataFrame:
    """Rows of the tenants in a time range, closed or without its end."""
    t = F.col(time)
    out = df.where((t >= F.lit(start)) & ((t <= F.lit(end)) if closed else (t < F.lit(end))))
    return out if tenants is None else out.where(F.col(tenant).isin(*tenants))


def write_archive(df: DataFrame, path: str, promoted: tuple[str, ...] = PROMOTED) -> None:
    """Append log rows, sorted within each file, so time ranges prune row groups. A small day of a tenant is one file; a large one is
    split over tasks and files by adaptive execution, near its advisory size."""
    out = df.withColumns({f"f_{p}": F.try_element_at("fields", F.lit(p)) for p in promoted})
    out.hint("rebalance", "tenant_id", "ingest_date").sortWithinPartitions("timestamp", "log_id").write.mode("append").partitionBy("tenant_id", "ingest_date").parquet(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def archive_search(archive: DataFrame, first: date, last: date, operator, limit: int = 250) -> tuple[DataFrame, DataFrame]:
    """(rows, one row with limit_hit): any operator over the days' distinct rows, capped.

    The search runs once: one row more than the limit is written, in the operator's order, and read for both.
    """
    found = operator(archive.where(F.col("ingest_date").between(F.lit(first), F.lit(last))).dropDuplicates(["log_id"])).limit(limit + 1)
    found = written(found.withColumn("_n", F.monotonically_increasing_id()), "search")  # a limit leaves one partition, in order
    place = F.row_number().over(Window.orderBy("_n"))  # limit + 1 rows
    return found.withColumn("_n", place).where(F.col("_n") <= limit).orderBy("_n").drop("_n"), found.agg((F.count("*") > limit).alias("limit_hit"))


def restore(archive: DataFrame, hot: DataFrame, start, end, time: str = "timestamp", key: str = "log_id", target: str | None = None) -> DataFrame:
    """Archived rows of a window that are not hot, each once; run again, it gives none."""
    rows = archive.where((F.col(time) >= F.lit(start)) & (F.col(time) < F.lit(end))).dropDuplicates([key]).join(hot.select(key), key, "left_anti")
    return rows if target is None else rows.withColumn("tenant_id", F.lit(target))


def reconcile_counts(archive: DataFrame, hot: DataFrame, tenant: str, time: str) -> DataFrame:
    """Rows of each tenant and day in both, and which days need a restore."""
    count = lambda df, name: df.groupBy(F.col(tenant).alias("tenant"), F.to_date(time).alias("day")).agg(F.count("*").alias(name))
    both = count(archive, "archived").join(count(hot, "hot"), ["tenant", "day"], "full")
    both = both.select("tenant", "day", F.coalesce("archived", F.lit(0)).alias("archived"), F.coalesce("hot", F.lit(0)).alias("hot"))
    return both.withColumn("restore", F.col("archived") > F.col("hot"))


def expired_partitions(days: DataFrame, keep: int, as_of: date, day: str = "day") -> DataFrame:
    return days.where(F.col(day) < F.lit(as_of - timedelta(days=keep)))


def rollover(days: DataFrame, quota: int, tenant: str = "tenant", day: str = "day", size: str = "bytes") -> DataFrame:
    """The oldest days to drop of each tenant over its quota, until four fifths of it are left; never the newest."""
    by = Window.partitionBy(tenant)
    left = F.sum(size).over(by.orderBy(F.col(day).desc()).rowsBetween(Window.unboundedPreceding, 0))
    own = days.withColumn("_total", F.sum(size).over(by)).withColumn("_left", left).withColumn("_newest", F.max(day).over(by))
    return own.where((F.col("_total") > quota) & (F.col("_left") > 0.8 * quota) & (F.col(day) < F.col("_newest"))).drop("_total", "_left", "_newest")


def delete_partitions(spark: SparkSession, path: str, partitions: DataFrame, columns: tuple[str, ...] = ("tenant_id", "ingest_date")) -> int:
    """Delete whole partitions through the file system of the path; the list is one row for each, not for each event."""
    jvm = spark._jvm
    name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    n = 0
    for r in partitions.select(*columns).distinct().toLocalIterator():
        p = jvm.org.apache.hadoop.fs.Path(path + "/" + "/".join(f"{c}={name(str(r[c]))}" for c in columns))
        n += p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return n


def scan_estimate(archive: DataFrame) -> DataFrame:
    """Files, bytes and rows that a scan would open."""
    files = archive.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).agg(F.count("*").alias("n"))
    return files.agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("n").alias("rows"))


def small_partitions(archive: DataFrame, target: int, before: date, budget: int | None = None) -> DataFrame:
    """Sealed days whose files are smaller than the target on average, the most scattered first, within a budget of bytes."""
    files = archive.select("tenant_id", "ingest_date", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).distinct()
    by = files.where(F.col("ingest_date") < F.lit(before)).groupBy("tenant_id", "ingest_date").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).where((F.col("files") > 1) & (F.col("bytes") / F.col("files") < target))
    if budget is None:
        return by
    run = F.sum("bytes").over(Window.orderBy(F.col("files").desc(), "tenant_id", "ingest_date").rowsBetween(Window.unboundedPreceding, 0))  # a row for each partition
    return by.withColumn("_run", run).where(F.col("_run") <= budget).drop("_run")


def compact(spark: SparkSession, path: str, chosen: DataFrame, target: int = 512 << 20) -> None:
    """Rewrite the files of the chosen partitions into files near the target size.

    What is rewritten is a list of files, kept in the shared folder, so rows that are appended meanwhile stay.
    New files are written beside the archive and renamed into it; then those of the list are deleted. A
    failure in between leaves rows twice, never none, and archive_search() and restore() take each once.
    The driver renames and deletes files by name; rows never pass through it. A day above the target is cut by time of day
    into as many ranges, each a task and a file of its own.
    """
    by = ["tenant_id", "ingest_date"]
    place = F.col("_metadata.file_path").alias("_file")
    files = read_archive(spark, path).select(*by, place, F.col("_metadata.file_size").alias("_size")).distinct().join(chosen.select(*by), by, "left_semi")
    files = written(files, "rewritten")
    total = files.agg(F.sum("_size")).first()[0]
    if not total:
        return
    fresh = f"{path.rstrip('/')}__compacting_{uuid.uuid4().hex}"
    rows = read_archive(spark, path).select("*", place).join(files.select("_file"), "_file", "left_semi").drop("_file")
    sizes = files.groupBy(*by).agg(F.greatest(F.round(F.sum("_size") / target), F.lit(1)).cast("long").alias("_slices"))
    rows = rows.join(F.broadcast(sizes), by)  # a row for each partition
    cut = F.coalesce(F.floor(F.pmod(F.unix_seconds("timestamp"), F.lit(86_400)) * F.col("_slices") / 86_400), F.lit(0))
    tasks = max(1, round(total / target), sizes.agg(F.max("_slices")).first()[0])
    dealt = rows.withColumn("_cut", cut).repartition(tasks, *by, "_cut").drop("_cut", "_slices")
    dealt.sortWithinPartitions(*by, "timestamp", "log_id").write.partitionBy(*by).parquet(fresh)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    named = lambda uri: jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
    fs = where(path).getFileSystem(conf)
    for r in spark.read.parquet(fresh).select(F.col("_metadata.file_path").alias("p")).distinct().toLocalIterator():
        new = named(r["p"])
        folder = f"{path}/{new.getParent().getParent().getName()}/{new.getParent().getName()}"
        fs.mkdirs(where(folder))
        if not fs.rename(new, where(f"{folder}/{new.getName()}")):
            raise OSError(f"can't move {r['p']}")
    for r in files.select("_file").toLocalIterator():
        fs.delete(named(r["_file"]), False)
    fs.delete(where(fresh), True)
