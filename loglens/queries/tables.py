"""The given tables, and log rows derived from them by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log rows: tenants from users, fields from the other columns, an address from the user."""
    e = events(spark, sf_dir)
    ip = F.concat(F.lit("10."), F.col("user_id") % 4, F.lit("."), F.col("user_id") % 200, F.lit("."), F.col("event_id") % 250)
    fields = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("action"), F.col("event_type"), F.lit("src_ip"), ip)
    return e.select(F.col("ts").alias("timestamp"), F.col("ts").alias("ingest_timestamp"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("log_id"), F.concat(F.lit("t"), F.col("user_id") % 3).alias("tenant_id"), "event_id", "user_id", "event_type", "value", ip.alias("src_ip"), fields.alias("fields"), F.to_date("ts").alias("event_date"), F.to_date("ts").alias("ingest_date"))


def process_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as process telemetry: half start processes under earlier ones, the others touch files, addresses and names.

    Each tree is a tenant's own."""
    e = events(spark, sf_dir)
    n, user = F.col("event_id"), F.col("user_id")
    kind = F.element_at(F.array(*(F.lit(k) for k in ("process_creation", "file_write", "process_creation", "network_connect", "process_creation", "dns_query", "process_creation", "process_access", "process_creation", "remote_thread"))), (n % 10 + 1).cast("int"))
    image = lambda x: F.concat(F.lit("C:\\Users\\u"), user % 7, F.lit("\\app"), x % 13, F.lit(".exe"))
    even = n - n % 2
    return e.select(
        F.concat(F.lit("t"), F.substring(F.conv(F.floor(n / 2).cast("string"), 10, 3), 1, 1)).alias("tenant_id"), F.col("ts").alias("timestamp"), F.lpad(n.cast("string"), 12, "0").alias("log_id"), kind.alias("category"),
        F.concat(F.lit("p"), even).alias("process_guid"), F.when(n >= 6, F.concat(F.lit("p"), F.floor(n / 6).cast("long") * 2)).otherwise("").alias("parent_guid"),
        image(even).alias("image"), image(F.floor(n / 6) * 2).alias("parent_image"), F.concat(F.lit("host"), user % 5).alias("computer_name"),
        image(n + 1).alias("target_file"), F.concat(F.lit("93.184."), n % 5, F.lit("."), user % 9).alias("dst_ip"), F.concat(F.lit("d"), n % 40, F.lit(".example.com.")).alias("query"), image(n + 3).alias("target_image"),
    )


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as connections: suppliers to a few destinations, with bytes and seconds."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(F.col("l_suppkey").cast("string").alias("src"), (F.col("l_partkey") % 50).cast("string").alias("dst"), F.lit("443").alias("port"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("size"), (F.col("l_quantity") * 60).alias("duration"))
