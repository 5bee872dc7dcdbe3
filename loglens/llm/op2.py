"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import table

WEIGHTS = (5, 2, 1)
#: A target stops at so many times its source's size, and a document is taken so often at most.
MOST = 3
#: Documents that one salt of one source and size class has at most, about, if all are of that source and class.
SALTED = 200_000
#: Size classes: so many to each factor of e.
CLASSES = 32


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target): shares by weight, none above MOST times its source's size.

    Sources above their limit get it; the others share the rest by weight, however often that pushes
    another over: sorted by limit over weight, those above come first, so one running sum finds them.
    One row for each source goes through one window; documents don't.
    """
    own = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    own = own.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    own = own.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("limit", F.col("source_size") * float(MOST))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before, rest, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    own = own.withColumn("level", level).withColumn("over", F.col("level") * F.col("weight") > F.col("limit"))
    rate = F.max(F.when(~F.col("over"), F.col("level"))).over(whole)
    return own.select("source", "source_size", F.when(F.col("over"), F.col("limit")).otherwise(F.least("limit", rate * F.col("weight"))).alias("target"))


def sample(docs: DataFrame, size: str | Column, source: str, key: str, weights: tuple[int, ...] = WEIGHTS, seed: int = 1) -> DataFrame:
    """docs with source_size, target and copies (0 to MOST) added; columns of these names are replaced.

    Within a source every document expects target / source_size copies. Running over the source's
    documents by rising size, the expected copies are summed up, one offset from the seed is added, and
    a document gets a copy for each whole number that the sum passes. As the order is by size, what is
    taken strays from the target by about one document at most. Sums are exact: a document adds target,
    in whole words, to a decimal, and source_size of those are a copy.

    The sum is built in three levels, so no window holds more than one salt of one size class: counts
    of (source, size class, salt) are a small table, and documents are dealt by that key. There are as many
    salts as the rows need. Null sources are one source; null keys and equal keys or sizes get their place
    by a hash of the whole row, so they are split, too; sources without words get no copies; an empty table
    gives an empty one.
    """
    size = F.col(size) if isinstance(size, str) else size
    salts = max(16, -(-docs.count() // SALTED))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    content = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    keyed = docs.select(row.alias("_row"), size.alias("_size"), F.col(key).alias("_key"), F.coalesce(F.col(source), F.lit("")).alias("_s"), F.col(source).isNull().alias("_null"), F.pmod(F.xxhash64(F.lit(seed), *content), F.lit(salts)).alias("_salt"))
    keyed = keyed.withColumn("_class", F.floor(F.log(F.col("_size") + 1.0) * CLASSES))
    cells = table(keyed.groupBy("_null", "_s", "_class", "_salt").agg(F.count("*").alias("n"), F.sum("_size").alias("w")), "cells")
    want = targets(cells.select(F.when(~F.col("_null"), F.col("_s")).alias("source"), F.col("w").alias("size")), weights)
    want = want.select(F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_s"), "source_size", "target")
    want = want.withColumn("_words", F.least(F.floor(F.col("target") + 0.5), MOST * F.col("source_size")).cast("decimal(18,0)"))

    within = Window.partitionBy("_null", "_s", "_class").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("_null", "_s").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    classes = cells.groupBy("_null", "_s", "_class").agg(F.sum("n").alias("n")).withColumn("_base", F.coalesce(F.sum("n").over(across), F.lit(0))).drop("n")
    cells = cells.withColumn("_in", F.coalesce(F.sum("n").over(within), F.lit(0))).join(classes, ["_null", "_s", "_class"]).join(want, ["_null", "_s"])
    cells = cells.select("_null", "_s", "_class", "_salt", "source_size", "target", "_words", (F.col("_base") + F.col("_in")).alias("_before"))

    cell = ["_null", "_s", "_class", "_salt"]
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("_size", "_key"))
    offset = F.when(F.col("source_size") > 0, F.pmod(F.xxhash64(F.lit(seed)), F.col("source_size")))
    passed = lambda i: F.expr(f"coalesce((cast({i} as decimal(18,0)) * _words + _offset) div nullif(cast(source_size as decimal(18,0)), 0), 0)")
    out = keyed.withColumn("_i", place).join(cells, cell).withColumn("_i", F.col("_i") + F.col("_before")).withColumn("_offset", offset)
    own = [f"_row.`{c}`" for c in docs.columns if c not in ("source_size", "target", "copies")]
    return out.select(*own, "source_size", "target", (passed("_i") - passed("_i - 1")).alias("copies"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, seed: int = 1) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it, with the columns of docs."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(source).alias("_source"), F.col(key).alias("_id"), n_words(F.col(text)).alias("_words"))
    out = sample(row, "_words", "_source", "_id", weights, seed).where("copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = table(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sized")
    out = sample(sized, "size", "source", "doc_id")
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
