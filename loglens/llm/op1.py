"""Chat formatting with collapse of cumulative snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import table

#: Turns of a conversation that one window orders.
SPAN = 256


def light(turns: DataFrame) -> DataFrame:
    """(conv, span, turn, role, tie, a, b): turns without their texts, of which (a, b) are hashes with the role.

    tie is the text where another turn has the same conversation, number and role, so that the text decides
    the order, else null.
    """
    keys = ["conv", "turn", "role"]
    ties = table(turns.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), "ties")  # read from a table, its size is known
    on = F.expr(" and ".join(f"l.{k} <=> r.{k}" for k in keys))
    own = turns.alias("l").join(ties.alias("r"), on, "left").select("l.*", F.when(F.col("r.n").isNotNull(), F.col("l.text")).alias("tie"))
    content = [F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), F.col("role").isNull(), F.col("text").isNull()]
    return own.select("conv", F.floor(F.col("turn") / SPAN).alias("span"), "turn", "role", "tie", F.xxhash64(F.lit(11), *content).alias("a"), F.xxhash64(F.lit(13), *content).alias("b"))


def prefix_hashes(own: DataFrame) -> DataFrame:
    """(conv, k, p, q) of light() turns: k counts a conversation's turns, (p, q) identifies its first k.

    A turn's hash covers its place, role and text, and a prefix is the sum of its turns' hashes, so it
    rolls along as a running sum. Places and sums are built over spans of turn numbers and then over
    the spans, so that a long conversation isn't one group.
    """
    inside = Window.partitionBy("conv", "span").orderBy(*(F.col(c).asc_nulls_first() for c in ("turn", "role", "tie")))
    across = Window.partitionBy("conv").orderBy(F.col("span").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    ordered = table(own.select("conv", "span", F.row_number().over(inside).alias("i"), "a", "b"), "turns")
    sizes = ordered.groupBy("conv", "span").agg(F.max("i").alias("m")).withColumn("base", F.coalesce(F.sum("m").over(across), F.lit(0))).drop("m")
    on = F.expr("l.conv <=> r.conv and l.span <=> r.span")
    placed = ordered.alias("l").join(sizes.alias("r"), on).select("l.*", (F.col("l.i") + F.col("r.base")).alias("k"))
    # halves of the hashes, so that sums of any length stay exact
    for name, seed in (("p", 17), ("q", 19)):
        placed = placed.withColumn(name, F.pmod(F.xxhash64(F.lit(seed), "k", "a", "b"), F.lit(1 << 40)))
    run = Window.partitionBy("conv", "span").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    placed = table(placed.select("conv", "span", "k", *(F.sum(c).over(run).alias(c) for c in ("p", "q"))), "sums")
    totals = placed.groupBy("conv", "span").agg(F.max_by("p", "k").alias("sp"), F.max_by("q", "k").alias("sq"))
    totals = totals.select("conv", "span", *(F.coalesce(F.sum(s).over(across), F.lit(0)).alias(s) for s in ("sp", "sq"))).where("sp > 0 or sq > 0")
    out = placed.alias("l").join(table(totals, "totals").alias("r"), on, "left")  # only conversations of several spans
    return out.select("l.conv", "l.k", (F.col("l.p") + F.coalesce("r.sp", F.lit(0))).alias("p"), (F.col("l.q") + F.coalesce("r.sq", F.lit(0))).alias("q"))


def collapse(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, n_turns, rendered): each maximal logged conversation, rendered as one chat text.

    A log that stores a conversation again at each step holds prefixes of the longest version. A
    conversation whose turns, in order, begin a longer one is dropped; of equal ones, the smallest id
    stays. Turns are ordered by number, then role, then text (nulls first), so ties and repeated rows
    have one order; a null role or text differs from an empty one but is rendered as one; rows with a
    null conversation form one conversation. Other columns are not read.

    Hashes of whole conversations meet the distinct hashes of proper prefixes in an anti-join: the
    prefix side holds a common beginning once, whatever the number of conversations that share it. Only
    hashes and numbers pass through windows and joins; texts move once, those of the conversations kept.
    """
    own = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    hashed = table(prefix_hashes(light(own)), "prefixes")
    whole = hashed.groupBy("conv").agg(F.max(F.struct("k", "p", "q")).alias("w")).select("conv", F.col("w.k").alias("n"), "w.p", "w.q")
    unique = whole.groupBy("n", "p", "q").agg(F.min("conv").alias("conv"), F.count("*").alias("same"))
    # more conversations have it than end with it
    proper = unique.join(hashed.groupBy(F.col("k").alias("n"), "p", "q").agg(F.count("*").alias("having")), ["n", "p", "q"]).where("having > same")
    kept = unique.join(proper.select("n", "p", "q"), ["n", "p", "q"], "left_anti").select("conv")
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    shown = own.alias("h").join(table(kept, "kept").alias("w"), F.expr("h.conv <=> w.conv"), "left_semi")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))), lambda x: x["line"]), "")
    return shown.groupBy("conv").agg(F.count("*").alias("n_turns"), text.alias("rendered")).withColumnRenamed("conv", conv_col)


def op1_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = """
WITH ordered AS (
  SELECT conv_id, role, text, row_number() OVER w AS k FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
), rolled AS (
  SELECT conv_id, role, text, k, string_agg(coalesce(role, chr(1)) || chr(2) || coalesce(text, chr(1)), chr(3)) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS p,
    count(*) OVER (PARTITION BY conv_id) AS n FROM ordered
), whole AS (SELECT min(conv_id) AS conv_id, n, p FROM rolled WHERE k = n GROUP BY n, p),
proper AS (SELECT DISTINCT k, p FROM rolled WHERE k < n),
kept AS (SELECT conv_id FROM whole WHERE NOT EXISTS (SELECT 1 FROM proper WHERE proper.k = whole.n AND proper.p = whole.p))
SELECT conv_id, max(n) AS n_turns, string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY k) AS rendered
FROM rolled WHERE conv_id IN (SELECT conv_id FROM kept) GROUP BY conv_id
"""
