"""Traversal of parent/child rows: a job for each level, with the frontier as a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import written


def descend(df: DataFrame, child: str, parent: str, seeds: DataFrame, depth: int = 10, include: list[str] | None = None) -> DataFrame:
    """(child, parent, include..., _depth, _path): all paths from the seeds (one column, start) down.

    No node is remembered: one that is reached on several paths repeats, and cycles end at the depth.
    The level's join picks its own strategy from the size of the frontier, which was just written.
    """
    columns = include or []
    rows = df.select(F.col(child).alias("_child"), F.col(parent).alias("_parent"), *columns)
    first = rows.join(seeds.select(F.col("start").alias("_child")).distinct(), "_child").withColumns({"_depth": F.lit(0), "_path": F.col("_child").cast("string")})
    level = written(first, "level")
    levels = [level]
    for d in range(1, depth + 1):
        front = level.select(F.col("_child").alias("_up"), F.col("_path").alias("_before"))
        step = rows.join(front, F.col("_parent") == F.col("_up")).withColumns({"_depth": F.lit(d), "_path": F.concat_ws(" > ", "_before", F.col("_child").cast("string"))}).drop("_up", "_before")
        level = written(step, "level")
        if level.isEmpty():
            break
        levels.append(level)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.select(F.col("_child").alias(child), F.col("_parent").alias(parent), *columns, "_depth", "_path")


def bfs(df: DataFrame, child: str, parent: str, seeds: DataFrame, depth: int = 10, include: list[str] | None = None, time: str | None = None) -> DataFrame:
    """descend(), by depth and then by time, if there is one among the included columns, and path."""
    return descend(df, child, parent, seeds, depth, include).orderBy("_depth", *([time] if time else []), "_path")


def dfs(df: DataFrame, child: str, parent: str, seeds: DataFrame, depth: int = 10, include: list[str] | None = None) -> DataFrame:
    return descend(df, child, parent, seeds, depth, include).orderBy("_path")


def tree_ids(df: DataFrame, child: str, parent: str, seeds: DataFrame, depth: int = 10, direction: str = "forward", cap: int | None = None, scope: list[str] | None = None, by_seed: bool = False) -> DataFrame:
    """(scope..., id, depth): distinct nodes reached from the seeds (scope..., start) that exist, with their smallest depth.

    With by_seed, trees are told apart: a node is given with the start of each seed that reaches it.

    scope are columns within which ids are unique, such as a tenant; edges don't leave it. An anti-join
    with what was visited keeps every node once; a cap stops after the level that passes it.
    """
    scope = scope or []
    exists, node = [*scope, "id"], [*scope, *(["start"] if by_seed else []), "id"]
    tree = node[:-1]
    edges = df.select(*scope, F.col(parent).alias("a"), F.col(child).alias("b")).where("a is not null and b is not null")
    steps = {"forward": [edges], "backward": [edges.select(*scope, F.col("b").alias("a"), F.col("a").alias("b"))]}
    steps["both"] = steps["forward"] + steps["backward"]
    parts = []
    for step in steps[direction]:
        known = df.select(*scope, F.col(child).alias("id"))
        visited = written(seeds.select(*tree, F.col("start").alias("id")).distinct().join(known, exists, "left_semi").withColumn("depth", F.lit(0)), "visited")
        front, count = visited, visited.count() if cap is not None else 0
        for d in range(1, depth + 1):
            new = step.join(front.select(*tree, F.col("id").alias("a")), [*scope, "a"]).select(*tree, F.col("b").alias("id")).distinct()
            front = written(new.join(visited.select(*node), node, "left_anti").join(known, exists, "left_semi").withColumn("depth", F.lit(d)), "front")
            if front.isEmpty():
                break
            visited = visited.unionByName(front)
            if cap is not None and (count := count + front.count()) >= cap:
                break
        parts.append(visited)
    out = reduce(DataFrame.unionByName, parts).groupBy(*node).agg(F.min("depth").alias("depth"))
    return out if cap is None else out.orderBy("depth", *node).limit(cap)


def jump_table(df: DataFrame, child: str, parent: str, depth: int = 50, scope: list[str] | None = None) -> DataFrame:
    """(scope..., k, id, up): the ancestors 2^k generations above each node, for 2^k up to the depth; made once, it serves all searches.

    A doubling joins the last generation with itself, so 50 levels take six tables of at most a row for each node. A node with
    several parents has a row for each ancestor. Nodes of a cycle are their own ancestors. Null ids and parents have no rows.
    """
    scope = scope or []
    step = written(df.select(*scope, F.col(child).alias("id"), F.col(parent).alias("up")).where("id is not null and up is not null").distinct(), "jumps")
    parts, k = [step.withColumn("k", F.lit(0))], 1
    while 2**k <= depth:
        half = step.select(*scope, F.col("id").alias("up"), F.col("up").alias("above"))
        step = written(step.join(half, [*scope, "up"]).select(*scope, "id", F.col("above").alias("up")).distinct(), "jumps")
        if step.isEmpty():
            break
        parts.append(step.withColumn("k", F.lit(k)))
        k += 1
    return reduce(DataFrame.unionByName, parts).select(*scope, "k", "id", "up")


def tree_ids_by_jumps(df: DataFrame, child: str, jumps: DataFrame, seeds: DataFrame, depth: int = 50, direction: str = "forward", scope: list[str] | None = None, by_seed: bool = False) -> DataFrame:
    """The rows of tree_ids() without a cap, by joins that grow with the logarithm of the depth.

    jumps are jump_table()'s for this depth or a greater one. What is reached within 2^k generations, taken 2^k further, is what is
    reached within twice as many; the smallest depth of a node stays, so cycles end.
    """
    scope = scope or []
    tree = [*scope, *(["start"] if by_seed else [])]
    node = [*tree, "id"]
    known = df.select(*scope, F.col(child).alias("id"))
    parts = []
    for way in ("forward", "backward") if direction == "both" else (direction,):
        a, b = ("up", "id") if way == "forward" else ("id", "up")
        reach = written(seeds.select(*tree, F.col("start").alias("id")).distinct().join(known, [*scope, "id"], "left_semi").withColumn("depth", F.lit(0)), "reach")
        for k in range(depth.bit_length()):
            step = jumps.where(F.col("k") == k).select(*scope, F.col(a).alias("_at"), F.col(b).alias("_to"))
            further = reach.withColumnRenamed("id", "_at").join(step, [*scope, "_at"]).select(*tree, F.col("_to").alias("id"), (F.col("depth") + 2**k).alias("depth")).where(F.col("depth") <= depth)
            reach = written(reach.unionByName(further).groupBy(*node).agg(F.min("depth").alias("depth")), "reach")
        parts.append(reach)
    out = reduce(DataFrame.unionByName, parts).groupBy(*node).agg(F.min("depth").alias("depth"))
    return out.join(known, [*scope, "id"], "left_semi").select(*node, "depth")


def process_tree(df: DataFrame, child: str, parent: str, seeds: DataFrame, depth: int = 10, direction: str = "both", scope: list[str] | None = None) -> DataFrame:
    """Rows of the nodes below (forward), above (backward) or both, each once."""
    ids = tree_ids(df, child, parent, seeds, depth, direction, scope=scope)
    return df.join(ids.withColumnsRenamed({"id": child, "depth": "_depth"}), [*(scope or []), child])
