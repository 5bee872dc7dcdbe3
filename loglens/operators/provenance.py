"""Process lineage, edges and their frequencies; scored, diffused and reconnected trees.

Events have tenant_id, timestamp, log_id, category, process_guid, parent_guid, image, parent_image,
computer_name and one target column for each kind of event. Processes are known by their id within a
tenant, and baselines are a tenant's own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.transforms import abstract_domain, abstract_ip, abstract_path
from ..plans.shared import written
from .graph import tree_ids

#: Hosts counted of one target; one that has so many is common.
HOSTS = 256
#: kind of edge -> (category of event, target column, abstraction)
KINDS = {
    "spawn": ("process_creation", "image", abstract_path),
    "file_write": ("file_write", "target_file", abstract_path),
    "net_connect": ("network_connect", "dst_ip", abstract_ip),
    "dns_query": ("dns_query", "query", abstract_domain),
    "remote_thread": ("remote_thread", "target_image", abstract_path),
    "process_access": ("process_access", "target_image", abstract_path),
}
# How strong each bridge between trees is.
BRIDGES = {"file": 1.0, "net": 0.85, "dns": 0.85, "injection": 0.95, "access": 0.9}


#: What one side of an edge is known by, within its tenant.
SOURCE = ["tenant_id", "src_image", "event_type"]


def typed(events: DataFrame) -> DataFrame:
    """Events that make an edge, with event_type (its kind), label, target_norm and src_image added.

    Edges and frequencies both read these, so write them once where both are built. All conditions are on
    the events' own columns: each path is abstracted in one expression, and none is repeated in a filter.
    """
    category = F.col("category")
    here = {k: category == c for k, (c, target, _) in KINDS.items() if target in events.columns}
    some = reduce(lambda a, b: a | b, ((h & (F.col(KINDS[k][1]) != "")) for k, h in here.items()))
    choose = lambda of: reduce(lambda out, k: F.when(here[k], of(k)).otherwise(out), here, F.lit(None).cast("string"))
    out = events.where(some).withColumns({"event_type": choose(lambda k: F.lit(k)), "label": choose(lambda k: F.col(KINDS[k][1]))})
    out = out.withColumn("_source", F.when(category == KINDS["spawn"][0], F.col("parent_image")).otherwise(F.col("image")))
    norm = F.lit(None).cast("string")
    for abstract in dict.fromkeys(KINDS[k][2] for k in here):
        norm = F.when(category.isin(*(KINDS[k][0] for k in here if KINDS[k][2] is abstract)), abstract(F.col("label"))).otherwise(norm)
    return out.withColumns({"target_norm": norm, "src_image": abstract_path(F.col("_source"))}).drop("_source")


def _typed(events: DataFrame) -> DataFrame:
    return events if "target_norm" in events.columns else typed(events)


def build_lineage(events: DataFrame) -> DataFrame:
    """One row for each process of a tenant: its creation that was written last."""
    own = events.where("category = 'process_creation' and process_guid <> ''")
    columns = ["timestamp", "log_id", "parent_guid", "image", "parent_image", "computer_name"]
    return own.groupBy("tenant_id", "process_guid").agg(F.max_by(F.struct(*columns), F.struct("timestamp", "log_id")).alias("r")).select("tenant_id", "process_guid", "r.*")


def build_edges(events: DataFrame) -> DataFrame:
    """One row for each process, kind and abstracted target: last event, count, keys of the frequency table.

    A question for a name that looks like an address is left out.
    """
    own = events.where("category <> 'process_creation' and process_guid <> ''")
    if "query" in events.columns:
        own = own.where(~((F.col("category") == "dns_query") & F.col("query").rlike(r"^[0-9.]+$|:")) | F.col("query").isNull())
    own = _typed(own)
    out = own.groupBy("tenant_id", "process_guid", "event_type", F.col("src_image").alias("fkey_src"), F.col("target_norm").alias("fkey_tgt")).agg(
        F.max_by(F.struct("label", "log_id", "computer_name"), F.struct("timestamp", "log_id")).alias("r"), F.max("timestamp").alias("timestamp"), F.count("*").alias("cnt")
    )
    node = F.concat(F.split_part(F.col("event_type"), F.lit("_"), F.lit(1)), F.lit(":"), F.col("fkey_tgt"))
    return out.select("tenant_id", "process_guid", "event_type", node.alias("dst_node"), "fkey_src", "fkey_tgt", "r.label", "r.log_id", "timestamp", "r.computer_name", "cnt")


def build_frequency(events: DataFrame) -> DataFrame:
    """Partials: events for each source, kind, abstracted target, day and host, to be appended and summed."""
    own = _typed(events.where("case when category = 'process_creation' then parent_image else image end <> ''"))
    return own.groupBy(*SOURCE, "target_norm", F.to_date("timestamp").alias("day"), F.col("computer_name").alias("host")).agg(F.count("*").alias("event_count"))


def hosts_of(lineage: DataFrame) -> DataFrame:
    """(tenant_id, all_hosts)"""
    return lineage.groupBy("tenant_id").agg(F.count_distinct("computer_name").alias("all_hosts"))


def spawn_edges(lineage: DataFrame) -> DataFrame:
    return lineage.where("parent_guid <> ''").select("tenant_id", F.col("parent_guid").alias("parent"), F.col("process_guid").alias("child"), F.lit("spawn").alias("event_type"), F.col("image").alias("label"), abstract_path(F.col("parent_image")).alias("fkey_src"), abstract_path(F.col("image")).alias("fkey_tgt"), "log_id", "timestamp")


def leaf_edges(edges: DataFrame) -> DataFrame:
    return edges.select("tenant_id", F.col("process_guid").alias("parent"), F.col("dst_node").alias("child"), "event_type", "label", "fkey_src", "fkey_tgt", "log_id", "timestamp")


def score_edges(edges: DataFrame, frequency: DataFrame, total_hosts: DataFrame) -> DataFrame:
    """Adds anomaly_score. Everything is counted within a tenant; total_hosts is hosts_of() its lineage.

    Spawn: how unusual the child is for its parent, 1 without a baseline. Others: that, or how rare the
    target is among hosts, whichever is larger; without a baseline of the source only the latter. A
    target on HOSTS hosts or more is common, one that was never seen scores 1.

    The frequency table is summed once by host; the totals of pairs, sources and targets are sums of that.
    """
    by_host = frequency.groupBy(*SOURCE, "target_norm", "host").agg(F.sum("event_count").alias("n"))
    pair = by_host.groupBy(*SOURCE, "target_norm").agg(F.sum("n").alias("fe"))
    source = pair.groupBy(*SOURCE).agg(F.sum("fe").alias("ft"))
    target = ["tenant_id", "event_type", "target_norm"]
    spread = by_host.select(*target, "host").distinct().groupBy(*target).agg(F.count("host").alias("hosts"))
    own = edges.withColumnsRenamed({"fkey_src": "src_image", "fkey_tgt": "target_norm"})
    own = own.join(pair, [*SOURCE, "target_norm"], "left").join(source, SOURCE, "left").join(spread, target, "left").join(total_hosts, "tenant_id", "left")
    hosts, ft, every = (F.coalesce(c, F.lit(0)) for c in ("hosts", "ft", "all_hosts"))
    among = F.when((hosts >= HOSTS) | (every == 0), 0.0).otherwise(1 - hosts / every)
    here = F.when(ft > 0, 1 - F.coalesce("fe", F.lit(0)) / ft)
    score = F.when(F.col("event_type") == "spawn", F.coalesce(here, F.lit(1.0))).when(ft == 0, among).otherwise(F.greatest(here, among))
    return own.select(*(c for c in edges.columns if c not in ("fkey_src", "fkey_tgt")), F.round(score, 4).alias("anomaly_score"))


def gate_leaves(scored: DataFrame, threshold: float = 0.7, diffuse: bool = False, floor: float = 0.05, per_process: int = 64) -> DataFrame:
    """All spawn edges, and the others from the threshold; before diffusion, the best of each process from a low floor."""
    spawn, leaves = scored.where("event_type = 'spawn'"), scored.where("event_type <> 'spawn'")
    if not diffuse:
        return spawn.unionByName(leaves.where(F.col("anomaly_score") >= threshold))
    order = Window.partitionBy("tenant_id", "parent").orderBy(F.col("anomaly_score").desc(), "child", "event_type")
    best = leaves.where(F.col("anomaly_score") >= floor).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_process).drop("_r")
    return spawn.unionByName(best)


def surprisal(score: Column) -> Column:
    return -F.log(F.greatest(F.lit(1.0) - score, F.lit(0.01)))


def diffuse(edges: DataFrame, threshold: float = 0.0, decay: float = 0.2, depth: int = 50) -> DataFrame:
    """Scores passed down each tenant's trees: S(v) = surprisal of its spawn edge + decay * S(parent); an
    edge scores 1 - exp(-S) but never less than before. A job for each level; nodes count once."""
    spawn = edges.where("event_type = 'spawn' and parent <> '' and child <> ''")
    spawn = written(spawn.groupBy("tenant_id", "child").agg(F.min_by(F.struct("parent", "anomaly_score"), F.struct("parent")).alias("r")).select("tenant_id", "child", "r.*"), "spawn")
    roots = spawn.select("tenant_id", F.col("parent").alias("node")).distinct().join(spawn.select("tenant_id", F.col("child").alias("node")), ["tenant_id", "node"], "left_anti").withColumn("s", F.lit(0.0))
    level = written(roots, "sums")
    sums = level
    for _ in range(depth):
        step = spawn.join(level.select("tenant_id", F.col("node").alias("parent"), "s"), ["tenant_id", "parent"]).select("tenant_id", F.col("child").alias("node"), (surprisal(F.col("anomaly_score")) + decay * F.col("s")).alias("s"))
        level = written(step, "sums")
        if level.isEmpty():
            break
        sums = sums.unionByName(level)
    own = edges.withColumn("_at", F.when(F.col("event_type") == "spawn", F.col("child")).otherwise(F.col("parent")))
    own = own.join(sums.select("tenant_id", F.col("node").alias("_at"), F.col("s").alias("_s")), ["tenant_id", "_at"], "left").withColumn("_s", F.coalesce("_s", F.lit(0.0)))
    total = F.when(F.col("event_type") == "spawn", F.col("_s")).otherwise(surprisal(F.col("anomaly_score")) + decay * F.col("_s"))
    score = F.round(F.greatest(1 - F.exp(-total), "anomaly_score"), 4)
    return own.withColumn("anomaly_score", score).select(*edges.columns).where((F.col("event_type") == "spawn") | (F.col("anomaly_score") >= threshold))


def rare_targets(frequency: DataFrame, kind: str) -> DataFrame:
    """(tenant_id, target_norm): targets of few hosts and few images of their tenant, at most max(3, half
    the hosts) and max(4, a tenth of the images)."""
    totals = frequency.groupBy("tenant_id").agg(F.count_distinct("host").alias("h"), F.count_distinct("src_image").alias("i"))
    by = frequency.where(F.col("event_type") == kind).groupBy("tenant_id", "target_norm").agg(F.count_distinct("host").alias("hosts"), F.count_distinct("src_image").alias("images"))
    return by.join(totals, "tenant_id").where("hosts <= greatest(3, floor(0.5 * h)) and images <= greatest(4, floor(0.1 * i))").select("tenant_id", "target_norm")


def _trees(df: DataFrame) -> list[str]:
    """What tells trees apart: the tenant, and the seed where the rows have one."""
    return ["tenant_id", *(["start"] if "start" in df.columns else [])]


def _best(peers: DataFrame, trees: list[str], most: int | None, order: list[Column]) -> DataFrame:
    """The first peers of each tree (all with None). Spark drops the others of a task before it shuffles."""
    if most is None:
        return peers
    place = F.row_number().over(Window.partitionBy(*trees).orderBy(*order, "peer_guid"))
    return peers.withColumn("_r", place).where(F.col("_r") <= most).drop("_r")


def _ranked(met: DataFrame, trees: list[str], most: int | None) -> DataFrame:
    """The best peers of each tree: by distinct shared artifacts, then anomaly, then id."""
    peers = met.groupBy(*trees, "peer_guid").agg(F.count_distinct("object_id").alias("n"), F.max("anomaly").alias("best"))
    return _best(peers, trees, most, [F.col("n").desc(), F.col("best").desc()]).select(*trees, "peer_guid")


def reconnect(tree: DataFrame, edges: DataFrame, lineage: DataFrame, frequency: DataFrame, most: int | None = None) -> DataFrame:
    """(tenant_id, recon_type, src_guid, peer_guid, object_id, label, anomaly), with start if tree has it: other processes of the same
    tenant that share a rare artifact.

    tree has tenant_id and process_guid, and perhaps start, the seed of a process's tree. Files written by the tree and executed elsewhere, rare addresses
    and domains that both ask for, and processes into which the tree injected or which it opened.

    With most, only the best so many peers of each tree are paired with their sources, as by rank_peers(): they are
    ranked by the artifacts that a tree has, each taken once, so runs of a common image never meet all sources.
    """
    trees = _trees(tree)
    inside = tree.select(*trees, "process_guid").distinct()
    own = edges.join(inside, ["tenant_id", "process_guid"])
    of = lambda kind: own.where(F.col("event_type") == kind)
    made = lambda df, name, by, key, thing: df.select(*trees, F.lit(name).alias("recon_type"), F.lit(by).alias("_by"), key.alias("_key"), F.col("process_guid").alias("src_guid"), thing.alias("object_id"), "label")
    path = F.lower("label")
    mine = [made(of("file_write"), "file", "run", path, F.concat(F.lit("file:"), path))]
    mine += [made(of(kind), name, "run", path, F.col("dst_node")) for name, kind in (("injection", "remote_thread"), ("access", "process_access"))]
    theirs = [lineage.select("tenant_id", F.lit("run").alias("_by"), F.lower("image").alias("_key"), F.col("process_guid").alias("peer_guid"))]
    for name, kind in (("net", "net_connect"), ("dns", "dns_query")):
        rare = rare_targets(frequency, kind).withColumnRenamed("target_norm", "fkey_tgt")
        few = of(kind).join(rare, ["tenant_id", "fkey_tgt"], "left_semi").where(~F.col("fkey_tgt").rlike(r"^internal$|/24$|\.(local|lan|internal)$"))
        mine.append(made(few, name, name, F.col("dst_node"), F.col("dst_node")))
        theirs.append(edges.where(F.col("event_type") == kind).select("tenant_id", F.lit(name).alias("_by"), F.col("dst_node").alias("_key"), F.col("process_guid").alias("peer_guid")))
    strength = F.create_map(*(F.lit(x) for pair in BRIDGES.items() for x in pair))
    mine = reduce(DataFrame.unionByName, mine).distinct().withColumn("anomaly", strength[F.col("recon_type")])
    theirs = reduce(DataFrame.unionByName, theirs).distinct()
    on = ["tenant_id", "_by", "_key"]
    outside = lambda df: df.join(inside.withColumnRenamed("process_guid", "peer_guid"), [*trees, "peer_guid"], "left_anti")
    columns = [*trees, "recon_type", "src_guid", "peer_guid", "object_id", "label", "anomaly"]
    if most is None:
        return outside(mine.join(theirs, on)).select(*columns)
    things = mine.select(*trees, "_by", "_key", "object_id", "anomaly").distinct()
    best = written(_ranked(outside(things.join(theirs, on)), trees, most), "peers")
    return mine.join(theirs.join(best, ["tenant_id", "peer_guid"]), [*on, *trees[1:]]).select(*columns)


def rank_peers(peers: DataFrame, most: int | None = 50) -> DataFrame:
    """All rows of the best peers of each tree (tenant, and start if there is one): by distinct shared artifacts, then anomaly, then id."""
    trees = _trees(peers)
    return peers.join(_ranked(peers, trees, most), [*trees, "peer_guid"], "left_semi").select(*peers.columns)


def bridge_edges(peers: DataFrame) -> DataFrame:
    """Edges that join peers to the tree: both ends to a shared object, or the writer to the executor."""
    end = lambda rows, a, b: rows.select("tenant_id", F.col(a).alias("parent"), F.col(b).alias("child"), "recon_type", "label", "anomaly")
    shared = peers.where(F.col("recon_type").isin("net", "dns"))
    direct = peers.where(~F.col("recon_type").isin("net", "dns"))
    ends = end(shared, "src_guid", "object_id").unionByName(end(shared, "peer_guid", "object_id")).unionByName(end(direct, "src_guid", "peer_guid"))
    return ends.groupBy("tenant_id", "parent", "child", "recon_type").agg(F.min("label").alias("label"), F.max("anomaly").alias("anomaly_score"))


def expandable(peers: DataFrame, most: int | None = 5, least: float = 0.8) -> DataFrame:
    """(tenant_id, start): the peers over the strongest bridges of each tree, whose own trees are worth adding."""
    trees = _trees(peers)
    strong = peers.groupBy(*trees, "peer_guid").agg(F.max("anomaly").alias("best")).where(F.col("best") >= least)
    return _best(strong, trees, most, [F.col("best").desc()]).select("tenant_id", F.col("peer_guid").alias("start")).distinct()


def expand_tree(lineage: DataFrame, tree: DataFrame, peers: DataFrame, most: int | None = 5, depth: int = 3, cap: int | None = None) -> DataFrame:
    """(tenant_id, process_guid): the trees and what the best peers of each started. A cap, if given, keeps those nearest to their roots."""
    more = tree_ids(lineage, "process_guid", "parent_guid", expandable(peers, most), depth, scope=["tenant_id"])
    ids = tree.select("tenant_id", "process_guid", F.lit(0).alias("depth")).unionByName(more.select("tenant_id", F.col("id").alias("process_guid"), "depth"))
    ids = ids.groupBy("tenant_id", "process_guid").agg(F.min("depth").alias("depth"))
    return (ids if cap is None else ids.orderBy("depth", "tenant_id", "process_guid").limit(cap)).select("tenant_id", "process_guid")


def provenance(events: DataFrame, seeds: DataFrame, depth: int = 10, threshold: float = 0.7, decay: float = 0.2, peers: int | None = 50, expand: int | None = 5, cap: int | None = None, most: int | None = None) -> DataFrame:
    """The scored edges of the trees of the seeds (tenant_id, start), of their strongest peers, and the bridges.

    peers and expand are limits of each seed's tree (None: no limit). cap bounds the processes of the trees and most the edges; with most, spawn edges come first, then the
    highest scores. These two are None unless asked for: then nothing is cut.
    """
    events = written(typed(events), "typed")
    lineage, edges, freq = written(build_lineage(events), "lineage"), written(build_edges(events), "edges"), written(build_frequency(events), "frequency")
    ids = written(tree_ids(lineage, "process_guid", "parent_guid", seeds, depth, "both", cap, ["tenant_id"], by_seed=True).withColumnRenamed("id", "process_guid"), "trees")
    found = written(reconnect(ids, edges, lineage, freq, peers), "peers")
    ids = written(expand_tree(lineage, ids, found, expand, cap=cap), "tree")
    spawn = spawn_edges(lineage).join(ids.withColumnRenamed("process_guid", "child"), ["tenant_id", "child"], "left_semi")
    leaves = leaf_edges(edges).join(ids.withColumnRenamed("process_guid", "parent"), ["tenant_id", "parent"], "left_semi")
    scored = score_edges(spawn.unionByName(leaves.select(spawn.columns)), freq, hosts_of(lineage))
    columns = ["tenant_id", "parent", "child", "event_type", "label", "anomaly_score"]
    out = diffuse(gate_leaves(scored, threshold, diffuse=True), threshold, decay).select(*columns)
    out = out.unionByName(bridge_edges(found).withColumnRenamed("recon_type", "event_type").select(*columns))
    if most is None:
        return out
    return out.orderBy(F.col("event_type") != "spawn", F.col("anomaly_score").desc(), "tenant_id", "parent", "child", "event_type").limit(most)
