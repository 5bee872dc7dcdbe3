"""Queries over graphs, provenance, baselines, archive files and streams, with their oracles."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from ..operators import enrich, graph, models
from ..operators import provenance as pv
from ..plans.shared import folder, written
from ..sources import archive
from ..streaming import jobs
from .tables import connections, events, logs, process_events

Q: dict = {}
O: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


def _tree(spark, d):
    return events(spark, d).select("event_id", F.when(F.col("event_id") > 0, F.floor(F.col("event_id") / 3)).cast("long").alias("parent_id"), "event_type")


def _seeds(df):
    return df.select(F.col("event_id").alias("start"))


WALK = """WITH RECURSIVE e AS (SELECT event_id, event_type, CASE WHEN event_id > 0 THEN event_id // 3 END AS parent_id FROM events),
walk AS (SELECT event_id, parent_id, 0 AS _depth, CAST(event_id AS VARCHAR) AS _path FROM e WHERE event_type = 'error'
 UNION ALL SELECT e.event_id, e.parent_id, _depth + 1, _path || ' > ' || e.event_id FROM walk JOIN e ON e.parent_id = walk.event_id WHERE _depth < 2)
SELECT * FROM walk"""


@query("t1_bfs", WALK)
def bfs(spark, d):
    e = _tree(spark, d)
    return graph.bfs(e, "event_id", "parent_id", _seeds(e.where("event_type = 'error'")), 2)


@query("t1_dfs", WALK)
def dfs(spark, d):
    e = _tree(spark, d)
    return graph.dfs(e, "event_id", "parent_id", _seeds(e.where("event_type = 'error'")), 2)


@query("t2_process_tree", """WITH RECURSIVE e AS (SELECT event_id, event_type, CASE WHEN event_id > 0 THEN event_id // 3 END AS parent_id FROM events),
down AS (SELECT event_id, 0 AS k FROM e WHERE event_type = 'error' UNION ALL SELECT e.event_id, k + 1 FROM down JOIN e ON e.parent_id = down.event_id WHERE k < 3),
up AS (SELECT event_id, parent_id, 0 AS k FROM e WHERE event_type = 'error' UNION ALL SELECT e.event_id, e.parent_id, k + 1 FROM up JOIN e ON e.event_id = up.parent_id WHERE k < 3)
SELECT event_id, min(k) AS _depth FROM (SELECT event_id, k FROM down UNION ALL SELECT event_id, k FROM up) GROUP BY 1""")
def process_tree(spark, d):
    e = _tree(spark, d)
    return graph.process_tree(e, "event_id", "parent_id", _seeds(e.where("event_type = 'error'")), 3).select("event_id", "_depth")


@query("v1_tree_ids", """WITH RECURSIVE e AS (SELECT event_id, event_type, CASE WHEN event_id > 0 THEN event_id // 3 END AS parent_id FROM events),
down AS (SELECT event_id, 0 AS k FROM e WHERE event_type = 'error' UNION ALL SELECT e.event_id, k + 1 FROM down JOIN e ON e.parent_id = down.event_id WHERE k < 6)
SELECT event_id AS id, min(k) AS depth FROM down GROUP BY 1""")
def tree_ids(spark, d):
    e = _tree(spark, d)
    return graph.tree_ids(e, "event_id", "parent_id", _seeds(e.where("event_type = 'error'")), 6)


@query("v1_tree_by_jumps", """WITH RECURSIVE e AS (SELECT event_id, event_type, CASE WHEN event_id > 0 THEN event_id // 3 END AS parent_id FROM events),
down AS (SELECT event_id, 0 AS k FROM e WHERE event_type = 'error' UNION ALL SELECT e.event_id, k + 1 FROM down JOIN e ON e.parent_id = down.event_id WHERE k < 50),
up AS (SELECT event_id, parent_id, 0 AS k FROM e WHERE event_type = 'error' UNION SELECT e.event_id, e.parent_id, k + 1 FROM up JOIN e ON e.event_id = up.parent_id WHERE k < 50)
SELECT event_id AS id, min(k) AS depth FROM (SELECT event_id, k FROM down UNION ALL SELECT event_id, k FROM up) GROUP BY 1""")
def tree_by_jumps(spark, d):
    e = _tree(spark, d)
    return graph.tree_ids_by_jumps(e, "event_id", graph.jump_table(e, "event_id", "parent_id"), _seeds(e.where("event_type = 'error'")), direction="both")


IMAGE = lambda x: f"'c:\\users\\*\\app' || (({x}) % 13) || '.exe'"
RAW = lambda x: f"'C:\\Users\\u' || (user_id % 7) || '\\app' || (({x}) % 13) || '.exe'"
PROC = f"""
k AS (SELECT *, CASE event_id % 10 WHEN 1 THEN 'file_write' WHEN 3 THEN 'net_connect' WHEN 5 THEN 'dns_query' WHEN 7 THEN 'process_access' WHEN 9 THEN 'remote_thread' ELSE 'spawn' END AS event_type_ FROM events),
x AS (SELECT 't' || to_base(event_id // 2, 3)[1] AS tenant_id, event_id, ts, 'host' || (user_id % 5) AS host, event_type_ AS event_type, 'p' || (event_id - event_id % 2) AS guid, CASE WHEN event_id >= 6 THEN 'p' || ((event_id // 6) * 2) ELSE '' END AS parent,
 CASE WHEN event_type_ = 'spawn' THEN {IMAGE("(event_id // 6) * 2")} ELSE {IMAGE("event_id - event_id % 2")} END AS src_image,
 CASE event_type_ WHEN 'spawn' THEN {IMAGE("event_id - event_id % 2")} WHEN 'file_write' THEN {IMAGE("event_id + 1")} WHEN 'net_connect' THEN '93.184.' || (event_id % 5) || '.' || (user_id % 9) WHEN 'dns_query' THEN 'd' || (event_id % 40) || '.example.com' ELSE {IMAGE("event_id + 3")} END AS target_norm,
 CASE event_type_ WHEN 'spawn' THEN {RAW("event_id - event_id % 2")} WHEN 'file_write' THEN {RAW("event_id + 1")} WHEN 'net_connect' THEN '93.184.' || (event_id % 5) || '.' || (user_id % 9) WHEN 'dns_query' THEN 'd' || (event_id % 40) || '.example.com.' ELSE {RAW("event_id + 3")} END AS label FROM k),
freq AS (SELECT tenant_id, src_image, event_type, target_norm, CAST(ts AS DATE) AS day, host, count(*) AS event_count FROM x GROUP BY 1, 2, 3, 4, 5, 6),
lineage AS (SELECT tenant_id, guid, parent, label AS raw_image, src_image, target_norm, host, ts, event_id FROM x WHERE event_type = 'spawn'),
edges AS (SELECT tenant_id, guid, event_type, split_part(event_type, '_', 1) || ':' || target_norm AS dst_node, src_image, target_norm, max(label) AS label, count(*) AS cnt, max(ts) AS timestamp FROM x WHERE event_type <> 'spawn' GROUP BY 1, 2, 3, 4, 5, 6),
pair AS (SELECT tenant_id, src_image, event_type, target_norm, sum(event_count) AS fe FROM freq GROUP BY 1, 2, 3, 4), src AS (SELECT tenant_id, src_image, event_type, sum(event_count) AS ft FROM freq GROUP BY 1, 2, 3),
spread AS (SELECT tenant_id, event_type, target_norm, count(DISTINCT host) AS hosts FROM freq GROUP BY 1, 2, 3), allh AS (SELECT tenant_id, count(DISTINCT host) AS h FROM lineage GROUP BY 1),
e AS (SELECT tenant_id, parent, guid AS child, 'spawn' AS event_type, src_image, target_norm, raw_image AS label FROM lineage WHERE parent <> '' UNION ALL SELECT tenant_id, guid, dst_node, event_type, src_image, target_norm, label FROM edges),
scored AS (SELECT tenant_id, parent, child, event_type, label, round(CASE WHEN event_type = 'spawn' THEN 1 - fe / ft ELSE greatest(1 - fe / ft, CASE WHEN hosts >= 256 THEN 0 ELSE 1 - hosts / h END) END, 4) AS anomaly_score
 FROM e JOIN pair USING (tenant_id, src_image, event_type, target_norm) JOIN src USING (tenant_id, src_image, event_type) JOIN spread USING (tenant_id, event_type, target_norm) JOIN allh USING (tenant_id))"""


def _diffused(scored: str, columns: str, where: str = "") -> str:
    return f"""dspawn AS (SELECT tenant_id, child, min(parent) AS parent, arg_min(anomaly_score, parent) AS a FROM {scored} WHERE event_type = 'spawn' GROUP BY 1, 2),
droots AS (SELECT DISTINCT tenant_id, parent AS node FROM dspawn WHERE (tenant_id, parent) NOT IN (SELECT (tenant_id, child) FROM dspawn)),
ds AS (SELECT tenant_id, node, CAST(0 AS DOUBLE) AS s FROM droots UNION ALL SELECT tenant_id, child, -ln(greatest(1 - a, 0.01)) + 0.2 * s FROM dspawn JOIN ds USING (tenant_id) WHERE dspawn.parent = ds.node),
diffused AS (SELECT {columns}, round(greatest(anomaly_score, 1 - exp(-(CASE WHEN event_type = 'spawn' THEN coalesce(s, 0) ELSE -ln(greatest(1 - anomaly_score, 0.01)) + 0.2 * coalesce(s, 0) END))), 4) AS score
FROM {scored} d LEFT JOIN ds ON ds.tenant_id = d.tenant_id AND ds.node = CASE WHEN event_type = 'spawn' THEN d.child ELSE d.parent END)"""


#: The trees of all roots, other processes that share rare artifacts with them, and the best of those.
PEERS = f"""WITH RECURSIVE {PROC},
walk AS (SELECT tenant_id, guid, 0 AS k FROM lineage WHERE parent = '' UNION ALL SELECT tenant_id, lineage.guid, k + 1 FROM walk JOIN lineage USING (tenant_id) WHERE lineage.parent = walk.guid AND k < 4),
tree AS (SELECT DISTINCT tenant_id, guid FROM walk), own AS (SELECT edges.* FROM edges JOIN tree USING (tenant_id, guid)),
few AS (SELECT tenant_id, event_type, target_norm FROM (SELECT tenant_id, event_type, target_norm, count(DISTINCT host) AS n, count(DISTINCT src_image) AS i FROM freq GROUP BY 1, 2, 3)
 JOIN (SELECT tenant_id, count(DISTINCT host) AS hosts, count(DISTINCT src_image) AS images FROM freq GROUP BY 1) USING (tenant_id) WHERE n <= greatest(3, floor(0.5 * hosts)) AND i <= greatest(4, floor(0.1 * images))),
met AS (SELECT own.tenant_id, CASE own.event_type WHEN 'file_write' THEN 'file' WHEN 'remote_thread' THEN 'injection' ELSE 'access' END AS recon_type, own.guid AS src_guid, l.guid AS peer_guid, CASE own.event_type WHEN 'file_write' THEN 'file:' || lower(own.label) ELSE own.dst_node END AS object_id, own.label
 FROM own JOIN lineage l ON l.tenant_id = own.tenant_id AND lower(l.raw_image) = lower(own.label) WHERE own.event_type IN ('file_write', 'remote_thread', 'process_access')
 UNION ALL SELECT own.tenant_id, split_part(own.event_type, '_', 1), own.guid, o.guid, own.dst_node, own.label FROM own JOIN few USING (tenant_id, event_type, target_norm) JOIN edges o ON o.tenant_id = own.tenant_id AND o.event_type = own.event_type AND o.dst_node = own.dst_node WHERE own.event_type IN ('net_connect', 'dns_query')),
peers AS (SELECT DISTINCT *, CASE recon_type WHEN 'file' THEN 1.0 WHEN 'injection' THEN 0.95 WHEN 'access' THEN 0.9 ELSE 0.85 END AS anomaly FROM met WHERE (tenant_id, peer_guid) NOT IN (SELECT (tenant_id, guid) FROM tree)),
ranked AS (SELECT tenant_id, peer_guid, row_number() OVER (PARTITION BY tenant_id ORDER BY count(DISTINCT object_id) DESC, max(anomaly) DESC, peer_guid) AS r FROM peers GROUP BY 1, 2)"""
BRIDGES = lambda n: f"""admitted AS (SELECT * FROM peers WHERE (tenant_id, peer_guid) IN (SELECT (tenant_id, peer_guid) FROM ranked WHERE r <= {n})),
bridges AS (SELECT tenant_id, parent, child, recon_type, min(label) AS label, max(anomaly) AS anomaly_score FROM (
 SELECT tenant_id, src_guid AS parent, object_id AS child, recon_type, label, anomaly FROM admitted WHERE recon_type IN ('net', 'dns') UNION ALL SELECT tenant_id, peer_guid, object_id, recon_type, label, anomaly FROM admitted WHERE recon_type IN ('net', 'dns')
 UNION ALL SELECT tenant_id, src_guid, peer_guid, recon_type, label, anomaly FROM admitted WHERE recon_type NOT IN ('net', 'dns')) GROUP BY 1, 2, 3, 4)"""  # noqa: E731
EXPANDED = """best AS (SELECT tenant_id, peer_guid FROM admitted GROUP BY 1, 2 HAVING max(anomaly) >= 0.8 QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY max(anomaly) DESC, peer_guid) <= 5),
more AS (SELECT tenant_id, peer_guid AS guid, 0 AS k FROM best SEMI JOIN lineage ON lineage.tenant_id = best.tenant_id AND lineage.guid = best.peer_guid UNION ALL SELECT tenant_id, lineage.guid, k + 1 FROM more JOIN lineage USING (tenant_id) WHERE lineage.parent = more.guid AND k < 3),
expanded AS (SELECT tenant_id, guid FROM tree UNION SELECT tenant_id, guid FROM more)"""


@query("b1_build_lineage", f"WITH {PROC} SELECT tenant_id, guid AS process_guid, parent AS parent_guid, raw_image AS image, host AS computer_name FROM lineage")
def lineage(spark, d):
    return pv.build_lineage(process_events(spark, d)).select("tenant_id", "process_guid", "parent_guid", "image", "computer_name")


@query("b2_build_edges", f"WITH {PROC} SELECT tenant_id, guid AS process_guid, event_type, dst_node, label, src_image AS fkey_src, target_norm AS fkey_tgt, cnt, timestamp FROM edges")
def edges(spark, d):
    return pv.build_edges(written(pv.typed(process_events(spark, d)), "typed")).select("tenant_id", "process_guid", "event_type", "dst_node", "label", "fkey_src", "fkey_tgt", "cnt", "timestamp")


@query("b3_build_frequency", f"WITH {PROC} SELECT * FROM freq")
def frequency(spark, d):
    return pv.build_frequency(process_events(spark, d))


def _built(spark, d):
    """(lineage, edges, frequency), from events that were abstracted once."""
    p = written(pv.typed(process_events(spark, d)), "typed")
    return pv.build_lineage(p), pv.build_edges(p), pv.build_frequency(p)


def _scored(spark, d):
    line, edge, freq = _built(spark, d)
    spawn = pv.spawn_edges(line)
    both = spawn.unionByName(pv.leaf_edges(edge).select(spawn.columns))
    return pv.score_edges(both, freq, pv.hosts_of(line))


@query("v2_score_edges", f"WITH {PROC} SELECT * EXCLUDE (label) FROM scored")
def score(spark, d):
    return _scored(spark, d).select("tenant_id", "parent", "child", "event_type", "anomaly_score")


@query("v3_gate_leaves", f"WITH {PROC}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type = 'spawn', tenant_id, parent ORDER BY anomaly_score DESC, child, event_type) AS r FROM scored WHERE event_type = 'spawn' OR anomaly_score >= 0.05) SELECT tenant_id, parent, child, event_type, anomaly_score FROM r WHERE event_type = 'spawn' OR r <= 1")
def gate(spark, d):
    return pv.gate_leaves(_scored(spark, d), diffuse=True, per_process=1).select("tenant_id", "parent", "child", "event_type", "anomaly_score")


@query("v4_diffuse", f"WITH RECURSIVE {PROC}, {_diffused('scored', 'd.tenant_id, d.parent, d.child, event_type')} SELECT * FROM diffused")
def diffuse(spark, d):
    return pv.diffuse(_scored(spark, d)).select("tenant_id", "parent", "child", "event_type", F.col("anomaly_score").alias("score"))


def _roots(lineage):
    return lineage.where("parent_guid = ''").select("tenant_id", F.col("process_guid").alias("start"))


def _peers(spark, d, most=None):
    """(lineage, tree, peers): the trees of all roots and the processes that share artifacts with them."""
    line, edge, freq = (written(x, n) for x, n in zip(_built(spark, d), ("lineage", "edges", "frequency"), strict=True))
    tree = graph.tree_ids(line, "process_guid", "parent_guid", _roots(line), 4, scope=["tenant_id"]).withColumnRenamed("id", "process_guid")
    return line, tree, pv.reconnect(tree, edge, line, freq, most)


@query("v5_reconnect", f"{PEERS} SELECT * FROM peers")
def reconnect(spark, d):
    return _peers(spark, d)[2]


@query("v6_rank_peers", f"{PEERS} SELECT * FROM peers WHERE (tenant_id, peer_guid) IN (SELECT (tenant_id, peer_guid) FROM ranked WHERE r <= 20)")
def rank(spark, d):
    return pv.rank_peers(_peers(spark, d)[2], 20)


@query("v7_expand_tree", f"{PEERS}, {BRIDGES(50)}, {EXPANDED} SELECT tenant_id, guid AS process_guid FROM expanded")
def expand(spark, d):
    line, tree, found = _peers(spark, d, 50)
    return pv.expand_tree(line, tree, written(found, "peers"))


@query("v8_bridge_edges", f"{PEERS}, {BRIDGES(20)} SELECT * FROM bridges")
def bridge(spark, d):
    return pv.bridge_edges(_peers(spark, d, 20)[2])


@query("v9_provenance", f"""{PEERS}, {BRIDGES(50)}, {EXPANDED},
part AS (SELECT s.* FROM scored s SEMI JOIN expanded x ON x.tenant_id = s.tenant_id AND x.guid = CASE WHEN s.event_type = 'spawn' THEN s.child ELSE s.parent END),
gated AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY event_type = 'spawn', tenant_id, parent ORDER BY anomaly_score DESC, child, event_type) AS r FROM part WHERE event_type = 'spawn' OR anomaly_score >= 0.05) WHERE event_type = 'spawn' OR r <= 64),
{_diffused("gated", "d.tenant_id, d.parent, d.child, event_type, label")}
SELECT tenant_id, parent, child, event_type, label, score AS anomaly_score FROM diffused WHERE event_type = 'spawn' OR score >= 0.7
UNION ALL SELECT * FROM bridges""")
def whole(spark, d):
    p = process_events(spark, d)
    return pv.provenance(p, _roots(pv.build_lineage(p)), depth=4)


@query("m1_model_source", "SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages WHERE prefix(url, 'https') AND strlen(regexp_extract(url, '://([^/?#]+)', 1)) >= 5")
def source(spark, d):
    from .tables import read

    return models.model_source(read(spark, d, "pages"), [F.startswith("url", F.lit("https"))], [("host", "url", "://([^/?#]+)", 5)]).select("page_id", "host")


@query("m2_rarity_state", "SELECT event_type AS part, user_id AS value, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2, 3")
def rarity(spark, d):
    return models.rarity_state(events(spark, d), "event_type", "user_id", "ts")


RARITY = "v AS (SELECT event_type AS part, user_id AS value, count(DISTINCT CAST(ts AS DATE)) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2), t AS (SELECT part, sum(n) AS total, count(*) AS u FROM v GROUP BY 1), rs AS (SELECT part, value, n, CAST(total AS BIGINT) AS total, round(100.0 * n / total, 4) AS percent, round(0.95 * (total - u) / total, 4) AS confidence FROM v JOIN t USING (part))"


@query("m3_rarity_score", f"WITH {RARITY} SELECT * FROM rs")
def rarity_score(spark, d):
    return models.rarity_score(rarity(spark, d))


@query("m4_first_seen", "SELECT user_id AS entity, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days, floor(epoch(min(ts))) >= floor(epoch(TIMESTAMP '2024-01-02 12:00:00')) - 3600 AS is_new FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def first_seen(spark, d):
    return models.first_seen_score(models.first_seen_state(events(spark, d), "user_id", "ts"), datetime(2024, 1, 2, 12))


@query("m5_volume_score", """
WITH c AS (SELECT event_type AS entity, date_trunc('day', ts) AS b, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-25' GROUP BY 1, 2),
l AS (SELECT entity, list_sort(list(CAST(n AS DOUBLE))) AS c, arg_max(n, b) AS latest, count(*) AS buckets FROM c GROUP BY 1 HAVING count(*) >= 7),
m AS (SELECT *, c[len(c) // 2 + 1] AS median FROM l), x AS (SELECT *, list_sort(list_transform(c, lambda v: abs(v - median))) AS dv FROM m)
SELECT entity, latest, buckets, median, dv[len(dv) // 2 + 1] AS mad, CASE WHEN dv[len(dv) // 2 + 1] = 0 THEN 0.0 ELSE round(0.6745 * (latest - median) / dv[len(dv) // 2 + 1], 4) END AS zscore FROM x""")
def volume(spark, d):
    return models.volume_score(models.volume_state(events(spark, d), "event_type", "ts"), datetime(2024, 1, 25, 7))


@query("m6_network_state", """
WITH c AS (SELECT CAST(l_suppkey AS VARCHAR) AS src, CAST(l_partkey % 50 AS VARCHAR) AS dst, CAST(epoch(l_shipdate) AS BIGINT) AS sec, CAST(l_quantity AS DOUBLE) AS size, l_quantity * 60 AS duration FROM lineitem),
s AS (SELECT *, make_timestamp(sec // 31536000 * 31536000 * 1000000) AS span FROM c), t AS (SELECT DISTINCT src, dst, span, sec FROM s),
g AS (SELECT src, dst, span, CAST(sec - lag(sec) OVER (PARTITION BY src, dst, span ORDER BY sec) AS DOUBLE) AS v FROM t)
SELECT src, dst, span, 'pair' AS kind, NULL AS v, count(*) AS n, round(sum(duration), 2) AS duration, min(sec) AS first, max(sec) AS last FROM s GROUP BY ALL
UNION ALL SELECT src, dst, span, 'hour', CAST(sec % 86400 // 3600 AS DOUBLE), count(*), NULL, NULL, NULL FROM s GROUP BY ALL
UNION ALL SELECT src, dst, span, 'size', size, count(*), NULL, NULL, NULL FROM s GROUP BY ALL
UNION ALL SELECT src, dst, span, 'gap', v, count(*), NULL, NULL, NULL FROM g WHERE v IS NOT NULL GROUP BY ALL""")
def network(spark, d):
    s = models.network_state(connections(spark, d), "src", "dst", "port", "ts", "size", "duration", every=365 * 86_400)
    return s.drop("port").withColumn("duration", F.round("duration", 2))


@query("m7_network_context", "SELECT CAST(l_partkey % 50 AS VARCHAR) AS dst, count(DISTINCT l_suppkey) AS sources, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS all_sources FROM lineitem GROUP BY 1")
def context(spark, d):
    return models.network_context(connections(spark, d))


_UNIT = lambda x: f"least(greatest({x}, 0), 1)"
#: Scores of every pair, from all its times and sizes.
BEACON = f"""c AS (SELECT CAST(l_suppkey AS VARCHAR) AS src, CAST(l_partkey % 50 AS VARCHAR) AS dst, CAST(epoch(l_shipdate) AS BIGINT) AS sec, CAST(l_quantity AS DOUBLE) AS size, l_quantity * 60 AS duration FROM lineitem),
p AS (SELECT src, dst, count(*) AS n, sum(duration) AS duration, min(sec) AS f, max(sec) AS l FROM c GROUP BY 1, 2 HAVING count(*) < 7776000),
gap AS (SELECT src, dst, CAST(sec - lag(sec) OVER (PARTITION BY src, dst ORDER BY sec) AS DOUBLE) AS v FROM (SELECT DISTINCT src, dst, sec FROM c)),
v AS (SELECT src, dst, 'ts' AS kind, v FROM gap WHERE v IS NOT NULL UNION ALL SELECT src, dst, 'ds', size FROM c),
q AS (SELECT src, dst, kind, count(*) AS k, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.75) AS c FROM v GROUP BY 1, 2, 3),
m AS (SELECT src, dst, kind, quantile_cont(abs(v - b), 0.5) AS mad FROM v JOIN q USING (src, dst, kind) GROUP BY 1, 2, 3),
d AS (SELECT src, dst, kind, CASE WHEN k < 3 THEN 0 ELSE (CASE WHEN c = a THEN 1 ELSE {_UNIT(f"1 - abs((c + a - 2 * b) / (c - a)) * CASE WHEN b >= 1 THEN {_UNIT('(c - a) / b / 0.1')} ELSE 1 END")} END + CASE WHEN b >= 1 THEN {_UNIT("(b - mad) / b")} ELSE 0 END) / 2 END AS s FROM q JOIN m USING (src, dst, kind)),
b AS (SELECT src, dst, sec % 86400 // 3600 AS hour, count(*) AS n FROM c GROUP BY 1, 2, 3),
h AS (SELECT src, dst, sum(n) AS points, count(*) AS hours, sqrt((sum((n - points / 24) ** 2) + (24 - count(*)) * (max(points) / 24) ** 2) / 24) / (max(points) / 24) AS cv FROM b JOIN (SELECT src, dst, sum(n) AS points FROM b GROUP BY 1, 2) USING (src, dst) GROUP BY 1, 2),
s AS (SELECT src, dst, p.n, p.duration, points, coalesce((SELECT s FROM d WHERE d.src = p.src AND d.dst = p.dst AND kind = 'ts'), 0) AS ts, coalesce((SELECT s FROM d WHERE d.src = p.src AND d.dst = p.dst AND kind = 'ds'), 0) AS ds,
 greatest({_UNIT("(l - f) / 7776000")}, hours / 24) AS dur, CASE WHEN cv > 1 THEN 0 ELSE {_UNIT("1 - cv")} END AS hist FROM p JOIN h USING (src, dst)),
beacons AS (SELECT src, dst, n, duration, CASE WHEN points >= 4 THEN round({_UNIT("0.25 * ts + 0.25 * ds + 0.25 * dur + 0.25 * hist")}, 3) ELSE 0 END AS beacon, CASE WHEN points >= 4 THEN round(ts, 3) ELSE 0 END AS ts_score, CASE WHEN points >= 4 THEN round(ds, 3) ELSE 0 END AS ds_score, CASE WHEN points >= 4 THEN round(dur, 3) ELSE 0 END AS dur_score, CASE WHEN points >= 4 THEN round(hist, 3) ELSE 0 END AS hist_score FROM s)""".replace("sum(n) AS points, count(*) AS hours, sqrt((sum((n", "max(points) AS points, count(*) AS hours, sqrt((sum((n")
TIERS = "CASE WHEN t < 3600 THEN 0.0 WHEN t < 14400 THEN 0.25 * (t - 3600) / 10800 WHEN t < 28800 THEN 0.25 + 0.25 * (t - 14400) / 14400 WHEN t < 43200 THEN 0.5 + 0.25 * (t - 28800) / 14400 ELSE least(1.0, 0.75 + 0.25 * (t - 43200) / 43200) END"


@query("m8_beacon_score", f"WITH {BEACON} SELECT src, dst, n, beacon, ts_score, ds_score, dur_score, hist_score FROM beacons")
def beacon(spark, d):
    c = connections(spark, d)
    own = c.groupBy("src", "dst", "port").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.unix_seconds("ts"))).alias("ts"), F.collect_list(F.col("size").cast("double")).alias("sizes"), F.unix_seconds(F.min("ts")).alias("first_ts"), F.unix_seconds(F.max("ts")).alias("last_ts"))
    return models.beacon_score(own, 90 * 86_400).select("src", "dst", "n", "beacon", "ts_score", "ds_score", "dur_score", "hist_score")


@query("m12_score_pairs", f"""WITH {BEACON}, x AS (SELECT dst, count(DISTINCT src) AS sources FROM c GROUP BY 1), y AS (SELECT count(DISTINCT src) AS every FROM c),
z AS (SELECT src, dst, '443' AS port, n, beacon, ts_score, ds_score, dur_score, hist_score, round({TIERS.replace("t <", "duration <").replace("(t -", "(duration -")}, 3) AS long_conn, sources / every AS share FROM beacons JOIN x USING (dst), y),
w AS (SELECT * EXCLUDE (share), round(share, 4) AS prevalence, round({_UNIT("greatest(beacon, long_conn) + CASE WHEN share > 0 AND share <= 0.02 THEN 0.15 WHEN share >= 0.5 THEN -0.15 ELSE 0 END")}, 3) AS score FROM z)
SELECT *, CASE WHEN score > 0.8 THEN 'critical' WHEN score > 0.6 THEN 'high' WHEN score > 0.4 THEN 'medium' WHEN score > 0.2 THEN 'low' ELSE 'none' END AS severity FROM w""")
def pairs(spark, d):
    state = written(models.network_state(connections(spark, d), "src", "dst", "port", "ts", "size", "duration", every=None), "network")
    return models.score_pairs(state, 90 * 86_400)


@query("m9_long_conn", f"WITH p AS (SELECT l_suppkey AS src, l_partkey % 50 AS dst, sum(l_quantity * 60) AS t FROM lineitem GROUP BY 1, 2) SELECT src, dst, round({TIERS}, 3) AS score FROM p")
def long_conn(spark, d):
    c = connections(spark, d).groupBy(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).agg(F.sum("duration").alias("t"))
    return c.select("src", "dst", models.long_conn_score(F.col("t")).alias("score"))


@query("m10_prevalence_modifier", "SELECT event_id, round(least(greatest(floor(value) / 100 + CASE WHEN user_id / 150.0 > 0 AND user_id / 150.0 <= 0.02 THEN 0.15 WHEN user_id / 150.0 >= 0.5 THEN -0.15 ELSE 0 END, 0), 1), 3) AS score FROM events")
def prevalence(spark, d):
    return events(spark, d).select("event_id", models.prevalence_modifier(F.floor("value") / 100, F.col("user_id") / 150.0).alias("score"))


@query("m11_severity_tier", "SELECT event_id, CASE WHEN value > 80 THEN 'critical' WHEN value > 60 THEN 'high' WHEN value > 40 THEN 'medium' WHEN value > 20 THEN 'low' ELSE 'none' END AS tier FROM events")
def severity(spark, d):
    return events(spark, d).select("event_id", models.severity_tier(F.col("value") / 100).alias("tier"))


@query("m13_backfill", "SELECT CAST(ts AS DATE) AS day, event_type AS part, count(*) AS rows, count(DISTINCT user_id) AS users FROM events WHERE ts < TIMESTAMP '2024-01-13' GROUP BY 1, 2")
def backfill(spark, d):
    path = folder(spark, "rarity")
    e = events(spark, d)
    state = lambda rows: models.rarity_state(rows, "event_type", "user_id", "ts")
    models.backfill(e, "ts", path, state, date(2024, 1, 1), date(2024, 1, 9))
    models.backfill(e, "ts", path, state, date(2024, 1, 1), date(2024, 1, 12))  # goes on where the first ended
    return spark.read.parquet(path).groupBy("day", "part").agg(F.sum("n").alias("rows"), F.count_distinct("value").alias("users"))


@query("m14_preview", f"WITH v AS (SELECT event_type AS part, user_id AS value, count(DISTINCT CAST(ts AS DATE)) AS n FROM events WHERE user_id IS NOT NULL AND ts >= TIMESTAMP '2024-01-20' GROUP BY 1, 2), t AS (SELECT part, sum(n) AS total FROM v GROUP BY 1) SELECT part, value, round(100.0 * n / total, 4) AS percent FROM v JOIN t USING (part)")
def preview(spark, d):
    return models.rarity_score(models.rarity_state(events(spark, d).where("ts >= timestamp '2024-01-20'"), "event_type", "user_id", "ts")).select("part", "value", "percent")


@query("m15_score_distribution", "WITH c AS (SELECT user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1), b AS (SELECT * FROM (VALUES (0, '1-9'), (1, '10-99'), (2, '100-999'), (3, '1K-9.9K'), (4, '10K-99K'), (5, '100K+')) v(band, label)) SELECT band, label, count(user_id) AS n FROM b LEFT JOIN c ON least(len(CAST(c.n AS VARCHAR)) - 1, 5) = band GROUP BY 1, 2")
def distribution(spark, d):
    e = models.first_seen_score(models.first_seen_state(events(spark, d), "user_id", "ts"), datetime(2024, 2, 1)).select("entity", F.col("n").alias("c"))
    return models.score_distribution(e, "c", "count")


@query("m16_model_alert", f"WITH {RARITY} SELECT event_id, percent AS model_percent FROM events JOIN rs ON part = event_type AND value = user_id WHERE percent <= 0.3 AND confidence > 0".replace("AND value = user_id", "AND rs.value = user_id"))
def model_alert(spark, d):
    scores = rarity_score(spark, d).where(models.model_alert("rarity", 0.3))
    return enrich.model_lookup(events(spark, d), scores, {"event_type": "part", "user_id": "value"}, ["percent"]).where("model_percent is not null").select("event_id", "model_percent")


@query("j4_model_lookup", f"WITH {RARITY} SELECT event_id, percent AS model_percent, confidence AS model_confidence FROM events LEFT JOIN rs ON part = event_type AND rs.value = user_id")
def model_lookup(spark, d):
    return enrich.model_lookup(events(spark, d), rarity_score(spark, d), {"event_type": "part", "user_id": "value"}, ["percent", "confidence"]).select("event_id", "model_percent", "model_confidence")


def _archived(spark, d) -> str:
    path = folder(spark, "archive")
    archive.write_archive(logs(spark, d).select("timestamp", "log_id", "tenant_id", "ingest_date", "fields"), path, ("user", "src_ip"))
    return path


@query("a10_write_archive", "SELECT 't' || (user_id % 3) AS tenant_id, CAST(ts AS DATE) AS ingest_date, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def write_archive(spark, d):
    return archive.read_archive(spark, _archived(spark, d)).groupBy("tenant_id", "ingest_date").agg(F.count("*").alias("n"), F.count_distinct("f_user").alias("users"))


@query("a12_archive_search", "SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS log_id, count(*) OVER () > 50 AS limit_hit FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-08' AND event_type = 'click' ORDER BY 1 LIMIT 50")
def archive_search(spark, d):
    rows, hit = archive.archive_search(archive.read_archive(spark, _archived(spark, d)), date(2024, 1, 5), date(2024, 1, 8), lambda x: x.where(F.col("fields")["action"] == "click").orderBy("log_id"), 50)
    return rows.select("log_id").crossJoin(F.broadcast(hit))  # one row


@query("a17_compact_archive", "SELECT 't' || (user_id % 3) AS tenant_id, CAST(ts AS DATE) AS ingest_date, count(*) AS n, CASE WHEN CAST(ts AS DATE) < DATE '2024-01-20' THEN 1 ELSE least(2, count(DISTINCT event_id % 2)) END AS files FROM events GROUP BY 1, 2")
def compact(spark, d):
    path = folder(spark, "archive")
    rows = logs(spark, d).select("event_id", "timestamp", "log_id", "tenant_id", "ingest_date", "fields")
    for k in (0, 1):  # two files a day
        archive.write_archive(rows.where(F.col("event_id") % 2 == k).drop("event_id"), path, ("user", "src_ip"))
    archive.compact(spark, path, archive.small_partitions(archive.read_archive(spark, path), 64 << 20, date(2024, 1, 20)))
    return archive.read_archive(spark, path).groupBy("tenant_id", "ingest_date").agg(F.count("*").alias("n"), F.count_distinct("_metadata.file_path").alias("files"))


@query("a18_scan_estimate", "SELECT count(*) AS rows, true AS some FROM events")
def scan_estimate(spark, d):
    return archive.scan_estimate(archive.read_archive(spark, _archived(spark, d))).select("rows", ((F.col("files") > 0) & (F.col("bytes") > 0)).alias("some"))


def _stream(spark, d):
    """The log rows as a stream of files."""
    path = folder(spark, "arrivals")
    logs(spark, d).write.parquet(path)
    return spark.readStream.schema(logs(spark, d).schema).option("maxFilesPerTrigger", 2).parquet(path)


@query("x1_ingest_stream", "SELECT 't' || (user_id % 3) AS tenant_id, CAST(ts AS DATE) AS ingest_date, 'web@1' AS normalizer, event_type AS act, date_trunc('second', ts) AS timestamp, count(*) AS n FROM events GROUP BY 1, 2, 4, 5")
def ingest(spark, d):
    out = folder(spark, "ingested")
    raw = _stream(spark, d).select(F.to_json(F.struct(F.col("event_type").alias("webAction"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("time"))).alias("value"), "tenant_id", F.col("timestamp").alias("arrival"))
    rows = jobs.normalized_stream(raw, "value", "arrival", "tenant_id", mapping={"act": ["web_action"]}, normalizer="web@1")
    jobs.ingest_stream(rows, out, folder(spark, "cp")).awaitTermination()
    return spark.read.parquet(out).groupBy("tenant_id", "ingest_date", "normalizer", F.col("fields")["act"].alias("act"), "timestamp").agg(F.count("*").alias("n"))


@query("x2_baseline_stream", "SELECT user_id AS entity, count(*) AS n, min(ts) AS first_seen FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def baselines(spark, d):
    out = folder(spark, "first-seen")
    state = lambda b: models.first_seen_state(b, "user_id", "timestamp")
    jobs.baseline_stream(_stream(spark, d), {"first_seen": (state, out), "rarity": (lambda b: models.rarity_state(b, "event_type", "user_id", "timestamp"), folder(spark, "rarity"))}, folder(spark, "cp")).awaitTermination()
    return models.first_seen_score(spark.read.parquet(out), datetime(2024, 2, 1)).select("entity", "n", "first_seen")


@query("x3_event_alerts", "SELECT event_id, 'large' AS rule_id FROM events WHERE event_type = 'purchase' AND value > 90")
def event_alerts(spark, d):
    out = folder(spark, "hits")
    match = lambda b: b.where((F.col("event_type") == "purchase") & (F.col("value") > 90)).select("event_id", F.lit("large").alias("rule_id"))
    jobs.event_alerts(_stream(spark, d), match, out, folder(spark, "cp")).awaitTermination()
    return spark.read.parquet(out).select("event_id", "rule_id")


@query("x4_window_alert", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 3")
def window_alert(spark, d):
    return jobs.window_alert(events(spark, d), "ts", "1 hour", ["event_type"], 3).select("window_start", "event_type", "n")


@query("x5_scheduled_alert", "SELECT user_id, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-14' AND ts <= TIMESTAMP '2024-01-15' GROUP BY 1 HAVING count(*) >= 2")
def scheduled(spark, d):
    return jobs.scheduled_alert(events(spark, d), "ts", datetime(2024, 1, 15), timedelta(days=1), ["user_id"], 2)


@query("x6_look_back", """
WITH e AS (SELECT user_id, event_type, epoch_us(ts) // 1000 AS t, event_id FROM events WHERE user_id IS NOT NULL AND event_type IN ('click', 'purchase') AND ts > TIMESTAMP '2024-01-13' AND ts <= TIMESTAMP '2024-01-15'),
l AS (SELECT *, lead(event_type) OVER w AS nk, lead(t) OVER w AS nt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, max(epoch_ms(nt)) AS done FROM l WHERE event_type = 'click' AND nk = 'purchase' AND nt - t <= 86400000 GROUP BY 1 HAVING max(epoch_ms(nt)) >= TIMESTAMP '2024-01-14'""")
def look_back(spark, d):
    from ..operators.sequence import chain

    steps = [F.col("event_type") == "click", F.col("event_type") == "purchase"]
    find = lambda rows: chain(rows, "user_id", steps, "ts", "event_id", within=86_400)
    return jobs.new_completions(events(spark, d), "ts", datetime(2024, 1, 14), datetime(2024, 1, 15), timedelta(days=1), find).select("user_id", "done")


@query("x7_throttle", """
WITH RECURSIVE s AS (SELECT DISTINCT event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), k AS (SELECT event_type, min(t) AS t FROM s GROUP BY 1
 UNION ALL SELECT event_type, (SELECT min(s.t) FROM s WHERE s.event_type = k.event_type AND s.t >= k.t + 21600) FROM k WHERE k.t IS NOT NULL)
SELECT event_type, make_timestamp(t * 1000000) AS ts FROM k WHERE t IS NOT NULL""")
def throttle(spark, d):
    return jobs.throttle(events(spark, d), ["event_type"], "ts", 21_600)


@query("x8_forward_hits", "SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS source, 'alerts' AS tenant_id, 'big' AS alert, CAST(user_id AS VARCHAR) AS actor FROM events WHERE value > 95")
def forward(spark, d):
    out = jobs.forward_hits(logs(spark, d).where("value > 95"), "alerts", "big", {"user": "actor"})
    return out.select(F.col("fields")["source_log_id"].alias("source"), "tenant_id", F.col("fields")["alert_name"].alias("alert"), F.col("fields")["actor"].alias("actor"))


@query("x9_hits_to_dictionary", "SELECT user_id, max(event_type) AS event_type FROM events WHERE user_id IS NOT NULL AND value > 80 GROUP BY 1 ORDER BY 1 LIMIT 1000")
def to_dictionary(spark, d):
    return jobs.hits_to_dictionary(events(spark, d).where("value > 80"), ["user_id", "event_type"], 1000)
