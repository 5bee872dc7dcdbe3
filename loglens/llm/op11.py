"""Merkle trees of a dataset: a digest and a proof for each row, and roots for each part and for all."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import numbered, table
from .words import tidy

#: Nodes that become one on the next level, and levels below a partition's own root.
FANOUT, LEVELS = 2, 12
#: What a leaf covers, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*columns: Column) -> Column:
    """Hex SHA-256 of columns, each "-" if null, else its number of UTF-8 bytes, ":" and its text."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*(one(c) for c in columns)), 256)


def _parent(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _subtree(leaves: list[str], levels: int | None, fanout: int) -> list[list[str]]:
    """The nodes of each level over the leaves: that many levels, or with None until one node is left."""
    out = [leaves]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        now = out[-1]
        out.append([_parent(now[i : i + fanout]) for i in range(0, len(now), fanout)])
    return out


def _beside(levels: list[list[str]], at: int, fanout: int) -> list[tuple[str, str]]:
    """(left, right) siblings of leaf at on each level below the top, joined."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % fanout
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + fanout])))
        at //= fanout
    return out


def _partitions(leaves: DataFrame, levels: int, fanout: int) -> DataFrame:
    """(tree, chunk, last, keys, extras, leaves, node): aligned runs of fanout**levels leaves, a row each, with the root of their subtree.

    A tree of one partition ends where one node is left; last is a tree's last chunk.
    """
    width = fanout**levels
    placed = numbered(leaves, "tree", [F.col("key").asc_nulls_first(), F.col("leaf"), F.col("extra"), F.col("row")], "at")
    ends = placed.groupBy("tree").agg(F.floor(F.max("at") / width).alias("last"))
    own = placed.select("tree", "key", "extra", "leaf", F.floor(F.col("at") / width).alias("chunk"), "at")
    grouped = own.groupBy("tree", "chunk").agg(F.sort_array(F.collect_list(F.struct("at", "key", "extra", "leaf"))).alias("own"))  # fanout**levels at most
    rows = grouped.join(ends, "tree").select("tree", "chunk", "last", F.col("own.key").alias("keys"), F.col("own.extra").alias("extras"), F.col("own.leaf").alias("leaves"))

    @tidy
    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [_subtree(own, levels if last else None, fanout)[-1][0] for own, last in zip(batch["leaves"].to_pylist(), batch["last"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.string())], names=[*batch.schema.names, "node"])

    return rows.mapInArrow(rooted, rows.withColumn("node", F.lit("")).schema)


def _butterfly(parts: DataFrame, fanout: int) -> DataFrame:
    """(tree, chunk, root, upper): each partition's proof above its own root, without a pass downward.

    In round j, the partitions whose numbers differ in digit j alone (base fanout) swap the roots of the
    subtrees that they stand for, and each hashes all of them to their parent: whoever is below a node
    knows it, and has its siblings from the rounds before. A tree's partitions are filled up to a power of the fanout by empty ones, which
    take part as soon as one of their group knows something, so no partition ever has more than fanout partners.
    """
    empty = F.sequence(F.col("last") + 1, F.expr(f"cast(pow({fanout}, ceil(log({fanout}, last + 1) - 1e-9)) as bigint) - 1"))
    filler = parts.where("chunk = last and last > 0").select("tree", "last", F.explode(F.when(F.element_at(empty, -1) > F.col("last"), empty)).alias("chunk"), F.lit(None).cast("string").alias("node"))
    pair = "array<struct<left:string,right:string>>"
    now = table(parts.select("tree", "last", "chunk", "node").unionByName(filler).withColumn("upper", F.array().cast(pair)), "round")
    top, step = parts.agg(F.max("last")).first()[0] or 0, 1  # one number
    while step <= top:
        digit = F.floor(F.col("chunk") / step) % fanout
        groups = now.where(F.col("last") >= step).groupBy("tree", F.floor(F.col("chunk") / (step * fanout)).alias("group"), (F.col("chunk") % step).alias("lane"))
        swapped = groups.agg(F.sort_array(F.collect_list(F.struct(digit.alias("digit"), "chunk", "node", "last", "upper"))).alias("own"))  # fanout at most
        nodes = lambda keep: F.array_join(F.transform(F.filter("own", lambda x: x["node"].isNotNull() & keep(x)), lambda x: x["node"]), "")
        parent = F.when(F.exists("own", lambda x: x["node"].isNotNull()), F.sha2(nodes(lambda _: F.lit(True)), 256))
        # a partition that knew nothing itself is no one's proof
        met = swapped.select("tree", parent.alias("parent"), "own", F.explode("own").alias("me"))
        sides = F.struct(nodes(lambda x: x["digit"] < F.col("me.digit")).alias("left"), nodes(lambda x: x["digit"] > F.col("me.digit")).alias("right"))
        met = met.select("tree", "me.last", "me.chunk", F.col("parent").alias("node"), F.concat("me.upper", F.array(sides)).alias("upper"))
        now = table(met.unionByName(now.where(F.col("last") < step)), "round")
        step *= fanout
    return now.where("chunk <= last").select("tree", "chunk", F.col("node").alias("root"), "upper")


def forest(leaves: DataFrame, levels: int = LEVELS, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """Trees over leaves (tree, key, leaf, extra, row): a tree's leaves ascend by key (nulls first), then digest.

    The first result has a row for each partition: tree, chunk, last (the tree's last chunk), root (the tree's), keys,
    extras and leaves in order, upper (siblings above it); the second one has (tree, root). Groups of fanout nodes become one until one is left; the last
    group of a level may be smaller.
    """
    parts = table(_partitions(leaves, levels, fanout), "partitions")
    known = table(_butterfly(parts, fanout), "uppers")
    return parts.drop("node").join(known, ["tree", "chunk"]), known.where("chunk = 0").select("tree", "root")


def manifest(docs: DataFrame, by: str = "lang", id_col: str = "doc_id", columns: tuple[str, ...] = COLUMNS, levels: int = LEVELS, fanout: int = FANOUT, tampered: Column | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    A leaf is the digest of the row's columns; the trees of the values of by (null first) have the subroots, and a tree over those
    has the root. The proof is what a row's holder must be given to compute the root: the digest covers its
    siblings from the leaf to the root. folded_root is computed from them and the row as it is now:
    tampered, if given, is the digest of its columns as they were found later (null: unchanged), so
    verified tells which rows changed since the manifest was made.

    Rows with one id are ordered by their leaf, null ids come first; repeated rows are leaves of their own.
    An empty table gives no rows. Other columns are not read. Texts are read once and do not move.
    """
    now = F.lit(None).cast("string") if tampered is None else tampered
    tree = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("-"))  # in order of the values' bytes, null first
    slim = docs.select(tree.alias("tree"), F.col(id_col).cast("long").alias("key"), digest(*(F.col(c) for c in columns)).alias("leaf"), now.alias("extra"), F.monotonically_increasing_id().alias("row"))
    parts, roots = forest(table(slim, "leaves"), levels, fanout)
    # the same again over the subroots: their order is that of tree
    tops, _ = forest(roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("root").alias("leaf"), F.lit(None).cast("string").alias("extra"), F.lit(0).cast("long").alias("row")), levels, fanout)
    schema = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def folded(leaf: str, beside: list[tuple[str, str]]) -> str:
        for left, right in beside:
            leaf = _parent([left, leaf, right])
        return leaf

    def proofs(own: list[str], last: int, upper: list[dict]) -> Iterator[list[tuple[str, str]]]:
        below, above = _subtree(own, levels if last else None, fanout), [(u["left"], u["right"]) for u in upper]
        for at in range(len(own)):
            yield [*_beside(below, at, fanout), *above]

    @tidy
    def subroots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                beside = [[{"left": a, "right": b} for a, b in p] for p in proofs(r["leaves"], r["last"], r["upper"])]
                yield pa.RecordBatch.from_pydict({"tree": r["keys"], "whole": [r["root"]] * len(beside), "rest": beside}, schema=pa.schema([("tree", pa.string()), ("whole", pa.string()), ("rest", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))]))

    @tidy
    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rest, rows = [(u["left"], u["right"]) for u in r["rest"]], []
                for leaf, key, found, beside in zip(r["leaves"], r["keys"], r["extras"], proofs(r["leaves"], r["last"], r["upper"]), strict=True):
                    path = beside + rest
                    root = folded(found or leaf, path)
                    rows.append((key, leaf, r["root"], r["whole"], _parent([x for p in path for x in p]), root, root == r["whole"]))
                yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names=[c.split()[0] for c in schema.split(", ")])

    above = table(tops.mapInArrow(subroots, "tree string, whole string, rest array<struct<left:string,right:string>>"), "tops")
    return parts.join(above, "tree").mapInArrow(finished, schema).withColumnRenamed("id", id_col)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in COLUMNS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, digest(*changed))
    return manifest(docs, tampered=tampered)


#: Unsigned crc32 of the decimal {0}, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}::VARCHAR) + 1), lambda i: ascii(substr({0}::VARCHAR, i::INT, 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in COLUMNS) + ")"

ORACLE = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, lang, {_LEAF} AS leaf, {_LEAF.replace("n_chars", "(n_chars + 1)")} AS other, {CRC32.format("doc_id")} % 7 = 0 AS bad,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS k FROM documents
), level AS (
  SELECT lang, 0 AS h, k, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM rows
  UNION ALL
  SELECT DISTINCT lang, h + 1, k // 2, sha256(string_agg(node, '') OVER (PARTITION BY lang, k // 2 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), (n + 1) // 2 FROM level WHERE n > 1
), subroots AS (
  SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k FROM level WHERE n = 1
), top AS (
  SELECT 0 AS h, k, subroot AS node, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT DISTINCT h + 1, k // 2, sha256(string_agg(node, '') OVER (PARTITION BY k // 2 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), (n + 1) // 2 FROM top WHERE n > 1
), climb AS (
  SELECT doc_id, r.lang, 0 AS h, k, '' AS proof, CASE WHEN bad THEN other ELSE leaf END AS node FROM rows r
  UNION ALL
  SELECT c.doc_id, c.lang, c.h + 1, c.k // 2, c.proof || coalesce(s.node, ''), sha256(CASE WHEN c.k % 2 = 0 THEN c.node || coalesce(s.node, '') ELSE s.node || c.node END)
  FROM climb c JOIN level own ON own.lang IS NOT DISTINCT FROM c.lang AND own.h = c.h AND own.k = c.k
  LEFT JOIN level s ON s.lang IS NOT DISTINCT FROM c.lang AND s.h = c.h AND s.k = xor(c.k, 1) WHERE own.n > 1
), low AS (SELECT doc_id, lang, arg_max(proof, h) AS proof, arg_max(node, h) AS node FROM climb GROUP BY doc_id, lang),
rise AS (
  SELECT l.doc_id, l.lang, 0 AS h, u.k, l.proof, l.node FROM low l JOIN subroots u ON u.lang IS NOT DISTINCT FROM l.lang
  UNION ALL
  SELECT c.doc_id, c.lang, c.h + 1, c.k // 2, c.proof || coalesce(s.node, ''), sha256(CASE WHEN c.k % 2 = 0 THEN c.node || coalesce(s.node, '') ELSE s.node || c.node END)
  FROM rise c JOIN top own ON own.h = c.h AND own.k = c.k LEFT JOIN top s ON s.h = c.h AND s.k = xor(c.k, 1) WHERE own.n > 1
), ends AS (SELECT doc_id, lang, arg_max(proof, h) AS proof, arg_max(node, h) AS node FROM rise GROUP BY doc_id, lang)
SELECT r.doc_id, r.leaf, u.subroot, t.node AS root, sha256(e.proof) AS proof_sha256, e.node AS folded_root, e.node = t.node AS verified
FROM rows r JOIN subroots u ON u.lang IS NOT DISTINCT FROM r.lang JOIN ends e ON e.doc_id IS NOT DISTINCT FROM r.doc_id AND e.lang IS NOT DISTINCT FROM r.lang CROSS JOIN (SELECT node FROM top WHERE n = 1) t
"""
