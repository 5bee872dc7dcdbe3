"""The trie of conversations' beginnings, from fingerprints that are combined instead of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .op2 import n_words
from .op11 import CRC32
from .scratch import numbered, table
from .words import tidy

#: Conversations that share a base, and the most turns that are taken from it, plus one.
FAMILY, HEADS = 20, 4
#: Primes of a fingerprint's parts: products of two values below one stay exact in a long.
PRIMES = (2147483647, 2147483629, 2147483587)
KEYS = [f"f{i}" for i in range(len(PRIMES))]
PARENT = [f"p{i}" for i in range(len(PRIMES))]
#: Turns of a conversation that one window orders, and bytes of ids hashed as one row.
SPAN, PIECE = 256, 1 << 16


def _bases(attempt: int) -> list[int]:
    """A base for each prime; another attempt has others."""
    return [int.from_bytes(hashlib.sha256(f"{attempt}:{p}".encode()).digest()[:8], "big") % (p - 2) + 2 for p in PRIMES]


def _power(base: int, prime: int, k: Column) -> Column:
    """base**k modulo prime for k below 2**40, from the squares of base."""
    squares = F.array(*(F.lit(pow(base, 1 << i, prime)) for i in range(40)))
    bits = F.transform(squares, lambda s, i: F.when(F.getbit(k, i) == 1, s).otherwise(F.lit(1).cast("long")))
    used = F.slice(bits, 1, F.length(F.bin(k)))
    return F.aggregate(used, F.lit(1).cast("long"), lambda x, s: x * s % prime)


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, k, turn, words): the k-th turn (from 1) of conversation c; turn is a digest of its role and text.

    Turns are ordered by number, nulls first, then role and digest. Null roles and texts are empty. Rows
    without a conversation are left out, as they can't be rebuilt. Texts are read once and do not move.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    own = conversations.where(F.col(conv_col).isNotNull())
    own = own.select(F.col(conv_col).cast("string").alias("c"), F.col(turn_col).cast("long").alias("_turn"), role.alias("_role"), F.sha2(F.concat(F.octet_length(role), F.lit(":"), role, text), 256).alias("turn"), n_words(text).cast("long").alias("words"), F.monotonically_increasing_id().alias("_row"))
    placed = numbered(table(own, "turns"), "c", [F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("turn"), F.col("_row")], "k")
    return placed.select(F.col("c").cast("long").alias("c"), (F.col("k") + 1).alias("k"), "turn", "words")


def _running(rows: DataFrame, at: str, columns: list[str], backwards: bool = False) -> DataFrame:
    """rows (c, at, columns) with each column's sum up to at within c, or with backwards from at on.

    Sums are built over spans of SPAN places and then over the spans, so that a long conversation isn't one group.
    """
    order = (lambda c: F.col(c).desc()) if backwards else (lambda c: F.col(c).asc())
    inside = Window.partitionBy("c", "_span").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy("c").orderBy(order("_span")).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("_span", F.floor(F.col(at) / SPAN))
    own = own.withColumns({x: F.sum(x).over(inside) for x in columns})
    ends = (F.min_by if backwards else F.max_by)
    sums = own.groupBy("c", "_span").agg(*(ends(x, at).alias(f"_{x}") for x in columns))
    before = sums.select("c", "_span", *(F.sum(f"_{x}").over(across).alias(f"_{x}") for x in columns)).where(F.col(f"_{columns[0]}").isNotNull())
    out = own.join(before, ["c", "_span"], "left")  # only conversations of several spans
    return out.withColumns({x: F.col(x) + F.coalesce(f"_{x}", F.lit(0)) for x in columns}).drop("_span", *(f"_{x}" for x in columns))


def fingerprints(turns: DataFrame, attempt: int = 0) -> DataFrame:
    """turns with e0.. (a turn's own term) and f0.. (the fingerprint of the first k turns).

    A sequence of n turns is (n, sum of t(i) * B**i over its places i) modulo a prime, for each prime. Two
    of them are joined by (n, x) * (m, y) = (n + m, x + B**n * y), which is associative, has (0, 0) as one, and can be undone from the left.
    """
    bases = _bases(attempt)
    terms = {f"e{i}": F.pmod(F.xxhash64(F.lit(2 * attempt + 7), F.lit(i), "turn"), F.lit(p)) * _power(b, p, F.col("k")) % p for i, (b, p) in enumerate(zip(bases, PRIMES, strict=True))}
    own = turns.withColumns(terms)
    summed = _running(own.withColumns({f: F.col(f"e{i}") for i, f in enumerate(KEYS)}), "k", KEYS)
    return summed.withColumns({f: F.col(f) % p for f, p in zip(KEYS, PRIMES, strict=True)})


def rebuilt(turns: DataFrame, attempt: int = 0, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """(c, d, f0.., p0.., turn, words, whole): a row for each depth of each rebuilt conversation, the empty one included.

    f0.. is the fingerprint of its first d turns and p0.. that of one less; turn (null at depth 0) and words are those of the stored turn that
    stands at place d, and whole marks the last one. The base's head and the conversation's own
    suffix are combined by their fingerprints: the prefix up to the head is taken off a stored prefix of the conversation
    from the left, and what is left is appended to the base's head.
    """
    own = table(fingerprints(turns, attempt), "fingerprints")
    struct = F.struct("k", "turn", "words", *KEYS, *(f"e{i}" for i in range(len(PRIMES))))
    first = F.sort_array(F.collect_list(F.when(F.col("k") < heads, struct)))  # heads - 1 at most
    convs = table(own.groupBy("c").agg(F.max("k").alias("n"), first.alias("first")), "heads")
    h = F.crc32(F.col("c").cast("string").cast("binary")) % heads
    convs = convs.withColumns({"h": h, "base": F.col("c") - F.col("c") % family})
    both = convs.join(convs.select(F.col("c").alias("base"), F.col("first").alias("of_base")), "base", "left")
    zero = F.lit(0).cast("long")
    head = F.when(F.col("of_base").isNull(), F.slice("first", 1, 0)).otherwise(F.slice("of_base", 1, F.col("h").cast("int")))
    both = both.withColumn("head", head).withColumns({"g": F.size("head").cast("long"), "cut": F.slice("first", 1, F.col("h").cast("int"))})
    # a conversation's head as a product (g, x), and what its own first h turns add to its prefixes
    ends = {f"x{i}": F.coalesce(F.try_element_at("head", F.lit(-1))[f], zero) for i, f in enumerate(KEYS)} | {f"y{i}": F.coalesce(F.try_element_at("cut", F.lit(-1))[f], zero) for i, f in enumerate(KEYS)}
    both = both.withColumns(ends).withColumn("m", F.col("g") + F.greatest(F.col("n") - F.col("h"), zero))
    both = table(both.select("c", "h", "g", "m", "head", *ends), "rebuilt")
    columns = ["c", "d", *KEYS, *PARENT, "turn", "words", "whole"]
    roots = both.select("c", zero.alias("d"), *(zero.alias(f) for f in (*KEYS, *PARENT)), F.lit(None).cast("string").alias("turn"), zero.alias("words"), (F.col("m") == 0).alias("whole"))
    up = both.select("c", "m", F.posexplode("head").alias("_i", "t")).select("c", (F.col("_i") + 1).cast("long").alias("d"), "m", "t.*")
    up = up.withColumns({q: F.pmod(F.col(f) - F.col(f"e{i}"), F.lit(p)) for i, (f, q, p) in enumerate(zip(KEYS, PARENT, PRIMES, strict=True))}).withColumn("whole", F.col("d") == F.col("m"))
    rest = own.join(both.drop("head"), "c").where("k > h").withColumn("d", F.col("k") - F.col("h") + F.col("g"))
    shifted = {}
    for i, (b, p) in enumerate(zip(_bases(attempt), PRIMES, strict=True)):
        # B**(g - h): h and g are below heads
        by = F.element_at(F.array(*(F.lit(pow(b, x, p)) for x in range(1 - heads, heads))), (F.col("g") - F.col("h") + heads).cast("int"))
        whole = (F.col(f"x{i}") + F.pmod(F.col(KEYS[i]) - F.col(f"y{i}"), F.lit(p)) * by) % p
        shifted[KEYS[i]] = whole
        shifted[PARENT[i]] = F.pmod(whole - F.col(f"e{i}") * by % p, F.lit(p))
    rest = rest.withColumns(shifted | {"whole": F.col("d") == F.col("m")})
    return roots.unionByName(up.select(*columns)).unionByName(rest.select(*columns))


def _digests(ends: DataFrame) -> DataFrame:
    """(c, d, sha): the SHA-256 of the sorted, comma-joined ids of each node (given by its c and d) in ends (node_c, d, id).

    Ids are dealt by ranges, joined into pieces where they are, and the pieces of a node are hashed one after
    the other as they pass: only they meet in one task, and no more than one is held.
    """

    @tidy
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, size, n = None, [], 0, 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([place], pa.int32()), pa.array([n], pa.int64()), pa.array([",".join(own)])], names=["c", "d", "part", "n", "ids"])

        place = 0
        for batch in batches:
            for c, d, i, place in zip(*(batch[x].to_pylist() for x in ("c", "d", "id", "part")), strict=True):
                if own and ((c, d) != key or size > PIECE):
                    yield piece()
                    n, own, size = n + 1, [], 0
                key = c, d
                own.append(str(i))
                size += len(own[-1]) + 1
        if own:
            yield piece()

    @tidy
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])], names=["c", "d", "sha"])
        for batch in batches:
            for c, d, ids in zip(*(batch[x].to_pylist() for x in ("c", "d", "ids")), strict=True):
                if (c, d) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key:
                    yield row()
                key, state = (c, d), hashlib.sha256(ids.encode())
        if key:
            yield row()

    order = ["c", "d", "id"]
    dealt = ends.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, F.spark_partition_id().alias("part"))
    pieces = table(dealt.mapInArrow(joined, "c long, d long, part int, n long, ids string"), "ids")
    return pieces.repartition("c", "d").sortWithinPartitions("c", "d", "part", "n").select("c", "d", "ids").mapInArrow(hashed, "c long, d long, sha string")


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations (see rebuilt()): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Nodes are groups of equal fingerprints. Equality is verified through the turns that they refer to: if all of a
    group have the same last turn (by SHA-256) and the same parent, then, from the root on, all are equal; else
    everything is done again with other bases. A null role or text is empty, rows without a conversation
    are left out, turns of one number are ordered by role and digest, an empty table gives no nodes. Other columns are not read.

    Sums over subtrees need no walk: each node is counted at its smallest member's own chain of
    beginnings, as a running sum from the end of the chain; a node's subtree is then the sum over its members.
    """
    turns = table(turns_of(conversations, conv_col, turn_col, role_col, text_col), "ordered")
    attempt = 0
    while True:
        rows = table(rebuilt(turns, attempt, family, heads), "beginnings")
        same = [F.min(x) for x in (*PARENT, "turn")], [F.max(x) for x in (*PARENT, "turn")]
        firm = reduce(lambda a, b: a & b, (a.eqNullSafe(b) for a, b in zip(*same, strict=True)))
        nodes = rows.groupBy("d", *KEYS).agg(F.min("c").alias("c"), F.count("*").alias("n_convs"), *(F.first(p).alias(p) for p in PARENT), F.first("words").alias("words"), firm.alias("firm"))
        nodes = table(nodes, "nodes")
        if nodes.where("not firm").isEmpty():
            break
        attempt += 1
    children = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), *(F.col(p).alias(f) for f, p in zip(KEYS, PARENT, strict=True))).agg(F.count("*").alias("n_children"))
    nodes = table(nodes.join(children, ["d", *KEYS], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "children")
    own = nodes.select("c", "d", ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"), (F.col("n_children") == 0).cast("long").alias("n_leaves"))
    sums = ["saved_tokens", "n_leaves"]
    chains = rows.select("c", "d", *KEYS).join(own, ["c", "d"], "left").na.fill(0, sums)
    under = _running(chains, "d", sums, backwards=True).groupBy("d", *KEYS).agg(*(F.sum(x).alias(x) for x in sums))
    whole = rows.where("whole").select("d", *KEYS, F.col("c").alias("id")).join(nodes.select("d", *KEYS, "c"), ["d", *KEYS])
    ends = table(_digests(table(whole.select("c", "d", "id"), "ends")), "digests")
    parents = nodes.select((F.col("d") + 1).alias("d"), *(F.col(f).alias(p) for f, p in zip(KEYS, PARENT, strict=True)), F.col("c").alias("parent"))
    out = nodes.join(under, ["d", *KEYS]).join(ends, ["c", "d"], "left").join(parents, ["d", *PARENT], "left")
    sha = F.coalesce("sha", F.sha2(F.lit(""), 256))
    return out.select(F.col("c").alias(conv_col), F.col("d").alias("depth"), F.col("parent").alias(f"parent_{conv_col}"), "n_convs", "n_children", "n_leaves", "saved_tokens", sha.alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_TURN = "strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')"

ORACLE = f"""
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256({_TURN})) AS k, sha256({_TURN}) AS t,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL
), convs AS (SELECT c, c - c % {FAMILY} AS base, {CRC32.format("c")} % {HEADS} AS h FROM (SELECT DISTINCT c FROM own)),
parts AS (
  SELECT v.c, o.k, o.t, o.words, 0 AS part FROM convs v JOIN own o ON o.c = v.base AND o.k <= v.h
  UNION ALL SELECT v.c, o.k, o.t, o.words, 1 FROM convs v JOIN own o ON o.c = v.c AND o.k > v.h
), numbered AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, k) AS d, t, words FROM parts),
chains AS (
  SELECT c, d, string_agg(t, ',') OVER (PARTITION BY c ORDER BY d) AS p, coalesce(string_agg(t, ',') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS q, words FROM numbered
  UNION ALL SELECT c, 0, '', NULL, 0 FROM convs
), marked AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS whole FROM chains),
nodes AS (SELECT d, p, any_value(q) AS q, min(c) AS c, count(*) AS n, any_value(words) AS words, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (whole) AS ends FROM marked GROUP BY d, p),
children AS (SELECT d - 1 AS d, q AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
counted AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN children k ON k.d = n.d AND k.p = n.p),
under AS (SELECT a.d, a.p, sum((b.n - 1) * b.words) AS saved, count(*) FILTER (b.n_children = 0) AS leaves FROM counted b JOIN chains a ON a.c = b.c AND a.d <= b.d GROUP BY ALL)
SELECT n.c AS conv_id, n.d AS depth, up.c AS parent_conv_id, n.n AS n_convs, n.n_children, u.leaves AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM counted n JOIN under u ON u.d = n.d AND u.p = n.p LEFT JOIN counted up ON up.d = n.d - 1 AND up.p = n.q
"""
