"""Near-duplicate vectors by a pigeonhole join over subspaces."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import components, table

COSINE = 0.9
#: Dimensions of a block.
BLOCK = 32
#: Vectors of one cell that are held in memory together, and those from which the cells of each length are cut.
CHUNK, SAMPLE = 8192, 16_384
#: Probing vectors, and vectors at home, compared at once: their distances fit in a processor's cache.
STEP, TILE = 512, 1024


@lru_cache(8)
def rotation(n: int) -> np.ndarray:
    """A fixed random rotation, so that every block gets its share of any vector's length."""
    q, r = np.linalg.qr(np.random.default_rng(20).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, n): usable vectors as bytes. Null, zero, empty or non-finite ones are left out.

    Columns of floats stay floats; all others become doubles.
    """
    kind = numpy_kind(df, vec_col)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, v in zip(batch["id"].to_pylist(), batch["v"], strict=True):
                if i is None or not v.is_valid or v.values.null_count or not len(v.values):
                    continue
                a = v.values.to_numpy(zero_copy_only=False).astype(kind)
                if np.isfinite(a).all() and a.any():
                    out.append((i, a.tobytes(), len(a)))
            columns = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int32()), strict=True)], names=["id", "v", "n"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).mapInArrow(pick, "id long, v binary, n int")


def numpy_kind(df: DataFrame, vec_col: str) -> type:
    return np.float32 if isinstance(getattr(df.schema[vec_col].dataType, "elementType", None), T.FloatType) else np.float64


def unit(raw: list[bytes], n: int, kind: type) -> np.ndarray:
    """Unit vectors in double precision."""
    v = np.frombuffer(b"".join(raw), kind).reshape(-1, n).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Cells:
    """A block's space cut into cells by medians of a sample, each time along the dimension that spreads most.

    Cells are numbered from left to right; every point lies in one. Only how the work is cut depends on the sample.
    """

    def __init__(self, points: np.ndarray, depth: int):
        d = points.shape[1]
        self.depth, self.along, self.at = depth, np.zeros(1 << depth, np.int64), np.full(1 << depth, np.inf)
        self.low, self.high = np.full((2 << depth, d), -np.inf), np.full((2 << depth, d), np.inf)
        own = {1: points}
        for node in range(1, 1 << depth):
            p = own.pop(node)
            k = int(np.argmax(p.std(axis=0))) if len(p) else 0
            cut = float(np.median(p[:, k])) if len(p) else 0.0
            self.along[node], self.at[node] = k, cut
            for side in (0, 1):
                child = 2 * node + side
                self.low[child], self.high[child] = self.low[node], self.high[node]
                (self.low if side else self.high)[child, k] = cut
                own[child] = p[(p[:, k] >= cut) == bool(side)]

    def home(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (x[np.arange(len(x)), self.along[node]] >= self.at[node])
        return node - (1 << self.depth)

    def near(self, x: np.ndarray, squared: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cells): the cells above its own that each point's ball reaches."""
        row, node = np.arange(len(x)), np.ones(len(x), np.int64)
        for _ in range(self.depth):
            row, node = np.repeat(row, 2), np.stack([2 * node, 2 * node + 1], axis=1).ravel()
            out = np.maximum(np.maximum(self.low[node] - x[row], x[row] - self.high[node]), 0.0)
            keep = (out * out).sum(axis=1) <= squared
            row, node = row[keep], node[keep]
        cell = node - (1 << self.depth)
        above = cell > self.home(x)[row]
        return row[above], cell[above]


def cells_of(classes: DataFrame, kind: type) -> dict[tuple[int, int], Cells]:
    """Cells of each length with more than CHUNK vectors, and of each of its blocks, from SAMPLE vectors with the smallest hashes."""
    out = {}
    for r in classes.groupBy("n").count().where(F.col("count") > CHUNK).collect():  # a row for each length
        n = r["n"]
        raw = [bytes(x["v"]) for x in classes.where(F.col("n") == n).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()]
        x = unit(raw, n, kind) @ rotation(n)
        depth = min(math.ceil(math.log2(r["count"] / CHUNK)), int(math.log2(max(len(raw) / 16, 1))))
        out.update({(n, b): Cells(x[:, b * BLOCK : (b + 1) * BLOCK], depth) for b in range(-(-n // BLOCK))})
    return out


def links(classes: DataFrame, cosine: float = COSINE, kind: type = np.float64) -> DataFrame:
    """(id, links, root): for each vector and group, the weight it is linked to and the smallest id joined.

    Two unit vectors at the cosine or closer have a squared distance of 2 - 2 * cosine at most, so in one
    of the blocks of their rotated forms it is at most that divided by the number of blocks. Each block's
    space is cut into cells over all its dimensions; a vector is at home in one and probes those cells
    above it that the ball with the block's radius reaches, so partners meet in the cell of one of them. A
    group is up to CHUNK vectors of a cell; the later chunks and the probes stream by, block distances are
    compared, and what is within the budget is checked on whole vectors. A pair counts in the first block
    that has it within the budget, so each is counted once and none has to be written: a group returns
    sums and a spanning forest.
    """
    budget_of = lambda blocks: (2 - 2 * cosine) / blocks
    cells = cells_of(classes, kind)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["n"].to_numpy()
            for n in np.unique(sizes).tolist():
                own = batch.filter(pa.array(sizes == n))
                x = unit(own["v"].to_pylist(), n, kind) @ rotation(n)
                blocks = -(-n // BLOCK)
                for b in range(blocks):
                    home, row, reach = np.zeros(len(own), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                    if c := cells.get((n, b)):
                        part = x[:, b * BLOCK : (b + 1) * BLOCK]
                        home, (row, reach) = c.home(part), c.near(part, budget_of(blocks) + 1e-7)
                    every = pa.array(np.concatenate([np.arange(len(own)), row]))
                    probe = np.repeat([0, 1], [len(own), len(row)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*(own[c].take(every) for c in ("id", "w", "v", "n")), pa.array(np.full(len(every), b, np.int32)), pa.array(np.concatenate([home, reach])), pa.array(probe)], names=["id", "w", "v", "n", "block", "cell", "probe"])

    placed = classes.select("id", "w", "v", "n").mapInArrow(place, "id long, w long, v binary, n int, block int, cell long, probe int")
    cell = ["n", "block", "cell"]
    counts = table(placed.where("probe = 0").groupBy(*cell).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "cells")
    own = placed.join(counts, cell).withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    # at home in its chunk, a probe in the chunks before it; from other cells, a probe in all of them
    chunk = F.when(F.col("probe") == 0, F.sequence(F.lit(0), F.col("own"))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    rows = own.withColumn("chunk", F.explode(chunk)).withColumn("probe", F.when((F.col("probe") == 0) & (F.col("chunk") == F.col("own")), 0).otherwise(1))
    group = [*cell, "chunk"]
    rows = rows.select("id", "w", "v", *group, "probe").repartition(*group).sortWithinPartitions(*group, "probe")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys = np.stack([batch[c].to_numpy() for c in (*group, "probe")])
            cut = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(cut, cut[1:], strict=False):
                if s == e:
                    continue
                now, part = tuple(keys[:-1, s].tolist()), batch.slice(s, e - s)
                if now != key:
                    if state:
                        yield state.result()
                    key, state = now, _Group(now[0], now[1], budget_of(-(-now[0] // BLOCK)), cosine, kind)
                state.add(part, bool(keys[-1, s]))
        if state:
            yield state.result()

    return rows.mapInArrow(join, "id long, links long, root long")


class _Group:
    """One chunk of a cell and what it has been linked to."""

    def __init__(self, n: int, block: int, budget: float, cosine: float, kind: type):
        self.n, self.block, self.budget, self.cosine, self.kind = n, block, budget, cosine, kind
        self.turn, self.sums, self.edges = rotation(n), {}, []
        self.raw: list = []
        self.home = None

    def _load(self, ids: list, weights: list, raw: list):
        """ids, weights, unit vectors, and two forms of the block whose product is half the squared distance, negated."""
        u = unit(raw, self.n, self.kind)
        own = u @ self.turn[:, self.block * BLOCK : (self.block + 1) * BLOCK]
        half, one = (own**2).sum(axis=1, keepdims=True) / 2, np.ones((len(own), 1))
        return np.array(ids), np.array(weights), u, np.hstack([own, -half, -one]).astype(np.float32), np.hstack([own, one, half]).astype(np.float32)

    def add(self, part: pa.RecordBatch, probe: bool) -> None:
        rows = [part[c].to_pylist() for c in ("id", "w", "v")]
        if not probe:
            self.raw += zip(*rows, strict=True)
            return
        self._ready()
        if self.home is not None:
            for at in range(0, len(rows[0]), STEP):
                self._compare(self._load(*(r[at : at + STEP] for r in rows)), 0)

    def _ready(self) -> None:
        if self.raw:
            self.home, self.raw = self._load(*map(list, zip(*self.raw, strict=True))), []
            for at in range(0, len(self.home[0]), STEP):
                self._compare(tuple(x[at : at + STEP] for x in self.home), at + 1)

    def _compare(self, other: tuple, above: int) -> None:
        """above: 0 for probes, else one more than the place where other begins in home, of which each pair counts once."""
        least = -(self.budget / 2 + 1e-5)
        for at in range(0, len(self.home[0]), TILE):
            close = other[3] @ self.home[4][at : at + TILE].T >= least
            if not close.any():
                continue
            i, j = np.nonzero(close)
            j += at
            if above:
                later = j > i + above - 1
                i, j = i[later], j[later]
            for k in range(0, len(i), 1 << 16):
                self._verify(other, i[k : k + (1 << 16)], j[k : k + (1 << 16)])

    def _verify(self, other: tuple, i: np.ndarray, j: np.ndarray) -> None:
        ids, weights, u = self.home[:3]
        good = (other[2][i] * u[j]).sum(1) >= self.cosine
        i, j = i[good], j[good]
        if not len(i):
            return
        apart = ((other[2][i] - u[j]) @ self.turn) ** 2
        by = np.add.reduceat(apart, range(0, self.n, BLOCK), axis=1)
        first = np.argmax(by <= self.budget * (1 + 1e-9) + 1e-12, axis=1) == self.block
        i, j = i[first], j[first]
        a, b = other[0][i], ids[j]
        for x, w in ((a, weights[j]), (b, other[1][i])):
            k, inv = np.unique(x, return_inverse=True)
            for y, s in zip(k.tolist(), np.bincount(inv, w).astype(np.int64).tolist(), strict=True):
                self.sums[y] = self.sums.get(y, 0) + s
        self.edges.append(np.unique(_roots(np.stack([a, b])), axis=1))

    def result(self) -> pa.RecordBatch:
        self._ready()
        root = {}
        if self.edges:
            v, r = _roots(np.concatenate(self.edges, axis=1))
            root = dict(zip(v.tolist(), r.tolist(), strict=True))
        k = list(self.sums)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array([self.sums[x] for x in k], pa.int64()), pa.array([root[x] for x in k], pa.int64())], names=["id", "links", "root"])


def _roots(edges: np.ndarray) -> np.ndarray:
    """Each vertex of the edges with the smallest one it reaches."""
    names, at = np.unique(edges, return_inverse=True)
    at = at.reshape(2, -1)
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[at[0]], root[at[1]])
        new = root.copy()
        np.minimum.at(new, at[0], low)
        np.minimum.at(new, at[1], low)
        new = new[new]
        if (new == root).all():
            return np.stack([names, names[root]])
        root = new


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept), one row for each row of df.

    Vectors whose cosine reaches the threshold are linked, whatever their other columns. Equal vectors
    are one class with a weight first, so copies are never compared. Vectors of different lengths aren't
    linked; null, empty, zero ones and those with a null or non-finite component stay alone, as does a
    null id (its component_id is null and kept true). Identical repeated rows are one vector; rows that
    share an id with different vectors are one vertex whose links are added up.
    """
    good = table(vectors(df, id_col, vec_col).distinct(), "vectors")
    classes = good.groupBy("v", "n").agg(F.min("id").alias("id"), F.count("*").alias("w"))
    classes = table(classes, "classes")
    found = table(links(classes, cosine, numpy_kind(df, vec_col)), "found")
    comps = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    of_class = classes.join(sums, "id", "left").join(comps.withColumnRenamed("v", "vertex"), F.col("id") == F.col("vertex"), "left")
    of_class = of_class.select("v", F.coalesce("c", "id").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"))
    of_id = good.select("id", "v").join(of_class, "v").groupBy("id").agg(F.sum("links").alias("n_links"), F.min("c").alias("component_id"))
    out = df.select(F.col(id_col).cast("long").alias("id")).join(of_id, "id", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_col)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
