"""Near-duplicate documents by an inverted join on MinHash signature coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import components, table
from .words import U, chunks, mix, ngrams, odd, tidy, words

SHINGLE = 5
#: Signature coordinates, and how many of them must agree. A pair at similarity 0.75 agrees in
#: Binomial(40, 0.75) of them: fewer than 17 in about 3 of a million cases, and rarer above 0.75.
COORDINATES, MATCHES = 40, 17
#: Stars drawn in each list of values, and of real shingles at most; members outside a list's largest component up to which it is paired.
STARS, MORE_STARS, OUTSIDE = 1, 4, 64
#: Bytes of compressed texts that are ordered together.
PART = 2 << 20
SIGNED = T.StructType().add("id", "long").add("n", "long").add("h1", "long").add("h2", "long").add("sig", T.ArrayType(T.LongType()))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes; a shorter text is one shingle, an empty one none."""
    first, hs = words(texts, lower=True)
    start, h = ngrams(first, hs, SHINGLE)
    cut = np.searchsorted(start, first)
    r, out = odd(SHINGLE, SHINGLE), []
    for i in range(len(texts)):
        own = h[cut[i] : cut[i + 1]]
        if not len(own) and (w := hs[first[i] : first[i + 1]]).size:
            own = mix((w * r[: len(w)]).sum(keepdims=True, dtype=U) + U(len(w)))
        out.append(np.unique(own))
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), two sums that identify the set, and its signature (empty for an empty set)."""
    factors = odd(COORDINATES, 77)

    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch, "text", 4 << 20):
                sets = shingle_sets(c["text"])
                n = np.array([len(s) for s in sets], np.int64)
                full = n > 0
                sums, sig = np.zeros((2, len(n)), U), np.zeros((int(full.sum()), COORDINATES), U)
                if full.any():
                    h = np.concatenate(sets)
                    at = (np.cumsum(n) - n)[full]
                    for k, salt in enumerate((U(0x1234567), U(0xFEDCBA9))):
                        sums[k, full] = np.add.reduceat(mix(h ^ salt), at)
                    for k, f in enumerate(factors):
                        v = h * f
                        v ^= v >> U(29)
                        v *= U(0xBF58476D1CE4E5B9)
                        sig[:, k] = (np.minimum.reduceat(v, at) & ~U(63)) | U(k)
                offsets = pa.array(np.concatenate([[0], np.cumsum(full * COORDINATES)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(sig.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([c["id"], pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists], names=SIGNED.names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(sign, SIGNED)


def squeezed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, z): the texts under zstandard, for joins that have to move them."""

    @tidy
    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["id"], pa.array([z.compress(x or b"") for x in b["text"].cast(pa.binary()).to_pylist()], pa.binary())], names=["id", "z"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(squeeze, "id long, z binary")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= 75 * union."""

    @tidy
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                seen = {i: t for k in "ab" for i, t in zip(part[k].to_pylist(), part[f"z{k}"].to_pylist(), strict=True)}
                sets = dict(zip(seen, shingle_sets(pa.array([z.decompress(t) for t in seen.values()], pa.large_binary())), strict=True))
                good = []
                for a, b in zip(part["a"].to_pylist(), part["b"].to_pylist(), strict=True):
                    x, y = sets[a], sets[b]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * both >= 75 * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    own = pairs.join(texts.select(F.col("id").alias("a"), F.col("z").alias("za")), "a").join(texts.select(F.col("id").alias("b"), F.col("z").alias("zb")), "b")
    return own.select("a", "b", "za", "zb").mapInArrow(confirm, "a long, b long")


def real_posts(texts: DataFrame) -> DataFrame:
    """(rep, n, weight, tok, place): the shingles under which two linked sets among the texts must meet.

    Ordered by their frequency among these texts, rarest first, two sets at similarity 0.75 share one of
    the first n - ceil(0.75 n) + 1 of each. Shingles of one text come first and need no posting.

    Texts are dealt into parts of a few MB and hashes into buckets, one to some parts. A part sends
    each distinct shingle once with its count, a bucket sums the counts and answers which are shared, and
    the part orders its sets: no row is made for a shingle but those that are posted.
    """
    size = texts.agg(F.sum(F.octet_length("z"))).first()[0] or 1
    parts = -(-size // PART)
    bits = max(4, parts.bit_length() - 2)
    dealt = texts.withColumn("part", F.pmod(F.xxhash64("id", F.lit(4)), F.lit(parts)).cast("int"))

    def sets_in(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, sizes, hashes) of the sets of a part."""
        z, ids, n, found = zstandard.ZstdDecompressor(), [], [], []
        for batch in t.to_batches(max_chunksize=256):
            own = shingle_sets(pa.array([z.decompress(x) for x in batch["z"].to_pylist()], pa.large_binary()))
            ids.append(batch["id"].to_numpy()), n.append([len(x) for x in own]), found.extend(own)
        return (np.concatenate(ids), np.concatenate(n), np.concatenate(found)) if ids else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U))

    def by_bucket(part: int, h: np.ndarray, count: np.ndarray) -> pa.Table:
        """Sorted hashes and their counts, a row for each bucket."""
        bucket = (h >> U(64 - bits)).astype(np.int32)
        cut = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        spans = [(s, e) for s, e in zip(cut, cut[1:], strict=False) if s < e]
        return pa.table([pa.array([part] * len(spans), pa.int32()), pa.array([int(bucket[s]) for s, _ in spans], pa.int32()), pa.array([h[s:e].tobytes() for s, e in spans], pa.binary()), pa.array([count[s:e].astype("<i8").tobytes() for s, e in spans], pa.binary())], names=["part", "bucket", "keys", "counts"])

    def count(t: pa.Table) -> pa.Table:
        return by_bucket(t["part"][0].as_py(), *np.unique(sets_in(t)[2], return_counts=True))

    def total(t: pa.Table) -> pa.Table:
        keys, counts = ([np.frombuffer(x, kind) for x in t[c].to_pylist()] for c, kind in (("keys", U), ("counts", "<i8")))
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(at, np.concatenate(counts).astype(np.float64)).astype(np.int64)
        out = []
        for part, k in zip(t["part"].to_pylist(), keys, strict=True):
            c = sums[np.searchsorted(every, k)]
            out.append(by_bucket(part, k[c > 1], c[c > 1]))
        return pa.concat_tables(out)

    def post(found: pa.Table, own: pa.Table) -> pa.Table:
        ids, n, h = sets_in(own)
        keys = np.concatenate([np.zeros(0, U), *(np.frombuffer(x, U) for x in found["keys"].to_pylist())])
        often = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, "<i8") for x in found["counts"].to_pylist())])
        order = np.argsort(keys)
        keys, often = np.append(keys[order], U(2**64 - 1)), np.append(often[order], 1)
        at = np.searchsorted(keys, h)
        c = np.where(keys[at] == h, often[at], 1)
        row = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((h, c, row))
        h, c = h[order], c[order]
        place = np.arange(len(h)) - (np.cumsum(n) - n)[row] + 1
        keep = (c > 1) & (4 * place <= 4 * n[row] - 3 * n[row] + 4)
        row = row[keep]
        return pa.table({"rep": pa.array(ids[row]), "n": pa.array(n[row].astype(np.int64)), "weight": pa.array(n[row].astype(np.int64)), "tok": pa.array(h[keep].view(np.int64)), "place": pa.array(place[keep].astype(np.int64))})

    counts = "part int, bucket int, keys binary, counts binary"
    shared = dealt.groupBy("part").applyInArrow(count, counts).groupBy("bucket").applyInArrow(total, counts)
    return shared.groupBy("part").cogroup(dealt.groupBy("part")).applyInArrow(post, "rep long, n long, weight long, tok long, place long")


class _Search:
    """Links found so far between classes with the given lists of values and texts, and what they join."""

    def __init__(self, lists: DataFrame, texts: DataFrame):
        self.lists, self.texts = lists, texts
        self.comps = None

    def _add(self, pairs: DataFrame) -> None:
        """Count the collisions of candidate pairs, confirm those above the threshold, join what they link."""
        toks = self.lists.select("rep", "toks")
        pairs = pairs.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct()
        both = pairs.join(toks.toDF("a", "x"), "a").join(toks.toDF("b", "y"), "b")
        good = table(both.where(F.size(F.array_intersect("x", "y")) >= MATCHES).select("a", "b"), "candidates")
        if good.isEmpty():
            return
        links = table(confirmed(good, self.texts), "links")
        if links.isEmpty():
            return
        if self.comps is not None:  # what was joined before, as a star for each component
            links = links.unionByName(self.comps.where("v <> c").select(F.col("v").alias("a"), F.col("c").alias("b")))
        self.comps = components(links)

    def _own(self, posts: DataFrame) -> DataFrame:
        if self.comps is None:
            return posts.withColumn("comp", F.col("rep"))
        return posts.join(self.comps, F.col("rep") == F.col("v"), "left").withColumn("comp", F.coalesce("c", "rep")).drop("v", "c")

    def settle(self, posts: DataFrame, stars: int, bound: int | None = None) -> DataFrame:
        """Find all links between members of each list; return the members of lists left out, if there is a bound.

        First a star: each list's member with the most frequent values meets all the others. Then further
        stars, if they are asked for and as long as they help: around members outside the list's largest
        component, in lists with more than OUTSIDE of them. Last, every member outside a list's largest
        component meets all members of other components, so no pair that could still join two components is
        left out. Lists with more than bound such members are not paired but returned.
        """
        before = None
        long_enough = F.expr("100 * least(x_n, y_n) >= 75 * greatest(x_n, y_n)")
        if "place" in posts.columns:  # places count from the rarest, so both sets must have enough left
            long_enough = long_enough & F.expr("175 * (1 + least(x_n - x_place, y_n - y_place)) >= 75 * (x_n + y_n)")
        columns = [c for c in ("rep", "n", "place", "comp", "top") if c in (*posts.columns, "comp", "top")]
        side = lambda df, k: df.select("tok", *(F.col(c).alias(f"{k}_{c}") for c in columns if c in df.columns))
        for turn in range(stars):
            own = self._own(posts)
            outside = own
            if turn:
                live = table(self._live(own).where(F.col("outside") > OUTSIDE), "live")
                left = live.agg(F.sum("outside")).first()[0]
                if not left or (before and left > 0.5 * before):
                    break
                before = left
                near = table(own.join(live, "tok"), "near")
                outside, own = near.where("comp <> top").drop("top", "outside"), near.drop("top", "outside")
            by = F.xxhash64("rep", F.lit(turn)) if turn else F.col("weight")
            middle = outside.groupBy("tok").agg(F.max(F.struct(by.alias("by"), *(c for c in columns if c in outside.columns))).alias("m")).select("tok", "m.*")
            self._add(side(middle, "x").join(side(own, "y"), "tok").where(F.expr("x_comp <> y_comp") & long_enough))
        own = self._own(posts)
        # only lists that join nothing yet are left, so both are small and written rather than derived again for each use
        every = table(own.join(table(self._live(own), "live"), "tok"), "near")
        near = every if bound is None else every.where(F.col("outside") <= bound)
        if not near.isEmpty():
            few = side(near.where("comp <> top"), "x")
            self._add(few.join(side(near, "y"), "tok").where(F.expr("x_comp <> y_comp and (y_comp = y_top or x_rep < y_rep)") & long_enough))
        return every.where(F.lit(False) if bound is None else F.col("outside") > bound).select("rep").distinct()

    @staticmethod
    def _live(own: DataFrame) -> DataFrame:
        """(tok, top, outside): the largest component of each list of several, and how many members are in others."""
        sizes = own.groupBy("tok", "comp").agg(F.count("*").alias("m"))
        lists = sizes.groupBy("tok").agg(F.max(F.struct("m", "comp")).alias("big"), F.sum("m").alias("all"))
        return lists.select("tok", F.col("big.comp").alias("top"), (F.col("all") - F.col("big.m")).alias("outside")).where("outside > 0")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept: one row for each row of docs.

    Documents whose sets of distinct 5-word shingles (ASCII lower case) have a similarity of 0.75 or
    more are linked; component_id is the smallest id reachable and kept marks it. Null and blank texts
    have no shingles and stay alone; so does a null id, whose component_id is null and which is kept.
    Rows sharing an id are one vertex, their links confirmed on its smallest text. Only the id and the
    text are read.

    1. Equal sets become one class, so copies are never paired.
    2. Each class is posted under its (coordinate, value) pairs. Values that one class has are skipped.
       The rest are ordered by global frequency: a pair that agrees in MATCHES of COORDINATES meets in
       the rarest (COORDINATES - MATCHES + 1) of each side, so only those postings are joined. Pairs
       that meet, each once, have their collisions counted and are confirmed on full sets.
    3. Large lists are not squared: see _Search.settle. Lists that stay large without links, such as
       those of a common notice, are joined again under real shingles, in which their members differ.
    """
    signed = table(signatures(docs, id_col, text_col), "signed")
    some = F.expr("n > 0 and id is not null")
    classes = signed.where(some).groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"))
    tokens = classes.select("rep", "n", F.explode("sig").alias("tok"))
    shared = tokens.groupBy("tok").agg(F.count("*").alias("cnt")).where("cnt > 1")
    lists = (
        tokens.join(shared, "tok")
        .groupBy("rep", "n")
        .agg(F.sort_array(F.collect_list(F.struct("cnt", "tok"))).alias("t"))
        .where(F.size("t") >= MATCHES)
        .select("rep", "n", F.col("t.tok").alias("toks"), F.expr("aggregate(t, 0L, (s, x) -> s + x.cnt)").alias("weight"))
    )
    lists = table(lists, "lists")
    named = signed.where(some).groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"))
    if lists.isEmpty():  # no two different sets can be linked; copies still are, below
        named = named.withColumnRenamed("rep", "component_id")
    else:
        texts = squeezed(docs.where(F.col(id_col).isNotNull()), id_col, text_col).join(lists.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
        texts = table(texts.groupBy("id").agg(F.min("z").alias("z")), "texts")
        search = _Search(lists, texts)
        hot = search.settle(lists.select("rep", "n", "weight", F.explode(F.expr(f"slice(toks, 1, size(toks) - {MATCHES - 1})")).alias("tok")), STARS, OUTSIDE)
        if not hot.isEmpty():
            search.settle(table(real_posts(texts.join(hot.select(F.col("rep").alias("id")), "id", "left_semi")), "posts"), MORE_STARS)
        named = named.withColumnRenamed("rep", "component_id") if search.comps is None else named.join(search.comps, F.col("rep") == F.col("v"), "left").select("h1", "h2", "n", F.coalesce("c", "rep").alias("component_id"))
    named = table(named, "named")  # read from a table, the join below can split a class with very many copies
    out = signed.drop("sig").join(named, ["h1", "h2", "n"], "left")
    out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
