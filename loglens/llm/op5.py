"""Substring dedup by fixed-block anchors."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import U, mix, ngrams, rows_of, tidy, tidy_pair, trim, words

WINDOW = 13
#: Any window of 13 words holds one whole block of 7 that starts at a multiple of 7.
BLOCK = (WINDOW + 1) // 2
FOUND = "part int, bucket int, keys binary"
PROBE = "bucket int, part int, n int, keys binary, aligned binary, several binary"
NEAR = "bucket int, part int, base long, keys binary, ids binary"


class Split:
    """How the top bits of a hash name a bucket, and the next ones a key within it."""

    def __init__(self, bits: int, width: int):
        self.bits, self.width, self.rest = bits, width, min(64 - bits, 8 * width)

    def keys(self, h: np.ndarray) -> np.ndarray:
        return h >> U(64 - self.bits - self.rest)

    def bucket(self, k: np.ndarray) -> np.ndarray:
        return (k >> U(self.rest)).astype(np.int32)

    def pack(self, k: np.ndarray) -> bytes:
        return _packed(k & U((1 << self.rest) - 1), self.width)

    def unpack(self, bucket: int, b: bytes) -> np.ndarray:
        return _unpacked(b, self.width) | U(bucket << self.rest)


def _packed(a: np.ndarray, width: int) -> bytes:
    """The low width bytes of each value."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(b: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _part(ids: np.ndarray, parts: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U)) % U(parts)).astype(np.int32)


def _spans(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal values begins and ends."""
    cut = np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(sorted_values)], strict=True)) if len(sorted_values) else []


def _starts(sorted_values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1])


def _answers(bucket: int, keys: np.ndarray, part: np.ndarray, split: Split) -> pa.Table:
    """The found keys, one record for each part that asked."""
    order = np.argsort(part, kind="stable")
    keys, part = keys[order], part[order]
    spans = _spans(part)
    return pa.table({"part": pa.array([int(part[s]) for s, _ in spans], pa.int32()), "bucket": pa.array([bucket] * len(spans), pa.int32()), "keys": pa.array([split.pack(keys[s:e]) for s, e in spans], pa.binary())})


def _asked(t: pa.Table, split: Split) -> np.ndarray:
    """Sorted keys of the answers to one part."""
    found = [split.unpack(r["bucket"], r["keys"]) for r in t.select(["bucket", "keys"]).to_pylist()]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, U)


def _among(k: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(asked):
        return np.zeros(len(k), bool)
    return asked[np.minimum(np.searchsorted(asked, k), len(asked) - 1)] == k


def _texts(t: pa.Table) -> pa.Array:
    z = zstandard.ZstdDecompressor()
    return pa.array([z.decompress(b) if b is not None else None for b in t["z"].to_pylist()], pa.large_binary())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), cleaned: bool = False) -> DataFrame:
    """One row for each row of docs: id, the columns named in carry, n_words, n_removed, kept; with cleaned
    also cleaned, the text as it was where nothing goes, else kept.

    A word goes if it lies in a window of 13 words whose word sequence also starts in a document with a
    smaller id. kept holds the other words joined by one space; it is '' for a null or blank text.
    Rows with the same id never remove words of each other. A null id neither removes nor loses words.
    Columns of docs that are not named are not read, so their names don't matter.

    Documents are dealt by a hash of id and text into parts of a few MB, so rows of one id or of none are split, and hashes into buckets; both are as
    many as the corpus needs, so groups keep one size at every scale.

    1. Index and probe: each part sends its distinct rolling blocks of 7 words to their buckets, marked
       where one starts at a multiple of 7 (the index) and where several of the part's documents have
       it. A bucket answers which blocks are indexed somewhere and in two documents at least. Hashes are
       cut to the width that the corpus needs; a false answer costs work only.
    2. Extend: a part takes all windows of 13 words around its answered blocks and sends each distinct
       64-bit fingerprint with the smallest id of its own; a bucket answers which a smaller id also has.
    3. Each part rewrites its documents. Adjacent windows overlap, so what goes are maximal repeats.

    A block or window that very many documents share is one entry for each part, not for each document,
    and no pair of documents is ever made.
    """
    stats = docs.agg(F.sum(F.octet_length(text_col)).alias("b")).first()
    total = max(int(stats["b"] or 0), 1)
    n_words = max(total / 6, 2)
    bits = max(6, math.ceil(math.log2(n_words / 2**19)))
    parts = max(1, math.ceil(total / (4 << 20)))
    width = min(8, max(2, math.ceil((math.log2(n_words / BLOCK) + 8 - bits) / 8)))
    wide = min(8, math.ceil((2 * math.log2(n_words) + 20 - bits) / 8))
    kept = [f"k{i}" for i in range(len(carry))]

    seven, thirteen = Split(bits, width), Split(bits, wide)
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(k) for k, c in zip(kept, carry, strict=True)))
    nothing = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("base", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary())])

    def loaded(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, hashes) of a part's documents that have an id."""
        t = t.filter(t["id"].is_valid())
        return t["id"].to_numpy(), *words(_texts(t))

    def probe(t: pa.Table) -> pa.Table:
        trim()
        ids, first, hs = loaded(t)
        start, h = ngrams(first, hs, BLOCK)
        row = rows_of(first, start)
        long = np.diff(first)[row] >= WINDOW
        start, row, k = start[long], row[long], seven.keys(h[long])
        order = np.argsort(k, kind="stable")
        k, who, index = k[order], ids[row][order], ((start - first[row]) % BLOCK == 0)[order]
        out: list[list] = [[] for _ in range(6)]
        if len(k):
            at = _starts(k)
            aligned, several, k = np.logical_or.reduceat(index, at), np.minimum.reduceat(who, at) != np.maximum.reduceat(who, at), k[at]
            bucket, part = seven.bucket(k), t["part"][0].as_py()
            for s, e in _spans(bucket):
                for o, v in zip(out, (int(bucket[s]), part, e - s, seven.pack(k[s:e]), np.packbits(aligned[s:e]).tobytes(), np.packbits(several[s:e]).tobytes()), strict=True):
                    o.append(v)
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(o, x) for o, x in zip(out, kinds, strict=True)], names=["bucket", "part", "n", "keys", "aligned", "several"])

    def meet(key: tuple, t: pa.Table) -> pa.Table:
        rows, bucket = t.to_pylist(), key[0].as_py()
        bit = lambda r, c: np.unpackbits(np.frombuffer(r[c], np.uint8), count=r["n"]).astype(bool)
        k = np.concatenate([seven.unpack(bucket, r["keys"]) for r in rows])
        part = np.repeat([r["part"] for r in rows], [r["n"] for r in rows])
        aligned, several = (np.concatenate([bit(r, c) for r in rows]) for c in ("aligned", "several"))
        order = np.argsort(k, kind="stable")
        k, part, aligned, several = k[order], part[order], aligned[order], several[order]
        at = _starts(k)
        sizes = np.diff(at, append=len(k))
        good = np.repeat(np.logical_or.reduceat(aligned, at) & (np.logical_or.reduceat(several, at) | (sizes > 1)), sizes)
        return _answers(bucket, k[good], part[good], seven)

    def extend(found: pa.Table, own: pa.Table) -> pa.Table:
        trim()
        if not found.num_rows or not own.num_rows:
            return nothing.empty_table()
        ids, first, hs = loaded(own)
        start, h = ngrams(first, hs, BLOCK)
        hit = np.zeros(len(hs) + WINDOW, np.int64)
        hit[start[_among(seven.keys(h), _asked(found, seven))] + 1] = 1
        hits = np.cumsum(hit)
        start, h = ngrams(first, hs, WINDOW)
        near = hits[start + WINDOW - BLOCK + 1] > hits[start]
        start, k = start[near], thirteen.keys(h[near])
        if not len(k):
            return nothing.empty_table()
        order = np.argsort(k, kind="stable")
        k, who = k[order], ids[rows_of(first, start)][order]
        at = _starts(k)
        k, who, base = k[at], np.minimum.reduceat(who, at), int(ids.min())
        size = max(1, (int(ids.max()) - base).bit_length() + 7 >> 3)
        bucket, part = thirteen.bucket(k), own["part"][0].as_py()
        rows = [{"bucket": int(bucket[s]), "part": part, "base": base, "keys": thirteen.pack(k[s:e]), "ids": _packed((who[s:e] - base).view(U), size)} for s, e in _spans(bucket)]
        return pa.Table.from_pylist(rows, schema=nothing)

    def decide(key: tuple, t: pa.Table) -> pa.Table:
        rows, bucket = t.to_pylist(), key[0].as_py()
        keys = [thirteen.unpack(bucket, r["keys"]) for r in rows]
        who = np.concatenate([_unpacked(r["ids"], len(r["ids"]) // len(k)).view(np.int64) + r["base"] for r, k in zip(rows, keys, strict=True)])
        part, k = np.repeat([r["part"] for r in rows], [len(x) for x in keys]), np.concatenate(keys)
        order = np.argsort(k, kind="stable")
        k, who, part = k[order], who[order], part[order]
        at = _starts(k)
        late = who > np.repeat(np.minimum.reduceat(who, at), np.diff(at, append=len(k)))
        return _answers(bucket, k[late], part[late], thirteen)

    @tidy_pair
    def rewrite(found: pa.Table, own: pa.Table) -> pa.Table:
        trim()
        texts, valid = _texts(own), own["id"].is_valid().to_numpy(zero_copy_only=False) if own.num_rows else np.zeros(0, bool)
        ids = own["id"].fill_null(0).to_numpy()
        first, hs = words(texts)
        start, h = ngrams(first, hs, WINDOW)
        row = rows_of(first, start)
        start, row, k = start[valid[row]], row[valid[row]], thirteen.keys(h[valid[row]])
        edge = np.zeros(len(hs) + WINDOW + 1, np.int64)
        if len(k):
            order = np.argsort(k, kind="stable")
            at, who = _starts(k[order]), ids[row][order]
            gone = np.zeros(len(k), bool)
            gone[order] = who > np.repeat(np.minimum.reduceat(who, at), np.diff(at, append=len(k)))
            gone |= _among(k, _asked(found, thirteen))
            np.add.at(edge, start[gone], 1)
            np.add.at(edge, start[gone] + WINDOW, -1)
        cover = np.cumsum(edge) > 0
        out: list[list] = [[], [], []]
        for i, text in enumerate(texts.to_pylist()):
            own_words = (text or b"").split()
            left = own_words
            if (c := cover[first[i] : first[i + 1]]).any():
                left = [w for w, g in zip(own_words, c.tolist(), strict=True) if not g]
            for o, v in zip(out, (len(own_words), len(own_words) - len(left), b" ".join(left)), strict=True):
                o.append(v)
        last = {"cleaned": pa.array([None if t is None else k if n else t for t, k, n in zip(texts.to_pylist(), out[2], out[1], strict=True)], pa.binary()).cast(pa.string())} if cleaned else {}
        return pa.table({"id": own["id"], **{k: own[k] for k in kept}, "n_words": pa.array(out[0], pa.int64()), "n_removed": pa.array(out[1], pa.int64()), "kept": pa.array(out[2], pa.binary()).cast(pa.string()), **last})

    @tidy
    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            packed = pa.array([z.compress(x) if x is not None else None for x in b["text"].cast(pa.binary()).to_pylist()], pa.binary())
            ids = b["id"].fill_null(0).to_numpy(zero_copy_only=False)
            sums = np.array([zlib.crc32(x) if x is not None else 0 for x in packed.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(_part(ids + (sums << 31), parts), pa.int32()), b["id"], packed, *(b[k] for k in kept)], names=["part", "id", "z", *kept])

    place = T.StructType().add("part", "integer").add("id", "long").add("z", "binary")
    result = T.StructType().add("id", "long")
    for k, c in zip(kept, carry, strict=True):
        place, result = place.add(k, docs.schema[c].dataType), result.add(k, docs.schema[c].dataType)
    result = result.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    result = result.add("cleaned", "string") if cleaned else result
    dealt = narrow.mapInArrow(squeeze, place)  # the three groupings below share its one shuffle

    found = dealt.groupBy("part").applyInArrow(probe, PROBE).groupBy("bucket").applyInArrow(meet, FOUND)
    near = found.groupBy("part").cogroup(dealt.groupBy("part")).applyInArrow(extend, NEAR)
    gone = near.groupBy("bucket").applyInArrow(decide, FOUND)
    done = gone.groupBy("part").cogroup(dealt.groupBy("part")).applyInArrow(rewrite, result)
    return done.select(F.col("id").alias(id_col), *(F.col(k).alias(c) for k, c in zip(kept, carry, strict=True)), "n_words", "n_removed", "kept", *(["cleaned"] if cleaned else []))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
