"""Best-fit packing of tokenized documents into sequences."""

from __future__ import annotations

import math
import re
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import table
from .words import U, chunks, encoded, hashed, raw, spans, tidy, tokenizer

LENGTH, END = 2048, 0
#: Pieces packed together by one task at a time. Each such shard leaves about one sequence unfilled.
SHARD = 4096
#: Words that a worker remembers at most, those used last.
REMEMBERED = 600_000
#: Bytes of text encoded at once.
CHUNK = 2 << 20
#: Letters that stay themselves one by one.
LETTERS = re.compile("[a-zà-öø-ÿ]+")
#: Marks that may follow a word, and what they must follow to be told apart.
MARKED, SOLID = np.zeros(256, bool), np.zeros(256, bool)
MARKED[list(b".,;:!?#$%&*")] = True
SOLID[list(string.ascii_letters.encode() + string.digits.encode())] = True


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts from remembered ids of their words, gathered without a Python object for each word.

    The vocabulary drops white space and never merges across it; within a word it lower-cases, splits
    letters and digits from other characters, and marks the token that ends each part. So a word and the
    marks after it have the same ids apart, and many runs of letters can be encoded as one text and told
    apart by the marked tokens.

    Words are told apart by 64-bit hashes of their bytes, A-Z in lower case. What is remembered are sorted hashes and, for
    each, a slice of one array of ids.
    """

    def __init__(self, path: str):
        self.model = tokenizer(path)
        self.ends = np.zeros(self.model.get_vocab_size(), bool)
        self.ends[[i for t, i in self.model.get_vocab().items() if t.endswith("</w>")]] = True
        self.keys, self.size, self.used, self.ids = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.turn = 0

    def _runs(self, runs: list[str]) -> dict[str, bytes]:
        """Ids of runs of letters, encoded together; each has the tokens up to a marked one."""
        groups, out = [runs[at : at + 200] for at in range(0, len(runs), 200)], {}
        for some, found in zip(groups, encoded(self.model, [" ".join(g) for g in groups], 20), strict=True):
            ids = np.array(found.ids, "<u4")
            cut = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
            data = ids.tobytes()
            out.update((run, data[s:e]) for run, s, e in zip(some, cut[:-1], cut[1:], strict=True))
        return out

    def _new(self, every: list[str]) -> list[bytes]:
        """The ids of words."""
        runs = [w for w in every if LETTERS.fullmatch(w)]
        found = self._runs(runs)
        rest = [w for w in every if w not in found]
        found.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(rest, encoded(self.model, rest, 4000), strict=True))
        return [found[w] for w in every]

    def _learn(self, keys: np.ndarray, found: list[bytes]) -> None:
        """Add words that aren't known; if there are too many, those used longest ago go."""
        size = np.array([len(x) // 4 for x in found], np.int64)
        ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), "<u4")])
        keys, size, used = np.concatenate([self.keys, keys]), np.concatenate([self.size, size]), np.concatenate([self.used, np.full(len(keys), self.turn)])
        begin = np.cumsum(size) - size
        if len(keys) > REMEMBERED:
            last = np.sort(used)[-REMEMBERED // 2]
            keep = np.flatnonzero((used >= last) | (used == self.turn))
            keys, size, used, begin = keys[keep], size[keep], used[keep], begin[keep]
        order = np.argsort(keys)
        self.keys, self.size, self.used = keys[order], size[order], used[order]
        self.ids = ids[_slices(begin[order], self.size)]
        self.begin = np.cumsum(self.size) - self.size

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(cut, ids): row i has ids[cut[i]:cut[i + 1]], of which the last is END."""
        self.turn += 1
        data, off = raw(texts)
        first, starts, ends = _marks_apart(data, *spans(data, off))
        hashes = hashed(data, starts, ends, lower=True)
        if len(special := np.flatnonzero(data == 60)):  # special tokens are told from other words by their case
            some = np.unique(np.searchsorted(starts, special, "right") - 1)
            hashes[some] = hashed(data, starts[some], ends[some]) + U(1)
        keys, where, at = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(place, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        self.used[place[known]] = self.turn
        if not known.all():
            s, e, blob = starts[where[~known]].tolist(), ends[where[~known]].tolist(), data.tobytes()
            low = blob.lower()
            self._learn(keys[~known], self._new([(w if b"<" not in (w := low[x:y]) else blob[x:y]).decode() for x, y in zip(s, e, strict=True)]))
            place = np.searchsorted(self.keys, keys)
        size, begin = (self.size[place][at], self.begin[place][at]) if len(keys) else (np.zeros(0, np.int64),) * 2
        ids = self.ids[_slices(begin, size)]
        ends = np.concatenate([[0], np.cumsum(size)])[first[1:]]  # where each row's END goes
        return np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]), np.insert(ids, ends, np.uint32(END))


def _marks_apart(data: np.ndarray, first: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """spans() with the marks that follow a letter or digit at a word's end as words of their own."""
    if not len(starts):
        return first, starts, ends
    other = np.arange(1, len(data) + 1, dtype=np.int32)
    other[MARKED[data]] = 0
    core = np.maximum.accumulate(other, out=other)[ends - 1].astype(np.int64)  # where the last other character before the word's end stops
    cut = (core < ends) & (core > starts) & SOLID[data[core - 1]]
    n = 1 + cut
    place = np.cumsum(n) - n
    new = np.repeat(np.arange(len(starts)), n)
    s, e = starts[new], ends[new]
    e[place[cut]], s[place[cut] + 1] = core[cut], core[cut]
    return np.concatenate([[0], np.cumsum(n)])[first], s, e


def _slices(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all slices of an array that begin there and have these sizes."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each Python worker, so that its tasks share what it remembers."""
    return Encoder(path)


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids, cut only where they exceed the length."""

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for whole in batches:
            for batch in chunks(whole, "text", CHUNK):
                at, ids = encode(batch["text"])
                count = np.diff(at)
                many = -(-count // length)
                row = np.repeat(np.arange(len(count)), many)
                piece = np.arange(len(row)) - (np.cumsum(many) - many)[row]
                start = piece * length
                size = np.minimum(length, count[row] - start)
                data, begin = memoryview(ids.astype("<u4", copy=False).tobytes()), ((at[:-1][row] + start) * 4).tolist()
                crc = [zlib.crc32(data[s : s + n]) for s, n in zip(begin, (size * 4).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, "id long, piece int, start long, length long, ids_crc32 long")


def fill(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece: largest first into one bin at a time, then the best two fit.

    A bin takes the largest piece that still fits, again and again. With a gap left, its smallest piece
    gives way to two unpacked ones where they fill the widened gap better.
    """
    order = np.argsort(-sizes, kind="stable")
    left = [[] for _ in range(length + 1)]
    for i in order[::-1]:
        left[sizes[i]].append(i)
    count = np.array([len(x) for x in left])
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    rest, n = len(sizes), 0

    def largest(room: int) -> int:
        found = np.flatnonzero(count[1 : room + 1])
        return int(found[-1]) + 1 if len(found) else 0

    while rest:
        own, room = [], length
        while room and (size := largest(room)):
            own.append(size)
            count[size] -= 1
            room -= size
        if room and len(own) > 1:
            wide = room + own[-1]
            there = np.flatnonzero(count[: wide + 1])
            if len(there):
                partner = np.searchsorted(there, wide - there, "right") - 1
                good = partner >= 0
                a, b = there[good], there[partner[good]]
                good = (a != b) | (count[a] > 1)
                a, b = a[good], b[good]
                if len(a) and (best := int(np.argmax(a + b))) >= 0 and a[best] + b[best] > own[-1]:
                    count[own.pop()] += 1
                    for size in (int(a[best]), int(b[best])):
                        own.append(size)
                        count[size] -= 1
        at = 0
        for size in own:
            i = left[size].pop()
            bins[i], offsets[i] = n, at
            at += size
        rest -= len(own)
        n += 1
    return bins, offsets


def pack(cut: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """cut with sequence_id and offset added.

    Pieces are dealt by hash into shards of about the given size, whatever their documents, sources or
    sizes, and each shard is packed alone. The hash covers a row's number, which is the same whenever the
    files of the given table are read, so repeated rows and null ids are dealt like any others.
    """
    total = cut.count()
    shards = max(1, math.ceil(total / shard))
    names = [f.name for f in cut.schema]

    def packed(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = fill(t["length"].to_numpy(), length)
        base = t["shard"][0].as_py() << 32
        return pa.table({**{k: t[k] for k in names}, "sequence_id": pa.array(bins + base), "offset": pa.array(offsets)})

    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("id", "piece", F.monotonically_increasing_id()), F.lit(shards)).cast("long"))
    schema = cut.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema
    return dealt.groupBy("shard").applyInArrow(packed, schema)


def packed_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each piece of each document with its sequence and its place there.

    A null or blank text is one piece that holds the end id alone; a null id stays null. An empty table
    gives no pieces. Only the id and the text are read. Texts are tokenized once: pieces, a few numbers
    each, are written before they are counted and packed.
    """
    cut = table(pieces(docs, path or vocabulary(), id_col, text_col), "pieces")
    return pack(cut).withColumnRenamed("id", id_col)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
