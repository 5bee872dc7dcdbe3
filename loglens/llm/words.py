"""Words of whole Arrow batches as 64-bit hashes, without a Python object for each word.

A word is a run of bytes other than space and 0x09-0x0D. Its hash is a polynomial in its bytes modulo
2**64, taken from running sums, so a batch of any texts takes a few numpy passes.
"""

from __future__ import annotations

import ctypes
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Any odd numbers do, as long as they never change.
BASE, INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes hashed at once: bounds the tables of powers.
SPAN = 1 << 20
_powers: dict[str, np.ndarray] = {}


def tidy(f):
    """A function of Arrow batches that gives its memory back when its partition ends: Python workers are reused, and
    what one stage has left free in its allocators would count beside the next stage's."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            trim()

    return run


def tidy_pair(f):
    """tidy() for a function of two Arrow tables."""

    @functools.wraps(f)
    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        try:
            return f(a, b)
        finally:
            trim()

    return run


def tokenizer(path: str):
    """The tokenizer of a file, on one thread: a task has one core, and each further thread's allocator would keep memory of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_padding(), model.no_truncation()
    return model


def encoded(model, texts: list[str], most: int) -> Iterator:
    """The tokenizer's encodings of texts, only so many at a time, as each is far larger than its ids."""
    for at in range(0, len(texts), most):
        yield from model.encode_batch_fast(texts[at : at + most], add_special_tokens=False)


def trim() -> None:
    pa.default_memory_pool().release_unused()
    if trimmer := _libc():
        trimmer(0)


@functools.cache
def _libc():
    """glibc's malloc_trim, or None elsewhere."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None


def mix(h: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all its bits."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(29)
    h *= U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(32))


def odd(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * BASE + U(seed)) | U(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and INVERSE from 0 on. Only SPAN of each are kept, so a very long word leaves nothing behind."""
    if not _powers or n > SPAN:
        found = []
        for x in (BASE, INVERSE):
            p = np.full(n, x, U)
            p[0] = 1
            found.append(np.cumprod(p, dtype=U))
        if n > SPAN:
            return found[0], found[1]
        _powers["up"], _powers["down"] = found
    return _powers["up"][:n], _powers["down"][:n]


def chunks(batch: pa.RecordBatch, text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most limit bytes of text, or of one row."""
    size = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and where each begins (nulls: empty)."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, starts, ends): row i has the words whose bytes are data[starts[j]:ends[j]], first[i] <= j < first[i + 1]."""
    if not len(data):
        return np.zeros(len(off), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = BLANK[data[:-1]]
    edge[off] = True
    solid = ~BLANK[data]
    starts = np.flatnonzero(solid & edge[:-1])
    edge[:-1] = BLANK[data]
    edge[off] = True
    ends = np.flatnonzero(solid & edge[1:]) + 1
    return np.searchsorted(starts, off), starts, ends


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """The hash of each of the words between these ascending places."""
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SPAN, "right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        part = data[lo:hi]
        up, down = powers(max(SPAN, hi - lo))
        sums = np.zeros(hi - lo + 1, U)
        terms = (LOWER[part] if lower else part).astype(U)
        terms += U(1)
        terms *= up[: hi - lo]
        np.cumsum(terms, out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U)
        at = to
    return mix(out)


def words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(first, hashes): row i has the words hashes[first[i]:first[i + 1]]."""
    data, off = raw(texts)
    first, starts, ends = spans(data, off)
    return first, hashed(data, starts, ends, lower)


def ngrams(first: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every run of n words within a row; start counts words of the batch."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    last = np.repeat(first[1:], np.diff(first)) - n
    start = np.flatnonzero(np.arange(len(hashes)) <= last)
    h = np.zeros(len(hashes) - n + 1, U)
    for j, r in enumerate(odd(n, n)):
        h += hashes[j : len(h) + j] * r
    return start, mix(h[start])


def rows_of(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The row to which each word position belongs."""
    return np.searchsorted(first, at, "right") - 1
