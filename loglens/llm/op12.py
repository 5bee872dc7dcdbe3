"""Token ids in files of independently coded blocks, by a range coder with mixed adaptive predictions."""

from __future__ import annotations

import string
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import table
from .words import U, chunks, encoded, hashed, raw, tidy, tokenizer

#: Id that ends a document, ids of a block, blocks of a file.
END, BLOCK, LANES = 2, 4096, 2048
#: Ids of each block that a step of coding takes.
SPELL = 16
#: Pieces of text that a worker remembers at most, some 50 bytes each, and bytes of text encoded at once.
REMEMBERED, CHUNK = 1_500_000, 2 << 20
#: New pieces encoded as one text.
TOGETHER = 200
#: Bits of order-0 frequencies, of mixing weights, and of both; bits of a lane's table of order 2.
BITS0, BITSW, BITS2 = 12, 11, 11
BITS = BITS0 + BITSW
#: Places of a block before which its order-0 frequencies are counted anew.
EPOCHS = (256, 1024, 2048)
#: Confidence of a prediction goes up to LEVEL. A weight has 15 bits, loses a part of 2**RATE at each id and
#: gains STEP where it was right, so the two of a lane never take all of the code space.
LEVEL, RATE, STEP = 7, 4, 2016
MAGIC = b"ids1"
#: Bytes before which a space always begins a new piece.
SAFE = np.zeros(256, bool)
SAFE[[*range(0x21, 0x3C), *range(0x3D, 0x7F), 0xC3]] = True
#: Letters and digits, and marks that begin a new token after one.
WORD, MARK = np.zeros(256, bool), np.zeros(256, bool)
WORD[list(string.ascii_letters.encode() + string.digits.encode())] = True
MARK[list(b".,;:!?")] = True


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts from remembered ids of their pieces.

    The vocabulary's pattern starts a new token at a space before a character that is none, whatever
    stands before it, so a text is cut there and at other places of this kind, and each distinct piece is
    encoded once. It isn't cut before "<", where a special token may begin, nor before bytes that may begin
    another kind of space. New pieces with one space, at their begin, are encoded together and told apart by the tokens
    that begin with it; all others are encoded alone.
    """

    def __init__(self, path: str):
        self.model = tokenizer(path)
        if self.model.get_vocab_size() > 1 << 16:
            raise ValueError("a vocabulary of more than 65,536 ids is not supported")
        self.leads = np.zeros(1 << 16, bool)
        self.leads[[i for t, i in self.model.get_vocab().items() if t.startswith("Ġ")]] = True
        self.keys, self.begin, self.size, self.used, self.ids = np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint16)
        self.turn = 0

    def _together(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin of each piece, ids) of pieces that begin with their only space."""
        own, upto = data[_slices(starts, ends - starts)].tobytes(), [0, *np.cumsum(ends - starts)[TOGETHER - 1 :: TOGETHER].tolist(), int((ends - starts).sum())]
        texts = [own[s:e].decode() for s, e in zip(upto, upto[1:], strict=False) if s < e]
        ids = np.concatenate([np.zeros(0, np.uint16), *(np.array(e.ids, np.uint16) for e in encoded(self.model, texts, 20))])
        return np.flatnonzero(self.leads[ids]), ids

    def _new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, size, ids) of pieces: piece i has ids[begin[i]:begin[i] + size[i]]."""
        stops = np.concatenate([[0], np.cumsum((data == 32) | (data == 60))])
        joined = (data[starts] == 32) & (ends > starts + 1) & (stops[ends] - stops[starts] == 1)
        joined &= SAFE[data[np.minimum(starts + 1, len(data) - 1)]]
        begin, size = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        at, ids = self._together(data, starts[joined], ends[joined])
        if len(at) == joined.sum():
            begin[joined], size[joined] = at, np.diff(at, append=len(ids))
        else:  # a vocabulary whose tokens don't tell
            joined[:], ids = False, ids[:0]
        pieces = [data[s:e].tobytes().decode() for s, e in zip(starts[~joined].tolist(), ends[~joined].tolist(), strict=True)]
        alone = [np.array(e.ids, np.uint16) for e in encoded(self.model, pieces, 4000)]
        size[~joined] = [len(x) for x in alone]
        begin[~joined] = len(ids) + np.cumsum(size[~joined]) - size[~joined]
        return begin, size, np.concatenate([ids, *alone])

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Add pieces that aren't known, by ascending keys; if there are too many, those used longest ago go."""
        begin, size, ids = self._new(data, starts, ends)
        at = np.searchsorted(self.keys, keys)
        begin += len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        self.keys, self.begin, self.size, self.used = (np.insert(a, at, b) for a, b in ((self.keys, keys), (self.begin, begin), (self.size, size), (self.used, self.turn)))
        if len(self.keys) > REMEMBERED:
            last = np.sort(self.used)[-REMEMBERED // 2]
            keep = np.flatnonzero((self.used >= last) | (self.used == self.turn))
            self.keys, self.size, self.used, begin = self.keys[keep], self.size[keep], self.used[keep], self.begin[keep]
            self.ids = self.ids[_slices(begin, self.size)]
            self.begin = np.cumsum(self.size) - self.size

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(cut, ids): row i has ids[cut[i]:cut[i + 1]], of which the last is END."""
        self.turn += 1
        data, off = raw(texts)
        starts = _cuts(data, off)
        ends = np.append(starts[1:], len(data))
        keys, where, at = np.unique(hashed(data, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(place, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        self.used[place[known]] = self.turn
        if not known.all():
            self._learn(keys[~known], data, starts[where[~known]], ends[where[~known]])
            place = np.searchsorted(self.keys, keys)
        size, begin = (self.size[place][at], self.begin[place][at]) if len(keys) else (np.zeros(0, np.int64),) * 2
        upto = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, off)]
        ids = np.insert(self.ids[_slices(begin, size)], upto[1:], END)
        return upto + np.arange(len(off)), ids


def _cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pieces begin: at rows that aren't empty; within a row at spaces before SAFE bytes, at marks
    after letters or digits, and around a line end with a mark, letter or digit before and a SAFE byte after it."""
    if not len(data):
        return np.zeros(0, np.int64)
    cut = np.zeros(len(data) + 1, bool)
    before = SAFE[data[1:]]
    cut[:-2] = (data[:-1] == 32) & before
    cut[1:-1] |= MARK[data[1:]] & WORD[data[:-1]]
    line = np.flatnonzero(data == 10)
    line = line[(line > 0) & (line < len(data) - 1)]
    line = line[(MARK | WORD)[data[line - 1]] & before[line]]
    line = line[~np.isin(line, off) & ~np.isin(line + 1, off)]
    cut[line], cut[line + 1] = True, True
    last = off[off > 0] - 1  # the last byte of a row
    cut[last] &= data[last] != 32
    cut[off] = True
    return np.flatnonzero(cut[:-1])


def _slices(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all slices of an array that begin there and have these sizes."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each Python worker, so that its tasks share what it remembers."""
    return Encoder(path)


class Lanes:
    """The models of many blocks, one a lane, which take one id each at a time; a block's model is its own.

    A block's ids are numbered within its alphabet. Order 0 gives every one of them a share by its
    frequency, counted anew at EPOCHS. Orders 1 and 2 predict the id that last followed the same one or
    two ids. The code space of 2**BITS parts is split between the three by weights that are learned for each pair of
    confidences, which are numbers of right predictions in a row: first order 2's part, then that of order 1, then order 0's,
    in proportion to its frequencies. An id is coded by the first order that predicts it.
    """

    def __init__(self, sizes: np.ndarray):
        n, self.most, self.sizes = len(sizes), max(int(sizes.max(initial=0)), 1), sizes
        lanes = np.arange(n, dtype=np.int64)
        self.base, self.base0, self.base_mix = lanes * self.most, lanes << BITS0, lanes << 6
        trust = np.arange(LEVEL + 1, dtype=np.int32) << 11
        self.mix = np.tile((trust[:, None] << 16 | trust).ravel(), n)
        self.slots = np.zeros(0, np.int16)
        self.count(np.zeros((0, n), np.int16), False)

    def count(self, seen: np.ndarray, slots: bool) -> None:
        """Order-0 frequencies from the ids so far (step by lane), and with slots what each part of 2**BITS0 stands for."""
        k, n = seen.shape
        freq = np.zeros((n, self.most), np.int32)
        for at in range(0, n, 64):  # some lanes at a time, to bound what is in memory
            own, size = seen[:, at : at + 64].T, self.sizes[at : min(at + 64, n), None].astype(np.int32)
            counts = np.bincount((own + (np.arange(len(own)) * self.most)[:, None]).ravel(), minlength=len(own) * self.most).reshape(-1, self.most)
            # below 2**24
            f = np.where(np.arange(self.most) < size, 1 + counts.astype(np.int32) * ((1 << BITS0) - size) // np.int32(max(k, 1)), 0)
            f[np.arange(len(f)), size[:, 0] - 1] += (1 << BITS0) - f.sum(1, dtype=np.int32)
            freq[at : at + 64] = f
        self.freq = ((np.cumsum(freq, 1, dtype=np.int32) - freq) << (BITS0 + 1) | freq).ravel()
        if slots:
            self.slots = np.repeat(np.tile(np.arange(self.most, dtype=np.int16), n), freq.ravel())

    def narrow(self, n: int) -> None:
        """Go on with the first n lanes."""
        self.sizes, self.base, self.base0, self.base_mix = self.sizes[:n], self.base[:n], self.base0[:n], self.base_mix[:n]

    def interval(self, m: np.ndarray, at: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, size) of ids (at: as index) under weights m, where orders 1 and 2 predict them or not."""
        c2, c1, w0 = _shares(m)
        f = self.freq.take(self.base + at)
        begin = f >> (BITS0 + 1)
        begin *= w0
        begin += c1
        f &= (2 << BITS0) - 1
        f *= w0
        c1 -= c2
        begin = np.where(h1, c2, begin)
        begin *= ~h2
        return begin, np.where(h2, c2, np.where(h1, c1, f))


def _shares(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c2, c1, w0) of weights: the ends of the parts of orders 2 and 1, and what a part of 2**BITS0 of order 0 has. A weight is never 0."""
    c2 = m >> (31 - BITSW)
    c2 += 1
    c2 <<= BITS0
    c1 = m & 0x7FFF
    c1 >>= 15 - BITSW
    c1 += 1
    c1 <<= BITS0
    c1 += c2
    w0 = (1 << BITS) - c1
    w0 >>= BITS0
    return c2, c1, w0


def _faded(m: np.ndarray) -> np.ndarray:
    """Weights without the part that they lose at each id."""
    lost = m >> RATE
    lost &= (0x7FFF >> RATE) * 0x10001
    return m - lost


def _followed(context: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For ids of blocks (block by step) and the contexts before them: the confidence in what last followed the context,
    plus LEVEL + 1 where it is the id. What never came before predicts 0, without confidence."""
    order = np.argsort(context, 1, kind="stable")
    key, x = np.take_along_axis(context, order, 1), np.take_along_axis(ids, order, 1)
    again = np.zeros(ids.shape, bool)
    np.equal(key[:, 1:], key[:, :-1], out=again[:, 1:])
    told = np.zeros_like(x)
    np.multiply(x[:, :-1], again[:, 1:], out=told[:, 1:])
    right = told == x
    place, fresh = np.arange(ids.shape[1], dtype=np.int16), ~again  # where a row of right predictions begins
    fresh[:, 1:] |= ~right[:, :-1]
    found = place - np.maximum.accumulate(np.where(fresh, place, np.int16(0)), 1)
    np.minimum(found, LEVEL, out=found)
    found += right * np.int16(LEVEL + 1)
    out = np.empty(ids.shape, np.uint8)
    np.put_along_axis(out, order, found.astype(np.uint8), 1)
    return out


def _told(ids: np.ndarray) -> np.ndarray:
    """How orders 1 and 2 do at each id of blocks (block by step): 6 bits of confidences, then 1 where order 1 predicts the id and 2 where order 2 does."""
    before = np.zeros((len(ids), ids.shape[1] + 2), np.uint16)
    before[:, 2:] = ids
    one, two = before[:, 1:-1], before[:, :-2]
    # modulo 2**16, of which only the lowest BITS2 bits count
    context = one * np.uint16(0x9E3B) + two * np.uint16(0x6A09) & np.uint16((1 << BITS2) - 1)
    f1, f2 = _followed(one, ids), _followed(context, ids)
    return (f2 & LEVEL) << 3 | f1 & LEVEL | (f1 >> 3) << 6 | (f2 >> 3) << 7


def squeeze(ids: np.ndarray) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """(directory, alphabets, words) of the blocks of ids: (ids, alphabet, 32-bit words, crc32) of each, and its bytes.

    All ids are known, so what orders 1 and 2 predict is found block by block beforehand; weights and code go on id by id, in all blocks at once.
    """
    blocks = [ids[at : at + BLOCK] for at in range(0, len(ids), BLOCK)]
    if not blocks:
        return np.zeros((0, 4), np.uint32), [], []
    there, number, alphabets, sizes = np.zeros(1 << 16, bool), np.zeros(1 << 16, np.int16), [], []
    local = np.zeros((len(blocks), min(BLOCK, len(ids))), np.int16)
    told = np.zeros(local.shape, np.uint8)
    for i, own in enumerate(blocks):
        there[own] = True
        known = np.flatnonzero(there)
        there[known] = False
        number[known] = np.arange(len(known))
        local[i, : len(own)] = number[own]
        gaps = np.diff(known.astype(np.int32), prepend=0)
        high = gaps > 255
        alphabets.append(np.packbits(high).tobytes() + (gaps & 255).astype(np.uint8).tobytes() + (gaps[high] >> 8).astype(np.uint8).tobytes())
        sizes.append(len(known))
    for at in range(0, len(blocks), 8):  # so many as a core's cache holds
        told[at : at + 8] = _told(local[at : at + 8])
    # step by lane
    local, told = np.ascontiguousarray(local.T), np.ascontiguousarray(told.T)
    steps, last, n = len(local), len(blocks[-1]), len(blocks)
    model, room = Lanes(np.array(sizes)), steps * BITS // 32 + 4
    out, place = np.zeros(n * room, np.uint32), np.arange(n) * room
    low, width = np.zeros(n, U), np.full(n, 2**64 - 1, U)
    gains = np.array([0, STEP, STEP << 16, STEP << 16], np.int32)
    stops = sorted({*range(0, steps, SPELL), *(e for e in (*EPOCHS, last) if e < steps), steps})
    for k, end in zip(stops, stops[1:], strict=False):
        if k == last:
            n -= 1
            done, low, width, place = (low[n], place[n]), low[:n], width[:n], place[:n]
            model.narrow(n)
        if k in EPOCHS:
            model.count(local[:k, :n], False)
        own = told[k:end, :n]
        which, gain = (own & 63) + model.base_mix, gains.take(own >> 6)
        weights = np.empty(own.shape, np.int32)
        for i, g, m in zip(which, gain, weights, strict=True):
            m[:] = model.mix.take(i)
            g += _faded(m)
            model.mix[i] = g
        begins, widths = model.interval(weights, local[k:end, :n], (own & 64).view(bool), (own & 128).view(bool))
        for begin, size in zip(begins.astype(U), widths.astype(U), strict=True):
            width >>= U(BITS)
            begin *= width
            width *= size
            low += begin
            carry = place[low < begin] - 1
            while len(carry):  # into what was put out
                out[carry] += np.uint32(1)
                carry = carry[out[carry] == 0] - 1
            full = np.flatnonzero(width < U(1 << 32))
            to, code = place.take(full), low.take(full)
            out[to] = code >> U(32)
            place[full] = to + 1
            low[full] = code << U(32)
            width[full] = width.take(full) << U(32)
    if n < len(blocks):
        low, place = np.append(low, done[0]), np.append(place, done[1])
    out[place], out[place + 1] = low >> U(32), low & U(0xFFFFFFFF)
    place = place + 2 - np.arange(len(blocks)) * room
    crc = [zlib.crc32(own.astype("<u2").tobytes()) for own in blocks]
    words = [out[i * room : i * room + p].astype("<u4").tobytes() for i, p in enumerate(place.tolist())]
    return np.array([[len(b) for b in blocks], sizes, place, crc], np.int64).T.astype(np.uint32), alphabets, words


def expand(directory: np.ndarray, data: memoryview, first: int = 0) -> np.ndarray:
    """The ids of blocks from their directory and bytes. A block that doesn't fit its checksum is a ValueError; first is its number there."""
    if not len(directory):
        return np.zeros(0, np.uint16)
    if (directory[:-1, 0] != BLOCK).any() or not (0 < directory[-1, 0] <= BLOCK) or (directory[:, 1] > directory[:, 0]).any() or (directory[:, 1] == 0).any():
        raise ValueError("the directory of blocks is damaged")
    alphabets, words, at = [], [], 0
    for _, m, w, _ in directory.tolist():
        high = np.unpackbits(np.frombuffer(data[at : at + -(-m // 8)], np.uint8))[:m].astype(bool)
        at += -(-m // 8)
        gaps = np.frombuffer(data[at : at + m], np.uint8).astype(np.int32)
        at += m
        if len(gaps) != m or len(high) != m:
            raise ValueError("the file ends too early")
        top = np.frombuffer(data[at : at + int(high.sum())], np.uint8)
        gaps[high] += top.astype(np.int32) << 8
        at += len(top)
        alphabets.append((np.cumsum(gaps) & 0xFFFF).astype(np.uint16))
        words.append(np.frombuffer(data[at : at + 4 * w], "<u4"))
        at += 4 * w
    n, sizes = len(directory), directory[:, 1].astype(np.int64)
    room = max(map(len, words)) + 2
    code = np.zeros(n * room, np.uint32)
    for i, w in enumerate(words):
        code[i * room : i * room + len(w)] = w
    model, last = Lanes(sizes), int(directory[-1, 0])
    model.count(np.zeros((0, n), np.int16), True)
    steps = BLOCK if n > 1 else last
    local = np.zeros((steps, n), np.int16)
    place = np.arange(n) * room
    rest, width = code[place].astype(U) << U(32) | code[place + 1].astype(U), np.full(n, 2**64 - 1, U)
    place += 2
    # what followed one and two ids (8 * id + confidence), a lane's tables side by side
    each = model.most + (1 << BITS2)
    tables, bases, which = np.zeros(n * each, np.int16), np.arange(n) * each + np.array([[0], [model.most]]), np.zeros((2, n), np.int64)
    a, b = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(steps):
        if k == last:
            n -= 1
            model.narrow(n)
            rest, width, place, a, b, bases, which = rest[:n], width[:n], place[:n], a[:n], b[:n], bases[:, :n], which[:, :n].copy()
        if k in EPOCHS:
            model.count(local[:k, :n], True)
        which[0] = a
        np.multiply(a, 0x9E3B, out=which[1])
        which[1] += b
        which[1] &= (1 << BITS2) - 1
        which += bases
        b = a * 0x6A09  # of the id before, for the next one
        entry = tables.take(which)
        guess, trust = entry >> 3, entry & LEVEL
        i = (trust[1] << 3 | trust[0]) + model.base_mix
        m = model.mix.take(i)
        c2, c1, w0 = _shares(m)
        width >>= U(BITS)
        q = np.minimum(rest // width, U((1 << BITS) - 1)).astype(np.int32)
        slot = np.maximum(q, c1)
        slot -= c1
        # divided as unsigned numbers, which is faster
        x = model.slots.take((slot.view(np.uint32) // w0.view(np.uint32)) + model.base0)
        x = np.where(q < c2, guess[1], np.where(q < c1, guess[0], x))
        local[k, :n] = x
        hit = guess == x
        a = x.astype(np.int64)
        begin, size = model.interval(m, a, hit[0], hit[1])
        rest -= begin.astype(U) * width
        width *= size.astype(U)
        full = np.flatnonzero(width < U(1 << 32))
        to = place.take(full)
        rest[full] = rest.take(full) << U(32) | code.take(to, mode="clip")
        width[full] = width.take(full) << U(32)
        place[full] = to + 1
        m = _faded(m)
        m += hit[1] * np.int32(STEP << 16)
        m += (hit[0] > hit[1]) * np.int32(STEP)
        model.mix[i] = m
        entry += trust < LEVEL
        tables[which] = np.where(hit, entry, x << 3)
    out = [a[np.minimum(local[:k, i], len(a) - 1)] for i, (a, k) in enumerate(zip(alphabets, directory[:, 0].tolist(), strict=True))]
    for i, (own, crc) in enumerate(zip(out, directory[:, 3].tolist(), strict=True)):
        if zlib.crc32(own.astype("<u2").tobytes()) != crc:
            raise ValueError(f"block {first + i} does not fit its checksum")
    return np.concatenate(out)


def pack_file(names: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file: its documents and their numbers of ids, the directory of blocks (each with a checksum), the blocks."""
    known = np.array([x is not None for x in names], bool)
    index = zlib.compress(np.array([x or 0 for x in names], "<i8").tobytes() + counts.astype("<u4").tobytes() + np.packbits(known).tobytes(), 1)
    directory, alphabets, words = squeeze(ids)
    heads = directory.astype("<u4").tobytes()
    body = b"".join(x for pair in zip(alphabets, words, strict=True) for x in pair)
    return struct.pack("<4sIIIII", MAGIC, len(names), len(index), zlib.crc32(index), len(directory), zlib.crc32(heads)) + index + heads + body


def read_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(ids of documents, their numbers of tokens, all token ids) of pack_file(); any damage is a ValueError."""
    view, head = memoryview(data), struct.calcsize("<4sIIIII")
    if len(data) < head:
        raise ValueError("the file ends too early")
    magic, n, size, crc, blocks, crc_heads = struct.unpack_from("<4sIIIII", data)
    index, heads = view[head : head + size], view[head + size : head + size + 16 * blocks]
    if magic != MAGIC or zlib.crc32(index) != crc or zlib.crc32(heads) != crc_heads:
        raise ValueError("the head of the file is damaged")
    plain = zlib.decompress(index)
    known = np.unpackbits(np.frombuffer(plain[12 * n :], np.uint8))[:n].astype(bool)
    names = [x if k else None for x, k in zip(np.frombuffer(plain[: 8 * n], "<i8").tolist(), known.tolist(), strict=True)]
    ids = expand(np.frombuffer(heads, "<u4").reshape(-1, 4), view[head + size + 16 * blocks :])
    counts = np.frombuffer(plain[8 * n : 12 * n], "<u4").astype(np.int64)
    if counts.sum() != len(ids):
        raise ValueError("the file's documents don't have as many ids as its blocks")
    return names, counts, ids


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK * LANES) -> DataFrame:
    """(part, first, n_ids, bytes): the files of all documents' ids, in ascending order of id (nulls first).

    Rows of one id are ordered by a hash of their texts. A null text is empty, so its document is the end id
    alone. Documents are dealt by ranges of (id, hash, place in the input), so that neither a null id nor
    repeated rows make a large part; parts ascend, and so do files by first, the ids before them in their part. A file holds
    whole documents, of about the given number of ids or of a longer document alone. Other columns are not read.
    """

    @tidy
    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, first = encoder(path), None, 0
        names, counts, ids = [], [], []

        def file() -> pa.RecordBatch:
            every, count = np.concatenate(ids), np.concatenate(counts)
            ids.clear()  # with the batches that they are parts of
            out = pack_file(names, count, every)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([len(every)], pa.int64()), pa.array([out], pa.binary())], names=["part", "first", "n_ids", "bytes"])

        have = 0
        for whole in batches:
            for batch in chunks(whole, "text", CHUNK):
                if not batch.num_rows:
                    continue
                part = batch["part"][0].as_py()
                cut, found = encode(batch["text"])
                own, at = batch["id"].to_pylist(), 0
                while at < len(own):
                    # documents up to the file's size; one alone if it is longer
                    to = max(at + (not have), int(np.searchsorted(cut, cut[at] + size - have, "right")) - 1)
                    if to > at:
                        names += own[at:to]
                        counts.append(np.diff(cut[at : to + 1]))
                        ids.append(found[cut[at] : cut[to]])
                        have += int(cut[to] - cut[at])
                        at = to
                    if at < len(own):
                        yield file()
                        first, have = first + have, 0
                        names, counts, ids = [], [], []
        if have:
            yield file()

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    own = own.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("id").asc_nulls_first(), F.col("tie"), F.col("row")]
    dealt = own.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("id", "text", F.spark_partition_id().alias("part")).mapInArrow(filed, "part int, first long, n_ids long, bytes binary")


def read_ids(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files, all from their decoded bytes."""
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    @tidy
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch["base"].to_pylist(), batch["bytes"], strict=True):
                names, counts, ids = read_file(data.as_buffer().to_pybytes())
                plain, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(counts)
                crc = [zlib.crc32(plain[4 * s : 4 * e]) for s, e in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(ends - counts + base), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = files.join(F.broadcast(before), "part")  # a row for each partition
    return placed.select((F.col("base") + F.col("first")).alias("base"), "bytes").mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents' ids written as files in the shared folder and read back: (id, start, n_tokens, ids_crc32) of each.

    Null ids come first and stay null, null or empty texts have the end id alone, repeated rows stay
    rows, an empty table gives none.
    """
    files = table(write_ids(docs, path or vocabulary(), id_col, text_col), "token-ids")
    return read_ids(files).withColumnRenamed("doc_id", id_col)


def op12_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
