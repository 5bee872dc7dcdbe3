"""Documents as a column of MPEG transport streams, and transport streams, own or foreign, parsed and described."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import table
from .words import chunks, tidy

# Fixed values of the transport stream format.
PACKET, SYNC, PAT_PID, NULL_PID, PAT_TABLE, PMT_TABLE, PRIVATE_STREAM = 188, 0x47, 0x0000, 0x1FFF, 0x00, 0x02, 0xBD
PRIVATE_DATA_TYPE = 0x06
CLOCK = 90_000
#: Streams whose elementary packets have no optional header.
PLAIN_STREAMS = (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)

#: What mux() writes: packet ids, bytes of an access unit, units a second, units from one random-access point to the next.
PROGRAM, PMT_PID, DATA_PID = 1, 0x1000, 0x0100
UNIT, RATE, GROUP = 16_384, 25, 8
ALIGN = 64


@lru_cache(256)
def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def section(table_id: int, extension: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + extension.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def table_packet(pid: int, content: bytes) -> np.ndarray:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return np.frombuffer((head + content).ljust(PACKET, b"\xff"), np.uint8)


PAT = table_packet(PAT_PID, section(PAT_TABLE, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
PMT = table_packet(PMT_PID, section(PMT_TABLE, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_DATA_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0"))


def stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, pts >> 22 & 0xFF, 1 | (pts >> 14) & 0xFE, pts >> 7 & 0xFF, 1 | pts << 1 & 0xFE])


def clock_field(base: int) -> bytes:
    """A program clock reference of a time in 1/90000 s."""
    return ((base << 15) | 0x7E00).to_bytes(6, "big")


def mux(payload: bytes) -> bytes:
    """An elementary packet for each access unit; each group of them begins with the tables, a random-access mark and the clock."""
    out, counter = [], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit = payload[at : at + UNIT]
        time = k * CLOCK // RATE
        pes = b"\0\0\1" + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp(time) + unit
        random = k % GROUP == 0
        if random:
            for t in (PAT, PMT):
                t = t.copy()
                t[3] |= k // GROUP % 16
                out.append(t)
        used = 8 if random else 0
        size = PACKET - 4
        first = size - used
        n = 1 + max(0, -(-(len(pes) - first) // size))
        rows = np.full((n, PACKET), 0xFF, np.uint8)
        rows[:, 0], rows[:, 1], rows[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
        rows[0, 1] |= 0x40
        rows[:, 3] = 0x10 | (counter + np.arange(n)) % 16
        data = np.frombuffer(pes, np.uint8)
        if random:
            rows[0, 3] |= 0x20
            rows[0, 4:12] = np.frombuffer(b"\x07\x50" + clock_field(time), np.uint8)
        last = len(pes) if n == 1 else (len(pes) - first) - (n - 2) * size
        room = first if n == 1 else size
        if n > 1:
            rows[0, PACKET - first :] = data[:first]
            rows[1 : n - 1, 4:] = data[first : first + (n - 2) * size].reshape(n - 2, size)
        if stuff := room - last:  # the adaptation field of the last packet grows to fill it
            used = used if n == 1 else 0
            rows[n - 1, 3] |= 0x20
            rows[n - 1, 4] = used + stuff - 1
            if not used and stuff > 1:
                rows[n - 1, 5] = 0
        rows[n - 1, PACKET - last :] = data[len(pes) - last :]
        out.append(rows.ravel())
        counter += n
    return np.concatenate(out).tobytes() if out else b""


@dataclass
class Stream:
    """One elementary stream: its bytes, a time (or None) for each access unit, the units at which decoding can
    start, packets in the file, breaks in its counters, clock references, and what was found damaged."""

    payload: bytes = b""
    pts: list[int | None] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)
    packets: int = 0
    breaks: int = 0
    clocks: int = 0
    damage: dict[str, int] = field(default_factory=dict)

    def hurt(self, what: str, n: int = 1) -> None:
        if n:
            self.damage[what] = self.damage.get(what, 0) + n


def packets_of(stream: bytes, out: Stream) -> np.ndarray:
    """The packets as rows. Where packets don't follow each other, the next place with two sync bytes is looked for."""
    data = np.frombuffer(stream, np.uint8)
    whole = len(data) // PACKET * PACKET
    rows = data[:whole].reshape(-1, PACKET)
    if whole == len(data) and (rows[:, 0] == SYNC).all():
        return rows
    marks = np.flatnonzero(data == SYNC)
    follows = np.zeros(len(data) + PACKET + 1, bool)
    follows[marks] = True
    follows[len(data)] = True  # the last packet ends with the file
    good = marks[follows[np.minimum(marks + PACKET, len(follows) - 1)] & (marks + PACKET <= len(data))]
    parts, at, ready = [], 0, None
    while at + PACKET <= len(data):
        if data[at] == SYNC and (ready == at or follows[at + PACKET]):
            parts.append(at)
            at = ready = at + PACKET
        else:
            out.hurt("sync")
            next_ = np.searchsorted(good, at + 1)
            if next_ == len(good):
                break
            at, ready = int(good[next_]), None
    if at < len(data):
        out.hurt("tail")
    return data[np.array(parts, np.int64)[:, None] + np.arange(PACKET)] if parts else np.zeros((0, PACKET), np.uint8)


def begins(rows: np.ndarray) -> np.ndarray:
    """Where each packet's payload begins; PACKET where it has none."""
    at = np.where(rows[:, 3] & 0x20, 5 + rows[:, 4].astype(np.int32), 4)
    return np.where(rows[:, 3] & 0x10, np.minimum(at, PACKET), PACKET)


def sections(rows: np.ndarray, out: Stream) -> list[bytes]:
    """The sections on one packet id that are whole, whatever packets they span."""
    found, buffer = [], None
    start = begins(rows)
    for row, s in zip(rows, start.tolist(), strict=True):
        part = row[s:].tobytes()
        if not part:
            continue
        if row[1] & 0x40:
            pointer = part[0]
            if buffer is not None:
                found += _cut(buffer + part[1 : 1 + pointer])[0]
            buffer = part[1 + pointer :]
        elif buffer is None:
            continue
        else:
            buffer += part
        done, buffer = _cut(buffer)
        found += done
    good = [s for s in dict.fromkeys(found) if not s[1] & 0x80 or not crc32_mpeg(s)]
    out.hurt("table", len(set(found)) - len(good))
    return good


def _cut(buffer: bytes) -> tuple[list[bytes], bytes | None]:
    """Whole sections at the head of the bytes, and what is left of an unfinished one."""
    done = []
    while len(buffer) >= 3 and buffer[0] != 0xFF:
        size = 3 + ((buffer[1] & 0x0F) << 8 | buffer[2])
        if len(buffer) < size:
            return done, buffer
        done.append(buffer[:size])
        buffer = buffer[size:]
    return done, buffer if buffer and buffer[0] != 0xFF else None


def _once(rows: np.ndarray) -> np.ndarray:
    """The first of packets that repeat one table."""
    return rows[:1] if len(rows) > 1 and (rows[:, 1] & 0x40 > 0).all() and (rows[:, 4:] == rows[0, 4:]).all() else rows


def program_streams(rows: np.ndarray, pids: np.ndarray, out: Stream) -> dict[int, tuple[int, list[tuple[int, int]]]]:
    """{program: (clock's packet id, [(type, packet id) of each elementary stream])}, from the tables in force last."""
    programs: dict[int, int] = {}
    for s in sections(_once(rows[pids == PAT_PID]), out):
        if s[0] == PAT_TABLE and len(s) >= 12 and s[5] & 1:
            programs |= {p: int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF for i in range(8, len(s) - 7, 4) if (p := int.from_bytes(s[i : i + 2], "big"))}
    streams = {}
    for program, pid in programs.items():
        for s in sections(_once(rows[pids == pid]), out):
            if s[0] != PMT_TABLE or len(s) < 16 or not s[5] & 1 or int.from_bytes(s[3:5], "big") != program:
                continue
            at, end, every = 12 + (int.from_bytes(s[10:12], "big") & 0x0FFF), len(s) - 4, []
            while at + 5 <= end:
                every.append((s[at], int.from_bytes(s[at + 1 : at + 3], "big") & 0x1FFF))
                at += 5 + (int.from_bytes(s[at + 3 : at + 5], "big") & 0x0FFF)
            streams[program] = (int.from_bytes(s[8:10], "big") & 0x1FFF, every)
    return streams


def continuous(own: np.ndarray, out: Stream) -> tuple[np.ndarray, np.ndarray]:
    """(packets to keep, those before which something was lost) of one packet id, by the counters' rules.

    A counter rises with each packet that has a payload and stays for one without; a packet may be sent
    twice; a discontinuity that is announced is no break.
    """
    counter, loaded = (own[:, 3] & 0x0F).astype(np.int16), (own[:, 3] & 0x10) > 0
    announced = ((own[:, 3] & 0x20) > 0) & (own[:, 4] > 0) & ((own[:, 5] & 0x80) > 0)
    keep, lost = np.ones(len(own), bool), np.zeros(len(own), bool)
    if loaded.all() and not announced.any() and (np.diff(counter) % 16 == 1).all():
        return keep, lost
    before, again = None, False
    for i in range(len(own)):
        if before is None or announced[i]:
            before, again = i, False
            continue
        step = (counter[i] - counter[before]) % 16
        if not loaded[i]:
            lost[i] = step != 0
        elif step == 0 and loaded[before] and not again and (own[i, 4:] == own[before, 4:]).all():
            keep[i], again = False, True
            continue
        else:
            lost[i] = step != 1
        before, again = i, False
    out.hurt("repeated", int((~keep).sum()))
    return keep, lost


def time_of(head: bytes) -> int | None:
    if len(head) < 14 or not head[7] & 0x80:
        return None
    return (head[9] >> 1 & 7) << 30 | head[10] << 22 | head[11] >> 1 << 15 | head[12] << 7 | head[13] >> 1


def demux(stream: bytes, program: int | None = None, pid: int | None = None) -> Stream:
    """The elementary stream of a program (the lowest one) with a packet id (the first one listed).

    Streams come from any multiplexer: program and stream descriptors, tables over several packets, other
    programs, network and null packets, stuffing, repeated and empty packets are read by their rules. Damage
    raises nothing: what can't be read is left out and counted in damage (sync, tail, error, table, program,
    scrambled, lost, header, size, repeated), counter breaks in breaks, and the rest is returned.
    """
    out = Stream()
    rows = packets_of(stream, out)
    out.packets = len(rows)
    if bad := int((rows[:, 1] & 0x80 > 0).sum()):
        out.hurt("error", bad)
        rows = rows[rows[:, 1] & 0x80 == 0]
    pids = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    programs = {p: s for p, s in program_streams(rows, pids, out).items() if s[1] and program in (None, p)}
    if not programs:
        out.hurt("program")
        return out
    clock, streams = programs[min(programs)]
    pid = streams[0][1] if pid is None else pid
    own = rows[pids == clock]
    out.clocks = int((((own[:, 3] & 0x20) > 0) & (own[:, 4] > 6) & ((own[:, 5] & 0x10) > 0)).sum())
    own = rows[pids == pid]
    keep, lost = continuous(own, out)
    out.breaks = int(lost.sum())
    own, lost = own[keep], lost[keep]
    if (hidden := own[:, 3] & 0xC0 > 0).any():
        out.hurt("scrambled", int(hidden.sum()))
        own, lost = own[~hidden], lost[~hidden]
    start = begins(own)
    content, ends = own[np.arange(PACKET)[None, :] >= start[:, None]], np.cumsum(PACKET - start)
    units = np.flatnonzero((own[:, 1] & 0x40 > 0) & (start < PACKET))
    random = (own[:, 3] & 0x20 > 0) & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)
    edges = [*(ends[units] - (PACKET - start[units])).tolist(), len(content)]
    out.hurt("lost", int(lost.sum()))
    if edges[0]:
        out.hurt("header")  # the beginning of the first packet is missing
    parts = []
    for unit, s, e in zip(units.tolist(), edges, edges[1:], strict=False):
        head = content[s : min(e, s + 14)].tobytes()
        if len(head) < 6 or head[:3] != b"\0\0\1":
            out.hurt("header")
            continue
        size = head[4] << 8 | head[5]
        if size and size != e - s - 6:
            out.hurt("size")
            e = min(e, s + 6 + size)
        plain = head[3] in PLAIN_STREAMS
        if random[unit]:
            out.random_access.append(len(parts))
        out.pts.append(None if plain else time_of(head))
        parts.append(content[s + (6 if plain else 9 + head[8] if len(head) > 8 else len(head)) : e])
    out.payload = np.concatenate(parts).tobytes() if parts else b""
    return out


def payload_of(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data.ljust(max(ALIGN, -(-len(data) // ALIGN) * ALIGN), b"\0")


def as_streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media), one row for each row of docs: texts multiplexed into transport streams.

    The text's UTF-8 bytes, padded with zeros to a positive multiple of 64, become media, a stream with one
    private program. A null text is an empty one, a null id stays null, repeated rows give repeated rows, equal
    texts equal media. Only the id and the text are read.
    """

    @tidy
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", 4 << 20):
                made = [(n, mux(p)) for n, p in map(payload_of, batch["text"].to_pylist())]
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())], names=["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(convert, "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


PARSED = "payload binary, pts array<long>, random_access array<int>, packets int, breaks int, clocks int, damage map<string,int>"
PARSED_ARROW = {"payload": pa.binary(), "pts": pa.list_(pa.int64()), "random_access": pa.list_(pa.int32()), "packets": pa.int32(), "breaks": pa.int32(), "clocks": pa.int32(), "damage": pa.map_(pa.string(), pa.int32())}


def parsed(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, payload, pts, random_access, packets, breaks, clocks, damage), one row for each row of media.

    What demux() finds in any transport streams: a time (90 kHz) or null for each access unit, the units at
    which decoding can start, and what was damaged, by kind. A null stream gives nulls; an empty one, or bytes
    that are none, an empty payload. Only the id and the stream are read.
    """

    @tidy
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "media", 4 << 20):
                found = [None if m is None else demux(m) for m in batch["media"].to_pylist()]
                get = lambda s, k: None if s is None else list(s.damage.items()) if k == "damage" else getattr(s, k)
                yield pa.RecordBatch.from_arrays([batch["id"], *(pa.array([get(s, k) for s in found], t) for k, t in PARSED_ARROW.items())], names=["id", *PARSED_ARROW])

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInArrow(parse, f"id long, {PARSED}").withColumnRenamed("id", id_col)


DIGEST = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


def digests(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of stored streams.

    As parsed(), with digests where that has bytes, so that texts don't travel again.
    """

    def digest(m: bytes) -> tuple:
        s = demux(m)
        feature = f"packets={s.packets};units={len(s.pts)};random_access={len(s.random_access)};last_pts={s.pts[-1] if s.pts else ''};breaks={s.breaks}"
        feature += "".join(f";{k}={n}" for k, n in sorted(s.damage.items()))
        return len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-ALIGN:]), len(m), hashlib.sha256(m).hexdigest(), feature

    @tidy
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "media", 4 << 20):
                rows = [(None,) * len(DIGEST) if m is None else digest(m) for m in batch["media"].to_pylist()]
                columns = zip(*rows, strict=True) if rows else [[]] * len(DIGEST)
                yield pa.RecordBatch.from_arrays([batch["id"], batch["n_bytes"], *(pa.array(c, t) for c, t in zip(columns, DIGEST.values(), strict=True))], names=["id", "n_bytes", *DIGEST])

    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select(F.col(id_col).cast("long").alias("id"), F.col("n_bytes").cast("long").alias("n_bytes"), F.col(media_col).alias("media")).mapInArrow(describe, schema).withColumnRenamed("id", id_col)


def op8_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams are stored as a column of a table; what is reported is read back from it."""
    return digests(table(as_streams(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media"))
