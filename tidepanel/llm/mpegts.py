"""Media columns: MPEG transport streams.

:func:`mux` wraps a payload as one private data stream: a program association table and a program map
table before each random-access point, access units in PES packets with presentation times, continuity
counters, and random-access and clock fields in adaptation fields. :func:`demux` reads any stream of
188-byte packets: it parses the program tables (sections with a bad checksum are ignored), checks the
continuity counters of each elementary stream, drops repeated packets, reassembles the PES packets and
gives their timestamps and random-access points.

Null payloads count as empty; an empty payload gives a stream of tables alone. Bytes that do not begin
with the sync byte at a packet's place are skipped and counted. Everything is per row, so a long payload
needs memory of a few times its own size, and equal payloads give equal streams.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET = 188
PAT_PID, PMT_PID, DATA_PID, PRIVATE_DATA, PRIVATE_STREAM = 0, 0x1000, 0x100, 0x06, 0xBD
FIRST_PTS, PTS_STEP = 90_000, 3_600
PES_HEADER = 14


@lru_cache(4096)
def crc32_mpeg(data: bytes) -> int:
    """CRC with polynomial 04C11DB7, not reflected."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    raw = bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return np.frombuffer(raw.ljust(PACKET, b"\xff"), np.uint8)


@lru_cache(1)
def _tables() -> np.ndarray:
    pat = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
    return np.stack([_table_packet(PAT_PID, pat), _table_packet(PMT_PID, pmt)])


@lru_cache(2048)
def _layout(size: int, random_access: bool) -> tuple[np.ndarray, np.ndarray]:
    """Packets for a PES packet of ``size`` bytes without those bytes, and where they go."""
    rows, places, left, first = [], [], size, True
    while left or first:
        field_size = 8 if first and random_access else 0
        take = min(left, 184 - field_size)
        field_size = 184 - take
        row = np.full(PACKET, 0xFF, np.uint8)
        row[:4] = 0x47, (0x40 if first else 0) | DATA_PID >> 8, DATA_PID & 255, 0x30 if field_size else 0x10
        if field_size:
            row[4] = field_size - 1
        if field_size > 1:
            row[5] = 0x50 if first and random_access else 0
        rows.append(row)
        places.append(np.arange(PACKET) >= 4 + field_size)
        left, first = left - take, False
    return np.stack(rows), np.stack(places)


def _stamp(value: int) -> bytes:
    return bytes([0x21 | (value >> 29) & 0x0E, (value >> 22) & 255, 1 | (value >> 14) & 0xFE, (value >> 7) & 255, 1 | (value << 1) & 0xFE])


def mux(payload: bytes, unit: int = 5_760, gop: int = 4) -> bytes:
    """``payload`` as a transport stream, ``unit`` bytes to an access unit, every ``gop``-th a random-access point."""
    out, tables_sent, data_sent = [], 0, 0
    for k, at in enumerate(range(0, max(len(payload), 1), unit)):
        pts, part, random_access = (FIRST_PTS + k * PTS_STEP) % 2**33, payload[at : at + unit], k % gop == 0
        if random_access:
            tables = _tables().copy()
            tables[:, 3] |= tables_sent & 15
            tables_sent += 1
            out.append(tables)
        if not part:
            break
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (8 + len(part)).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + part
        packets, place = _layout(len(pes), random_access)
        packets = packets.copy()
        packets[place] = np.frombuffer(pes, np.uint8)
        packets[:, 3] |= ((np.arange(len(packets)) + data_sent) & 15).astype(np.uint8)
        data_sent += len(packets)
        if random_access:
            packets[0, 6:12] = np.frombuffer((pts << 15 | 0x7E00).to_bytes(6, "big"), np.uint8)
        out.append(packets)
    return np.concatenate(out).tobytes()


@dataclass
class Stream:
    """An elementary stream: its bytes, and (pts, dts, offset, size, random access) of its PES packets."""

    kind: int
    data: bytes = b""
    units: list[tuple[int | None, int | None, int, int, bool]] = field(default_factory=list)
    continuity_errors: int = 0
    repeated: int = 0


@dataclass
class Transport:
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, Stream] = field(default_factory=dict)
    packets: int = 0
    lost_sync: int = 0


def _sections(packets: np.ndarray, at: np.ndarray, starts: np.ndarray, table: int) -> Iterator[bytes]:
    """Whole sections of one table from a PID's packets, gathered over packets; a bad checksum is skipped."""
    buffer = b""
    for row, offset, begins in zip(packets, at, starts, strict=True):
        body = row[offset:].tobytes()
        if begins and body:
            buffer = body[1 + body[0] :]
        else:
            buffer += body
        while len(buffer) >= 3 and buffer[0] != 0xFF:
            size = 3 + (int.from_bytes(buffer[1:3], "big") & 0xFFF)
            if len(buffer) < size:
                break
            section, buffer = buffer[:size], buffer[size:]
            if section[0] == table and size >= 12 and crc32_mpeg(section[:-4]) == int.from_bytes(section[-4:], "big"):
                yield section


def _time(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1


def _reassemble(packets: np.ndarray, at: np.ndarray, starts: np.ndarray, random: np.ndarray, breaks: np.ndarray, stream: Stream) -> None:
    counters = (packets[:, 3] & 15).astype(int)
    carries = at < PACKET
    keep, last = np.ones(len(packets), bool), None
    step = np.diff(counters[carries]) % 16
    if (step == 1).all():
        keep &= carries
    else:  # a lost or repeated packet: walk through
        for i in np.flatnonzero(carries):
            if last is not None and not breaks[i]:
                if counters[i] == counters[last] and (packets[i] == packets[last]).all():
                    stream.repeated += 1
                    keep[i] = False
                    continue
                stream.continuity_errors += int(counters[i] != (counters[last] + 1) % 16)
            last = i
        keep &= carries
    packets, at, starts, random = packets[keep], at[keep], starts[keep], random[keep]
    if not len(packets):
        return
    flat = packets[np.arange(PACKET) >= at[:, None]].tobytes()
    ends = np.cumsum(PACKET - at)
    begin = (ends - (PACKET - at))[starts]
    limits = [*begin[1:].tolist(), len(flat)] if len(begin) else []
    parts, done = [], 0
    for b, e, ra in zip(begin.tolist(), limits, random[starts].tolist(), strict=True):
        pes = flat[b:e]
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
            continue
        size = int.from_bytes(pes[4:6], "big")
        head = 9 + pes[8]
        body = pes[head : 6 + size if size else None]
        pts = _time(pes[9:14]) if pes[7] & 0x80 and len(pes) >= 14 else None
        dts = _time(pes[14:19]) if pes[7] & 0xC0 == 0xC0 and len(pes) >= 19 else None
        stream.units.append((pts, dts, done, len(body), bool(ra)))
        parts.append(body)
        done += len(body)
    stream.data = b"".join(parts)


def demux(ts: bytes) -> Transport:
    """Programs, elementary streams and their timed units."""
    whole = np.frombuffer(ts, np.uint8)
    whole = whole[: len(whole) // PACKET * PACKET].reshape(-1, PACKET)
    good = whole[:, 0] == 0x47
    good &= whole[:, 1] & 0x80 == 0  # transport error
    found = Transport(packets=len(whole), lost_sync=int((~good).sum()) + bool(len(ts) % PACKET))
    p = whole[good]
    pid = (p[:, 1].astype(int) & 0x1F) << 8 | p[:, 2]
    control = p[:, 3] >> 4 & 3
    has_field = control & 2 > 0
    at = np.where(control & 1, 4 + np.where(has_field, 1 + p[:, 4].astype(int), 0), PACKET).clip(max=PACKET)
    flags = np.where(has_field & (p[:, 4] > 0), p[:, 5], 0)
    starts = p[:, 1] & 0x40 > 0
    of = lambda n: pid == n
    for section in _sections(p[of(PAT_PID)], at[of(PAT_PID)], starts[of(PAT_PID)], 0):
        for i in range(8, len(section) - 4, 4):
            if number := int.from_bytes(section[i : i + 2], "big"):
                found.programs[number] = int.from_bytes(section[i + 2 : i + 4], "big") & 0x1FFF
    for table in set(found.programs.values()):
        for section in _sections(p[of(table)], at[of(table)], starts[of(table)], 2):
            i = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
            while i + 5 <= len(section) - 4:
                found.streams.setdefault(int.from_bytes(section[i + 1 : i + 3], "big") & 0x1FFF, Stream(section[i]))
                i += 5 + (int.from_bytes(section[i + 3 : i + 5], "big") & 0xFFF)
    for n, stream in found.streams.items():
        own = of(n)
        _reassemble(p[own], at[own], starts[own], flags[own] & 0x40 > 0, flags[own] & 0x80 > 0, stream)
    return found


def padded(text: bytes, block: int = 576) -> bytes:
    """``text`` and bytes 255 up to a positive multiple of ``block``."""
    return text + b"\xff" * (max(block, -(-len(text) // block) * block) - len(text))


def _content(s: Stream) -> str:
    raw = np.frombuffer(bytes(s.data), np.uint8)
    if not len(raw):
        return "entropy=0 mean=0 deviation=0 skew=0 low=0 high=0"
    share = np.bincount(raw, minlength=256) / len(raw)
    some, value = share[share > 0], np.arange(256)
    mean = float(share @ value)
    spread = float(share @ (value - mean) ** 2) ** 0.5
    skew = float(share @ (value - mean) ** 3) / spread**3 if spread else 0.0
    sums = np.concatenate([[0], np.cumsum(raw, dtype=np.int64)])
    units = [(sums[u[2] + u[3]] - sums[u[2]]) / u[3] for u in s.units if u[3]] or [mean]
    return f"entropy={-float(some @ np.log2(some)) + 0.0:.4f} mean={mean:.4f} deviation={spread:.4f} skew={skew:.4f} low={min(units):.4f} high={max(units):.4f}"


def feature(t: Transport) -> str:
    """What the stream holds, in one line.

    Of each elementary stream: its shape, the entropy of its bytes, their mean, deviation and skewness, and
    the least and largest mean of its timed units.
    """
    out = []
    for pid, s in sorted(t.streams.items()):
        times = [x[0] for x in s.units if x[0] is not None]
        points = [i for i, x in enumerate(s.units) if x[4]]
        out.append(f"pid={pid} type={s.kind} units={len(s.units)} points={len(points)} first={min(times, default=0)} last={max(times, default=0)} breaks={s.continuity_errors} repeats={s.repeated} {_content(s)}")
    return f"programs={len(t.programs)} packets={t.packets}; " + "; ".join(out)


def _binary(values: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in values]


def store(docs: DataFrame, block: int = 576) -> DataFrame:
    """(doc_id, n_bytes, media): each text, padded to ``block``, as a transport stream in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                raw = _binary(part.column(1).cast(pa.binary()))
                yield pa.record_batch([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([mux(padded(x, block)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, media binary")


def read(media: DataFrame) -> DataFrame:
    """Reads a ``media`` column back: the reassembled payload's digests, timed units and a feature line.

    ``units`` lists (pts, dts, offset, size, random_access) of the first elementary stream. A null or
    unreadable stream gives an empty payload and no units. Other columns stay as they are.
    """
    keep = [c for c in media.columns if c != "media"]
    added = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, units array<struct<pts:long,dts:long,offset:long,size:long,random_access:boolean>>"
    unit = pa.list_(pa.struct([("pts", pa.int64()), ("dts", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("random_access", pa.bool_())]))
    names = ["pts", "dts", "offset", "size", "random_access"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for ts in _binary(b.column(b.schema.get_field_index("media"))):
                t = demux(ts)
                s = min(t.streams.items(), default=(0, Stream(0)))[1]
                rows.append((len(s.data), hashlib.sha256(s.data).hexdigest(), zlib.crc32(s.data[-32:]), len(ts), hashlib.sha256(ts).hexdigest(), feature(t), [dict(zip(names, u, strict=True)) for u in s.units]))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), unit]
            yield pa.record_batch([b.column(b.schema.get_field_index(c)) for c in keep] + [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [*keep, *(x.split(" ")[0] for x in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "units"))])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name != "media")
    return media.mapInArrow(run, f"{schema}, {added}")


def media_columns(docs: DataFrame) -> DataFrame:
    """One row per document: its text stored as a transport stream and read back."""
    return read(store(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
