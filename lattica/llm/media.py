"""Media columns: a text's bytes as samples in an MPEG transport stream, and the stream parsed again."""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

# Fixed values of the transport stream format.
PACKET, SYNC, PAT_PID, NULL_PID = 188, 0x47, 0x0000, 0x1FFF
PMT_PID, ES_PID, PROGRAM = 0x0100, 0x0101, 1
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data, private_stream_1
FRAME = 576
#: Samples a presentation unit holds, 90 kHz ticks between units, and units between random-access points.
UNIT, TICKS, ACCESS_EVERY = 8 * FRAME, 3600, 8
PES_HEADER = 14


@lru_cache(4096)
def section_crc(data: bytes) -> int:
    """CRC-32/MPEG-2."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1
            crc &= 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table, 0xB0 | length >> 8, length & 255, number >> 8, number & 255, 0xC1, 0, 0])
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


def _tables() -> bytes:
    pat = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    stream = bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"
    pmt = _section(0x02, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + stream)
    return _table_packet(PAT_PID, pat) + _table_packet(PMT_PID, pmt)


TABLES = _tables()


@lru_cache(64)
def _layout(size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Packets of one unit of ``size`` samples without counters and times, where its samples go, and the packet count."""
    todo, out, places, first = PES_HEADER + size, [], [], True
    while todo:
        extra = 8 if first else 0  # an adaptation field with flags and a clock reference
        take = min(todo, PACKET - 4 - extra)
        stuffing = PACKET - 4 - extra - take
        head = bytearray([SYNC, (0x40 if first else 0) | ES_PID >> 8, ES_PID & 255, 0x30 if extra or stuffing else 0x10])
        if extra:
            head += bytes([7 + stuffing, 0x10, *[0] * 6]) + b"\xff" * stuffing
        elif stuffing == 1:
            head += b"\x00"
        elif stuffing:
            head += bytes([stuffing - 1, 0]) + b"\xff" * (stuffing - 2)
        places.append(len(out) * PACKET + len(head) + np.arange(take))
        out.append(bytes(head) + bytes(take))
        todo, first = todo - take, False
    flat, where = np.frombuffer(b"".join(out), np.uint8).copy(), np.concatenate(places)
    length = size + PES_HEADER - 6
    flat[where[:9]] = [0, 0, 1, STREAM_ID, length >> 8, length & 255, 0x80, 0x80, 5]
    flat.setflags(write=False)
    return flat, where, len(out)


def _units(data: np.ndarray, size: int, first: int, packets: int) -> tuple[np.ndarray, int]:
    """Units of ``size`` samples each, numbered from ``first``; ``packets``: those of the stream before."""
    flat, where, per = _layout(size)
    n = len(data) // size
    out = np.tile(flat, (n, 1))
    number = first + np.arange(n, dtype=np.int64)
    t = number * TICKS & (1 << 33) - 1
    out[:, 5] |= np.where(number % ACCESS_EVERY == 0, 0x40, 0).astype(np.uint8)
    for at, v in zip(range(6, 12), (t >> 25, t >> 17, t >> 9, t >> 1, (t & 1) << 7 | 0x7E, 0 * t), strict=True):
        out[:, at] = v & 255
    for at, v in zip(where[9:14], (0x21 | t >> 29 & 0x0E, t >> 22, 1 | t >> 14 & 0xFE, t >> 7, 1 | t << 1 & 0xFE), strict=True):
        out[:, at] = v & 255
    out[:, where[PES_HEADER:]] = data.reshape(n, size)
    out[:, 3::PACKET] |= (packets + np.arange(n * per) & 15).astype(np.uint8).reshape(n, per)
    return out.reshape(-1), packets + n * per


def mux(payload: bytes) -> bytes:
    """A transport stream of one program that carries ``payload``, a positive multiple of 576 bytes."""
    data = np.frombuffer(payload, np.uint8)
    whole = len(data) // UNIT
    parts, packets = [TABLES], 0
    if whole:
        body, packets = _units(data[: whole * UNIT], UNIT, 0, packets)
        parts.append(body.tobytes())
    if rest := len(data) - whole * UNIT:
        parts.append(_units(data[whole * UNIT :], rest, whole, packets)[0].tobytes())
    return b"".join(parts)


@dataclass
class Stream:
    payload: bytes
    times: np.ndarray  # presentation time of each unit, 90 kHz
    access: np.ndarray  # index of units that are random-access points
    access_at: np.ndarray  # byte offset in the stream of each of those
    gaps: int  # continuity errors
    packets: int


def _parse_section(packet: bytes, table: int) -> bytes:
    at = 4 + (1 + packet[4] if packet[3] & 0x20 else 0)
    at += 1 + packet[at]
    length = (packet[at + 1] & 0x0F) << 8 | packet[at + 2]
    section = packet[at : at + 3 + length]
    if section[0] != table or section_crc(section[:-4]) != int.from_bytes(section[-4:], "big"):
        raise ValueError("damaged program table")
    return section[8:-4]


def demux(media: bytes) -> Stream:
    """Parse program tables, check continuity counters, and reassemble the first elementary stream of the first program."""
    if not media or len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        raise ValueError("lost synchronisation")
    pids = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]

    def first(pid: int) -> bytes:
        at = np.flatnonzero((pids == pid) & (p[:, 1] & 0x40 > 0))
        if not len(at):
            raise ValueError(f"no table on packet id {pid}")
        return p[at[0]].tobytes()

    pat = _parse_section(first(PAT_PID), 0x00)
    programs = [(int.from_bytes(pat[i : i + 2], "big"), int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF) for i in range(0, len(pat), 4)]
    pmt = _parse_section(first(next(pid for number, pid in programs if number)), 0x02)
    at = 4 + ((pmt[2] & 0x0F) << 8 | pmt[3])
    es_pid = int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF

    rows = np.flatnonzero((pids == es_pid) & (p[:, 3] & 0x10 > 0))
    e = p[rows]
    counter = e[:, 3] & 15
    gaps = int(((counter[1:].astype(np.int16) - counter[:-1]) % 16 != 1).sum())
    adapted = e[:, 3] & 0x20 > 0
    begins = 4 + np.where(adapted, 1 + e[:, 4].astype(np.int32), 0)
    flagged = adapted & (e[:, 4] > 0) & (e[:, 5] & 0x40 > 0)
    body = e[np.arange(PACKET) >= begins[:, None]]
    ends = np.cumsum(PACKET - begins)
    starts = np.flatnonzero(e[:, 1] & 0x40)
    heads = np.concatenate(([0], ends[:-1]))[starts]
    h = body[heads[:, None] + np.arange(PES_HEADER)].astype(np.int64)
    if (h[:, :3] != [0, 0, 1]).any():
        raise ValueError("damaged packet header")
    times = (h[:, 9] >> 1 & 7) << 30 | h[:, 10] << 22 | (h[:, 11] >> 1) << 15 | h[:, 12] << 7 | h[:, 13] >> 1
    skip = 9 + h[:, 8]
    held = (h[:, 4] << 8 | h[:, 5]) + 6 - skip
    if len(heads) and (heads + skip + held != np.append(heads[1:], len(body))).any():
        raise ValueError("elementary packets don't fill their units")
    keep = np.ones(len(body) + 1, np.int8)
    marks = np.zeros(len(body) + 1, np.int32)
    np.add.at(marks, heads, 1)
    np.add.at(marks, heads + skip, -1)
    keep = np.cumsum(marks[:-1]) == 0
    points = np.flatnonzero(flagged[starts])
    return Stream(body[keep].tobytes(), times, points, rows[starts[points]] * PACKET, gaps, len(p))


def padded(data: bytes) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of 576."""
    return data + b"\xff" * (max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data))


STORED = "doc_id long, n_bytes long, media binary, unit_times array<long>, access_offsets array<long>"


def encode(docs: DataFrame) -> DataFrame:
    """The media column of ``docs`` (doc_id, text): one stream a row, its unit times and random-access offsets beside it.

    A null or empty text gives one frame of bytes 255. Rows are independent: repeated rows give repeated, equal
    streams, an empty table an empty one, and further columns are left out.
    """

    def run(batches):
        for batch in batches:
            raw, offs = common.text_buffers(batch.column("text"))
            view, ids = memoryview(raw), batch.column("doc_id")
            for i, j in common.doc_ranges(offs, 8 << 20):
                media = [mux(padded(bytes(view[offs[k] : offs[k + 1]]))) for k in range(i, j)]
                seen = [-(-max(FRAME, offs[k + 1] - offs[k] + (-(offs[k + 1] - offs[k])) % FRAME) // UNIT) for k in range(i, j)]
                per = _layout(UNIT)[2]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, j - i),
                        pa.array(offs[i + 1 : j + 1] - offs[i:j]),
                        pa.array(media, pa.binary()),
                        pa.array([np.arange(n) * TICKS for n in seen], pa.list_(pa.int64())),
                        pa.array([(2 + np.arange(0, n, ACCESS_EVERY) * per) * PACKET for n in seen], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_bytes", "media", "unit_times", "access_offsets"],
                )

    return common.spread(common.keyed(docs)).mapInArrow(run, STORED)


FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
)


def features(stored: DataFrame) -> DataFrame:
    """Parse each stored stream and compute its digests and features; a stream whose samples or points don't hold raises."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, n, media, times, points in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "n_bytes", "media", "unit_times", "access_offsets")), strict=True):
                s = demux(media)
                if s.gaps or s.times.tolist() != times or s.access_at.tolist() != points:
                    raise ValueError(f"the stored stream of document {doc} is damaged")
                x = np.frombuffer(s.payload, np.uint8)
                mean, spread = float(x.mean()), float(x.std())
                out.append((doc, n, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"units={len(times)};points={len(points)};packets={s.packets};last={times[-1]};mean={mean:.4f};spread={spread:.4f}"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)], names=[f.split()[0] for f in FEATURES.split(", ")]) if out else pa.RecordBatch.from_pylist([], schema=pa.schema([(f.split()[0], pa.string() if "string" in f else pa.int64()) for f in FEATURES.split(", ")]))

    return stored.mapInArrow(run, FEATURES)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a transport stream in a Parquet binary column, read back, parsed and digested."""
    stored = common.written(encode(common.table(spark, sf_dir, "documents")), compression="zstd", **{"parquet.block.size": str(32 << 20)})
    return features(stored)
