"""Media columns: MPEG transport streams in a binary column.

`mux` wraps a payload into a stream with one programme: a PAT and a PMT, then elementary packets (PES) of
private data, each with a timestamp; every REFRESH-th begins with a random-access point and a clock reference.
`demux` reads any such bytes back: it finds the packets, assembles and checks the program tables, follows the
PIDs they name, checks the continuity counters, reassembles the elementary packets and gives their timestamps
and random-access points. Lost or doubled packets are counted; an elementary packet with a gap is dropped.

A null text is an empty one, which is stored as UNIT zero bytes. Equal payloads give equal streams.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmd.llm.common import unused
from docmd.llm.textvec import slices, tidy

#: Fixed values of the format.
PACKET, SYNC, PAT_PID, NULL_PID = 188, 0x47, 0x0000, 0x1FFF
PRIVATE_DATA, PRIVATE_STREAM_1 = 0x06, 0xBD
CLOCK = 90_000

PMT_PID, DATA_PID, PROGRAM = 0x1000, 0x0100, 1
UNIT = 64
ACCESS_BYTES = 8192
TICKS = CLOCK // 25
REFRESH = 12


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(PAT_PID, _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _pts(t: int) -> bytes:
    t &= (1 << 33) - 1
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, 0x01 | t >> 14 & 0xFE, t >> 7 & 0xFF, 0x01 | t << 1 & 0xFE])


def _clock(t: int) -> bytes:
    return (t << 15 | 0x3F << 9).to_bytes(6, "big")


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream."""
    parts, counter = [_TABLES], 0
    for k, a in enumerate(range(0, len(payload), ACCESS_BYTES)):
        body = payload[a : a + ACCESS_BYTES]
        data = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(body) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts(k * TICKS) + body
        field_ = b"\x50" + _clock(k * TICKS) if k % REFRESH == 0 else b""
        room = PACKET - 4 - (len(field_) + 1 if field_ else 0)
        whole = max(0, (len(data) - room) // (PACKET - 4))
        rest = len(data) - room - whole * (PACKET - 4) if len(data) >= room else 0
        # the first packet, then full ones, then one with stuffing
        sizes = [min(room, len(data)), *[PACKET - 4] * whole, *([rest] if rest else [])]
        at = 0
        for i, size in enumerate(sizes):
            adapt = field_ if i == 0 else b""
            stuffing = PACKET - 4 - size - (len(adapt) + 1 if adapt else 0)
            if stuffing and not adapt:
                adapt = b"" if stuffing == 1 else b"\x00" + b"\xff" * (stuffing - 2)
            elif stuffing:
                adapt += b"\xff" * stuffing
            control = 0x30 if adapt or stuffing else 0x10
            parts.append(bytes([SYNC, (0x40 if i == 0 else 0) | DATA_PID >> 8, DATA_PID & 0xFF, control | counter]))
            if control == 0x30:
                parts.append(bytes([len(adapt)]) + adapt)
            parts.append(data[at : at + size])
            at += size
            counter = counter + 1 & 15
    return b"".join(parts)


@dataclass
class Stream:
    """What a transport stream holds."""

    packets: int = 0
    programs: dict[int, list[int]] = field(default_factory=dict)  # the elementary PIDs of each programme
    payload: bytes = b""  # of the elementary packets, one after another
    timestamps: list[int] = field(default_factory=list)
    access_points: list[tuple[int, int]] = field(default_factory=list)  # place in the payload, timestamp
    continuity_errors: int = 0
    table_errors: int = 0
    damaged: int = 0  # elementary packets that were dropped


def _sections(data: bytes) -> Iterator[bytes | None]:
    """Sections of a table's packets from the pointer on; None for one whose checksum is wrong."""
    at = 0
    while at + 3 <= len(data) and data[at] != 0xFF:
        size = 3 + (int.from_bytes(data[at + 1 : at + 3], "big") & 0x0FFF)
        section = data[at : at + size]
        yield section if len(section) == size and crc32_mpeg(section) == 0 else None
        at += size


def demux(media: bytes) -> Stream:
    """Reads a stream; bytes before the first packet and half packets at the end are passed over."""
    out = Stream()
    raw = np.frombuffer(media, np.uint8)
    start = next((k for k in range(min(PACKET, len(raw))) if (raw[k::PACKET][: (len(raw) - k) // PACKET] == SYNC).all()), 0)
    n = (len(raw) - start) // PACKET
    pk = raw[start : start + n * PACKET].reshape(n, PACKET)
    pk = pk[(pk[:, 0] == SYNC) & (pk[:, 1] < 0x80)] if n else pk
    out.packets = len(pk)
    if not len(pk):
        return out
    pid = (pk[:, 1].astype(np.int32) & 0x1F) << 8 | pk[:, 2]
    begins = pk[:, 1] & 0x40 > 0
    control, counter = pk[:, 3] >> 4 & 3, pk[:, 3] & 15
    has = control & 1 > 0
    head = np.where(control & 2 > 0, 5 + pk[:, 4].astype(np.int32), 4)
    flags = np.where((control & 2 > 0) & (pk[:, 4] > 0), pk[:, 5], 0)
    has &= head < PACKET

    def table(of: int) -> Iterator[bytes]:
        mine = np.flatnonzero((pid == of) & has)
        for j, i in enumerate(mine):
            if begins[i]:
                data = pk[i, head[i] :].tobytes()
                data = data[1 + data[0] :]
                for follow in mine[j + 1 :]:
                    if begins[follow]:
                        break
                    data += pk[follow, head[follow] :].tobytes()
                for section in _sections(data):
                    if section is None:
                        out.table_errors += 1
                    else:
                        yield section

    for section in table(PAT_PID):
        for k in range(8, len(section) - 4, 4):
            number, at = (int.from_bytes(section[k + j : k + j + 2], "big") for j in (0, 2))
            if section[0] == 0 and number:
                for program in table(at & 0x1FFF):
                    pids, k2 = [], 12 + (int.from_bytes(program[10:12], "big") & 0x0FFF)
                    while program[0] == 2 and k2 + 5 <= len(program) - 4:
                        pids.append(int.from_bytes(program[k2 + 1 : k2 + 3], "big") & 0x1FFF)
                        k2 += 5 + (int.from_bytes(program[k2 + 3 : k2 + 5], "big") & 0x0FFF)
                    out.programs[number] = pids
    wanted = [p for pids in out.programs.values() for p in pids]
    pieces, length = [], 0
    for own in dict.fromkeys(wanted):
        mine = np.flatnonzero((pid == own) & has)
        doubled = np.zeros(len(mine), bool)
        gap = np.zeros(len(mine), bool)
        if len(mine) > 1:
            step = (counter[mine][1:].astype(int) - counter[mine][:-1]) % 16
            doubled[1:] = (step == 0) & (pk[mine[1:]] == pk[mine[:-1]]).all(1)
            gap[1:] = (step != 1) & ~doubled[1:] & (flags[mine[1:]] & 0x80 == 0)
        out.continuity_errors += int(gap.sum())
        mine, gap = mine[~doubled], gap[~doubled]
        firsts = np.flatnonzero(begins[mine])
        for a, b in zip(firsts, np.append(firsts[1:], len(mine)), strict=False):
            rows = mine[a:b]
            inside = np.arange(PACKET)[None, :] >= head[rows][:, None]
            data = pk[rows][inside].tobytes()
            size = int.from_bytes(data[4:6], "big")
            if gap[a + 1 : b].any() or data[:3] != b"\x00\x00\x01" or len(data) < 9 or (size and len(data) < 6 + size):
                out.damaged += 1
                continue
            stamp = None
            if data[7] & 0x80:
                p = data[9:14]
                stamp = (p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 0xFE) << 14 | p[3] << 7 | p[4] >> 1
                out.timestamps.append(stamp)
            if flags[rows[0]] & 0x40:
                out.access_points.append((length, stamp if stamp is not None else -1))
            body = data[9 + data[8] : 6 + size if size else len(data)]
            pieces.append(body)
            length += len(body)
    out.payload = b"".join(pieces)
    return out


def padded(data: bytes) -> bytes:
    """data and zero bytes up to a positive multiple of UNIT."""
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\x00")


def feature(s: Stream) -> str:
    return (
        f"programs={len(s.programs)};packets={s.packets};units={len(s.timestamps)};access={len(s.access_points)};first={s.timestamps[0] if s.timestamps else -1};"
        f"last={s.timestamps[-1] if s.timestamps else -1};continuity_errors={s.continuity_errors};table_errors={s.table_errors};damaged={s.damaged}"
    )


def stored(rows: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_bytes of the text and its stream in `media`; these replace kept columns of their names."""
    keep = [c for c in keep if c not in ("n_bytes", "media")]
    own = unused(keep, "_text")
    slim = rows.select(*keep, F.col(text).alias(own))
    schema = rows.select(*keep).withColumns({"n_bytes": F.lit(0).cast("long"), "media": F.lit(b"")}).schema

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offsets in slices(batch.column(own)):
                media = [mux(padded(raw[a:b].tobytes())) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in keep), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], [*keep, "n_bytes", "media"])

    return slim.mapInArrow(run, schema)


_READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, timestamps array<long>, access_points array<struct<place:long,timestamp:long>>"


def read(rows: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and what the streams of `media` hold: digests, features, timestamps, random-access points."""
    stream = unused(keep, "_media")
    slim = rows.select(*keep, F.col(media).alias(stream))
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for cell in batch.column(stream):
                data = cell.as_buffer().to_pybytes() if cell.is_valid else b""
                s = demux(data)
                found = (len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(s), s.timestamps, [{"place": p, "timestamp": t} for p, t in s.access_points])
                for column, x in zip(out, found, strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.struct([("place", pa.int64()), ("timestamp", pa.int64())]))]
            names = [x.split(" ")[0] for x in _READ.split(", ")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], [*keep, *names])

    return slim.mapInArrow(run, f"{own}, {_READ}")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read(stored(documents), keep=("doc_id", "n_bytes"))
