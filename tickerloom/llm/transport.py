"""MPEG transport streams as a media column: packets, program tables, continuity counters, elementary packets, timestamps.

`mux` writes a payload as one private elementary stream: a program association and a program map table ahead of every random-access
point, then elementary packets of `UNIT_BYTES` with a presentation timestamp each.  `demux` reads any 188-byte packet stream back:
it follows the tables to the streams, checks continuity counters (a repeated packet counts once, a gap drops the
elementary packet it hits), reassembles elementary packets and keeps timestamps and random-access points.

Edge cases of `store`: a null or empty text is a payload of 192 spaces; equal texts give equal bytes; a null doc_id is kept; texts of any
length are stored whole; an empty table gives no rows; other columns are ignored.  `demux` of bytes that are no stream finds nothing and counts
the bytes it skipped.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tickerloom.llm.common import read

PACKET = 188
SYNC = 0x47
PMT_PID, STREAM_PID = 0x100, 0x101
PRIVATE_DATA = 0x06
PRIVATE_STREAM_1 = 0xBD
PAD = 192
UNIT_BYTES = 16 * PAD
#: Ticks of the 90 kHz clock between elementary packets, and elementary packets between random-access points.
TICKS = 3600
RAP_EVERY = 8
CLOCK = 1 << 33


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1
        table.append(crc & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32 of MPEG sections: most significant bit first, no final inversion; 0 over a section with its own CRC."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _CRC[(crc >> 24) ^ byte]
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | length >> 8, length & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0]) + body
    return head + section_crc(head).to_bytes(4, "big")


PAT = _section(0x00, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF]))
PMT = _section(0x02, 1, bytes([0xE0 | STREAM_PID >> 8, STREAM_PID & 0xFF, 0xF0, 0, PRIVATE_DATA, 0xE0 | STREAM_PID >> 8, STREAM_PID & 0xFF, 0xF0, 0]))


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter & 15, 0])
    return (head + section).ljust(PACKET, b"\xff")


def _timestamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | (t >> 29 & 14) | 1, t >> 22 & 255, (t >> 14 & 254) | 1, t >> 7 & 255, (t << 1 & 254) | 1])


def _read_timestamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def mux(payload: bytes) -> bytes:
    """payload as a transport stream with one program and one stream."""
    out, tables, counter = [], 0, 0
    heads = [bytes([SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF, 0x10 | c]) for c in range(16)]
    for unit, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        pts, rap = unit * TICKS % CLOCK, unit % RAP_EVERY == 0
        data = payload[at : at + UNIT_BYTES]
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (8 + len(data)).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(2, pts) + data
        field_bytes = b""
        if rap:
            out += [_table_packet(0, PAT, tables), _table_packet(PMT_PID, PMT, tables)]
            tables += 1
            field_bytes = b"\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big")
        place = 0
        while place < len(pes):
            room = 184 - (1 + len(field_bytes) if field_bytes else 0)
            part = pes[place : place + room]
            if field_bytes or len(part) < room:
                stuffed = field_bytes or (b"" if len(part) == 183 else b"\x00")
                stuffed = stuffed.ljust(183 - len(part), b"\xff")
                head = bytes([SYNC, (0x40 if place == 0 else 0) | STREAM_PID >> 8, STREAM_PID & 0xFF, 0x30 | counter])
                out.append(head + bytes([len(stuffed)]) + stuffed + part)
            elif place == 0:
                out.append(bytes([SYNC, 0x40 | STREAM_PID >> 8, STREAM_PID & 0xFF, 0x10 | counter]) + part)
            else:
                out.append(heads[counter] + part)
            counter = counter + 1 & 15
            place += len(part)
            field_bytes = b""
    return b"".join(out)


@dataclass
class Unit:
    """An elementary packet: timestamps in 90 kHz ticks (None where absent), random access, its bytes."""

    pts: int | None
    dts: int | None
    random_access: bool
    data: bytes


@dataclass
class Stream:
    pid: int
    kind: int
    units: list[Unit] = field(default_factory=list)
    broken: int = 0


@dataclass
class Demuxed:
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, Stream] = field(default_factory=dict)
    packets: int = 0
    skipped_bytes: int = 0
    continuity_errors: int = 0
    duplicates: int = 0
    bad_sections: int = 0


def _unit(pes: bytes, random_access: bool) -> Unit | None:
    """The elementary packet in pes, or None where it is cut short or malformed."""
    if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
        return None
    length = int.from_bytes(pes[4:6], "big")
    if length and len(pes) < 6 + length:
        return None
    end = 6 + length if length else len(pes)
    flags, head = pes[7] >> 6, 9 + pes[8]
    if head > end:
        return None
    pts = _read_timestamp(pes[9:14]) if flags & 2 and pes[8] >= 5 else None
    dts = _read_timestamp(pes[14:19]) if flags == 3 and pes[8] >= 10 else None
    return Unit(pts, dts, random_access, pes[head:end])


def demux(stream: bytes) -> Demuxed:
    """Programs, streams and elementary packets of a transport stream."""
    out = Demuxed()
    pmts: set[int] = set()
    last: dict[int, tuple[int, int]] = {}  # pid: counter, place of the packet
    open_units: dict[int, tuple[bool, list[bytes]]] = {}
    sections: dict[int, bytes] = {}

    def close(pid: int) -> None:
        if pid in open_units:
            random_access, parts = open_units.pop(pid)
            unit = _unit(b"".join(parts), random_access)
            if unit is None:
                out.streams[pid].broken += 1
            else:
                out.streams[pid].units.append(unit)

    def table(pid: int, data: bytes) -> None:
        size = 3 + (int.from_bytes(data[1:3], "big") & 0x0FFF) if len(data) >= 3 else 0
        if not size or len(data) < size:
            sections[pid] = data
            return
        sections.pop(pid, None)
        data = data[:size]
        if size < 12 or section_crc(data):
            out.bad_sections += 1
        elif pid == 0 and data[0] == 0x00:
            for k in range(8, size - 4, 4):
                number, at = int.from_bytes(data[k : k + 2], "big"), int.from_bytes(data[k + 2 : k + 4], "big") & 0x1FFF
                if number:
                    out.programs[number] = at
                    pmts.add(at)
        elif pid in pmts and data[0] == 0x02:
            k = 12 + (int.from_bytes(data[10:12], "big") & 0x0FFF)
            while k + 5 <= size - 4:
                at = int.from_bytes(data[k + 1 : k + 3], "big") & 0x1FFF
                out.streams.setdefault(at, Stream(at, data[k]))
                k += 5 + (int.from_bytes(data[k + 3 : k + 5], "big") & 0x0FFF)

    at, size, locked = 0, len(stream), False
    while at + PACKET <= size:
        if stream[at] != SYNC or not locked and at + PACKET < size and stream[at + PACKET] != SYNC:
            # Lost: go on at the next place that looks like a packet followed by another (or by the end).
            locked = False
            ahead = stream.find(b"\x47", at + 1)
            ahead = size if ahead < 0 else ahead
            out.skipped_bytes += ahead - at
            at = ahead
            continue
        flags, pid, control = stream[at + 1], (stream[at + 1] & 31) << 8 | stream[at + 2], stream[at + 3]
        place, at, locked = at, at + PACKET, True
        out.packets += 1
        if flags & 0x80:
            continue
        begin, random_access, jump = place + 4, False, False
        if control & 0x20:
            length = stream[place + 4]
            begin = place + 5 + length
            if length and begin <= at:
                random_access, jump = bool(stream[place + 5] & 0x40), bool(stream[place + 5] & 0x80)
        if not control & 0x10 or begin > at or pid == 0x1FFF:
            continue
        counter, known = control & 15, last.get(pid)
        if known and not jump:
            if counter == known[0] and stream[known[1] + 4 : known[1] + PACKET] == stream[place + 4 : at]:
                out.duplicates += 1
                continue
            if counter != known[0] + 1 & 15:
                out.continuity_errors += 1
                sections.pop(pid, None)
                if pid in open_units:
                    del open_units[pid]
                    out.streams[pid].broken += 1
        last[pid] = counter, place
        body = stream[begin:at]
        if pid == 0 or pid in pmts:
            if flags & 0x40:
                table(pid, body[1 + body[0] :] if body else b"")
            elif pid in sections:
                table(pid, sections[pid] + body)
        elif pid in out.streams:
            if flags & 0x40:
                close(pid)
                open_units[pid] = random_access, [body]
            elif pid in open_units:
                open_units[pid][1].append(body)
    out.skipped_bytes += size - at
    for pid in list(open_units):
        close(pid)
    return out


def payload_of(found: Demuxed) -> bytes:
    return b"".join(unit.data for pid in sorted(found.streams) for unit in found.streams[pid].units)


def feature(found: Demuxed) -> str:
    units = [unit for pid in sorted(found.streams) for unit in found.streams[pid].units]
    times = [unit.pts for unit in units if unit.pts is not None]
    return (
        f"programs={len(found.programs)};streams={len(found.streams)};packets={found.packets};units={len(units)};"
        f"random_access={sum(u.random_access for u in units)};first_pts={min(times, default=-1)};last_pts={max(times, default=-1)};"
        f"continuity_errors={found.continuity_errors};broken={sum(s.broken for s in found.streams.values())}"
    )


COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // PAD)) * PAD, b" ")


def measure(text: bytes) -> tuple:
    media = mux(padded(text))
    found = demux(media)
    back = payload_of(found)
    return (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(found))


def store(docs: DataFrame, media: bool = False) -> DataFrame:
    """Measures of every text stored as a transport stream and read back; with `media` the stream itself, as binary, too."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                columns = [pa.array(c, k) for c, k in zip(zip(*map(measure, texts), strict=True), types, strict=True)]
                if media:
                    columns.append(pa.array([mux(padded(t)) for t in texts], pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *names, *["media"] * media])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, {COLUMNS}" + ", media binary" * media)


def streams(media: DataFrame) -> DataFrame:
    """Elementary packets of a table (id, media binary): id, pid, unit, pts, dts, random_access, data; null media give no rows."""
    types = [("pid", pa.int64()), ("unit", pa.int64()), ("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_()), ("data", pa.binary())]

    def rows(batches):
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = demux(data or b"")
                units = [(s.pid, k, u.pts, u.dts, u.random_access, u.data) for s in found.streams.values() for k, u in enumerate(s.units)]
                if units:
                    ids = pa.array([key] * len(units), batch.schema.field(0).type)
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, (_, k) in zip(zip(*units, strict=True), types, strict=True))], [batch.schema.names[0], *(n for n, _ in types)])

    key, _ = media.columns[:2]
    kind = media.schema[key].dataType.simpleString()
    return media.mapInArrow(rows, f"`{key}` {kind}, pid long, unit long, pts long, dts long, random_access boolean, data binary")


def op8_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(read(spark, sf_dir, "documents"))
