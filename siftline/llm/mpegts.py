"""Media columns: MPEG transport streams.

A stream is a binary column. ``mux`` writes one (program tables, one private elementary stream in timed packets, random
access points with clock references); ``demux`` reads any stream of 188-byte packets: it finds the packet grid again
after garbage, checks the tables' CRCs, follows the association table to the map tables and their elementary streams,
counts breaks of the continuity counters, reassembles the elementary packets, and lists their timestamps.

Defined results: a null document has a null stream in ``encode`` unless nulls are asked to be empty; a stream with
nothing to read has no programs, packets or timestamps; equal payloads give equal streams. Repeated rows, empty tables
and extra columns are plain cases: each row is handled by itself, and only the named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops, workspace

PACKET = 188
SYNC = 0x47
PMT_PID, ES_PID = 0x1000, 0x0100
PRIVATE_PES, PRIVATE_STREAM = 0x06, 0xBD
UNIT_BYTES = 192 * 40
TICKS = 3600  # of a 90 kHz clock: 25 units a second
POINT_EVERY = 12


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc32_mpeg(head + body))


def _table_packet(pid: int, counter: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10 | (counter & 15)) + b"\x00" + section).ljust(PACKET, b"\xff")


PAT = _section(0x00, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
PMT = _section(0x02, 1, struct.pack(">HH", 0xE000 | ES_PID, 0xF000) + struct.pack(">BHH", PRIVATE_PES, 0xE000 | ES_PID, 0xF000))


def _timestamp(pts: int) -> bytes:
    return bytes([0x21 | ((pts >> 29) & 14), (pts >> 22) & 255, 1 | ((pts >> 14) & 254), (pts >> 7) & 255, 1 | ((pts << 1) & 254)])


def mux(payload: bytes, unit_bytes: int = UNIT_BYTES) -> bytes:
    """A transport stream that holds ``payload``, one elementary packet for every ``unit_bytes``."""
    out, counter, tables = [], 0, 0
    columns = np.arange(PACKET)
    for unit, at in enumerate(range(0, len(payload), unit_bytes)):
        data = payload[at : at + unit_bytes]
        pts = unit * TICKS
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + struct.pack(">H", len(data) + 8) + b"\x84\x80\x05" + _timestamp(pts & (2**33 - 1)) + data
        point = unit % POINT_EVERY == 0
        if point:
            out += [_table_packet(0, tables, PAT), _table_packet(PMT_PID, tables, PMT)]
            tables += 1
        room = PACKET - (12 if point else 4)
        n = 1 + max(0, -(-(len(pes) - room) // (PACKET - 4)))
        offset = np.full(n, 4)
        offset[0] = PACKET - room
        offset[-1] += n * (PACKET - 4) - (offset[0] - 4) - len(pes)
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
        packets[0, 1] |= 0x40
        packets[:, 3] = np.where(offset > 4, 0x30, 0x10) | ((counter + np.arange(n)) & 15)
        counter += n
        for i in {0, n - 1}:
            if offset[i] > 4:
                packets[i, 4] = offset[i] - 5
            if offset[i] > 5:
                packets[i, 5] = 0
        if point:
            packets[0, 5] = 0x50
            packets[0, 6:12] = list(struct.pack(">Q", ((pts & (2**33 - 1)) << 15) | 0x7E00)[2:])
        packets[columns >= offset[:, None]] = np.frombuffer(pes, np.uint8)
        out.append(packets.tobytes())
    return b"".join(out)


def packet_grid(stream: bytes) -> np.ndarray:
    """The packets as rows, wherever three sync bytes in a row (or to the end) show a grid."""
    data = np.frombuffer(stream, np.uint8)
    n = len(data) // PACKET
    if n and len(data) % PACKET == 0 and (data[::PACKET] == SYNC).all():
        return data.reshape(n, PACKET)
    rows, at = [], 0
    while at + PACKET <= len(data):
        if all(data[k] == SYNC for k in range(at, min(at + 3 * PACKET, len(data)), PACKET)):
            rows.append(data[at : at + PACKET])
            at += PACKET
        else:
            nxt = np.flatnonzero(data[at + 1 :] == SYNC)
            if not len(nxt):
                break
            at += 1 + int(nxt[0])
    return np.stack(rows) if rows else np.empty((0, PACKET), np.uint8)


def _payload_at(packets: np.ndarray) -> np.ndarray:
    """Where each packet's payload begins; 188 if it has none."""
    control = (packets[:, 3] >> 4) & 3
    begin = 4 + np.where(control & 2, 1 + packets[:, 4].astype(np.int64), 0)
    return np.where(control & 1, np.minimum(begin, PACKET), PACKET)


def _sections(packets: np.ndarray, table: int) -> list[tuple[int, bytes]]:
    """Numbers (of the program, in maps) and bodies (between header and CRC) of a PID's sections whose CRC holds."""
    begin, out, waiting = _payload_at(packets), [], b""
    for p, at in zip(packets, begin):
        body = p[at:].tobytes()
        starts = p[1] & 0x40 and body  # what stands before the pointer ends the section that waits
        for fresh, piece in ((False, body[1 : 1 + body[0]]), (True, body[1 + body[0] :])) if starts else ((False, body),):
            waiting = piece if fresh else waiting and waiting + piece
            while len(waiting) >= 3 and waiting[0] != 0xFF:
                size = 3 + (struct.unpack(">H", waiting[1:3])[0] & 0xFFF)
                if len(waiting) < size:
                    break
                one, waiting = waiting[:size], waiting[size:]
                if one[0] == table and size >= 12 and crc32_mpeg(one) == 0:
                    out.append((struct.unpack(">H", one[3:5])[0], one[8:-4]))
    return out


def demux(stream: bytes) -> dict:
    """programs {number: {stream PID: type}}, packets, breaks, payload (of all elementary streams by PID, end to end),
    and units: (pid, pts or -1, offset of its data in the payload, bytes, whether random access begins there).
    Tables are merged over their sections and versions: what any of them names is read."""
    packets = packet_grid(stream)
    pids = ((packets[:, 1].astype(np.int64) & 31) << 8) | packets[:, 2]
    programs: dict[int, dict[int, int]] = {}
    maps: set[int] = set()
    for _, body in _sections(packets[pids == 0], 0x00):
        for number, pid in struct.iter_unpack(">HH", body[: len(body) // 4 * 4]):
            if number:
                programs.setdefault(number, {})
                maps.add(pid & 0x1FFF)
    for pid in sorted(maps):
        for number, body in dict.fromkeys(_sections(packets[pids == pid], 0x02)):
            if number not in programs:
                continue
            at = 4 + (struct.unpack(">H", body[2:4])[0] & 0xFFF)
            while at + 5 <= len(body):
                kind, es, info = struct.unpack(">BHH", body[at : at + 5])
                programs[number][es & 0x1FFF] = kind
                at += 5 + (info & 0xFFF)
    breaks, units, payload, total = 0, [], [], 0
    for pid in sorted({p for streams in programs.values() for p in streams}):
        own = packets[pids == pid]
        begin = _payload_at(own)
        carries = begin < PACKET
        own, begin = own[carries], begin[carries]
        if not len(own):
            continue
        counter = own[:, 3] & 15
        step = (counter[1:].astype(np.int64) - counter[:-1]) & 15
        again = np.concatenate([[False], (step == 0) & (own[1:] == own[:-1]).all(1)])  # a packet may be sent twice
        marked = (own[:, 3] >> 4 == 3) & (own[:, 4] > 0) & (own[:, 5] & 0x80 > 0)  # an announced discontinuity
        breaks += int(((step != 1) & ~again[1:] & ~marked[1:]).sum())
        own, begin = own[~again], begin[~again]
        data = own[np.arange(PACKET) >= begin[:, None]].tobytes()
        ends = np.cumsum(PACKET - begin)
        first = np.flatnonzero(own[:, 1] & 0x40)
        point = (own[:, 3] >> 4 == 3) & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)
        for k, i in enumerate(first):
            at = int(ends[i] - (PACKET - begin[i]))
            to = int(ends[first[k + 1] - 1]) if k + 1 < len(first) else len(data)
            pes = data[at:to]
            if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
                continue
            size = struct.unpack(">H", pes[4:6])[0]
            pes = pes[: 6 + size] if size else pes
            pts = -1
            if pes[7] & 0x80 and len(pes) >= 14:
                p = pes[9:14]
                pts = ((p[0] & 14) << 29) | (p[1] << 22) | ((p[2] & 254) << 14) | (p[3] << 7) | (p[4] >> 1)
            body = pes[9 + pes[8] :]
            units.append((pid, pts, total, len(body), bool(point[i])))
            payload.append(body)
            total += len(body)
    return {"programs": programs, "packets": len(packets), "breaks": breaks, "payload": b"".join(payload), "units": units}


def padded(text: bytes, unit: int = 192) -> bytes:
    """``text`` with spaces up to a positive multiple of ``unit`` bytes."""
    return text.ljust(max(unit, -(-len(text) // unit) * unit), b" ")


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", null_is_empty: bool = True) -> DataFrame:
    """doc_id, n_bytes (without padding), media: a stream of each document's UTF-8 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, bounds in textops.utf8_batches(batch.column(1), 8_000_000):
                raw, rows = data.tobytes(), len(bounds) - 1
                valid = [True] * rows if null_is_empty else batch.column(1).slice(at, rows).is_valid().to_pylist()
                media = [mux(padded(raw[s:e])) if ok else None for s, e, ok in zip(bounds[:-1].tolist(), bounds[1:].tolist(), valid)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), pa.array(np.diff(bounds), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


#: Streams whose units are held at once, one after the other being read.
DECODE_ROWS = 256
UNITS = pa.list_(pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("offset", pa.int64()), ("bytes", pa.int64()), ("random_access", pa.bool_())]))


def decode(media: DataFrame) -> DataFrame:
    """``encode``'s rows parsed: digests of what was read back, packets, breaks, units (the timestamps), feature."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "packets", "breaks", "units", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, DECODE_ROWS) for b in batches for at in range(0, b.num_rows, DECODE_ROWS)):
            rows = []
            for stream in batch.column(2):
                raw = stream.as_buffer()
                raw = raw.to_pybytes() if raw is not None else b""
                got = demux(raw)
                payload, units = got["payload"], got["units"]
                times = [u[1] for u in units if u[1] >= 0]
                points = ",".join(str(u[1]) for u in units if u[4])
                feature = f"packets={got['packets']};units={len(units)};breaks={got['breaks']};programs={len(got['programs'])};pts={min(times, default=-1)}..{max(times, default=-1)};points={points}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), got["packets"], got["breaks"], [dict(zip(("pid", "pts", "offset", "bytes", "random_access"), u)) for u in units], feature))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), UNITS, pa.string()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, packets long, breaks long, "
        "units array<struct<pid:int,pts:bigint,offset:bigint,bytes:bigint,random_access:boolean>>, feature string",
    )


def transport_streams(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Stores every document as a stream and reads the stored streams back: ``decode``'s columns."""
    return decode(workspace.stage(encode(docs, text, key), "mpegts"))
