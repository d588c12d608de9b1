"""Bytes in MPEG transport streams: writing them, and reading the elementary streams of any program.

A stream is a row of packets of 188 bytes. The program association table (PID 0) names the program map tables, that
name the elementary streams' PIDs and types. The payload is cut into access units of UNIT bytes, each in a packetised
elementary packet with a presentation timestamp, UNIT_TICKS ticks of 90 kHz apart. Every KEY-th unit is a random-access
point: its first packet says so and has a clock reference. Packets are filled up with stuffing in adaptation fields.

Reading puts the tables together, of however many packets, and checks their checksums; checks the continuity counters of
the PID that is read; puts the elementary packets together and checks their lengths; and gives the payload, the
timestamps and which of them are random-access points.

A column of texts becomes a column of streams with encode_column(); a table with such a column is decoded with
decode_column(). Both work batch by batch and move nothing between tasks.

Defined cases. A null text is empty; its payload is 64 zero bytes. A very long text is one stream, held whole by the task
that writes or reads it. A null stream decodes to nulls. A stream that is not a row of packets, or whose tables are
wrong, decodes to nulls with the reason in `error`. A packet that repeats the one before it is passed over. Lost packets
count as discontinuities, be it that a counter is out of order (but where the stream says so), that a unit is shorter or
longer than it says, that packets come before the first unit, or that timestamps which go up evenly leave one out. A
unit that they are missing from is left out; one that is complete before them stays. A loss that none of this tells,
as of whole units at the end, can't be seen. Program 0 is the network's and is none. Repeated rows and other columns are
kept; a column in `keep` with the name of one that is made comes out as `given_` and its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import words as W
from sluice.llm.shared import given, stored, table

PACKET, SYNC = 188, 0x47
PMT_PID, DATA_PID, PROGRAM, PRIVATE = 0x1000, 0x0100, 1, 0x06
STREAM_ID = 0xBD
UNIT, KEY, UNIT_TICKS, FIRST_TICK = 8192, 16, 3600, 90_000
#: Payloads are padded to a multiple of this.
ALIGN = 64
HEADER = 14


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """The checksum of a table; 0 over a table with its checksum."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section_packet(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    section = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    section += section_crc(section).to_bytes(4, "big")
    head = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00"
    return (head + section).ljust(PACKET, b"\xff")


_TABLES = np.frombuffer(
    _section_packet(0, 0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    + _section_packet(PMT_PID, 0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"),
    np.uint8,
).reshape(2, PACKET)


def _stamp(ticks: int) -> bytes:
    t = ticks & 0x1FFFFFFFF
    return bytes([0x21 | (t >> 29) & 0x0E, t >> 22 & 0xFF, 0x01 | t >> 14 & 0xFE, t >> 7 & 0xFF, 0x01 | t << 1 & 0xFE])


def mux(payload: bytes) -> bytes:
    """A transport stream that holds a payload of at least a byte."""
    parts, counter = [_TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit = payload[at : at + UNIT]
        ticks = FIRST_TICK + UNIT_TICKS * k
        packet = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(ticks) + unit
        key = k % KEY == 0
        lead = 8 if key else 0  # an adaptation field with the flag and a clock reference
        n = 1 + max(0, -(-(len(packet) - (184 - lead)) // 184))
        rows = np.full((n, PACKET), 0xFF, np.uint8)
        rows[:, 0] = SYNC
        rows[:, 1], rows[:, 2] = DATA_PID >> 8, DATA_PID & 0xFF
        rows[0, 1] |= 0x40
        rows[:, 3] = 0x10 | (counter + np.arange(n)) & 0x0F
        counter = (counter + n) & 0x0F
        begin = np.full(n, 4)
        if key:
            base = ticks & 0x1FFFFFFFF
            rows[0, 3] |= 0x20
            rows[0, 4:12] = [7, 0x50, base >> 25 & 0xFF, base >> 17 & 0xFF, base >> 9 & 0xFF, base >> 1 & 0xFF, (base & 1) << 7 | 0x7E, 0]
            begin[0] = 12
        left = n * 184 - lead - len(packet)  # to stuff in the last packet
        if left:
            last = rows[n - 1]
            if last[3] & 0x20:
                last[4] += left
            else:
                last[3] |= 0x20
                last[4] = left - 1
                if left > 1:
                    last[5] = 0
            begin[n - 1] += left
        data = np.frombuffer(packet, np.uint8)
        if n == 1:
            rows[0, begin[0] :] = data
        else:
            first, end = PACKET - begin[0], len(data) - (PACKET - begin[n - 1])
            rows[0, begin[0] :] = data[:first]
            rows[1 : n - 1, 4:] = data[first:end].reshape(-1, 184)
            rows[n - 1, begin[n - 1] :] = data[end:]
        parts.append(rows)
    return np.concatenate(parts).tobytes()


class Demuxed:
    """What an elementary stream holds: payload, pts (ticks of each unit), random_access (indexes of units),
    discontinuities, packets (of the whole transport stream), program, pid, stream_type."""

    __slots__ = ("payload", "pts", "random_access", "discontinuities", "packets", "program", "pid", "stream_type")


class Packets:
    """The packets of a transport stream, and the elementary streams that its tables name: (program, type, PID)."""

    def __init__(self, data: bytes):
        if not data or len(data) % PACKET:
            raise ValueError("not a whole number of packets")
        rows = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
        if (rows[:, 0] != SYNC).any():
            raise ValueError("a packet does not begin with the sync byte")
        self.rows = rows
        self.pids = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
        self.has_field, self.has_payload = rows[:, 3] & 0x20 > 0, rows[:, 3] & 0x10 > 0
        self.begins = np.where(self.has_field, 5 + rows[:, 4].astype(np.int32), 4)
        self.streams: list[tuple[int, int, int]] = []
        pat = self._section(0)
        for at in range(8, len(pat) - 4, 4):
            program, pid = int.from_bytes(pat[at : at + 2], "big"), int.from_bytes(pat[at + 2 : at + 4], "big") & 0x1FFF
            if program:
                pmt = self._section(pid)
                at = 12 + (int.from_bytes(pmt[10:12], "big") & 0xFFF)
                while at < len(pmt) - 4:
                    self.streams.append((program, pmt[at], int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF))
                    at += 5 + (int.from_bytes(pmt[at + 3 : at + 5], "big") & 0xFFF)
        if not self.streams:
            raise ValueError("the tables name no elementary stream")

    def _own(self, pid: int) -> np.ndarray:
        """The packets of a PID that have a payload, without those that repeat the one before."""
        own = np.flatnonzero((self.pids == pid) & self.has_payload)
        same = np.zeros(len(own), bool)
        same[1:] = (self.rows[own[1:]] == self.rows[own[:-1]]).all(axis=1)
        return own[~same]

    def _section(self, pid: int) -> bytes:
        """The first table of a PID, of as many packets as it takes."""
        held, size = b"", 0
        for k in self._own(pid).tolist():
            row, begin = self.rows[k], int(self.begins[k])
            if row[1] & 0x40 and not held:
                begin += 1 + int(row[begin])
            elif not held:
                continue
            held += row[begin:].tobytes()
            if len(held) >= 3:
                size = 3 + (int.from_bytes(held[1:3], "big") & 0xFFF)
                if len(held) >= size:
                    break
        if not size:
            raise ValueError(f"no table with PID {pid}")
        section = held[:size]
        if len(section) < size or section_crc(section):
            raise ValueError(f"the table with PID {pid} has a wrong checksum")
        return section

    def read(self, program: int, stream_type: int, pid: int) -> Demuxed:
        out = Demuxed()
        out.packets, out.program, out.stream_type, out.pid = len(self.rows), program, stream_type, pid
        own = self._own(pid)
        mine, begin = self.rows[own], np.minimum(self.begins[own], PACKET)
        counters = mine[:, 3] & 0x0F
        flags = np.where(self.has_field[own] & (mine[:, 4] > 0), mine[:, 5], 0)
        breaks = np.flatnonzero(((np.diff(counters.astype(np.int16)) & 0x0F) != 1) & (flags[1:] & 0x80 == 0)) + 1
        out.discontinuities = len(breaks)
        sizes = PACKET - begin
        ends = np.cumsum(sizes)
        raw = mine[np.arange(PACKET) >= begin[:, None]].tobytes()
        starts = np.flatnonzero(mine[:, 1] & 0x40)
        if len(own) and (not len(starts) or starts[0]):
            out.discontinuities += 1
        parts, out.pts, out.random_access = [], [], []
        for s, till in zip(starts.tolist(), np.append(starts[1:], len(own)).tolist()):
            broken = breaks[np.searchsorted(breaks, s, "right") : np.searchsorted(breaks, till, "left")]
            last = int(broken[0]) if len(broken) else till  # what comes after a break belongs elsewhere
            unit = raw[int(ends[s] - sizes[s]) : int(ends[last - 1])]
            if unit[:3] != b"\x00\x00\x01":
                raise ValueError("an elementary packet does not begin with its start code")
            size = int.from_bytes(unit[4:6], "big")
            if not len(broken) and size and len(unit) != 6 + size:
                out.discontinuities += 1
            if len(unit) < 6 + size or not size and len(broken):
                continue  # packets of this unit are missing
            unit = unit[: 6 + size] if size else unit
            t = unit[9:14] if unit[7] & 0x80 else None
            if flags[s] & 0x40:
                out.random_access.append(len(out.pts))
            out.pts.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1 if t else None)
            parts.append(unit[9 + unit[8] :])
        if not out.discontinuities and None not in out.pts:
            step = np.diff(np.array(out.pts, np.int64))
            if len(step) > 2 and (step > 0).all() and 2 * (step == np.median(step)).sum() > len(step):
                out.discontinuities += int((step > 1.5 * np.median(step)).sum())
        out.payload = b"".join(parts)
        return out


def demux(data: bytes) -> Demuxed:
    """The first elementary stream of the first program."""
    packets = Packets(data)
    return packets.read(*packets.streams[0])


def demux_all(data: bytes) -> list[Demuxed]:
    """Every elementary stream of every program."""
    packets = Packets(data)
    return [packets.read(*stream) for stream in packets.streams]


def padded(text: bytes) -> bytes:
    return text + bytes(ALIGN - len(text) % ALIGN if len(text) % ALIGN or not text else 0)


def encode_column(docs: DataFrame, keep: tuple = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns in keep, n_bytes (of the text), media (a stream that holds the padded text)."""
    rows = docs.select(*given(keep, ("n_bytes", "media")), text_col)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(batch.num_columns - 1))
            raw, media, first = data.tobytes(), [], 0
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                media.append(mux(padded(raw[a:b])))
                if i + 1 == batch.num_rows or offsets[i + 1] - offsets[first] > 1 << 23:
                    own = batch.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array(np.diff(offsets[first : i + 2])), pa.array(media, pa.binary())], [*batch.schema.names[:-1], "n_bytes", "media"])
                    media, first = [], i + 1

    return rows.mapInArrow(each, f"{kinds}, n_bytes long, media binary")


_DECODED = "payload binary, pts array<long>, random_access array<int>, discontinuities int, packets int, program int, pid int, stream_type int, error string"


def decode_column(streams: DataFrame, keep: tuple = ("doc_id",), media_col: str = "media", every: bool = False) -> DataFrame:
    """The columns in keep and what each stream holds: payload, pts and random_access (indexes in pts) of its units,
    discontinuities, packets, program, pid, stream_type, error. A row for the first elementary stream of each transport
    stream, or, with every, for each of them."""
    types = [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.int32()] * 5, pa.string()]
    names = [x.split(" ")[0] for x in _DECODED.split(", ")]
    rows = streams.select(*given(keep, tuple(names)), media_col)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part, at, out = batch.slice(first, 1024), [], []
                for k, value in enumerate(part.column(part.num_columns - 1)):
                    found, error = [None], None
                    if value.is_valid:
                        data = value.as_buffer().to_pybytes()
                        try:
                            found = demux_all(data) if every else [demux(data)]
                        except (ValueError, IndexError) as e:
                            error = str(e)
                    for row in found:
                        at.append(k)
                        out.append([*(getattr(row, n) if row else None for n in names[:-1]), error])
                columns = list(zip(*out)) or [()] * len(names)
                kept = [c.take(pa.array(at, pa.int64())) for c in part.columns[:-1]] if every else part.columns[:-1]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(columns, types))], [*part.schema.names[:-1], *names])

    return rows.mapInArrow(each, f"{kinds}, {_DECODED}")


def op4_mpeg_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(encode_column(table(spark, sf_dir, "documents")), "media")
    kept = media.select("doc_id", "n_bytes", "media", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    out = decode_column(kept, ("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    last = F.octet_length("payload") - (ALIGN - 1)
    feature = F.concat_ws(
        ";", *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("program", "pid", "stream_type", "packets", "discontinuities")),
        F.concat(F.lit("units="), F.size("pts").cast("string")), F.concat(F.lit("random_access="), F.concat_ws(",", F.transform("random_access", lambda x: x.cast("string")))),
        F.concat(F.lit("pts="), F.get("pts", F.lit(0)).cast("string"), F.lit("-"), F.element_at("pts", -1).cast("string")),
    )
    return out.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", last, ALIGN)).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"),
    )


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op4_mpeg_ts": op4_mpeg_ts}
