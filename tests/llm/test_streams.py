"""Transport streams against a plain reader, and damaged ones."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import mpegts
from tests.llm.common import awkward, bag, frame


def crc(data):
    c = 0xFFFFFFFF
    for byte in data:
        for bit in range(7, -1, -1):
            c = (c << 1 ^ (0x04C11DB7 if (c >> 31 ^ byte >> bit) & 1 else 0)) & 0xFFFFFFFF
    return c


def plain(data):
    """Packet by packet: payload, pts, random-access units, (program, PID, type), clock references."""
    held, units, random_access, clocks = {}, {}, {}, []
    for at in range(0, len(data), 188):
        p = data[at : at + 188]
        assert p[0] == 0x47
        pid, begin = (p[1] & 0x1F) << 8 | p[2], 4
        key = False
        if p[3] & 0x20:
            begin = 5 + p[4]
            key = p[4] > 0 and bool(p[5] & 0x40)
            if p[4] > 0 and p[5] & 0x10:
                clocks.append(p[6] << 25 | p[7] << 17 | p[8] << 9 | p[9] << 1 | p[10] >> 7)
        if not p[3] & 0x10:
            continue
        if p[1] & 0x40:
            units.setdefault(pid, []).append(b"")
            random_access.setdefault(pid, []).append(key)
        units[pid][-1] += p[begin:]
        held.setdefault(pid, []).append(p[3] & 0x0F)

    def section(pid):
        raw = units[pid][0]
        raw = raw[1 + raw[0] :]
        raw = raw[: 3 + ((raw[1] & 0x0F) << 8 | raw[2])]
        assert crc(raw) == 0
        return raw

    pat = section(0)
    program, pmt_pid = pat[8] << 8 | pat[9], (pat[10] & 0x1F) << 8 | pat[11]
    pmt = section(pmt_pid)
    at = 12 + ((pmt[10] & 0x0F) << 8 | pmt[11])
    kind, pid = pmt[at], (pmt[at + 1] & 0x1F) << 8 | pmt[at + 2]
    assert all((a + 1) % 16 == b for a, b in zip(held[pid], held[pid][1:]))
    payload, pts = b"", []
    for u in units[pid]:
        assert u[:3] == b"\0\0\1" and len(u) == 6 + (u[4] << 8 | u[5]) and u[7] & 0x80
        t = u[9:14]
        pts.append((t[0] >> 1 & 7) << 30 | (t[1] << 8 | t[2]) >> 1 << 15 | (t[3] << 8 | t[4]) >> 1)
        payload += u[9 + u[8] :]
    return payload, pts, [k for k, x in enumerate(random_access[pid]) if x], (program, pid, kind), clocks


def test_streams_by_a_plain_reader():
    rng = random.Random(6)
    for n in (1, 64, 157, 158, 182, 183, 184, 8192, 8193, 300_000):
        data = rng.randbytes(n)
        stream = mpegts.mux(data)
        payload, pts, keys, (program, pid, kind), clocks = plain(stream)
        assert payload == data and clocks == [pts[k] for k in keys] and keys[0] == 0
        out = mpegts.demux(stream)
        assert (out.payload, out.pts, out.random_access, out.program, out.pid, out.stream_type) == (payload, pts, keys, program, pid, kind)


def test_feature_and_media_of_the_query(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    media = [(r["doc_id"], bytes(r["media"])) for r in mpegts.encode_column(frame(spark)).collect()]
    expected = []
    for i, stream in media:
        payload, pts, keys, (program, pid, kind), _ = plain(stream)
        feature = f"program={program};pid={pid};stream_type={kind};packets={len(stream) // 188};discontinuities=0;units={len(pts)};random_access={','.join(map(str, keys))};pts={pts[0]}-{pts[-1]}"
        expected.append((i, len(payload), hashlib.sha256(payload).hexdigest(), len(stream), hashlib.sha256(stream).hexdigest(), feature))
    got = mpegts.op4_mpeg_ts(spark, str(tmp_path)).select("doc_id", "payload_bytes", "payload_sha256", "media_bytes", "media_sha256", "feature").collect()
    assert bag(got) == bag(expected) and len(got) == len(awkward())


def packets(stream):
    return [stream[i : i + 188] for i in range(0, len(stream), 188)]


def test_losses_are_told():
    data = random.Random(7).randbytes(51_200)
    rows = packets(mpegts.mux(data))
    n = len(rows)
    unit = mpegts.UNIT

    def read(kept):
        return mpegts.demux(b"".join(kept))

    for first in (5, 40, 100, n - 20):  # sixteen packets: the counters go on as if nothing were missing
        out = read(rows[:first] + rows[first + 16 :])
        assert out.discontinuities and len(out.payload) < len(data) and len(out.payload) % unit in (0, len(data) % unit)
    out = read(rows[:-1])
    assert out.discontinuities == 1 and out.payload == data[: len(data) // unit * unit]
    starts = [k for k, p in enumerate(rows) if p[1] & 0x40 and (p[1] & 0x1F) << 8 | p[2] == mpegts.DATA_PID]
    out = read(rows[: starts[2]] + rows[starts[2] + 1 :])  # the unit before the lost packet is whole
    assert out.discontinuities and out.payload == data[: 2 * unit] + data[3 * unit :]
    out = read(rows[:2] + rows[3:])
    assert out.discontinuities and out.payload == data[unit:]
    out = read(rows[: starts[1]] + rows[starts[2] :])  # a whole unit
    assert out.discontinuities and out.payload == data[:unit] + data[2 * unit :]
    out = read([p for p in rows for _ in range(2)])  # every packet sent twice
    assert out.discontinuities == 0 and out.payload == data
    for k in range(2, n):
        assert read(rows[:k] + rows[k + 1 :]).discontinuities or k == n - 1 and starts[-1] == k


def sections(pid, table_id, number, body):
    """A table in as many packets as it takes."""
    s = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0" + body
    s = b"\0" + s + crc(s).to_bytes(4, "big")
    out = []
    for k, i in enumerate(range(0, len(s), 184)):
        out.append((b"\x47" + ((0x4000 if k == 0 else 0) | pid).to_bytes(2, "big") + bytes([0x10 | k]) + s[i : i + 184]).ljust(188, b"\xff"))
    return out


def moved(stream, pid):
    return [p[:1] + bytes([p[1] & 0xE0 | pid >> 8, pid & 0xFF]) + p[3:] for p in packets(stream)[2:]]


def test_several_programs_and_long_tables(spark):
    rng = random.Random(8)
    data = {0x200: rng.randbytes(20_000), 0x201: rng.randbytes(300), 0x300: rng.randbytes(9_000)}
    pat = sections(0, 0, 1, b"".join(a.to_bytes(2, "big") + (0xE000 | b).to_bytes(2, "big") for a, b in ((0, 0x10), (3, 0x1100), (7, 0x1101))))
    info = b"\x52\xc8" + bytes(200)  # a descriptor that makes the table longer than a packet

    def pmt(pid, program, streams):
        body = (0xE000 | streams[0][1]).to_bytes(2, "big") + b"\xf0\0"
        return sections(pid, 2, program, body + b"".join(bytes([k]) + (0xE000 | p).to_bytes(2, "big") + (0xF000 | len(info)).to_bytes(2, "big") + info for k, p in streams))

    head = pat + pmt(0x1100, 3, [(6, 0x200), (15, 0x201)]) + pmt(0x1101, 7, [(6, 0x300)])
    assert len(head) > 3
    queues = [moved(mpegts.mux(d), pid) for pid, d in data.items()]
    body = []
    while any(queues):
        q = rng.choice([q for q in queues if q])
        body.append(q.pop(0))
    stream = b"".join(head + body)
    found = mpegts.demux_all(stream)
    assert [(x.program, x.stream_type, x.pid, x.payload) for x in found] == [(3, 6, 0x200, data[0x200]), (3, 15, 0x201, data[0x201]), (7, 6, 0x300, data[0x300])]
    assert mpegts.demux(stream).payload == data[0x200] and not any(x.discontinuities for x in found)
    rows = spark.createDataFrame([(1, stream), (2, b"x"), (3, None)], "doc_id long, media binary")
    got = mpegts.decode_column(rows, every=True).orderBy("doc_id", "pid").collect()
    assert [(r["doc_id"], r["pid"]) for r in got] == [(1, 0x200), (1, 0x201), (1, 0x300), (2, None), (3, None)]
    with pytest.raises(ValueError):
        mpegts.demux(b"".join(head[:2] + body))


def test_columns_with_clashing_names(spark):
    docs = frame(spark).withColumn("media", F.lit(1)).withColumn("payload", F.lit("p")).withColumn("pts", F.lit("q"))
    made = mpegts.encode_column(docs, ("doc_id", "media", "payload", "pts"))
    assert made.columns == ["doc_id", "given_media", "payload", "pts", "n_bytes", "media"]
    back = mpegts.decode_column(made, ("doc_id", "payload", "pts"))
    assert back.columns[:3] == ["doc_id", "given_payload", "given_pts"] and len(set(back.columns)) == len(back.columns)
    assert {r["given_pts"] for r in back.collect()} == {"q"} and back.where("error IS NOT NULL").count() == 0
    assert np.array_equal(sorted(len(r["payload"]) for r in back.collect()), sorted(max(64, -(-len((t or "").encode()) // 64) * 64) for _, t, *_ in awkward()))
