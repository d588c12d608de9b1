import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import attribution, codes, mpegts, warc
from sluice.llm import words as W
from sluice.llm.shared import new_folder
from sluice.llm.tokens import Encoder, vocabulary
from tests.llm.common import awkward, bag, frame


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    return t


def texts():
    rng = random.Random(1)
    marks = ["a", "the ", "é", " ", "  ", "\n", "\r\n", "\t", "'s", "'", "1", "23", "...", "--", " ", " ", "\x1c", "\u0085", "漢字", "🙂", "ß.", "Don't", "_", "|", "<|endoftext|>"]
    return [r[1] or "" for r in awkward()] + ["".join(rng.choice(marks) for _ in range(rng.randrange(60))) for _ in range(1500)]


def test_encoder_is_the_library(library):
    import pyarrow as pa

    column = pa.array(texts())
    encoder = Encoder(vocabulary(), keep=100)
    got = []
    for b in W.blocks(column, W.NOT_SPACE):
        ids, counts = encoder.encode(b)
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [e.ids for e in library.encode_batch(texts(), add_special_tokens=False)]


def expected_attribution(library, text):
    """Line by line, token by token, with the library's own offsets."""
    from tokenizers.pre_tokenizers import ByteLevel  # noqa: F401  the library's byte alphabet

    text, lines, at = text or "", [], 0
    for line in text.split("\n"):
        lines.append([at, at + len(line), 0, 0])
        at += len(line) + 1
    raw, place = text.encode(), 0
    chars = [i for i, c in enumerate(text) for _ in c.encode()]
    for i in library.encode(text, add_special_tokens=False).ids:
        n = len(library.id_to_token(i))
        start, end = chars[place], chars[place + n - 1] + 1
        place += n
        shared = [min(end, e) - max(start, s) for s, e, *_ in lines]
        best = max(range(len(lines)), key=lambda k: (shared[k], -k))
        if shared[best] <= 0:
            best = max([k for k, x in enumerate(lines) if x[0] <= start], default=0)
        lines[best][2] += 1
        lines[best][3] += max(shared[best], 0) < end - start
    assert place == len(raw)
    return [(k, *x) for k, x in enumerate(lines)]


def test_attribution_by_brute_force(spark, library):
    rows = [(i, t) for i, t in enumerate(texts()[:400])]
    got = attribution.attribute(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(tuple(r) for r in got.collect()) == [(i, *x) for i, t in rows for x in expected_attribution(library, t)]


def test_attribution_with_the_librarys_offsets(spark):
    """Documents that go to the library by themselves are counted alike."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts(), " ".join(texts())])], "doc_id long, text string").repartition(3)
    assert bag(attribution.attribute(docs, whole=True).collect()) == bag(attribution.attribute(docs).collect())


def test_attribution_awkward(spark):
    got = attribution.attribute(frame(spark))
    assert {(r["section"], r["char_start"], r["char_end"], r["n_tokens"]) for r in got.where("doc_id IN (4, 5)").collect()} == {(0, 0, 0, 0)}
    assert attribution.attribute(frame(spark, [])).collect() == []
    fields = frame(spark).where("doc_id IN (1, 5)").select("doc_id", attribution.field_sections("lang", "text", "source").alias("f")).select("doc_id", "f.*")
    rows = attribution.attribute(fields, "sections").orderBy("doc_id", "section").collect()
    assert [(r["section"], r["char_end"] - r["char_start"]) for r in rows if r["doc_id"] == 1] == [(0, 2), (1, len(awkward()[0][1])), (2, 1)]
    none = fields.select("doc_id", "text", F.lit(None).alias("sections"))
    assert {r["section"] for r in attribution.attribute(none, "sections").collect()} == {0}


def test_rule_for_crossing_tokens():
    where, crossing = attribution.allocate(np.array([0, 3, 8, 9, 14]), np.array([3, 8, 9, 14, 15]), np.array([[1, 5], [5, 8], [10, 12], [12, 14]]))
    assert where.tolist() == [0, 1, 1, 2, 3] and crossing.tolist() == [True, True, True, True, True]


def test_codes_random_access():
    rng = np.random.default_rng(2)
    ids = np.concatenate([rng.integers(0, 50257, 5000), rng.integers(0, 256, 3000), [0, 255, 256, 65535, 65536, (1 << 32) - 1]]).astype(np.uint32)
    c = codes.Codes(codes.pack([7, None], np.array([0, 10, len(ids)]), ids))
    assert c.all().tolist() == ids.tolist() and c.doc_ids == [7, None]
    for i in [0, 511, 512, 513, *rng.integers(0, len(ids), 300).tolist(), len(ids) - 1]:
        assert c[i] == ids[i]
    with pytest.raises(ValueError):
        codes.Codes(codes.pack([1], np.array([0, 2]), ids[:2])[:-1])
    with pytest.raises(IndexError):
        c[len(ids)]


def test_token_files(spark, library):
    rows = sorted(((i, t) for i, t, *_ in awkward()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    expected, start = [], 0
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert bag(codes.token_files(frame(spark)).collect()) == bag(expected)
    assert codes.token_files(frame(spark, [])).collect() == []
    folder = new_folder(spark, "test")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)  # a file ends with a batch
    try:
        files = codes.write(frame(spark), folder, file_ids=200)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert files.count() > 3
    back = {r["start"]: r["ids"] for r in codes.read(files, folder).collect()}
    assert [len(back[s]) for _, s, _, _ in expected] == [n for _, _, n, _ in expected]


def test_transport_stream_round_trip():
    rng = random.Random(4)
    for n in (1, 64, 150, 157, 158, 159, 165, 166, 167, 168, 175, 182, 183, 184, 8191, 8192, 8193, 140_000):
        payload = rng.randbytes(n)
        stream = mpegts.mux(payload)
        out = mpegts.demux(stream)
        assert out.payload == payload and out.discontinuities == 0 and out.packets == len(stream) // 188
        assert len(out.pts) == -(-n // mpegts.UNIT) and out.random_access == list(range(0, len(out.pts), mpegts.KEY))
        assert out.pts == [mpegts.FIRST_TICK + k * mpegts.UNIT_TICKS for k in range(len(out.pts))]


def test_transport_stream_damage(spark):
    stream = mpegts.mux(bytes(range(256)) * 100)
    lost = stream[: 188 * 20] + stream[188 * 21 :]
    out = mpegts.demux(lost)
    assert out.discontinuities == 1 and len(out.pts) == 3 and len(out.payload) == 256 * 100 - mpegts.UNIT
    wrong = stream[:20] + b"\x00" + stream[21:]
    rows = spark.createDataFrame([(1, stream), (2, wrong), (3, b"x"), (4, None), (5, b"")], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in mpegts.decode_column(rows).collect()}
    assert got[1]["error"] is None and got[4]["error"] is None and got[4]["payload"] is None
    assert all(got[i]["error"] and got[i]["payload"] is None for i in (3, 5))


def test_media_query(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = mpegts.op4_mpeg_ts(spark, str(tmp_path)).collect()
    expected = []
    for i, t, *_ in awkward():
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        media = mpegts.mux(padded)
        expected.append((i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(media), hashlib.sha256(media).hexdigest()))
    assert bag(tuple(r)[:7] for r in got) == bag(expected)


def test_warc(spark):
    rows = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "u\r\nv", ""), (5, "http://é", "é" * 70000), (2, "http://a/2", "<p>x</p>"), (None, "n", "<p>x</p>"), (6, "h", "a\r\n\r\nb")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    folder = new_folder(spark, "warc-test")
    got = warc.read(warc.write(pages, folder, file_bytes=400), folder).collect()
    assert len(got) == len(rows)
    kinds = bag((r["page_id"], r["record_type"], r["refers_to"], r["payload_length"]) for r in got)
    assert kinds == bag([(1, "revisit", 2, 8), (2, "response", None, 8), (2, "response", None, 8), (None, "revisit", 2, 8), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 140000), (6, "response", None, 6)])
    for r in got:
        html = next((h or "" for i, _, h in rows if i == r["page_id"]), "").encode()
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(html).digest()).decode()
        assert r["payload"] in (None, html)
    apart = warc.read(warc.write(pages, f"{folder}-2", min_bytes=9), f"{folder}-2")
    assert apart.where("record_type = 'revisit'").count() == 0
    assert warc.read(warc.write(pages.limit(0), f"{folder}-3"), f"{folder}-3").collect() == []
