"""WARC files whose records are compressed one by one with a shared Zstandard dictionary.

A file is a sequence of Zstandard frames. The first is a skippable frame with the magic number 0x184D2A5D whose
content is the dictionary; every frame after it is one WARC record, compressed with that dictionary and with its
content size, so a record can be read knowing the dictionary and the frame's place only. The dictionary is built from
a bounded sample of the records to be archived: SAMPLE_RECORDS of them, those with the lowest hash of page_id and
html, until they have SAMPLE_BYTES; a page teaches with SAMPLE_BYTES / 16 characters of its html at most. The archive
itself holds all of every page.

Equal payloads are written once. Of the pages with one payload that with the largest page_id is a response, the
others are revisits that refer to it; with min_bytes above 0, smaller payloads are all responses. Roles are found on
digests alone: they are aggregated with partial sums, a payload on many pages is told to all tasks instead of gathering
its pages, and bodies are dealt once, by page_id, to meet their roles.

Writing tasks put files of about FILE_BYTES into the shared folder, named by attempt. The table of the files whose
tasks were committed says which ones count, so a task that is repeated leaves no record twice.

Defined cases. Null html is an empty payload. Rows that repeat a page_id and its payload get a record each; if the
page is its payload's response, all of them are. A null page_id ranks below all others. A null url is written as
`urn:sluice:none`. A very long page is a record like any other, held whole by the task that writes or reads it. An empty
table gives no files and an empty result. Columns other than page_id, url and html are not looked at, whatever their
names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.shared import beside_groups, hash_below, new_folder, stored, table

MAGIC = 0x184D2A5D
SAMPLE_RECORDS, SAMPLE_BYTES, DICT_BYTES = 2000, 8 << 20, 112 << 10
LEVEL = 3
#: A file is closed after so many bytes.
FILE_BYTES = 32 << 20

_DATE = "2024-01-01T00:00:00Z"  # of all records: the pages carry no date, and equal input gives equal files
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, refers_url: str | None, revisit: bool) -> bytes:
    """The bytes of one WARC/1.1 record."""
    uri = (url or "urn:sluice:none").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:sluice:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:sluice:page:{'none' if refers_to is None else refers_to}>"]
        if refers_url is not None:
            head.append("WARC-Refers-To-Target-URI: " + refers_url.replace("\r", "%0D").replace("\n", "%0A"))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields, in lower case, and the payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) < n + 4 or rest[n : n + 4] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    return fields, rest[:n].partition(b"\r\n\r\n")[2]


def dictionary(pages: DataFrame, total: int) -> bytes:
    """A dictionary for records of `total` pages (page_id, url, html), or no bytes if there is too little to learn from."""
    key = F.xxhash64("page_id", "html")
    near = pages.where(key <= hash_below(total, SAMPLE_RECORDS))
    html = F.coalesce(F.substring("html", 1, SAMPLE_BYTES // 16), F.lit("")).alias("html")
    # Equal rows have equal keys: however often a page occurs, it is sampled once.
    one = near.select(key.alias("key"), "page_id", "url", html).groupBy("key").agg(F.min(F.struct("page_id", "url", "html")).alias("r"))
    sample = one.orderBy("key").limit(SAMPLE_RECORDS).select("r.*")
    parts, held = [], 0
    for r in sample.toLocalIterator():
        payload = r["html"].encode()
        parts.append(record(r["page_id"], r["url"], payload, digest(payload), None, None, False))
        held += len(parts[-1])
        if held >= SAMPLE_BYTES:
            break
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(256, held // 10)), parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def _roles(pages: DataFrame, min_bytes: int, total: int) -> DataFrame:
    """pages (page_id, url, payload) with the response's page_id and url, and revisit."""
    rows = pages.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("n", F.octet_length("payload").cast("long"))
    rank = F.coalesce("page_id", F.lit(-(1 << 63)))
    narrow = rows.where(F.col("n") >= min_bytes).select("page_id", "url", "sha", "n")
    of = narrow.groupBy("sha", "n").agg(F.max(F.struct(rank.alias("rank"), "page_id", "url")).alias("to"), F.count(F.lit(1)).alias("copies"))
    of = of.where("copies > 1")  # a payload of its own is a response
    # Rows that repeat a page and its payload have the same role.
    roles = beside_groups(narrow.select("page_id", "sha", "n").distinct(), of, ["sha", "n"], "copies", total)
    roles = roles.select(F.col("page_id").alias("p"), F.col("sha").alias("s"), F.col("n").alias("m"), "to")
    out = rows.join(roles, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")) & (F.col("n") == F.col("m")), "left")
    revisit = F.col("to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("to.page_id"))
    return out.select("page_id", "url", "payload", F.col("to.page_id").alias("to_id"), F.col("to.url").alias("to_url"), revisit.alias("revisit"))


def write(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) to .warc.zst files in folder.

    Returns what was written, one row a file: name, records, bytes.
    """
    spark = pages.sparkSession
    total = pages.count()
    shared = spark.sparkContext.broadcast(dictionary(pages, total))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    rows = _roles(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload), min_bytes, total)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        used = shared.value
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(used) if used else None)
        done, out, name, records, size = [], None, "", 0, 0
        for batch in batches:
            for page_id, url, body, to_id, to_url, revisit in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if out is None:
                    name = f"part-{task.partitionId():05d}-{len(done):03d}-{task.taskAttemptId()}.warc.zst"
                    out, records = store.open_output_stream(f"{root}/{name}", compression=None), 0
                    size = out.write(struct.pack("<II", MAGIC, len(used)) + used)
                size += out.write(packer.compress(record(page_id, url, body, digest(body), to_id, to_url, revisit)))
                records += 1
                if size >= file_bytes:
                    out.close()
                    out = None
                    done.append((name, records, size))
        if out is not None:
            out.close()
            done.append((name, records, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["name", "records", "bytes"])

    return stored(rows.mapInArrow(each, "name string, records long, bytes long"), "warc-files")


def frames(data: bytes) -> Iterator[bytes]:
    """The records in a file's bytes."""
    magic, n = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("the file does not begin with a dictionary")
    used = data[8 : 8 + n]
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(used) if used else None)
    at, end = 8 + n, len(data)
    view = memoryview(data)
    while at < end:
        one = unpacker.decompressobj()
        out = [one.decompress(view[at : at + (1 << 16)])]
        at += 1 << 16
        while not one.eof:
            if at >= end:
                raise ValueError("a frame is cut short")
            out.append(one.decompress(view[at : at + (1 << 16)]))
            at += 1 << 16
        at = min(at, end) - len(one.unused_data)
        yield b"".join(out)


_READ = "page_id long, url string, record_type string, payload_digest string, payload_length long, refers_to long, payload binary"


def _number(uri: str | None) -> int | None:
    tail = uri.strip("<>").rpartition(":")[2] if uri else "none"
    return None if tail == "none" else int(tail)


def read(files: DataFrame, folder: str) -> DataFrame:
    """A row for each record in the files that write() returned; payload is null for revisits."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{root}/{name}") as f:
                    yield from _records(f.read())

    return files.select("name").repartition(max(1, files.count())).mapInArrow(each, _READ)


def _records(content: bytes) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    rows, held = [], 0
    for data in frames(content):
        f, payload = parse(data)
        revisit = f["warc-type"] == "revisit"
        named = f["warc-payload-digest"].removeprefix("sha1:")
        if not revisit and (digest(payload) != named or len(payload) != int(f["warc-payload-length"])):
            raise ValueError("a payload does not have its digest")
        rows.append({"page_id": _number(f["warc-record-id"]), "url": f["warc-target-uri"], "record_type": f["warc-type"], "payload_digest": named, "payload_length": int(f["warc-payload-length"]), "refers_to": _number(f.get("warc-refers-to")), "payload": None if revisit else payload})
        held += len(payload)
        if held > 1 << 24:
            yield pa.RecordBatch.from_pylist(rows, schema=kind)
            rows, held = [], 0
    yield pa.RecordBatch.from_pylist(rows, schema=kind)


def op6_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    records = read(write(table(spark, sf_dir, "pages"), folder), folder)
    return records.select("page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


ORACLE_SQL = {
    "op6_warc_dictionary": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS sha FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS top FROM h),
x AS (SELECT *, array_to_string([['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', c)] FOR c IN string_split(sha, '')], '') AS bits FROM r),
d AS (SELECT *, unnest(range(0, 32)) AS i FROM x)
SELECT page_id, CAST(any_value(n) AS BIGINT) AS payload_bytes,
       string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(('0b' || substr(bits, CAST(i * 5 + 1 AS INT), 5)) AS INT) + 1, 1), '' ORDER BY i) AS payload_digest,
       CASE WHEN page_id = any_value(top) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = any_value(top) THEN NULL ELSE any_value(top) END AS refers_to
FROM d GROUP BY page_id""",
}
QUERIES = {"op6_warc_dictionary": op6_warc_dictionary}
