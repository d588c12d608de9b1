"""Token ids in files of directly addressable codes.

An id is split into chunks of 8 bits, the lowest first. Level 0 holds every id's first chunk, level 1 the second chunk
of the ids that have one, and so on; but for the last, a level has a bitmap that says which of its entries go on, and
a rank directory with the number of such entries before every 512th. The place of an entry on the next level is thus
a look-up and a population count of 64 bytes at most, and any id is read without decoding its neighbours.

A file holds consecutive documents, whole, of about FILE_IDS ids: a header, the documents' ids and where each begins,
and the levels. Documents are dealt by ranges of doc_id and sorted within, so files in order hold all documents in
order. Tasks name files by attempt; the table of the files that were committed says which count, with the number of
ids before each, added up over groups of files first.

Defined cases. A null text is empty: it has the end id alone. Rows that share a doc_id are stored in the order of
their texts. A null doc_id comes first and is kept as null. A very long text is one entry of one file, whose ids a task
holds whole. An empty table gives no files and an empty result. Columns other than the id and the text are not looked at,
whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from sluice.llm import words as W
from sluice.llm.shared import handing_back, new_folder, stored, table
from sluice.llm.tokens import Encoder, vocabulary

MAGIC, BITS, RANK = b"DACIDS01", 8, 512
END = 0
FILE_IDS = 1 << 22
#: Bytes of rows that a task is given at a time; a longer text ends its batch.
BATCH = 1 << 18
#: Files whose sums are added up together before the groups' sums are.
GROUP = 1024


def encode(ids: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
    """For each level: chunks, bitmap, rank directory (the last two empty for the last level)."""
    levels, rest = [], ids.astype(np.uint32, copy=False)
    while True:
        chunks = (rest & np.uint32(0xFF)).astype(np.uint8).tobytes()
        on = rest > 0xFF
        if not on.any():
            levels.append((chunks, b"", b""))
            return levels
        filled = np.concatenate([on, np.zeros(-len(on) % RANK, bool)])
        ones = np.count_nonzero(filled.reshape(-1, RANK), axis=1)
        levels.append((chunks, np.packbits(filled, bitorder="little").tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes()))
        rest = rest[on] >> np.uint32(BITS)


def pack(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file's bytes. starts has one more entry than there are documents."""
    levels = encode(ids)
    out = [MAGIC, struct.pack("<QQI", len(doc_ids), len(ids), len(levels))]
    out += [np.array([x is not None for x in doc_ids], np.uint8).tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), starts.astype("<u8").tobytes()]
    for parts in levels:
        out += [struct.pack("<QQQ", *map(len, parts)), *parts]
    return b"".join(out)


class Codes:
    """A file's ids."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a file of codes")
        docs, self.n, levels = struct.unpack_from("<QQI", data, 8)
        at = 28
        known = np.frombuffer(data, np.uint8, docs, at)
        numbers = np.frombuffer(data, "<i8", docs, at + docs)
        self.doc_ids = [x if k else None for x, k in zip(numbers.tolist(), known.tolist())]
        self.starts = np.frombuffer(data, "<u8", docs + 1, at + 9 * docs).astype(np.int64)
        at += 9 * docs + 8 * (docs + 1)
        self.levels = []
        for _ in range(levels):
            sizes = struct.unpack_from("<QQQ", data, at)
            at += 24
            parts = []
            for size, kind in zip(sizes, (np.uint8, np.uint8, "<u4")):
                parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
                at += size
            self.levels.append(tuple(parts))
        if at != len(data):
            raise ValueError("a file of codes is cut short or too long")

    def __getitem__(self, i: int) -> int:
        """The i-th id, by one look-up a level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (BITS * k)
            if not len(bits) or not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK
            own = np.unpackbits(bits[block * RANK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK]
            i = int(ranks[block]) + int(own.sum())
        return value

    def all(self) -> np.ndarray:
        out = np.zeros(self.n, np.uint32)
        at = np.arange(self.n)
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.uint32) << np.uint32(BITS * k)
            at = at[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)] if len(bits) else at[:0]
        return out


def write(docs: DataFrame, folder: str, path: str | None = None, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all texts, each followed by END, to files in folder; returns the table of the files.

    Its rows: name, task, number, docs, ids (how many it holds), base (ids in all files before).
    """
    path = path or vocabulary()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        encoder = Encoder(path)
        done: list[tuple] = []
        names: list[int | None] = []
        parts: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def close() -> None:
            if names:
                starts, ids = np.concatenate([[0], np.cumsum(np.concatenate(counts))]), np.concatenate(parts)
                parts.clear()
                name = f"part-{task.partitionId():05d}-{len(done):03d}-{task.taskAttemptId()}.dac"
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(pack(names, starts, ids))
                done.append((name, task.partitionId(), len(done), len(names), int(starts[-1])))
            names.clear(), parts.clear(), counts.clear()

        held = 0
        for batch in batches:
            for b in W.blocks(batch.column(1), W.NOT_SPACE):
                ids, n = encoder.encode(b)
                parts.append(np.insert(ids, np.cumsum(n), END))
                counts.append(n + 1)
                names += batch.column(0).slice(b.rows[0], len(b)).to_pylist()
                held += len(parts[-1])
                if held >= file_ids:
                    close()
                    held = 0
        close()
        columns = list(zip(*done)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], ["name", "task", "number", "docs", "ids"])

    files = stored(rows.mapInArrow(handing_back(each), "name string, task long, number long, docs long, ids long"), "code-files", BATCH)
    return _with_base(files, GROUP)


def _with_base(files: DataFrame, group: int) -> DataFrame:
    """Adds base: the ids in all files before, in the order of task and number.

    Files of `group` consecutive tasks are added up among themselves, then the groups.
    """
    files = files.withColumn("group", F.floor(F.col("task") / group))
    before = Window.partitionBy("group").orderBy("task", "number").rowsBetween(Window.unboundedPreceding, -1)
    groups = files.groupBy("group").agg(F.sum("ids").alias("sum"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(F.col("group").alias("g"), F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("ahead"))
    out = files.withColumn("in_group", F.coalesce(F.sum("ids").over(before), F.lit(0))).join(groups, F.col("group") == F.col("g"))
    return out.select("name", "task", "number", "docs", "ids", (F.col("ahead") + F.col("in_group")).alias("base"))


def read(files: DataFrame, folder: str) -> DataFrame:
    """A row for each document in the files: doc_id, start (ids of all documents before), ids."""
    return _each_file(files, folder, "doc_id long, start long, ids array<int>", lambda c, base: _documents(c, base))


def _documents(c: Codes, base: int) -> Iterator[pa.RecordBatch]:
    ids, step = c.all().astype(np.int32), 4096
    for i in range(0, len(c.doc_ids), step):
        own = c.starts[i : i + step + 1]
        lists = pa.ListArray.from_arrays(pa.array((own - own[0]).astype(np.int32)), pa.array(ids[own[0] : own[-1]]))
        yield pa.RecordBatch.from_arrays([pa.array(c.doc_ids[i : i + step], pa.int64()), pa.array(base + own[:-1]), lists], ["doc_id", "start", "ids"])


def _digests(c: Codes, base: int) -> Iterator[pa.RecordBatch]:
    raw = c.all().astype("<u4").tobytes()
    crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(c.starts[:-1].tolist(), c.starts[1:].tolist())]
    yield pa.RecordBatch.from_arrays([pa.array(c.doc_ids, pa.int64()), pa.array(base + c.starts[:-1]), pa.array(np.diff(c.starts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _each_file(files: DataFrame, folder: str, schema: str, of) -> DataFrame:
    n = files.count()
    rows = files.select("name", "base").repartition(max(1, n)) if n else files.select("name", "base")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{root}/{name}") as f:
                    yield from of(Codes(f.read()), base)

    return rows.mapInArrow(handing_back(each), schema)


def token_files(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes docs' ids and reads them back: doc_id, start, n_tokens, ids_crc32 for each document."""
    folder = folder or new_folder(docs.sparkSession, "codes")
    return _each_file(stored(write(docs, folder), "code-index"), folder, "doc_id long, start long, n_tokens long, ids_crc32 long", _digests)


def op7_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op7_token_codes": op7_token_codes}
