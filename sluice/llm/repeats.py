"""Substring dedup by repeated-phrase automata: words in recurring passages go, the first occurrence stays.

Words are runs of characters other than ASCII white space. A window is WINDOW consecutive words of one document. A
word goes if a window that covers it also starts earlier: in a document with a smaller id, or earlier in its own.

The work is done on blocks: about 2 MB of whole documents, compressed, written once and read by every step.

1. Candidates. Of the runs of ANCHOR words inside a window, the one with the least hash stands for it; equal windows
   have equal ones. Each block names the anchors that stand for its windows, once each, and where one lies. Anchors
   that lie at one place only, in all blocks, go.
2. Automata. Each block is a shard with its own Aho-Corasick automaton, made of the words of the candidates that the
   block holds, so automata are bounded by the size of a block and their number grows with the corpus. All documents
   stream through their shard's automaton, which locates every occurrence of every such phrase, word for word.
3. Passages. Windows with a located phrase gather by their least one: consecutive ones with the same phrase are a run.
4. Confirmation. A passage is known by 128 bits of the BLAKE2 digest of its words, so that only what the automata
   located and what has the same words counts as recurring; the hashes of step 1 merely bring candidates together. Of
   runs that are equal as a whole the first stays and the others go. Where an anchor has different runs, the first of
   each kind is settled window by window, by the same digest: of equal windows the first stays. Firsts are minima of
   (doc_id, block, word), and only firsts travel back to their blocks, so no group is gathered, however often a
   passage occurs, and no run is joined with its likes.
5. Removal. In each block, words of runs and windows that are not firsts go; the others are joined by one space.

Defined cases. Null and empty texts have no words. Rows that share a doc_id rank by where they are read; equal rows
are interchangeable. A null doc_id ranks last. Texts shorter than a window stay whole. A text of over 2 MB is a block
of its own and is worked on whole, in about 60 bytes of memory for each of its bytes; so is a word of any length. An
empty table gives an empty result. Only the id and the text are read, whatever the other columns are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import words as W
from sluice.llm.shared import drop_folder, stored, table

WINDOW, ANCHOR = 20, 8
#: Anchors inside a window.
INSIDE = WINDOW - ANCHOR + 1

#: Kinds of runs that an anchor must have at least to count as hot.
HOT = 10_000

_NONE = np.iinfo(np.uint64).max


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of whole documents: block (unique), body (an Arrow stream of doc_id and text, compressed)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = W.text_bytes(batch.column(1))
            i, n = 0, len(offsets) - 1
            while i < n:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + W.BLOCK, "right")) - 1)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i).cast(pa.string())], schema=schema))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "body"])
                number, i = number + 1, j

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(each, "block long, body binary")


def unpack(body: bytes) -> tuple[pa.Array, W.Block]:
    batch = pa.ipc.open_stream(body).read_next_batch()
    data, offsets = W.text_bytes(batch.column(1))
    return batch.column(0), W.Block((0, batch.num_rows), data, offsets, W.NOT_SPACE)


def _bodies(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.Array, W.Block]]:
    for row, (block, body) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
        yield row, block, *unpack(body.as_buffer())


def _anchors(blocks: DataFrame) -> DataFrame:
    """anchor, block, word: an anchor that stands for windows of the block, and a word where it begins.

    The word is given as -1 - word if the anchor stands for windows at two places or more in the block.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, block, _, b in _bodies(batch):
                ok = np.flatnonzero(b.words_left() >= WINDOW)
                if not len(ok):
                    continue
                g = W.grams(b.hashes(), ANCHOR)
                least = W.sliding_min(g, INSIDE)[ok]
                chosen = np.zeros(len(g), bool)
                for k in range(INSIDE):
                    chosen[ok[g[ok + k] == least] + k] = True
                at = np.flatnonzero(chosen)
                value, where, times = np.unique(g[at], return_index=True, return_counts=True)
                where = at[where]
                yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(np.full(len(value), block)), pa.array(np.where(times > 1, -1 - where, where).astype(np.int32))], ["anchor", "block", "word"])

    return blocks.select("block", "body").mapInArrow(each, "anchor long, block long, word int")


def _recurring(anchors: DataFrame) -> DataFrame:
    """block, anchors, words: for each block its recurring anchors and where one of each begins.

    An anchor has a row a block at most, so even one that all documents hold has few rows.
    """
    again = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("rows"), F.min("word").alias("least")).where("rows > 1 OR least < 0")
    rows = anchors.join(again.select("anchor"), "anchor")
    word = F.when(F.col("word") < 0, -1 - F.col("word")).otherwise(F.col("word"))
    return rows.groupBy("block").agg(F.collect_list(F.struct("anchor", word.alias("word"))).alias("anchors"))


class Joined:
    """A block's words as one string of bytes: for each document with words, a space, its words joined by spaces, a
    space and a line feed. begins, ends: of words in it."""

    def __init__(self, b: W.Block):
        filled = np.cumsum(b.counts > 0)
        text_of = np.repeat(np.arange(len(b)), b.counts)
        self.ends = np.cumsum(b.ends - b.starts + 1) + 2 * (filled[text_of] - 1)
        self.begins = self.ends - (b.ends - b.starts) - 1
        raw = b.data.tobytes()
        parts = (raw[i:j].split() for i, j in zip(b.offsets[:-1], b.offsets[1:]))
        self.text = b"\n".join(b" " + b" ".join(p) + b" " for p in parts if p)

    def digests(self, first: np.ndarray, words: np.ndarray | int) -> np.ndarray:
        """Two whole numbers that stand for the words of each passage, given by its first word and their number."""
        # A word begins after its space, which belongs to the place where a phrase is looked for.
        text, blake = self.text, hashlib.blake2b
        spans = zip((self.begins[first] + 1).tolist(), self.ends[first + words - 1].tolist())
        return np.frombuffer(b"".join([blake(text[i:j], digest_size=16).digest() for i, j in spans]), np.int64).reshape(-1, 2)


def locate(joined: Joined, values: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words where anchors begin, anywhere in the block, and which: an automaton over the block's text.

    values name the anchors; words say where in the block one of each can be read.
    """
    # Bytes as Latin-1 characters: positions in the text are then positions of bytes.
    text = joined.text.decode("latin-1")
    phrases = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, (i, j) in enumerate(zip(joined.begins[words].tolist(), (joined.ends[words + ANCHOR - 1] + 1).tolist())):
        phrases.add_word(text[i:j], k)
    phrases.make_automaton()
    found = np.array([x for hit in phrases.iter(text) for x in hit], np.int64).reshape(-1, 2)
    return np.searchsorted(joined.ends, found[:, 0]) - (ANCHOR - 1), values[found[:, 1]]


_RUN = {"anchor": pa.int64(), "run1": pa.int64(), "run2": pa.int64(), "rank": pa.int64(), "word": pa.int32(), "length": pa.int32()}
_RUNS = "block long, " + ", ".join(f"{k} array<{'long' if t == pa.int64() else 'int'}>" for k, t in _RUN.items())


def _runs(blocks: DataFrame, recurring: DataFrame) -> DataFrame:
    """A row for each block with the runs in it: their anchors, their digests, the documents' ids, the words where they
    begin, and how many windows they have."""
    joined = blocks.join(recurring, "block").select("block", "body", "anchors.anchor", "anchors.word")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, block, ids, b in _bodies(batch):
                columns = _runs_of(ids, b, *(_numbers(batch, k, row) for k in (2, 3)))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([c], pa.list_(t)) for c, t in zip(columns, _RUN.values()))], ["block", *_RUN])

    return joined.mapInArrow(each, _RUNS)


def _numbers(batch: pa.RecordBatch, column: int, row: int) -> np.ndarray:
    """A list of whole numbers; none for null."""
    value = batch.column(column)[row]
    return value.values.to_numpy(zero_copy_only=False).astype(np.int64) if value.is_valid else np.zeros(0, np.int64)


def _runs_of(ids: pa.Array, b: W.Block, values: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    joined = Joined(b)
    at, value = locate(joined, values, words)
    anchors = np.full(len(b.starts), _NONE, W.U)
    anchors[at] = value.view(W.U)
    ok = np.flatnonzero(b.words_left() >= WINDOW)
    least = W.sliding_min(anchors, INSIDE)[ok]
    p = ok[least != _NONE]
    if not len(p):
        return [np.zeros(0, np.int64)] * len(_RUN)
    least = least[least != _NONE]
    q = np.zeros(len(p), np.int64)
    for k in reversed(range(INSIDE)):
        q = np.where(anchors[p + k] == least, p + k, q)
    first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1])]))
    length = np.diff(np.append(first, len(p)))
    a = p[first]
    run = joined.digests(a, length + WINDOW - 1)
    return [anchors[q[first]].astype(np.int64), run[:, 0], run[:, 1], _ranks(ids, b, a), a, length]


def _ranks(ids: pa.Array, b: W.Block, words: np.ndarray) -> np.ndarray:
    """The ids of the documents that hold the words; null is the largest."""
    return ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)[np.searchsorted(b.first, words, "right") - 1].astype(np.int64)


def _firsts(runs: DataFrame) -> DataFrame:
    """block, firsts: for each block the runs in it that are the first of their kind, as struct(word, length, anchor,
    mixed); mixed if the anchor has other kinds of runs too.

    The kinds of an anchor are counted with partial sums. An anchor that has more than a 1,000th of all runs, and there
    are fewer than 1,000 of those, is told to all tasks; its kinds are not gathered to be told.
    """
    each = runs.select("block", F.inline(F.arrays_zip(*_RUN)))
    kinds = each.groupBy("anchor", "run1", "run2").agg(F.min(F.struct("rank", "block", "word", "length")).alias("first")).select("anchor", "first.*")
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    total = runs.agg(F.sum(F.size("anchor"))).first()[0] or 0
    hot = max(HOT, total // 1000)
    told = kinds.join(F.broadcast(several.where(F.col("kinds") > hot).select("anchor", F.lit(True).alias("hot"))), "anchor", "left")
    cold = told.where("hot IS NULL").join(several.where(F.col("kinds") <= hot), "anchor").withColumn("mixed", F.col("kinds") > 1)
    out = cold.select("block", "word", "length", "anchor", "mixed").unionByName(told.where("hot").select("block", "word", "length", "anchor", F.lit(True).alias("mixed")))
    return out.groupBy("block").agg(F.collect_list(F.struct("word", "length", "anchor", "mixed")).alias("firsts"))


def _windows(blocks: DataFrame, firsts: DataFrame) -> DataFrame:
    """A row for each window of the first runs of their kind whose anchor has several kinds: anchor, window1 and
    window2 (a digest), rank, block, word."""
    mixed = firsts.select("block", F.filter("firsts", lambda x: x["mixed"]).alias("f")).where(F.size("f") > 0)
    joined = blocks.join(mixed, "block").select("block", "body", "f.word", "f.length", "f.anchor")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, block, ids, b in _bodies(batch):
                word, length, anchor = (_numbers(batch, k, row) for k in range(2, 5))
                at = np.repeat(word, length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
                window = Joined(b).digests(at, WINDOW)
                columns = [np.repeat(anchor, length), window[:, 0], window[:, 1], _ranks(ids, b, at), np.full(len(at), block), at.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "window1", "window2", "rank", "block", "word"])

    return joined.mapInArrow(each, "anchor long, window1 long, window2 long, rank long, block long, word int")


def _stay(windows: DataFrame) -> DataFrame:
    """block, stay: for each block the words where windows begin that are the first of their kind."""
    least = windows.groupBy("anchor", "window1", "window2").agg(F.min(F.struct("rank", "block", "word")).alias("first"))
    return least.groupBy("first.block").agg(F.collect_list("first.word").alias("stay"))


def _goes(n: int, word: np.ndarray, length: np.ndarray, first: np.ndarray, mixed: np.ndarray, stay: np.ndarray) -> np.ndarray:
    """Which of a block's n words go."""
    whole = ~np.isin(word, first)  # runs that are not the first of their kind
    starts = np.zeros(n + 1, bool)  # windows that go one by one
    each = np.isin(word, first[mixed > 0])
    k = np.arange(int(length[each].sum())) - np.repeat(np.cumsum(length[each]) - length[each], length[each])
    starts[np.repeat(word[each], length[each]) + k] = True
    starts[stay] = False
    single = np.flatnonzero(starts)
    begins, ends = np.append(word[whole], single), np.append(word[whole] + length[whole] + WINDOW - 1, single + WINDOW)
    return np.cumsum(np.bincount(begins, minlength=n + 1) - np.bincount(ends, minlength=n + 1))[:n] > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    spark = docs.sparkSession
    blocks = stored(pack(docs, id_col, text_col), "blocks")
    anchors = stored(_anchors(blocks), "anchors")
    recurring = stored(_recurring(anchors), "recurring")
    drop_folder(spark, anchors.stored_at)
    runs = stored(_runs(blocks, recurring), "runs")
    drop_folder(spark, recurring.stored_at)
    firsts = stored(_firsts(runs), "firsts")
    stay = stored(_stay(_windows(blocks, firsts)), "stay")
    told = runs.select("block", "word", "length").join(firsts.select("block", "firsts.word", "firsts.mixed").toDF("block", "first", "mixed"), "block", "left").join(stay, "block", "left")
    joined = blocks.join(told, "block", "left").select("block", "body", "word", "length", "first", "mixed", "stay")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, ids, b in _bodies(batch):
                goes = _goes(len(b.starts), *(_numbers(batch, k, row) for k in range(2, 7)))
                total = np.concatenate([[0], np.cumsum(goes)])
                removed = total[b.first[1:]] - total[b.first[:-1]]
                raw, kept = b.data.tobytes(), []
                for k, (i, j) in enumerate(zip(b.offsets[:-1].tolist(), b.offsets[1:].tolist())):
                    own = raw[i:j].split()
                    if removed[k]:
                        own = [w for w, go in zip(own, goes[b.first[k] : b.first[k + 1]].tolist()) if not go]
                    kept.append(b" ".join(own).decode())
                yield pa.RecordBatch.from_arrays([ids, pa.array(b.counts), pa.array(removed), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(each, "doc_id long, n_words long, n_removed long, kept string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = {
    "op1_substring_dedup": rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
goes AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM again)),
lists AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM goes GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.p) AS kept FROM words ANTI JOIN goes ON words.doc_id = goes.doc_id AND words.p = goes.p GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN lists ON d.doc_id = lists.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id""",
}
QUERIES = {"op1_substring_dedup": op1_substring_dedup}
