"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Words are runs of ASCII letters and digits and of characters outside ASCII, after lower-casing A-Z. A window is
`ngram` consecutive words of a benchmark item; an item of fewer words, but not none, is one window. The windows'
hashes are broadcast; each document's windows are looked up while it streams by, and every hit is confirmed on the
words themselves. The set that is broadcast holds MAX_WINDOWS windows at most: a larger benchmark is dealt by hash
into slices of that size, the documents are scanned once a slice, and the hits are put together by document.

Defined cases. Null or empty text has no words and is clean. A very long text is worked on whole. An empty benchmark makes every document clean. Equal
items each count. Repeated rows are each judged. Columns other than the id and the text are
not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import words as W
from sluice.llm.shared import handing_back, pieces, table

NGRAM = 13
#: Most windows that are broadcast at a time, about 150 MB in each Python worker.
MAX_WINDOWS = 500_000

_FOUND = "doc_id {id}, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,length:long>>"


def windows(benchmark: DataFrame, ngram: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per distinct window of the benchmark: hash, n (its words), words, item_ids (all items that hold it)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            h, n, text, item = [], [], [], []
            for b in W.blocks(batch.column(1), W.ALNUM, lower=True):
                hashes = b.hashes()
                for row, (i, j) in enumerate(zip(b.first[:-1], b.first[1:])):
                    if i == j:
                        continue
                    k = min(ngram, j - i)
                    g = W.grams(hashes[i:j], k)
                    h += g.astype(np.int64).tolist()
                    n += [int(k)] * len(g)
                    text += [b.text_of(s, s + k).decode() for s in range(i, j - k + 1)]
                    item += [ids[b.rows[0] + row]] * len(g)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int32()), pa.array(text, pa.string()), pa.array(item, pa.string())], ["hash", "n", "words", "item"])

    items = benchmark.select(F.col(id_col).cast("string"), text_col)
    return items.mapInArrow(each, "hash long, n int, words string, item string").groupBy("n", "hash", "words").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))


class WindowSet:
    """Windows for look-up: by number of words, the sorted hashes, and what each stands for."""

    #: Bits of the first filter, which most windows of clean text do not pass.
    BITS = 22

    def __init__(self, rows: list):
        self.by_n: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.of: dict[tuple[int, int], list[tuple[bytes, list[str]]]] = {}
        for r in rows:
            self.of.setdefault((r["n"], r["hash"] & 0xFFFFFFFFFFFFFFFF), []).append((r["words"].encode(), r["item_ids"]))
        for n in {n for n, _ in self.of}:
            h = np.sort(np.array([h for m, h in self.of if m == n], W.U))
            seen = np.zeros(1 << self.BITS, bool)
            seen[h >> W.U(64 - self.BITS)] = True
            self.by_n[n] = h, seen

    def hits(self, b: W.Block) -> Iterator[tuple[int, int, list[str]]]:
        """The first word, the number of words and the items of each window that occurs in the block."""
        if not self.by_n or not len(b.starts):
            return
        hashes, left = b.hashes(), b.words_left()
        for n, (known, seen) in self.by_n.items():
            g = W.grams(hashes, n)
            at = np.flatnonzero(seen[g >> W.U(64 - self.BITS)] & (left[: len(g)] >= n))
            if not len(at):
                continue
            k = np.searchsorted(known, g[at]).clip(max=len(known) - 1)
            for i in at[known[k] == g[at]].tolist():
                text = b.text_of(i, i + n)
                for words, items in self.of[n, int(g[i])]:
                    if words == text:
                        yield i, n, items


def _judged(b: W.Block, found: WindowSet) -> Iterator[tuple[int, int, list[str], list[tuple[int, int]]]]:
    """For each text of a block: words, hit words, items, merged spans of hit words."""
    edges, items, spans = np.zeros(len(b.starts) + 1, np.int64), {}, {}
    for i, n, own in found.hits(b):
        edges[i] += 1
        edges[i + n] -= 1
        items.setdefault(int(np.searchsorted(b.first, i, "right")) - 1, set()).update(own)
    hit = np.cumsum(edges[:-1]) > 0
    for row in items:
        i, j = b.first[row], b.first[row + 1]
        change = np.flatnonzero(np.diff(np.concatenate([[False], hit[i:j], [False]])))
        spans[row] = list(zip(change[::2].tolist(), (change[1::2] - change[::2]).tolist()))
    for row, n in enumerate(b.counts.tolist()):
        own = spans.get(row, [])
        yield n, sum(k for _, k in own), sorted(items.get(row, ())), own


def find(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, max_windows: int = MAX_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit (words inside any occurrence of a window), item_ids (sorted, of items
    with occurring windows), spans (first word and number of words of each run of hit words)."""
    spark = docs.sparkSession
    every = windows(benchmark, ngram).persist()
    try:
        slices = pieces(every.count(), max_windows)
        if slices == 1:
            return _scan(docs, spark.sparkContext.broadcast(WindowSet(every.collect())), id_col, text_col)
        # Slices by hash are even enough: no slice is near twice the mean at these sizes.
        sets = [spark.sparkContext.broadcast(WindowSet(every.where(F.pmod("hash", F.lit(slices)) == k).collect())) for k in range(slices)]
    finally:
        every.unpersist()
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key")).alias("doc_id"), text_col)
    kind = keyed.schema["doc_id"].dataType.simpleString()
    parts = None
    for found in sets:
        one = _scan(keyed, found, "doc_id", text_col, kind).distinct()  # equal rows have equal hits
        parts = one if parts is None else parts.unionByName(one)
    covered = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("spans")), lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))
    merged = parts.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.sort_array(covered).alias("w"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    # w is ascending: a run begins where the number before is not one less, and ends where the next is not one more.
    begins = F.filter("w", lambda x, i: (i == 0) | (F.get("w", i - 1) != x - 1))
    ends = F.filter("w", lambda x, i: (i == F.size("w") - 1) | (F.get("w", i + 1) != x + 1))
    spans = F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length")))
    merged = merged.select("doc_id", "n_words", F.size("w").cast("long").alias("n_hit"), "item_ids", spans.alias("spans"))
    out = keyed.select("doc_id").join(merged.withColumnRenamed("doc_id", "k"), F.col("doc_id").eqNullSafe(F.col("k")))
    return out.select(F.col("doc_id.id").alias("doc_id"), "n_words", "n_hit", "item_ids", "spans")


def _scan(docs: DataFrame, found, id_col: str, text_col: str, kind: str | None = None) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), text_col)
    types = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for b in W.blocks(batch.column(1), W.ALNUM, lower=True):
                for row in _judged(b, found.value):
                    for column, x in zip(out, row):
                        column.append(x)
            out[3] = [[{"start": s, "length": n} for s, n in x] for x in out[3]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, types))], ["doc_id", "n_words", "n_hit", "item_ids", "spans"])

    return rows.mapInArrow(handing_back(each), _FOUND.format(id=kind or rows.schema["doc_id"].dataType.simpleString()))


def contaminated(n_hit="n_hit", n_words="n_words"):
    """The contract's rule: a twentieth of the words or more are hit, and at least one."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))


def remove(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, whole: bool = True, max_windows: int = MAX_WINDOWS, text_col: str = "text") -> DataFrame:
    """docs, all columns, without contaminated rows; or, with whole=False, with the hit words cut out of all texts.

    A benchmark of more than max_windows windows is applied a slice at a time; rows are judged by the words that
    any slice hits, so the slices' hits are gathered before any row goes.
    """
    spark = docs.sparkSession
    every = windows(benchmark, ngram).persist()
    try:
        slices = pieces(every.count(), max_windows)
        sets = [spark.sparkContext.broadcast(WindowSet(every.where(F.pmod("hash", F.lit(slices)) == k).collect())) for k in range(slices)]
    finally:
        every.unpersist()
    at = docs.columns.index(text_col)
    schema = docs.schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            changed: dict[int, str] = {}
            blocks = list(W.blocks(batch.column(at), W.ALNUM, lower=True))
            changes = [np.zeros(len(b.starts) + 1, np.int64) for b in blocks]
            for found in sets:  # one slice in memory after another: broadcast values are read from local disk
                for b, edges in zip(blocks, changes):
                    for i, n, _ in found.value.hits(b):
                        edges[i] += 1
                        edges[i + n] -= 1
                if len(sets) > 1:
                    vars(found).pop("_value", None)  # it is read again from the worker's disk
            for b, edges in zip(blocks, changes):
                hit = np.cumsum(edges[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(hit)])
                n_hit = total[b.first[1:]] - total[b.first[:-1]]
                if whole:
                    keep[b.rows[0] : b.rows[1]] = (n_hit == 0) | (20 * n_hit < b.counts)
                else:
                    for row in np.flatnonzero(n_hit).tolist():
                        changed[b.rows[0] + row] = _cut(batch.column(at)[b.rows[0] + row].as_py().encode(), b, row, hit)
            if changed:
                texts = [changed.get(i, t) for i, t in enumerate(batch.column(at).to_pylist())]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(handing_back(each), schema)


def _cut(text: bytes, b: W.Block, row: int, hit: np.ndarray) -> str:
    """The text without its hit words and without what lies between two hit words."""
    base, out, at = b.offsets[row], [], 0
    i, j = b.first[row], b.first[row + 1]
    change = np.flatnonzero(np.diff(np.concatenate([[False], hit[i:j], [False]])))
    for s, e in zip(change[::2], change[1::2]):
        out.append(text[at : b.starts[i + s] - base])
        at = b.ends[i + e - 1] - base
    return b"".join([*out, text[at:]]).decode()


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    joined = F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), joined.alias("items_sha256"), contaminated().alias("contaminated"))


_WORDS = "regexp_extract_all(lower_ascii, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _lower(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


ORACLE_SQL = {
    "op5_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM (SELECT doc_id, coalesce({_lower('text')}, '') AS lower_ascii FROM documents)),
b AS (SELECT item_id, {_WORDS} AS w FROM (SELECT item_id, coalesce({_lower('text')}, '') AS lower_ascii FROM benchmark)),
bw AS (SELECT DISTINCT item_id, least(len(w), {NGRAM}) AS n, array_to_string(w[i : i + least(len(w), {NGRAM}) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {NGRAM} + 2, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
QUERIES = {"op5_benchmark_decontamination": op5_benchmark_decontamination}
