"""Language identification by compression.

Each language is a Zstandard raw-content dictionary made of training texts of that language. A text, reduced to its
lower-case words of letters, is compressed with each; the language whose dictionary gives the smallest size wins. Where
the runner-up is nearly as good the prediction is marked as rejected. All texts are compressed with the same settings.

A text of over PIECE bytes is cut into equal pieces of PIECE bytes at most. Each piece is compressed afresh, so that all
of it has the dictionary in reach, and the sizes are added up: every part of a text counts alike, and the margin doesn't
shrink with the length.

Training reads a bounded sample: SAMPLE_TEXTS documents a language at most (the ones with the lowest hash of doc_id), in
that order, until they make DICT_BYTES of reduced text. A text of over DICT_BYTES / TEXT_PART characters gives four
pieces, spread over it, that together have so many. There may be any number of languages: the model has DICT_BYTES for
each, and a task holds the compressors of SLICE languages at a time.

Defined cases. A null text, and one without any letter, is `und`, with score 0, and rejected. Ties go to the language
of more training rows, then to the first by code point. With no training rows every text is `und`. Rows with null lang
or null text teach nothing. Repeated rows are each predicted alike. All pieces of a text are compressed, however long it
is. Other columns are not looked at; a column in `extra` with the name of one that predict() makes comes out as `given_`
and its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from sluice.llm import words as W
from sluice.llm.shared import crc_fold, given, handing_back, hash_below, pieces, table

#: Where very many rows of a language share few ids, its sample may come short of SAMPLE_TEXTS.
SAMPLE_TEXTS, DICT_BYTES, TEXT_PART = 400, 1 << 18, 16
#: Languages whose compressors a task holds at a time, and bytes of texts that it judges by them in turn.
SLICE, TOGETHER = 64, 2 << 20
#: The compressors' parameters.
_HOW = {"strategy": zstandard.STRATEGY_BTLAZY2, "min_match": 3, "search_log": 4, "chain_log": 19, "hash_log": 17}
#: Bytes of a piece; with DICT_BYTES it stays within the compressors' window.
PIECE = 1 << 16
#: The least gain over the runner-up, as a share of its size, below which a prediction is rejected.
MIN_MARGIN = 0.005
UNKNOWN = "und"

#: ASCII characters that aren't letters become spaces before compression.
_LETTERS_ONLY = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
_LETTER = regex.compile(r"\p{L}")


def learn(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """A dictionary's content for each language of docs (doc_id, text, lang), the most frequent language first."""
    spark = docs.sparkSession
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0").select("lang", F.xxhash64("doc_id").alias("key"), "text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    if not counts:
        return {}

    def below(bounds: dict[str, int]) -> DataFrame:
        of = spark.createDataFrame(pa.table({"lang": sorted(bounds), "bound": pa.array([bounds[k] for k in sorted(bounds)], pa.int64())}))  # a row a language; no worker turns it into rows
        return rows.join(F.broadcast(of), "lang").where("key <= bound")

    near = below({lang: hash_below(n, sample_texts) for lang, n in counts.items()})
    first = near.select("lang", "key").distinct().withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("n") <= sample_texts)
    last = {r["lang"]: r["key"] for r in first.groupBy("lang").agg(F.max("key").alias("key")).toLocalIterator()}
    # A doc_id that many rows share could bring more rows than the sample has: each id teaches once.
    texts = below(last).groupBy("lang", "key").agg(F.max(_spread(F.col("text"), dict_bytes // TEXT_PART)).alias("text"))
    held: dict[str, list[bytes]] = {lang: [] for lang in sorted(last)}
    sizes = dict.fromkeys(held, 0)
    for r in texts.orderBy("lang", "key").toLocalIterator():
        if sizes[r["lang"]] < dict_bytes:
            held[r["lang"]].append(reduced(r["text"]))
            sizes[r["lang"]] += len(held[r["lang"]][-1]) + 1
    return {lang: b" ".join(held[lang])[:dict_bytes] for lang in sorted(held, key=lambda x: (-counts[x], x))}


def _spread(text: Column, most: int) -> Column:
    """The text, or, where it is longer than `most` characters, four pieces of it that together have so many."""
    n, each = F.length(text), most // 4
    at = [(F.lit(1) + (n - each) * k / 3).cast("int") for k in range(4)]
    return F.when(n <= most, text).otherwise(F.concat_ws(" ", *(F.substr(text, a, F.lit(each)) for a in at)))


def reduced(text: str) -> bytes:
    """What is compressed: lower case, and a single space wherever there were ASCII characters but letters."""
    return b" ".join(text.lower().encode().translate(_LETTERS_ONLY).split())


def cut(data: bytes) -> list[bytes]:
    """data in pieces of PIECE bytes at most, none longer than another by more than a byte."""
    n = pieces(len(data), PIECE)
    return [data[len(data) * k // n : len(data) * (k + 1) // n] for k in range(n)]


class Judge:
    """The languages of a model and compressors for them; one for each task."""

    def __init__(self, model: dict[str, bytes], min_margin: float = MIN_MARGIN, held: int = SLICE):
        self.languages, self.model, self.min_margin, self.held = list(model), model, min_margin, held
        self.ready: tuple[int, list] = (-1, [])

    def _compressors(self, first: int) -> list[zstandard.ZstdCompressor]:
        """Those of self.held languages, from the given one on."""
        if self.ready[0] != first:
            self.ready = first, [_compressor(self.model[x]) for x in self.languages[first : first + self.held]]
        return self.ready[1]

    def one(self, text: str | None) -> tuple[str, float, bool]:
        """The language, the score and whether the margin is too narrow."""
        return self.many([text])[0]

    def many(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """The same for each of some texts; the languages' compressors take turns."""
        parts = [cut(reduced(t)) if t and self.languages and _LETTER.search(t) else None for t in texts]
        best: list[tuple[float, int]] = [(float("inf"), 0)] * len(texts)
        other = [float("inf")] * len(texts)
        for first in range(0, len(self.languages), self.held):
            for k, c in enumerate(self._compressors(first), first):
                for row, own in enumerate(parts):
                    if own is None:
                        continue
                    size = sum([len(c.compress(part)) for part in own])
                    if size < best[row][0]:
                        other[row], best[row] = best[row][0], (size, k)
                    elif size < other[row]:
                        other[row] = size
        return [(UNKNOWN, 0.0, True) if own is None else self._told(*best[row], other[row]) for row, own in enumerate(parts)]

    def _told(self, size: float, language: int, other: float) -> tuple[str, float, bool]:
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margin = (other - size) / other
        return self.languages[language], min(1.0, 0.5 + 2 * margin), margin < self.min_margin

    def column(self, column: pa.Array) -> Iterator[tuple[str, float, bool]]:
        data, offsets = W.text_bytes(column)
        i, n = 0, len(offsets) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + TOGETHER, "right")) - 1)
            yield from self.many([data[a:b].tobytes().decode() for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist())])
            i = j


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    # Frames without magic number and size: what is compared is what the dictionary saves.
    how = zstandard.ZstdCompressionParameters(window_log=19, write_content_size=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS, **_HOW)
    of = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    of.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=of, compression_params=how)


def predict(docs: DataFrame, model: dict[str, bytes], min_margin: float = MIN_MARGIN, id_col: str = "doc_id", text_col: str = "text", extra: tuple = ()) -> DataFrame:
    """Per row: doc_id, the columns in extra, lang_pred, score (0.5 for a tie to 1 for a clear case), rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    made = ("doc_id", "lang_pred", "score", "rejected")
    rows = docs.select(F.col(id_col).alias("doc_id"), *given(extra, made), text_col)
    names = ["doc_id", *rows.columns[1:-1], *made[1:]]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Judge(sent.value, min_margin)
        for batch in batches:
            got = list(own.column(batch.column(batch.num_columns - 1)))
            new = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names)

    return rows.mapInArrow(handing_back(each), f"{kinds}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: dict[str, bytes], min_margin: float = MIN_MARGIN, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that are `und` or whose margin is too narrow."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Judge(sent.value, min_margin)
        for batch in batches:
            yield batch.filter(pa.array([not rejected for _, _, rejected in own.column(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(handing_back(each), docs.schema)


FOLDS, HELD_OUT = 4, 2


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.coalesce(crc_fold(F.col("doc_id"), FOLDS), F.lit(0))
    model = learn(docs.where(fold != HELD_OUT))
    marked = docs.select("doc_id", "text", (fold == HELD_OUT).alias("held_out"))
    return predict(marked, model, extra=("held_out",))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op8_language_id": op8_language_id}
