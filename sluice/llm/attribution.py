"""Token counts by section: whole documents are encoded once, and token spans are joined to section spans.

The ids of a document are those that the library gives for all of it. A byte-level vocabulary's tokens stand for fixed
runs of bytes, so the ids give the characters where each token begins and ends, as the library's offsets do. Distinct
pieces of text are encoded once a task, see tokens; with whole=True, or with a vocabulary of another pattern, every
document goes to the library by itself, which gives the same and takes about three times as long. Sections are spans of
characters, in ascending order, that do not overlap. Both lists are sorted, so the interval join of a document's tokens
to its sections is a merge by binary search within the document; nothing is shuffled.

The rule for tokens. A token goes, whole, to the section with which it shares the most characters, among equals to the
earliest. A token that shares none, as one that lies between two sections, goes to the last section that begins before
it, and before the first section to the first one. So a document's counts add up to the number of its tokens. Tokens
that are not inside their section with all their characters are also counted by themselves, as `n_crossing`.

Three makers of sections are here: line_sections() cuts a text into its lines, field_sections() puts several columns
into one text, and any column of array<struct<start:long,end:long>> can be given.

Defined cases. A null or empty text has one section, (0, 0), with no tokens. An empty or null list of sections counts
as one section over the whole text. Unsorted sections are sorted; overlapping ones are an error. Empty sections are
kept; a token can only go to them by the last part of the rule. Rows that share a doc_id, and equal rows, are each
counted. A very long text is worked on whole, in about 100 bytes of memory for each of its bytes. An empty table gives
an empty result. Columns beyond those named are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import words as W
from sluice.llm.shared import table
from sluice.llm.tokens import Encoder, vocabulary

_SPANS = "array<struct<start:bigint,end:bigint>>"


def line_sections(text: np.ndarray) -> np.ndarray:
    """Spans, in characters, of the lines of a text given as UTF-8 bytes; line feeds belong to none."""
    before = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
    breaks = np.flatnonzero(text == 0x0A)
    return np.column_stack([before[np.concatenate([[0], breaks + 1])], before[np.append(breaks, len(text))]])


def field_sections(*fields: Column | str, separator: str = "\n") -> Column:
    """struct(text, sections): the fields joined by the separator, and where each is; nulls are empty fields."""
    values = [F.coalesce(F.col(f) if isinstance(f, str) else f, F.lit("")) for f in fields]
    spans, at = [], F.lit(0).cast("long")
    for value in values:
        end = at + F.length(value)
        spans.append(F.struct(at.alias("start"), end.alias("end")))
        at = end + len(separator)
    return F.struct(F.concat_ws(separator, *values).alias("text"), F.array(*spans).cast(_SPANS).alias("sections"))


def allocate(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, by the rule, and whether it reaches outside it. Spans are ascending."""
    s, e = sections[:, 0], sections[:, 1]
    first = np.searchsorted(e, starts, "right")  # the first section that ends after the token begins
    last = np.searchsorted(s, ends, "left")  # the first one that begins at its end or later
    best = np.maximum(np.searchsorted(s, starts, "right") - 1, 0)
    most = np.zeros(len(starts), np.int64)
    k = first.copy()
    while True:
        open_ = np.flatnonzero(k < last)
        if not len(open_):
            return best, most < ends - starts
        own = k[open_]
        shared = np.minimum(ends[open_], e[own]) - np.maximum(starts[open_], s[own])
        more = shared > most[open_]
        best[open_[more]], most[open_[more]] = own[more], shared[more]
        k[open_] += 1


def _checked(spans: list[dict] | None, n: int) -> np.ndarray:
    if not spans:
        return np.array([[0, n]], np.int64)
    out = np.array(sorted((x["start"], x["end"]) for x in spans), np.int64)
    if (out[:, 0] > out[:, 1]).any() or (out[1:, 0] < out[:-1, 1]).any() or out[0, 0] < 0 or out[-1, 1] > n:
        raise ValueError("sections must not overlap and must lie inside the text")
    return out


def attribute(docs: DataFrame, sections: str | None = None, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """A row for each section of each row of docs: doc_id, section (from 0), char_start, char_end, n_tokens, n_crossing.

    sections: a column of spans; without it, lines.
    """
    path = path or vocabulary()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_col, *([F.col(sections).cast(_SPANS)] if sections else []))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for b in W.blocks(batch.column(1), W.NOT_SPACE):
                given = batch.column(2).slice(b.rows[0], len(b)).to_pylist() if sections else None
                yield _counted(batch.column(0).slice(b.rows[0], len(b)), b, encoder.spans(b, whole), given)

    return rows.mapInArrow(each, f"doc_id {kind}, section long, char_start long, char_end long, n_tokens long, n_crossing long")


def _counted(doc_ids: pa.Array, b: W.Block, tokens: Iterator[np.ndarray], given: list | None) -> pa.RecordBatch:
    before = np.concatenate([[0], np.cumsum((b.data & 0xC0) != 0x80)])  # characters before each byte
    at, out = [], []
    for row, own in enumerate(tokens):
        i, j = int(b.offsets[row]), int(b.offsets[row + 1])
        spans = line_sections(b.data[i:j]) if given is None else _checked(given[row], int(before[j] - before[i]))
        where, crossing = allocate(own[:, 0], own[:, 1], spans)
        n = len(spans)
        at += [row] * n
        out.append(np.column_stack([np.arange(n), spans, np.bincount(where, minlength=n), np.bincount(where[crossing], minlength=n)]))
    columns = np.concatenate(out) if out else np.zeros((0, 5), np.int64)
    return pa.RecordBatch.from_arrays([doc_ids.take(pa.array(at, pa.int64())), *(pa.array(columns[:, k].astype(np.int64)) for k in range(5))], ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"])


def op2_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute(table(spark, sf_dir, "documents"))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op2_token_attribution": op2_token_attribution}
