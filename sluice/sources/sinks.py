"""Writers of rows to text formats, and a table for people."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import documents, formats
from sluice.functions.paths import load


def to_jsonl(df: DataFrame) -> DataFrame:
    """`value`: a JSON object a row, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def to_csv(df: DataFrame) -> DataFrame:
    """`value`: texts quoted, other cells bare, nulls empty."""
    text = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
    return df.select(F.concat_ws(",", *[formats.csv_row(F.array(F.col(f"`{c}`")), c in text) for c in df.columns]).alias("value"))


def to_tsv(df: DataFrame) -> DataFrame:
    return df.select(formats.tsv_row(F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns])).alias("value"))


def write_lines(lines: DataFrame, path: str, separator: str = "\n") -> None:
    """`value`, a record each, with what comes after each; NUL for raw output that may hold line feeds. A record that
    holds a NUL fails the job where NUL parts them."""
    if separator == "\0":
        wrong = F.raise_error(F.lit("a record holds a NUL")).cast("string")
        lines = lines.select(F.when(F.instr("value", "\0") > 0, wrong).otherwise(F.col("value")).alias("value"))
    lines.select("value").write.option("lineSep", separator).text(path)


def to_yaml(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """`value`: JSON documents as YAML, each with its separator."""
    import yaml

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ["---\n" + yaml.safe_dump(_floats(load(d)), sort_keys=False, allow_unicode=True) for d in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    return docs.where(F.col(doc).isNotNull()).select(doc).mapInArrow(each, "value string")


def _floats(value):
    if isinstance(value, dict):
        return {k: _floats(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_floats(v) for v in value]
    return value if value is None or isinstance(value, (str, bool, int)) else float(value)


def to_json(docs: DataFrame, doc: str = "doc", width: int | None = 2) -> DataFrame:
    """`value`: JSON documents over several lines, or, without a width, on one."""
    return docs.select((documents.indented(doc, width) if width else documents.update(doc, [], lambda v: v)).alias("value"))


def to_toml(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """`value`: each document, an object, in TOML."""
    return docs.select(documents.toml(doc).alias("value"))


def table(df: DataFrame, rows: int = 100) -> str:
    """The first rows as a text table: widths by characters, numbers to the right, control characters escaped. A last
    line says so if there are more rows."""
    escape = str.maketrans({"\n": "\\n", "\r": "\\r", "\t": "\\t"})
    found = df.limit(rows + 1).collect()
    cells = [["" if x is None else str(x).translate(escape) for x in r] for r in found[:rows]]
    right = [f.dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "float", "double") for f in df.schema]
    width = [max([len(c), *(len(r[i]) for r in cells)]) for i, c in enumerate(df.columns)]
    line = lambda r: " | ".join(x.rjust(w) if k else x.ljust(w) for x, w, k in zip(r, width, right)).rstrip()
    more = [f"(the first {rows} rows)"] if len(found) > rows else []
    return "\n".join([line(df.columns), "-+-".join("-" * w for w in width), *map(line, cells), *more])
