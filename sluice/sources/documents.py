"""Readers: files to rows of documents (src_file, doc_idx, doc), doc being JSON text, or to rows of cells.

Line formats are splittable and stay in built-in operators. JSON files, YAML and TOML are read whole, file by file.
"""

from __future__ import annotations

import csv
import json
import tomllib
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from sluice.functions.paths import dump

_DOCS = "src_file string, doc_idx long, doc string"
_EXTENSIONS = {"json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "yaml": "yaml", "yml": "yaml", "toml": "toml", "csv": "csv", "tsv": "tsv", "txt": "raw"}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """src_file and line: raw input."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("src_file"), F.col("value").alias("line"))


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A document a line, blank lines left out: src_file and doc, or the schema's columns.

    With a schema, a line that is no JSON fails the job.
    """
    if schema:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return read_lines(spark, path).where(F.trim("line") != "").withColumnRenamed("line", "doc")


def _whole(spark: SparkSession, path: str, parse) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("src_file"), F.regexp_replace("value", "^﻿", "").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    docs = [dump(d) for d in parse(text)]
                except Exception as e:
                    raise ValueError(f"{name}: {e}") from e
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(docs), pa.string()), pa.array(range(len(docs)), pa.int64()), pa.array(docs, pa.string())], ["src_file", "doc_idx", "doc"])

    return files.mapInArrow(each, _DOCS)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A document a file."""
    return _whole(spark, path, lambda text: [json.loads(text, parse_float=Decimal)])


def _plain(value):
    """Dates as text, keys as text."""
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [_plain(v) for v in value]
    return value.isoformat() if hasattr(value, "isoformat") else value


def read_toml(spark: SparkSession, path: str) -> DataFrame:
    return _whole(spark, path, lambda text: [_plain(tomllib.loads(text, parse_float=Decimal))])


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """Every document of each file; empty ones are null."""
    import yaml

    return _whole(spark, path, lambda text: [_plain(d) for d in yaml.safe_load_all(text)])


def read_csv(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """`row`, an array of the cells as text; quotes are doubled inside quoted cells. Without a width the first record
    tells it; a record of another width fails the job."""
    reader = spark.read.schema(", ".join(f"c{i} string" for i in range(width))) if width else spark.read
    rows = reader.csv(path, header=False, multiLine=True, quote='"', escape='"', mode="FAILFAST", emptyValue="")
    return rows.select(F.transform(F.array(*rows.columns), lambda x: F.coalesce(x, F.lit(""))).alias("row"))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    r"""`row`, an array of the cells; \t, \n, \r and \\ are decoded, other back slashes stay. A cell that ends in a lone
    back slash fails the job."""

    def part(x: Column) -> Column:
        for escaped, plain in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
            x = F.replace(x, F.lit(escaped), F.lit(plain))
        return x

    def cell(x: Column) -> Column:
        # Between two back slashes that stand for one, each other one begins an escape.
        parts = F.split(x, r"\\\\", -1)
        lone = F.element_at(parts, -1).endswith("\\")
        return F.when(lone, F.raise_error(F.concat(F.lit("tsv: trailing escape in "), x)).cast("string")).otherwise(F.array_join(F.transform(parts, part), "\\"))

    return spark.read.text(path).select(F.transform(F.split("value", "\t", -1), cell).alias("row"))


def with_file_order(docs: DataFrame) -> DataFrame:
    """docs with file_idx: the place of src_file among all files by name, from 0. There is a row a file to be ordered."""
    files = docs.select("src_file").distinct()
    order = files.select(F.col("src_file").alias("__file"), (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("src_file")) - 1).alias("file_idx"))
    return docs.join(order, F.col("src_file") == F.col("__file")).drop("__file")


def inferred(cell: Column | str) -> Column:
    """The cell as JSON if it is a number, a boolean or null; else as a JSON text. Objects and arrays stay text."""
    cell = F.col(cell) if isinstance(cell, str) else cell
    quoted = F.regexp_replace(F.to_json(F.array(cell)), r"^\[|\]$", "")
    return F.when(F.rlike(cell, F.lit(r"^(-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?|true|false|null)$")), cell).otherwise(quoted)


def with_header(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows of cells as columns of these names."""
    return rows.select(*[F.get("row", F.lit(i)).alias(n) for i, n in enumerate(names)])


def csv_header(rows: DataFrame, order: list[str]) -> DataFrame:
    """`doc`: rows of cells (row) as JSON objects whose keys are the cells of the first row in an order."""
    place = F.struct(*order)
    head = rows.agg(F.min_by("row", place).alias("__names"), F.min(place).alias("__first"))
    named = rows.join(F.broadcast(head)).where(place > F.col("__first"))  # the head is one row
    cells = F.map_from_arrays("__names", F.transform("__names", lambda _, i: F.get("row", i)))
    return named.select(F.to_json(cells, {"ignoreNullFields": "false"}).alias("doc"))


def _tabular(head: str, separator: str) -> bool:
    """Two rows or more of as many cells, two or more."""
    rows = list(csv.reader(head.splitlines(), delimiter=separator, quoting=csv.QUOTE_MINIMAL if separator == "," else csv.QUOTE_NONE))
    return len(rows) > 1 and len(rows[0]) > 1 and len({len(r) for r in rows}) == 1


def _parses(parse, text: str) -> bool:
    try:
        parse(text)
    except ValueError:
        return False
    return True


def format_of(path: str, head: str = "", policy: str = "warn-fallback") -> str:
    """The format that a file's extension or its content tells; yaml if neither does.

    policy: "extension" or "sniff" takes that one alone; else the extension counts, and the content without one, or
    where the content is no JSON or TOML though the extension says so. head is the content, or whole lines of it.
    """
    named = _EXTENSIONS.get(path.rpartition(".")[2].lower()) if "." in path else None
    lines = [x.strip() for x in head.splitlines() if x.strip()]
    seen = None
    if len(lines) > 1 and all(x[0] in "{[" for x in lines):
        seen = "jsonl"
    elif lines and lines[0][0] in "{[" and _parses(json.loads, head):
        seen = "json"
    elif lines and _parses(tomllib.loads, head):
        seen = "toml"
    elif lines:
        seen = "tsv" if "\t" in head and _tabular(head, "\t") else "csv" if "," in head and _tabular(head, ",") else None
    wrong = bool(lines) and (named == "json" and not _parses(json.loads, head) or named == "toml" and not _parses(tomllib.loads, head))
    return {"extension": named, "sniff": seen}.get(policy, (seen if wrong and seen else named) or seen) or "yaml"
