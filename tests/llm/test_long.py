"""Very long texts, and columns of other names, through every operator that works on whole texts."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import codes, decontaminate, minhash, mixture, mpegts, repeats, warc
from sluice.llm.shared import new_folder
from tests.llm.common import bag, words
from tests.llm.test_formats import library  # noqa: F401
from tests.llm.test_text_operators import components, hits, removed


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    some = [f"w{rng.randrange(5000)}" for _ in range(450_000)]  # 2.5 MB: more than a block
    copy = list(some)
    for k in range(0, len(copy), 30_000):
        copy[k] = "other"
    passage = " ".join(some[1000:1060])
    return [(1, " ".join(some)), (2, " ".join(copy)), (3, passage), (4, f"before {passage} after"), (5, "x" * 3_000_000), (6, "")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns that the operators' own are called."""
    out = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("kept", "n_removed", "anchor", "block", "body", "component_id", "sig", "bands", "start", "ids", "base", "name", "n_hit", "spans", "key", "s", "row", "weight"):
        out = out.withColumn(name, F.lit("clash"))
    return out.withColumn("source", F.lit("a")).repartition(3)


def test_substring_dedup(docs, rows):
    got = repeats.remove_repeats(docs).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == removed([(i, words(t)) for i, t in rows])
    assert got[2]["kept"] == "" and got[3]["kept"] == "before after"


def test_near_duplicates(docs, rows):
    got = minhash.near_duplicates(docs).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == components(rows)
    assert [r["component_id"] for r in got if r["doc_id"] == 2] == [1]
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {1, 3, 5, 6}


def test_decontamination(spark, docs, rows):
    items = [(7, rows[2][1]), (8, "w1 w2")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find(docs, bench).collect()
    assert bag((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["item_ids"])) for r in got) == bag((i, *hits(t, items)) for i, t in rows)
    sliced = decontaminate.find(docs, bench, max_windows=5)
    assert bag(map(str, sliced.collect())) == bag(map(str, got))
    assert decontaminate.remove(docs, bench).columns == docs.columns


def test_token_files(docs, rows, library):  # noqa: F811
    expected, start = [], 0
    for i, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert bag(codes.token_files(docs).collect()) == bag(expected)


def test_media_and_archives(spark, docs, rows):
    back = mpegts.decode_column(mpegts.encode_column(docs, ("doc_id", "name")), ("doc_id", "name"))
    assert {(r["doc_id"], bytes(r["payload"])) for r in back.collect()} == {(i, mpegts.padded(t.encode())) for i, t in rows}
    pages = docs.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumn("url", F.lit("u")).withColumn("sha", F.lit(1)).withColumn("to", F.lit(2)).withColumn("payload", F.lit(3))
    folder = new_folder(spark, "long")
    got = warc.read(warc.write(pages, folder), folder).collect()
    assert {(r["page_id"], bytes(r["payload"])) for r in got} == {(i, t.encode()) for i, t in rows}


def test_mixing(docs, rows):
    got = {r["doc_id"]: r["size"] for r in mixture.mix(docs).collect()}
    assert got == {i: len(words(t)) for i, t in rows}
    assert mixture.sample(docs).columns == docs.columns
