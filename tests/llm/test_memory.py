"""What tasks are given at a time, and what a worker keeps after a task."""

import re

import pyarrow as pa

from sluice.llm import codes
from sluice.llm import words as W
from sluice.llm.shared import handing_back, stored
from sluice.llm.tokens import Encoder, vocabulary

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], ["n", "bytes"])


def test_batches_are_bounded_in_bytes(spark):
    """5,000 rows of 2,000 bytes are one batch by the number of rows; a row longer than the bound ends its batch."""
    rows = spark.range(0, 5000, 1, 1).selectExpr("id", "repeat('x', if(id = 4999, 300000, 2000)) text")
    before = spark.conf.get(SETTING, None)
    got = stored(rows.mapInArrow(sizes, "n long, bytes long"), "sizes", 1 << 16).collect()
    assert sum(r["n"] for r in got) == 5000
    assert len(got) > 100 and sorted(r["bytes"] for r in got)[-2] < 1 << 17
    assert spark.conf.get(SETTING, None) == before


def test_token_files_ask_for_small_batches(spark, tmp_path, monkeypatch):
    """Two files where one batch, and so one file, was before; the same rows for any size of batches."""
    docs = spark.range(0, 400, 1, 1).selectExpr("id doc_id", "repeat('one two three ', 200) text")
    asked, real = [], codes.stored

    def seen(df, label, *batch):
        asked.append((label, batch))
        return real(df, label, *batch)

    monkeypatch.setattr(codes, "stored", seen)
    files = codes.write(docs, f"file://{tmp_path}/small", file_ids=150_000)
    assert asked == [("code-files", (codes.BATCH,))]
    assert files.count() == 2
    monkeypatch.setattr(codes, "BATCH", 1 << 30)
    whole = codes.write(docs, f"file://{tmp_path}/whole", file_ids=150_000)
    one, two = (sorted((r["doc_id"], r["start"], tuple(r["ids"])) for r in codes.read(f, f"file://{tmp_path}/{at}").collect()) for f, at in ((files, "small"), (whole, "whole")))
    assert one == two and len(one) == 400


def held():
    """MB of this process that are not files."""
    with open("/proc/self/status") as f:
        return int(re.search(r"RssAnon:\s+(\d+)", f.read())[1]) / 1024


def test_free_memory_goes_back_after_a_task():
    """Many buffers are freed while one above them stays; without trimming, the process keeps them all."""
    kept = []

    def each(batches):
        for b in batches:
            own = [bytearray(60_000) for _ in range(4000)]
            kept.append(bytearray(60_000))
            yield b
            del own

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["a"])
    before = held()
    assert list(handing_back(each)(iter([batch]))) == [batch]
    assert held() < before + 60


def test_a_worker_does_not_grow_with_each_encoder():
    """Every task makes an encoder; a tokenizer of its own would leave about 5 MB behind each time."""
    text = pa.array([" ".join(f"word{i * 7919 % 9973} of{i}" for i in range(20_000))])

    def task(batches):
        encoder = Encoder(vocabulary())
        for b in W.blocks(text, W.NOT_SPACE):
            encoder.encode(b)
        yield from batches

    list(handing_back(task)(iter([])))
    before = held()
    for _ in range(12):
        list(handing_back(task)(iter([])))
    assert held() < before + 25
