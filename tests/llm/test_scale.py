"""Large groups: what they make an operator move, and that results are whole."""

import random

from pyspark.sql import functions as F

from sluice.llm import minhash, mixture
from tests.llm.common import bag
from tests.llm.test_text_operators import components


def grouped(rng):
    """Texts that share four fifths of their words in places, many near copies, and pairs linked through one shingle set."""
    common = [f"c{i}" for i in range(160)]
    rows = [(k, " ".join(common + [f"own{k}x{i}" for i in range(60)])) for k in range(150)]
    rows += [(200 + k, " ".join(common + [f"own{k}x{i}" for i in range(58)] + ["end"])) for k in range(0, 150, 10)]  # each linked with one of the above
    base = [f"b{i}" for i in range(150)]
    for k in range(150):
        w = list(base)
        w[rng.randrange(150)] = f"z{k}"
        rows.append((400 + k, " ".join(w)))
    rng.shuffle(rows)
    return rows


def test_large_buckets_by_brute_force(spark):
    rows = grouped(random.Random(3))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for block in (256, 16, 4):
        got = minhash.near_duplicates(docs, block=block).collect()
        assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == components(rows)


def test_large_buckets_are_sent_once(spark):
    """A bucket of n classes makes n rows, and one more for each part; shared words bring no two classes together."""
    n, block = 20_000, 64
    sets = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(b"").alias("sig"), F.array(F.struct(F.lit(5).cast("long").alias("bucket"), F.lit(n).cast("long").alias("size"), F.lit(0).cast("long").alias("head"))).alias("more"), F.lit(b"").alias("shingles"))
    groups = minhash.parted(sets, block)
    sizes = [r["count"] for r in groups.groupBy("bucket", "i", "j").count().collect()]
    assert sum(sizes) <= n + n // block + 1 and max(sizes) < 2 * block + 10
    own = [(k, k, b"".join(x.to_bytes(8, "little") for x in [*range(80), *range(1000 * k + 1000, 1000 * k + 1025)])) for k in range(500)]
    rare = minhash.rare_shingles(spark.createDataFrame(own, "doc_id long, more long, shingles binary"), (85, 100))
    assert rare.count() == 0


def test_mix_of_ties_and_heavy_weights(spark):
    """Keys in narrow spans, one id on a third of the rows, weights far apart: as in one sort of each source."""
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(1, 9), "a" if i % 3 else "b") for i in range(900)] + [(5000, "w w w", "a")] * 450 + [(None, "w", None)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    heavy = spark.createDataFrame([(i, 100.0 if i % 2 else 0.01) for i in range(900)], "doc_id long, weight double")
    for quality in (None, heavy):
        whole = mixture.mix(docs, quality)
        cut = mixture.mix(docs, quality, range_rows=5)
        assert bag(whole.collect()) == bag(cut.collect())
        by = whole.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
        assert all(abs(r["taken"] - r["target"]) <= r["most"] / 2 for r in by)
        times = {tuple(r)[:2]: r["n"] for r in whole.groupBy("doc_id", "source").agg((F.sum("taken") / F.max("size")).cast("long").alias("n")).where("n > 0").collect()}
        made = mixture.sample(docs, quality, range_rows=5).groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("n"))
        assert {tuple(r)[:2]: r["n"] for r in made.collect()} == times
