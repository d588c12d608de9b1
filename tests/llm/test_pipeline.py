"""The pipeline on awkward rows, against plain versions of its stages."""

from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import language
from tests.llm.common import DIR, awkward, bag, frame, words
from tests.llm.test_models import shares
from tests.llm.test_text_operators import components, hits


def lay(spark, folder, rows, items=(), labels=()):
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_by_brute_force(spark, tmp_path):
    """Each stage on what the one before kept, row by row."""
    some = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang", "source").where("doc_id < 120").collect()]
    rows = some + [(None, *some[0][1:3], "a"), (None, *some[0][1:3], "a"), (some[3][0], some[3][1], "en", None), (900, None, None, None), (901, "", "en", "a"), (902, "12 34", "en", "a")]
    items = [(i, " ".join(words(t)[:20])) for i, t, *_ in some[:40] if 20 <= len(words(t)) <= 300] + [(2000, None)]
    folder = lay(spark, tmp_path, rows, items)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, steps[-1], folder).write.parquet(f"{folder}/{name}")
        steps.append(spark.read.parquet(f"{folder}/{name}"))
    texts = [[(r["doc_id"], r["text"], r["source"]) for r in s.collect()] for s in steps[:-1]]
    judge = language.Judge(language.learn(docs))
    assert bag(texts[1]) == bag(r for r in texts[0] if not judge.one(r[1])[2])
    named = {i: t for i, t, _ in texts[1] if i is not None}
    kept = {i for i, _, c in components(list(named.items())) if i == c}
    assert sorted(i for i, *_ in texts[2] if i is not None) == sorted(kept) and sum(i is None for i, *_ in texts[2]) == 2
    assert all(r in texts[1] for r in texts[2])
    assert bag(texts[3]) == bag(r for r in texts[2] if not (h := hits(r[1], items))[1] or 20 * h[1] < h[0])
    assert len(texts[3]) < len(texts[2])
    sizes, taken = {}, {}
    for _, t, s in texts[3]:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    for _, t, s in texts[4]:
        taken[s] = taken.get(s, 0) + len(words(t))
    for s, target in shares(sizes).items():
        assert abs(taken.get(s, 0) - target) <= max(len(words(t)) for _, t, o in texts[3] if o == s)
    assert all(r in texts[3] for r in texts[4]) and max(bag(texts[4]).values()) <= 2 * max(bag(texts[3]).values())
    assert steps[-1].count() == len(texts[4])
    assert bag(corpus_pipeline.run(spark, folder).collect()) == bag(steps[-1].collect())


def test_awkward_rows_and_empty_tables(spark, tmp_path):
    folder = lay(spark, tmp_path / "awkward", awkward() * 2, [(1, "short item")], [(1, 1, 0), (None, 1, None), (6, None, 1)])
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in got} <= {i for i, *_ in awkward()}
    empty = lay(spark, tmp_path / "empty", [])
    assert corpus_pipeline.run(spark, empty).collect() == []
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    assert docs.where(F.col("n_words") == "clash").count() == 2 * len(awkward())
