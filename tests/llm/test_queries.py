import duckdb
import pytest

from sluice.llm import queries
from tests.llm.common import DIR, bag

TABLES = ("documents", "pages", "benchmark", "labels")


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_rows_equal(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    got = queries.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(columns)
    assert bag(got.select(columns).collect()) == bag(found.fetchall())


def test_pipeline_stages(spark):
    """Each stage on its own predecessor's rows: columns, and that its decisions take effect."""
    import corpus_pipeline
    from sluice.llm import decontaminate, minhash, mixture
    from sluice.llm.shared import stored, table

    docs = table(spark, DIR, "documents")
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, DIR), name)
        rows[name] = docs.count()
        if name != "token_output":
            assert docs.columns == table(spark, DIR, "documents").columns
            assert docs.join(before, ["doc_id", "text"], "left_anti").count() == 0
        if name == "near_dedup":
            kept = {r["doc_id"] for r in minhash.near_duplicates(before).where("kept").collect()}
            assert {r["doc_id"] for r in docs.collect()} == kept and rows[name] == len(kept)
        if name == "decontamination":
            assert decontaminate.find(docs, table(spark, DIR, "benchmark")).where(decontaminate.contaminated()).count() == 0
        if name == "mixing":
            mix = mixture.mix(before, mixture.label_weights(table(spark, DIR, "labels"))).where("taken > 0")
            assert rows[name] == sum(r["taken"] // r["size"] for r in mix.collect())
    assert rows["token_output"] == rows["mixing"] > 0
    assert bag(corpus_pipeline.run(spark, DIR).collect()) == bag(docs.collect())
