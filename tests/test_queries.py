"""Every query of the library against the SQL that stands beside it."""

import duckdb
import pytest

from sluice.plans import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", queries.QUERIES)
def test_rows_equal(spark, duck, name):
    got = queries.QUERIES[name](spark, DIR)
    found = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(repr(tuple(r)) for r in got.select(columns).collect()) == sorted(repr(r) for r in found.fetchall())


def test_pushed_down(spark):
    plan = queries.QUERIES["pricing_summary"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "l_comment" not in plan and "l_orderkey" not in plan
