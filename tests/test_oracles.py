"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from packlens.plans.queries import oracle_sql, queries

from .compare import rows_of

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = rows_of(queries()[name](spark, SF).toPandas())
    want = rows_of(duck.execute(oracle_sql()[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql()) - {"additive_model", "model_importances"}))
def test_query_without_sql_runs(spark, name):
    assert queries()[name](spark, SF).count() > 0
