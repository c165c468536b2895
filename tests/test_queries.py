"""Every query against the SQL that says the same. Learned queries, without SQL, run on the smallest tables."""

import os

import duckdb
import pytest

from touchline.plans.registry import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
LEARNED_SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in ("orders", "part", "lineitem"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(df):
    shown = lambda v: "" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(shown(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_and_sql_agree(spark, database, name):
    got, want = QUERIES[name](spark, SF).toPandas(), database.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_learned_queries_return_rows(spark, name):
    rows = QUERIES[name](spark, LEARNED_SF).toPandas()
    assert len(rows) and not rows.isna().all(axis=None)
