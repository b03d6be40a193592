"""Every query with SQL gives the rows that DuckDB gives on the same tables; no query is empty by accident."""

import math

import duckdb
import pytest

from tidewatch.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: At this size nothing is selected by these.
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got or name in MAY_BE_EMPTY
    sql = registry.oracle_sql().get(name)
    if sql:
        rows = duck.sql(sql)
        assert sorted(rows.columns) == columns
        order = [rows.columns.index(c) for c in columns]
        assert got == sorted(tuple(plain(r[i]) for i in order) for r in rows.fetchall())
