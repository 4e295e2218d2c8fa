"""Every registered query with SQL gives DuckDB's rows on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda x: round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    return sorted((tuple(str(cell(r[i])) for i in order) for r in values)), sorted(columns)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        path = f"{DATA}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


@pytest.mark.parametrize("name", sorted(entry.registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    told = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in told.description]
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, told.fetchall())


def test_every_query_has_sql():
    assert set(entry.registry.queries()) == set(entry.registry.oracle_sql())
