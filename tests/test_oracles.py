"""Every registered query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from strataloom.plans import catalog
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    mine = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=str)
    got = duck.sql(catalog.ORACLES[name])
    at = [got.columns.index(c) for c in columns]
    assert sorted(got.columns) == columns
    assert mine == sorted((tuple(norm(r[i]) for i in at) for r in got.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).columns


def test_entry_works_without_the_llm_parts(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert e.entry(spark).columns == ["resource", "n_programs", "programs"]
