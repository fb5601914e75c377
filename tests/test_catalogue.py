"""Every query of the catalogue against DuckDB on the smallest tables."""

import collections
import decimal

import duckdb
import pytest

from lodestar.plans import catalogue

from .conftest import SF

QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in catalogue.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        return f"d{v}" if isinstance(v, decimal.Decimal) else f"f{v + 0.0!r}" if isinstance(v, float) else f"{type(v).__name__[:1]}{v}"

    return collections.Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    ours = bag(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert ours == bag(names, found.fetchall())


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["join_inner", "join_multi", "join_comma", "join_lateral", "exists_semi", "scalar_subquery_corr"])
def test_equi_joins_are_not_nested_loops(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(catalogue.engine(spark, SF).sql("SELECT l_orderkey FROM lineitem WHERE l_quantity > 49"))
    assert "GreaterThan(l_quantity,49" in text and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text
