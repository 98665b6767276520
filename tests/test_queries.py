"""Every registered query against DuckDB, and the shape of the plans."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from millrace.flows.registry import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def by_name(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in data)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_points.queries())


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, oracle, name):
    df = entry_points.queries()[name](spark, SF_DIR)
    expected = oracle.sql(entry_points.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert by_name(df.columns, df.collect()) == by_name(expected.columns, expected.fetchall())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["region", "order_date", "order_count", "total_amount"] and df.count() == 1129


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in NAMES if n.startswith(("q_", "d_", "chk_", "lin_"))])
def test_no_pair_products(spark, name):
    """A constant key turns a semi or anti join into a look at one row; nothing else may loop."""
    text = plan(entry_points.queries()[name](spark, SF_DIR))
    loops = [line for line in text.splitlines() if "NestedLoop" in line]
    assert all("LeftAnti" in line or "LeftSemi" in line for line in loops), loops
    assert "CartesianProduct" not in text


def test_filters_and_columns_reach_the_files(spark):
    text = plan(entry_points.queries()["pipe_views_only"](spark, SF_DIR))
    assert "GreaterThan(o_totalprice,100000.0)" in text
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string>" in text


def test_published_data_is_filtered_in_the_files(spark, database):
    from millrace.flows.pipes import orders_pipeline
    from millrace.run import run

    run(spark, orders_pipeline(SF_DIR, database))
    text = plan(spark.table(f"{database}.orders_clean").filter("amount > 400000").select("orderId"))
    assert "PushedFilters: [IsNotNull(amount), GreaterThan(amount,400000.0)]" in text
    assert "ReadSchema: struct<orderId:bigint,amount:double>" in text
