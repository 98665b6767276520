from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def database(spark):
    from millrace.storage import scratch_database

    name, _ = scratch_database(spark)
    yield name
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


@pytest.fixture
def orders(spark):
    rows = [
        (11, "Bergen", "2031-01-07", 4.5),
        (12, "Aalborg", "2031-01-07", 0.0),
        (13, "Bergen", "2031-01-07", 2.25),
        (14, "Bergen", "2031-02-28", 10.0),
        (15, "Tampere", "2031-02-28", -3.0),
    ]
    return spark.createDataFrame(rows, "orderId bigint, region string, orderDate string, amount double")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
