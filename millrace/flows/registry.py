"""Named queries over the test tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        ORACLE[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(column: str | Column) -> Column:
    """A sum rounded to cents, so that the order of addition does not show."""
    return F.round(F.sum(column), 2)


def orders_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ``(orderId, region, orderDate, amount)``, the date as text."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("orderId"),
        F.col("o_orderpriority").alias("region"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("orderDate"),
        F.col("o_totalprice").alias("amount"),
    )


def cleaned(source: DataFrame) -> DataFrame:
    return source.filter(F.col("amount") > 100000).withColumn("order_date", F.to_date("orderDate"))


def daily(clean: DataFrame) -> DataFrame:
    return clean.groupBy("region", "order_date").agg(
        F.count(F.lit(1)).alias("order_count"), F.sum("amount").alias("total_amount")
    )


def shown(daily_orders: DataFrame) -> DataFrame:
    """Daily orders with the date as text and the sum in cents, alike in every engine."""
    return daily_orders.select(
        "region",
        F.col("order_date").cast("string").alias("order_date"),
        "order_count",
        F.round("total_amount", 2).alias("total_amount"),
    )


SOURCE_SQL = """
SELECT o_orderkey AS orderId, o_orderpriority AS region, strftime(o_orderdate, '%Y-%m-%d') AS orderDate,
  o_totalprice AS amount
FROM orders"""

CLEAN_SQL = f"""
SELECT orderId, region, orderDate, amount, CAST(orderDate AS DATE) AS order_date
FROM ({SOURCE_SQL}) AS source WHERE amount > 100000"""

DAILY_SQL = f"""
SELECT region, CAST(order_date AS VARCHAR) AS order_date, count(*) AS order_count,
  round(sum(amount), 2) AS total_amount
FROM ({CLEAN_SQL}) AS clean GROUP BY region, order_date"""
