"""Query bodies: the operators that flows use most."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.flows.registry import CLEAN_SQL, SOURCE_SQL, cleaned, money, orders_source, query, table
from millrace.storage import scratch_database


@query(SOURCE_SQL)
def q_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_source(spark, sf_dir)


@query("SELECT * FROM customer")
def q_select_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("*")


@query(f"""
SELECT orderId, CAST(CAST(orderDate AS DATE) AS VARCHAR) AS order_date,
  year(CAST(orderDate AS DATE)) AS order_year, TRY_CAST(region AS DATE) IS NULL AS bad_date
FROM ({SOURCE_SQL})""")
def q_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("orderDate")
    return orders_source(spark, sf_dir).select(
        "orderId",
        day.cast("string").alias("order_date"),
        F.year(day).cast("bigint").alias("order_year"),
        F.try_to_date("region").isNull().alias("bad_date"),
    )


@query(f"SELECT orderId, region, orderDate, amount FROM ({CLEAN_SQL})")
def q_filter_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_source(spark, sf_dir).filter(F.col("amount") > 100000)


@query(f"SELECT * FROM ({SOURCE_SQL}) WHERE region = '1-URGENT'")
def q_filter_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_source(spark, sf_dir).where("region = '1-URGENT'")


@query(f"SELECT * FROM ({SOURCE_SQL}) WHERE region = '1-URGENT' ORDER BY orderId LIMIT 1")
def q_filter_eq_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_source(spark, sf_dir).where("region = '1-URGENT'").orderBy("orderId").limit(1)


@query("""
SELECT o_orderkey, o_orderpriority || ';' || o_orderstatus AS note, '''' || o_orderstatus || '''' AS quoted
FROM orders
WHERE o_orderpriority || ';' || o_orderstatus <> '1-URGENT;F' AND '''' || o_orderstatus || '''' <> '''O'''""")
def q_filter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .select(
            "o_orderkey",
            F.concat_ws(";", "o_orderpriority", "o_orderstatus").alias("note"),
            F.concat(F.lit("'"), "o_orderstatus", F.lit("'")).alias("quoted"),
        )
        .filter((F.col("note") != "1-URGENT;F") & (F.col("quoted") != "'O'"))
    )


@query("""
SELECT o_orderkey, o_totalprice, c_name, c_mktsegment
FROM orders JOIN customer ON o_custkey = c_custkey""")
def q_join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "inner").select(
        "o_orderkey", "o_totalprice", "c_name", "c_mktsegment"
    )


@query("""
SELECT o_orderpriority, o_orderstatus, count(*) AS order_count, round(sum(o_totalprice), 2) AS total_amount
FROM orders GROUP BY o_orderpriority, o_orderstatus""")
def q_group_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .groupBy("o_orderpriority", "o_orderstatus")
        .agg(F.count(F.lit(1)).alias("order_count"), money("o_totalprice").alias("total_amount"))
    )


@query(f"""
SELECT region, CAST(CAST(orderDate AS DATE) AS VARCHAR) AS order_date, count(*) AS order_count,
  round(sum(amount), 2) AS total_amount
FROM ({SOURCE_SQL}) GROUP BY region, CAST(orderDate AS DATE)""")
def q_group_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        orders_source(spark, sf_dir)
        .groupBy("region", F.to_date("orderDate").alias("order_date"))
        .agg(F.count(F.lit(1)).alias("order_count"), money("amount").alias("total_amount"))
        .withColumn("order_date", F.col("order_date").cast("string"))
    )


@query("SELECT event_type, count(*) AS n_star, count(1) AS n_one, count(value) AS n_value FROM events GROUP BY event_type")
def q_count_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .groupBy("event_type")
        .agg(F.count("*").alias("n_star"), F.count(F.lit(1)).alias("n_one"), F.count("value").alias("n_value"))
    )


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def q_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.sum("l_quantity").alias("sum_qty"), money("l_extendedprice").alias("sum_price"))
    )


@query(f"SELECT count(*) AS n FROM ({CLEAN_SQL})")
def q_table_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    database, _ = scratch_database(spark)
    cleaned(orders_source(spark, sf_dir)).write.saveAsTable(f"{database}.orders_clean")
    return spark.table(f"{database}.orders_clean").agg(F.count("*").alias("n"))


@query("""
SELECT 'customer' AS party, c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance FROM customer
UNION ALL
SELECT 'supplier', s_suppkey, s_nationkey, s_acctbal FROM supplier""")
def q_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        F.lit("customer").alias("party"),
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.lit("supplier").alias("party"),
        F.col("s_suppkey").alias("id"),
        F.col("s_nationkey").alias("nation"),
        F.col("s_acctbal").alias("balance"),
    )
    return customers.unionByName(suppliers)


@query("""
SELECT s_suppkey, CAST(1 AS BIGINT) AS big, CAST(120.0 AS DOUBLE) AS price, CAST(-12.0 AS DOUBLE) AS refund,
  'east' AS region, 7 AS small
FROM supplier""")
def q_typed_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.lit(1).cast("bigint").alias("big"),
        F.lit(120.0).cast("double").alias("price"),
        F.lit(-12.0).cast("double").alias("refund"),
        F.lit("east").alias("region"),
        F.lit(7).cast("int").alias("small"),
    )
