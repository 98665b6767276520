"""Query bodies: the rest of Spark's query surface that a flow may use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.flows.registry import money, query, table
from millrace.operators.joins import anti, band_join, full_outer, semi
from millrace.operators.windows import framed, ranked
from millrace.settings import spark_conf
from millrace.storage import scratch_database


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "custkey")


def _rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in credit; the others' orders stay without a partner."""
    return (
        table(spark, sf_dir, "customer")
        .filter(F.col("c_acctbal") > 0)
        .select(F.col("c_custkey").alias("custkey"), "c_name", "c_acctbal")
    )


@query("""
SELECT o_orderkey, o_custkey AS custkey, c_name
FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0""")
def d_join_outer_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).join(_rich(spark, sf_dir), "custkey", "left").select("o_orderkey", "custkey", "c_name")


@query("""
SELECT o_orderkey, o_custkey AS custkey, c_name
FROM (SELECT * FROM customer WHERE c_acctbal > 0) RIGHT JOIN orders ON o_custkey = c_custkey""")
def d_join_outer_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _rich(spark, sf_dir).join(_orders(spark, sf_dir), "custkey", "right").select("o_orderkey", "custkey", "c_name")
    )


@query("""
SELECT coalesce(o_custkey, c_custkey) AS custkey, o_orderkey, c_name
FROM orders o
FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey""")
def d_join_outer_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir).select("custkey", "o_orderkey")
    return full_outer(orders, _rich(spark, sf_dir).select("custkey", "c_name"), ["custkey"])


@query("""
SELECT c_custkey AS custkey, c_name FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)""")
def d_join_semi_anti_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_name")
    return semi(customers, _orders(spark, sf_dir).filter(F.col("o_totalprice") > 450000), ["custkey"])


@query("""
SELECT c_custkey AS custkey, c_name FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)""")
def d_join_semi_anti_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_name")
    return anti(customers, _orders(spark, sf_dir).filter(F.col("o_totalprice") > 450000), ["custkey"])


@query("""
WITH tiers AS (
  SELECT floor(p_retailprice * p_size / 500) AS tier, min(p_retailprice * p_size) AS low,
    max(p_retailprice * p_size) AS high, count(*) AS n_parts
  FROM part GROUP BY 1)
SELECT round(low, 2) AS low, round(high, 2) AS high, n_parts, count(*) AS n_lines,
  round(sum(l_extendedprice), 2) AS amount
FROM lineitem JOIN tiers ON l_extendedprice BETWEEN low AND high GROUP BY low, high, n_parts""")
def d_join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by the price tier of a whole pack they fall into; tiers do not overlap."""
    pack = F.col("p_retailprice") * F.col("p_size")
    tiers = (
        table(spark, sf_dir, "part")
        .groupBy(F.floor(pack / 500).alias("tier"))
        .agg(F.min(pack).alias("low"), F.max(pack).alias("high"), F.count("*").alias("n_parts"))
    )
    lines = table(spark, sf_dir, "lineitem").select("l_extendedprice")
    return (
        band_join(lines, F.col("l_extendedprice"), tiers, "low", "high", 500.0)
        .groupBy("low", "high", "n_parts")
        .agg(F.count("*").alias("n_lines"), money("l_extendedprice").alias("amount"))
        .select(F.round("low", 2).alias("low"), F.round("high", 2).alias("high"), "n_parts", "n_lines", "amount")
    )


NATION_SQL = """
SELECT n_name, count(*) AS n_customers, round(sum(c_acctbal), 2) AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""


def _by_nation(customers: DataFrame, nations: DataFrame) -> DataFrame:
    return (
        customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(F.count("*").alias("n_customers"), money("c_acctbal").alias("balance"))
    )


@query(NATION_SQL)
def d_join_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left to Spark, which broadcasts by bytes and decides again when it has seen them."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return _by_nation(table(spark, sf_dir, "customer"), nations)


@query(NATION_SQL)
def d_join_broadcast_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join with broadcasting switched off for this flow; published while the setting holds."""
    database, _ = scratch_database(spark)
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    with spark_conf(spark, off):
        joined = _by_nation(table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"))
        joined.write.saveAsTable(f"{database}.by_nation")
    return spark.table(f"{database}.by_nation")


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def d_agg_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def d_agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .rollup("l_returnflag", "l_linestatus")
        .agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))
    )


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def d_agg_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .cube("l_returnflag", "l_linestatus")
        .agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))
    )


GROUPING_SETS_SQL = """
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty
FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())"""


@query(GROUPING_SETS_SQL.format(lineitem="lineitem"))
def d_agg_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(GROUPING_SETS_SQL, lineitem=table(spark, sf_dir, "lineitem"))


@query("""
SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY o_custkey HAVING count(*) > 10""")
def d_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(F.count("*").alias("n"), money("o_totalprice").alias("total"))
        .filter(F.col("n") > 10)
    )


RANK_SQL = """
SELECT o_custkey, o_orderkey,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS row_number,
  rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rank,
  dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dense_rank
FROM orders"""

FRAME_SQL = """
SELECT event_id, user_id, cents,
  CAST(sum(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far,
  lag(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous,
  lead(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following
FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"""


def _ranked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return ranked(orders, ["o_custkey"], "o_orderpriority", "o_orderkey").drop("o_orderpriority")


def _framed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("bigint").alias("cents")
    return framed(
        table(spark, sf_dir, "events").select("event_id", "user_id", "ts", cents),
        ["user_id"],
        ["ts", "event_id"],
        running={"so_far": "cents"},
        lag={"previous": "cents"},
        lead={"following": "cents"},
    ).drop("ts")


@query(RANK_SQL)
def d_window_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked_orders(spark, sf_dir)


@query(FRAME_SQL)
def d_window_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _framed_events(spark, sf_dir)


@query(RANK_SQL)
def d_window_rank_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with other slices, so that other customers' orders cross a border."""
    with spark_conf(spark, {"spark.sql.shuffle.partitions": "97"}):
        return _ranked_orders(spark, sf_dir)


@query(FRAME_SQL)
def d_window_frame_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with other slices, so that other users' events cross a border."""
    with spark_conf(spark, {"spark.sql.shuffle.partitions": "97"}):
        return _framed_events(spark, sf_dir)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def d_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


def _nations_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nation and rounded balance of both parties, each made distinct before anything is joined."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 100).alias("hundreds")
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 100).alias("hundreds")
    )
    return customers.distinct(), suppliers.distinct()


_SETS_SQL = """
SELECT c_nationkey AS nation, CAST(floor(c_acctbal / 100) AS BIGINT) AS hundreds FROM customer
{operator}
SELECT s_nationkey, CAST(floor(s_acctbal / 100) AS BIGINT) FROM supplier"""


@query(_SETS_SQL.format(operator="UNION"))
def d_setops_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, suppliers = _nations_of(spark, sf_dir)
    return customers.union(suppliers).distinct()


@query(_SETS_SQL.format(operator="INTERSECT"))
def d_setops_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, suppliers = _nations_of(spark, sf_dir)
    return customers.intersect(suppliers)


@query(_SETS_SQL.format(operator="EXCEPT"))
def d_setops_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, suppliers = _nations_of(spark, sf_dir)
    return customers.subtract(suppliers)


CTE_SQL = """
WITH totals AS (SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS n FROM {orders} GROUP BY o_custkey)
SELECT c_mktsegment, count(*) AS n_customers, sum(n) AS n_orders, round(sum(total), 2) AS total
FROM totals JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment"""

SCALAR_SQL = """
SELECT o_orderkey, o_totalprice FROM {orders}
WHERE o_totalprice > (SELECT max(c_acctbal) * 45 FROM {customer})"""

IN_SQL = """
SELECT o_orderkey, o_custkey FROM {orders}
WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING')"""

# The inner DISTINCT keeps a customer with very many orders from becoming one large partition.
EXISTS_SQL = """
SELECT c_custkey, c_name FROM {customer}
WHERE EXISTS (
    SELECT 1 FROM (SELECT DISTINCT o_custkey FROM {orders} WHERE o_orderpriority = '1-URGENT') urgent
    WHERE o_custkey = c_custkey)
  AND NOT EXISTS (
    SELECT 1 FROM (SELECT DISTINCT o_custkey FROM {orders} WHERE o_orderstatus = 'P') open
    WHERE o_custkey = c_custkey)"""


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))


def _plain(text: str) -> str:
    return text.format(orders="orders", customer="customer")


@query(_plain(CTE_SQL).replace("sum(n) AS", "CAST(sum(n) AS BIGINT) AS"))
def d_subquery_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, CTE_SQL)


@query(_plain(SCALAR_SQL))
def d_subquery_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, SCALAR_SQL)


@query(_plain(IN_SQL))
def d_subquery_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, IN_SQL)


@query(_plain(EXISTS_SQL))
def d_subquery_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, EXISTS_SQL)


@query("""
SELECT p_partkey, substring(p_name, 1, 4) AS start, upper(p_name) AS loud, length(p_name) AS n_chars,
  round(p_retailprice * 0.9, 2) AS reduced,
  CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class
FROM part""")
def d_scalar_text_math_date_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.substring("p_name", 1, 4).alias("start"),
        F.upper("p_name").alias("loud"),
        F.length("p_name").cast("bigint").alias("n_chars"),
        F.round(F.col("p_retailprice") * 0.9, 2).alias("reduced"),
        F.when(size < 10, "small").when(size < 30, "medium").otherwise("large").alias("size_class"),
    )


@query("""
SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, quarter(o_orderdate) AS quarter,
  count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY 1, 2""")
def d_scalar_text_math_date_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM-dd").alias("month"),
            F.quarter("o_orderdate").cast("bigint").alias("quarter"),
        )
        .agg(F.count("*").alias("n"), money("o_totalprice").alias("total"))
    )


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def d_json_array_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")
    )


@query("""
SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, CAST(embedding[1] AS DOUBLE) AS first,
  CAST(embedding[-1] AS DOUBLE) AS last
FROM embeddings""")
def d_json_array_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.size("embedding").cast("bigint").alias("n"),
        F.element_at("embedding", 1).cast("double").alias("first"),
        F.element_at("embedding", -1).cast("double").alias("last"),
    )
