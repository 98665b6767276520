"""Whole pipelines over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.flows.registry import CLEAN_SQL, DAILY_SQL, cleaned, daily, money, orders_source, query, shown, table
from millrace.model import MATERIALIZED_VIEW, TABLE, TEMPORARY_VIEW, Dataset, Flow, Pipeline
from millrace.run import FlowContext, from_scripts, load_project, report, run
from millrace.storage import new_path, scratch_database

# What the script pipelines have to give: sales by priority and month.
MONTHS_SQL = """
SELECT o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT o_custkey) AS buyers,
  round(sum(o_totalprice), 2) AS price
FROM orders WHERE o_totalprice > 0 GROUP BY 1, 2"""

SALES_SCRIPT = """
-- sales with a price; a view, so nothing is stored for it
create or replace temp view {sales} as
select o_orderpriority priority, date_format(o_orderdate, 'yyyy-MM') month, o_custkey buyer, o_totalprice price
from {raw} where o_totalprice > 0;
"""

BUYERS_SCRIPT = """
CREATE MATERIALIZED VIEW buyers AS
SELECT priority, month, buyer, sum(price) AS price FROM {sales} GROUP BY ALL;
"""

MONTHS_SCRIPT = """
SET spark.sql.adaptive.coalescePartitions.enabled=true;
CREATE MATERIALIZED VIEW months AS
WITH buyers AS (SELECT * FROM buyers WHERE price > 0)
SELECT priority, month, count(*) AS buyers, sum(price) AS price FROM buyers GROUP BY priority, month;
"""

SINK_SCRIPT = """
Insert Into month_sink
Select priority, month, count(distinct buyer) buyers, sum(price) price From {sales} Group By priority, month
"""

SINK_SCHEMA = "priority STRING, month STRING, buyers BIGINT, price DOUBLE"


def _script_folder(spark: SparkSession, texts: dict[str, str]) -> str:
    """A folder in the shared place with a file ``<name>/part-….sql`` for each text."""
    folder = new_path(spark, "project")
    for name, text in texts.items():
        rows = spark.createDataFrame([(text,)], "text string").coalesce(1)
        rows.write.options(quote="", sep="\u0001", lineSep="\u0002", extension="sql").csv(f"{folder}/{name}")
    return folder


def _names() -> dict[str, str]:
    tag = uuid.uuid4().hex
    return {"sales": f"all_sales_{tag}", "raw": f"all_orders_{tag}"}


def _months(df: DataFrame) -> DataFrame:
    return df.select("priority", "month", "buyers", F.round("price", 2).alias("price"))


def orders_pipeline(sf_dir: str, database: str) -> Pipeline:
    """Clean orders as a table, daily totals as a materialized view."""
    return Pipeline(
        "orders",
        [Dataset("orders_clean", TABLE), Dataset("daily_orders", MATERIALIZED_VIEW, format="parquet")],
        [
            Flow("clean_orders", "orders_clean", lambda c: cleaned(orders_source(c.spark, sf_dir)), ("orders_source",)),
            Flow("daily_orders", "daily_orders", lambda c: daily(c.read("orders_clean")), ("orders_clean",)),
        ],
        database=database,
    )


@query(DAILY_SQL)
def pipe_orders_dataframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    database, _ = scratch_database(spark)
    run(spark, orders_pipeline(sf_dir, database))
    return shown(spark.table(f"{database}.daily_orders"))


@query(MONTHS_SQL)
def pipe_orders_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project of three script files: a view, a materialized view, and one whose WITH name hides it after reading it."""
    database, _ = scratch_database(spark)
    names = _names()
    table(spark, sf_dir, "orders").createOrReplaceTempView(names["raw"])
    texts = {"1_months": MONTHS_SCRIPT, "2_buyers": BUYERS_SCRIPT, "3_sales": SALES_SCRIPT}
    folder = _script_folder(spark, {name: text.format(**names) for name, text in texts.items()})
    run(spark, load_project(spark, "orders_sql", [folder], database=database))
    for view in names.values():
        spark.catalog.dropTempView(view)
    return _months(spark.table(f"{database}.months"))


@query(MONTHS_SQL)
def pipe_insert_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals appended to a table of the default database that was there before."""
    database, _ = scratch_database(spark)
    names = _names()
    spark.sql(f"CREATE TABLE {database}.month_sink ({SINK_SCHEMA}) USING parquet")
    all_sales(spark, sf_dir).createOrReplaceTempView(names["sales"])
    scripts = spark.createDataFrame([("sink.sql", SINK_SCRIPT.format(**names))], "path string, text string")
    run(spark, from_scripts("insert_sink", scripts, database=database))
    spark.catalog.dropTempView(names["sales"])
    return _months(spark.table(f"{database}.month_sink"))


def all_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_totalprice > 0").select(
        F.col("o_orderpriority").alias("priority"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.col("o_custkey").alias("buyer"),
        F.col("o_totalprice").alias("price"),
    )


@query(DAILY_SQL)
def pipe_views_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both results are views; nothing is stored and the whole chain is one query."""
    tag = uuid.uuid4().hex
    clean, total = f"orders_clean_{tag}", f"daily_orders_{tag}"
    pipeline = Pipeline(
        "views",
        [Dataset(clean, TEMPORARY_VIEW), Dataset(total, TEMPORARY_VIEW)],
        [
            Flow("daily_orders", total, lambda c: daily(c.read(clean)), (clean,)),
            Flow("clean_orders", clean, lambda c: cleaned(orders_source(c.spark, sf_dir)), ("orders_source",)),
        ],
    )
    run(spark, pipeline)
    return shown(spark.table(total))


@query(f"""
SELECT flow, partitions, count(*) AS n, round(sum(amount), 2) AS total
FROM ({CLEAN_SQL}), (VALUES ('common', '6'), ('special', '3'), ('later', '6'), ('restored', 'yes')) AS f(flow, partitions)
GROUP BY flow, partitions""")
def pipe_flow_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A setting of the pipeline, overridden in one flow and put back for the next."""
    key, (database, _) = "spark.sql.shuffle.partitions", scratch_database(spark)
    before = spark.conf.get(key)

    def summary(name: str, value: str | None = None):
        def build(context: FlowContext) -> DataFrame:
            clean = cleaned(orders_source(context.spark, sf_dir))
            return clean.agg(
                F.lit(name).alias("flow"),
                F.lit(value or context.spark.conf.get(key)).alias("partitions"),
                F.count("*").alias("n"),
                money("amount").alias("total"),
            )

        return build

    flows = [Flow(name, name, summary(name)) for name in ("common", "special", "later")]
    flows[1] = flows[1].with_conf(key, "3")
    pipeline = Pipeline(
        "flow_conf", [Dataset(f.name, MATERIALIZED_VIEW) for f in flows], flows, database=database, conf={key: "6"}
    )
    run(spark, pipeline)
    result = summary("restored", "yes" if spark.conf.get(key) == before else "no")(FlowContext(spark, pipeline))
    for flow in flows:
        result = result.unionAll(spark.table(f"{database}.{flow.name}"))
    return result


@query(f"""
SELECT 1 AS seq, 0 AS stage, 'clean_orders' AS flow, 'orders_clean' AS target, count(*) AS rows FROM ({CLEAN_SQL})
UNION ALL
SELECT 2, 1, 'daily_orders', 'daily_orders', count(*) FROM ({DAILY_SQL})""")
def lin_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run did, with the rows it wrote, counted while writing."""
    database, _ = scratch_database(spark)
    return report(spark, run(spark, orders_pipeline(sf_dir, database)))
