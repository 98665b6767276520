"""Sources, publishing and settings shown on the test tables.

Each query works in a database of its own, publishes, and reads back.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType

from millrace.flows.registry import (
    CLEAN_SQL,
    DAILY_SQL,
    cleaned,
    daily,
    money,
    orders_source,
    query,
    shown,
    table,
)
from millrace.model import INSERT, MATERIALIZED_VIEW, ONCE, TABLE, TEMPORARY_VIEW, Dataset, Flow, Pipeline, PipelineError
from millrace.plans.scripts import statements
from millrace.run import FlowContext, run
from millrace.settings import default_namespace
from millrace.sinks.publish import publish
from millrace.sources.scripts import read_scripts
from millrace.sources.tables import read_path, read_table, typed_records
from millrace.storage import new_path, scratch_database
from millrace.streaming.guard import require_batch

DAILY_SCHEMA = StructType(
    [
        StructField("region", StringType()),
        StructField("order_date", DateType()),
        StructField("order_count", LongType()),
        StructField("total_amount", DoubleType()),
    ]
)

ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


def _unique(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex}"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def _with_status(spark: SparkSession, sf_dir: str, *status: str) -> DataFrame:
    return _orders(spark, sf_dir).filter(F.col("o_orderstatus").isin(*status))


@query(ORDERS_SQL)
def src_catalog_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow reads a dataset by name that an earlier run has published."""
    database, _ = scratch_database(spark)
    publish(Dataset(f"{database}.kept_orders", TABLE), _orders(spark, sf_dir))
    return FlowContext(spark, Pipeline("reader")).read(f"{database}.kept_orders")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def src_sql_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualified and back-quoted names in a SQL body."""
    database, _ = scratch_database(spark)
    publish(Dataset(f"{database}.kept_orders", TABLE), _orders(spark, sf_dir))
    context = FlowContext(spark, Pipeline("reader"))
    return context.sql(f"SELECT o_orderstatus, count(*) AS n FROM `{database}`.`kept_orders` GROUP BY o_orderstatus")


@query(CLEAN_SQL.replace("CAST(orderDate AS DATE) AS order_date", "CAST(CAST(orderDate AS DATE) AS VARCHAR) AS order_date"))
def src_session_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view registered before the run is an input that no flow writes."""
    view = _unique("orders_source")
    orders_source(spark, sf_dir).createOrReplaceTempView(view)
    database, _ = scratch_database(spark)
    pipeline = Pipeline(
        "session_view",
        [Dataset("orders_clean", TABLE)],
        [Flow("clean_orders", "orders_clean", lambda c: cleaned(c.read(view)), (view,))],
        database=database,
    )
    run(spark, pipeline)
    spark.catalog.dropTempView(view)
    return spark.table(f"{database}.orders_clean").withColumn("order_date", F.col("order_date").cast("string"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def src_metastore_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of a named database, as the catalog of the session has it."""
    database, _ = scratch_database(spark)
    table(spark, sf_dir, "customer").write.saveAsTable(f"{database}.customers")
    return read_table(spark, f"{database}.customers").select("c_custkey", "c_name", "c_mktsegment")


@query(ORDERS_SQL)
def src_parquet_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published table read from its directory."""
    database, location = scratch_database(spark)
    publish(Dataset(f"{database}.kept_orders", MATERIALIZED_VIEW, format="parquet"), _orders(spark, sf_dir))
    return read_path(spark, f"{location}/kept_orders")


LITERAL_ROWS = """
SELECT * FROM (VALUES ('1-URGENT', 5.0), ('2-HIGH', 4.0), ('3-MEDIUM', 3.0), ('4-NOT SPECIFIED', 2.0), ('5-LOW', 1.0))
  AS weights(priority, weight)"""

WEIGHTED_SQL = f"""
SELECT o_orderpriority AS priority, CAST(weight AS DOUBLE) AS weight, count(*) AS n,
  round(sum(o_totalprice), 2) AS total
FROM orders JOIN ({LITERAL_ROWS}) w ON o_orderpriority = priority GROUP BY o_orderpriority, weight"""


def _weighted(orders: DataFrame, weights: DataFrame) -> DataFrame:
    return (
        orders.join(F.broadcast(weights), F.col("o_orderpriority") == F.col("priority"))
        .groupBy("priority", F.col("weight").cast("double").alias("weight"))
        .agg(F.count("*").alias("n"), money("o_totalprice").alias("total"))
    )


@query(WEIGHTED_SQL)
def src_literal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as literals in SQL (five of them, hence the broadcast), joined with the orders."""
    return _weighted(table(spark, sf_dir, "orders"), spark.sql(LITERAL_ROWS))


@query(WEIGHTED_SQL)
def src_typed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed record list (five records, hence the broadcast), saved as a table and joined with the orders."""
    records = [("1-URGENT", 5.0), ("2-HIGH", 4.0), ("3-MEDIUM", 3.0), ("4-NOT SPECIFIED", 2.0), ("5-LOW", 1.0)]
    schema = StructType([StructField("priority", StringType(), False), StructField("weight", DoubleType(), False)])
    database, _ = scratch_database(spark)
    publish(Dataset(f"{database}.weights", TABLE), typed_records(spark, records, schema))
    return _weighted(table(spark, sf_dir, "orders"), spark.table(f"{database}.weights"))


@query("""
SELECT o_orderstatus AS status, o_orderkey // 10000 AS bundle,
  row_number() OVER (PARTITION BY o_orderstatus, o_orderkey // 10000 ORDER BY o_orderkey) AS statement_no,
  'INSERT INTO sink SELECT ''order ; ' || o_orderkey || '''' AS statement
FROM orders""")
def src_sql_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script per status and ten thousand order keys, written by Spark and found again in nested folders.

    A folder is named twice, once without its scheme, and its files still count once.
    """
    folder = new_path(spark, "scripts")
    text = F.concat(F.lit("INSERT INTO sink SELECT 'order ; "), F.col("o_orderkey").cast("string"), F.lit("';"))
    places = ["o_orderstatus", "bundle"]
    lines = table(spark, sf_dir, "orders").select(
        "o_orderstatus", F.floor(F.col("o_orderkey") / 10000).alias("bundle"), "o_orderkey", text.alias("line")
    )
    whole = lines.repartition(*places).sortWithinPartitions(*places, "o_orderkey").drop("o_orderkey")
    # The plain writer names its files .txt; this one takes the suffix that scripts have.
    whole.write.partitionBy(*places).options(quote="", sep="\u0001", extension="sql").csv(folder)
    found = statements(read_scripts(spark, [folder, folder.removeprefix("file://") + "/o_orderstatus=F"]))
    return found.select(
        F.regexp_extract("path", "o_orderstatus=([^/]*)", 1).alias("status"),
        F.regexp_extract("path", "bundle=([^/]*)", 1).cast("bigint").alias("bundle"),
        F.col("statement_no").cast("bigint").alias("statement_no"),
        "statement",
    )


@query(f"SELECT orderId, region, amount FROM ({CLEAN_SQL})")
def pub_temp_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = _unique("orders_clean")
    publish(Dataset(view, TEMPORARY_VIEW), cleaned(orders_source(spark, sf_dir)))
    return spark.table(view).select("orderId", "region", "amount")


@query(DAILY_SQL)
def pub_materialized_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second refresh replaces the rows and the schema of the first."""
    database, _ = scratch_database(spark)
    view = Dataset(f"{database}.daily_orders", MATERIALIZED_VIEW, format="parquet")
    publish(view, _orders(spark, sf_dir))
    publish(view, daily(cleaned(orders_source(spark, sf_dir))))
    return shown(spark.table(view.name))


@query(ORDERS_SQL)
def pub_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    database, _ = scratch_database(spark)
    publish(Dataset(f"{database}.kept_orders", TABLE), _orders(spark, sf_dir))
    return spark.table(f"{database}.kept_orders")


@query(ORDERS_SQL)
def pub_table_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    database, _ = scratch_database(spark)
    publish(Dataset(f"{database}.kept_orders", TABLE, format="orc"), _orders(spark, sf_dir))
    return spark.table(f"{database}.kept_orders")


@query("""
SELECT save_mode, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders JOIN (VALUES ('overwrite', false), ('append', true), ('append', false), ('ignore', true), ('errorifexists', true))
  AS kept(save_mode, finished) ON (o_orderstatus = 'F') = finished
GROUP BY save_mode""")
def pub_save_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table holding finished orders, saved again with all others in every mode."""
    database, _ = scratch_database(spark)
    parts = []
    for mode in ("overwrite", "append", "ignore", "errorifexists"):
        target = Dataset(f"{database}.orders_{mode}", TABLE)
        publish(target, _with_status(spark, sf_dir, "F"))
        again = _with_status(spark, sf_dir, "O", "P").select("o_totalprice", "o_orderstatus", "o_custkey", "o_orderkey")
        try:
            publish(target, again, mode)
        except AnalysisException:
            if mode != "errorifexists":
                raise
        parts.append(spark.table(target.name).select(F.lit(mode).alias("save_mode"), "o_totalprice"))
    every = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
    return every.groupBy("save_mode").agg(F.count("*").alias("n"), money("o_totalprice").alias("total"))


def _empty_sink(spark: SparkSession, name: str) -> Dataset:
    spark.createDataFrame([], DAILY_SCHEMA).write.saveAsTable(name)
    return Dataset(name, TABLE, write=INSERT)


@query(f"{DAILY_SQL} UNION ALL {DAILY_SQL}")
def pub_insert_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    database, _ = scratch_database(spark)
    sink = _empty_sink(spark, f"{database}.daily_orders_sink")
    for _ in range(2):
        publish(sink, daily(cleaned(orders_source(spark, sf_dir))))
    return shown(spark.table(sink.name))


@query("SELECT l_linestatus AS l_returnflag, l_returnflag AS l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def pub_insert_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts go by position: columns given in another order change places."""
    database, _ = scratch_database(spark)
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus")
    spark.createDataFrame([], lines.schema).write.saveAsTable(f"{database}.flags")
    publish(Dataset(f"{database}.flags", TABLE, write=INSERT), lines.select("l_linestatus", "l_returnflag"))
    return spark.table(f"{database}.flags").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def pub_insert_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    database, _ = scratch_database(spark)
    spark.sql(
        f"CREATE TABLE {database}.by_priority (o_orderkey BIGINT, o_totalprice DOUBLE, o_orderpriority STRING) "
        "USING parquet PARTITIONED BY (o_orderpriority)"
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    publish(Dataset(f"{database}.by_priority", TABLE, write=INSERT), rows)
    return spark.table(f"{database}.by_priority")


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def pub_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three flows fill one table; the view that reads it waits for all of them."""
    database, _ = scratch_database(spark)

    def load(status: str) -> Flow:
        return Flow(f"load_{status}", "all_orders", lambda c: _with_status(c.spark, sf_dir, status), ("raw_orders",))

    def totals(context: FlowContext) -> DataFrame:
        return (
            context.read("all_orders")
            .groupBy("o_orderstatus")
            .agg(F.count("*").alias("n"), money("o_totalprice").alias("total"))
        )

    pipeline = Pipeline(
        "fan_in",
        [Dataset("all_orders", TABLE), Dataset("totals", MATERIALIZED_VIEW)],
        [Flow("total", "totals", totals, ("all_orders",)), load("F"), load("O"), load("P")],
        database=database,
    )
    run(spark, pipeline)
    return spark.table(f"{database}.totals")


@query(DAILY_SQL)
def pub_bootstrap_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table is created empty from its declared schema, then appended to by name."""
    database, _ = scratch_database(spark)
    by_name = ("total_amount", "region", "order_count", "order_date")
    pipeline = Pipeline(
        "bootstrap",
        [Dataset("daily_orders", TABLE, schema=DAILY_SCHEMA)],
        [Flow("daily", "daily_orders", lambda c: daily(cleaned(orders_source(c.spark, sf_dir))).select(*by_name))],
        database=database,
    )
    run(spark, pipeline, save_mode="append")
    return shown(spark.table(f"{database}.daily_orders"))


@query(f"{ORDERS_SQL} UNION ALL {ORDERS_SQL} WHERE o_orderstatus <> 'F'")
def pub_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appending runs: the backfill happens once, the recurring flow twice."""
    database, _ = scratch_database(spark)
    pipeline = Pipeline(
        "backfill",
        [Dataset("history", TABLE)],
        [
            Flow("backfill", "history", lambda c: _with_status(c.spark, sf_dir, "F"), mode=ONCE),
            Flow("recent", "history", lambda c: _with_status(c.spark, sf_dir, "O", "P")),
        ],
        database=database,
    )
    for _ in range(2):
        run(spark, pipeline, save_mode="append", once_log=f"{database}.once_log")
    return spark.table(f"{database}.history")


@query("""
SELECT outcome, CASE WHEN outcome = 'published' THEN n ELSE 0 END AS n
FROM (SELECT count(*) AS n FROM events),
  (VALUES ('published'), ('refused: missing'), ('refused: streaming')) AS o(outcome)""")
def pub_guard_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing and streams are refused before they are published; the batch goes through."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events*.parquet")
    refused = []
    for case, result in (("missing", None), ("streaming", stream)):
        try:
            require_batch(result, case)
        except PipelineError:
            refused.append(f"refused: {case}")
    database, _ = scratch_database(spark)
    publish(Dataset(f"{database}.events", TABLE), require_batch(events, "events"))
    published = spark.table(f"{database}.events").agg(F.lit("published").alias("outcome"), F.count("*").alias("n"))
    return published.unionAll(spark.createDataFrame([(r, 0) for r in refused], "outcome string, n bigint"))


def _numeric_priorities(spark: SparkSession, sf_dir: str, point: str, key: str) -> DataFrame:
    """Row counts, with the value that ``key`` has while the query is built."""
    return table(spark, sf_dir, "orders").agg(
        F.lit(point).alias("point"), F.lit(spark.conf.get(key, "unset")).alias("value"), F.count("*").alias("n")
    )


@query("""
SELECT point, value, count(*) AS n
FROM orders, (VALUES ('before', 'unset'), ('first', 'blue'), ('second', 'blue'), ('after', 'unset')) AS p(point, value)
GROUP BY point, value""")
def opt_pipeline_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A setting of the whole run holds in every flow and is gone afterwards."""
    key, (database, _) = "millrace.show.colour", scratch_database(spark)
    before = _numeric_priorities(spark, sf_dir, "before", key)
    pipeline = Pipeline(
        "conf",
        [Dataset("first", TABLE), Dataset("second", TABLE)],
        [
            Flow(point, point, lambda c, point=point: _numeric_priorities(c.spark, sf_dir, point, key))
            for point in ("first", "second")
        ],
        database=database,
        conf={key: "blue"},
    )
    run(spark, pipeline)
    after = _numeric_priorities(spark, sf_dir, "after", key)
    return before.unionAll(spark.table(f"{database}.first")).unionAll(spark.table(f"{database}.second")).unionAll(after)


@query("""
SELECT 'strict' AS flow, count(*) AS n, count(TRY_CAST(substring(o_orderpriority, 1, 1) AS INTEGER)) AS n_numbers FROM orders
UNION ALL
SELECT 'lenient', count(*), count(TRY_CAST(o_orderpriority AS INTEGER)) FROM orders""")
def opt_flow_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flow casts leniently, because its own setting switches the strict mode off."""
    database, _ = scratch_database(spark)

    def counted(name: str, text: str):
        def build(context: FlowContext) -> DataFrame:
            orders = table(context.spark, sf_dir, "orders")
            return orders.agg(
                F.lit(name).alias("flow"), F.count("*").alias("n"), F.count(F.expr(f"CAST({text} AS INT)")).alias("n_numbers")
            )

        return build

    strict = Flow("strict", "strict", counted("strict", "substring(o_orderpriority, 1, 1)"))
    lenient = Flow("lenient", "lenient", counted("lenient", "o_orderpriority"))
    pipeline = Pipeline(
        "flow_conf",
        [Dataset("lenient", TABLE), Dataset("strict", TABLE)],
        [lenient.with_conf("spark.sql.ansi.enabled", "false"), strict],
        database=database,
    )
    run(spark, pipeline)
    return spark.table(f"{database}.strict").unionAll(spark.table(f"{database}.lenient"))


@query("""
SELECT 'default' AS place, o_orderkey FROM orders WHERE o_orderstatus = 'F'
UNION ALL
SELECT 'qualified', o_orderkey FROM orders WHERE o_orderstatus <> 'F'""")
def opt_default_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain names mean the database of the block; a written database wins."""
    (first, _), (second, _) = scratch_database(spark), scratch_database(spark)
    before = spark.catalog.currentDatabase()
    with default_namespace(spark, database=first):
        publish(Dataset("kept_orders", TABLE), _with_status(spark, sf_dir, "F"))
        publish(Dataset(f"{second}.kept_orders", TABLE), _with_status(spark, sf_dir, "O", "P"))
        plain = spark.table("kept_orders").select(F.lit("default").alias("place"), "o_orderkey")
    if spark.catalog.currentDatabase() != before:
        raise PipelineError("the default database was not put back")
    return plain.unionAll(spark.table(f"{second}.kept_orders").select(F.lit("qualified"), "o_orderkey"))


@query("SELECT o_orderstatus, count(*) AS n, 'spark_catalog' AS inside, 'yes' AS restored FROM orders GROUP BY o_orderstatus")
def opt_default_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of the block, put back like the database; a local session has one catalog, so no switch shows here."""
    database, _ = scratch_database(spark)
    before = spark.catalog.currentCatalog()
    with default_namespace(spark, catalog="spark_catalog", database=database):
        inside = spark.catalog.currentCatalog()
        publish(Dataset("kept_orders", TABLE), _orders(spark, sf_dir))
    restored = "yes" if spark.catalog.currentCatalog() == before else "no"
    return (
        spark.table(f"{database}.kept_orders")
        .groupBy("o_orderstatus")
        .agg(F.count("*").alias("n"), F.lit(inside).alias("inside"), F.lit(restored).alias("restored"))
    )
