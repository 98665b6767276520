from __future__ import annotations

from pathlib import Path

import pytest
from conftest import rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace import Dataset, PipelineError
from millrace.model import TABLE
from millrace.settings import default_namespace, spark_conf
from millrace.sinks.publish import bootstrap, publish
from millrace.storage import drop_scratch, scratch_database, shared_dir, stored
from millrace.streaming.guard import require_batch


def test_temporary_views_run_no_job(spark, orders):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("views", "")
    publish(Dataset("orders_clean", "temporary_view"), orders)
    assert list(tracker.getJobIdsForGroup("views")) == []
    assert spark.table("orders_clean").count() == 5
    spark.catalog.dropTempView("orders_clean")


def test_overwrite_replaces_rows_and_schema(spark, database):
    view = Dataset(f"{database}.v", "materialized_view", format="parquet")
    publish(view, spark.sql("SELECT 1 AS x"))
    publish(view, spark.sql("SELECT 2 AS y, 'a' AS z"))
    assert spark.table(view.name).columns == ["y", "z"] and rows(spark.table(view.name)) == [(2, "a")]


def test_formats(spark, database):
    for name, given, expected in (("a", None, "parquet"), ("b", "orc", "orc"), ("c", "json", "json")):
        publish(Dataset(f"{database}.{name}", "table", format=given), spark.range(3))
        detail = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {database}.{name}").collect()}
        assert detail["Provider"].lower() == expected


def test_save_modes(spark, database):
    target = Dataset(f"{database}.t", "table")
    publish(target, spark.sql("SELECT 1 AS a, 2 AS b"))
    publish(target, spark.sql("SELECT 4 AS b, 3 AS a"), "append")
    assert rows(spark.table(target.name)) == [(1, 2), (3, 4)]
    publish(target, spark.sql("SELECT 9 AS a, 9 AS b"), "ignore")
    assert spark.table(target.name).count() == 2
    with pytest.raises(AnalysisException, match="ALREADY_EXISTS"):
        publish(target, spark.range(1), "errorifexists")
    with pytest.raises(PipelineError, match="save mode must be one of"):
        publish(target, spark.range(1), "upsert")


def test_inserts_go_by_position_into_existing_tables(spark, database):
    spark.sql(f"CREATE TABLE {database}.t (a INT, b INT) USING parquet")
    target = Dataset(f"{database}.t", "table", write="insert")
    publish(target, spark.sql("SELECT 1 AS b, 2 AS a"))
    publish(target, spark.sql("SELECT 3 AS x, 4 AS y"), "overwrite")
    assert rows(spark.table(target.name)) == [(1, 2), (3, 4)]
    with pytest.raises(AnalysisException):
        publish(target, spark.sql("SELECT 1 AS a"))
    with pytest.raises(AnalysisException, match="NOT_FOUND"):
        publish(Dataset(f"{database}.missing", "table", write="insert"), spark.range(1))


def test_partitioned_inserts_gather_rows_first(spark, database):
    spark.sql(f"CREATE TABLE {database}.t (id BIGINT, p STRING) USING parquet PARTITIONED BY (p)")
    target = Dataset(f"{database}.t", "table", write="insert")
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "hot").otherwise("cold").alias("other")).repartition(16)
    publish(target, df)
    assert rows(spark.table(target.name).groupBy("p").count()) == [("cold", 100), ("hot", 900)]
    assert spark.table(target.name).select(F.input_file_name()).distinct().count() == 2


def test_bootstrap_only_where_a_schema_asks_for_it(spark, database):
    schema = StructType([StructField("id", LongType(), False)])
    assert bootstrap(spark, Dataset(f"{database}.t", "table", schema=schema))
    assert spark.table(f"{database}.t").count() == 0 and spark.table(f"{database}.t").columns == ["id"]
    publish(Dataset(f"{database}.t", "table"), spark.range(2), "append")
    bootstrap(spark, Dataset(f"{database}.t", "table", schema=schema))
    assert spark.table(f"{database}.t").count() == 2
    assert not bootstrap(spark, Dataset(f"{database}.n", "table"))
    assert not bootstrap(spark, Dataset("v", "temporary_view", schema=schema))
    assert not bootstrap(spark, Dataset(f"{database}.i", "table", write="insert", schema=schema))
    assert not spark.catalog.tableExists(f"{database}.i")


def test_only_batches_pass(spark):
    with pytest.raises(PipelineError, match="flow 'f' returned no DataFrame"):
        require_batch(None, "f")
    stream = spark.readStream.format("rate").load()
    with pytest.raises(PipelineError, match="flow 'f' returned a streaming DataFrame"):
        require_batch(stream, "f")
    df = spark.range(1)
    assert require_batch(df, "f") is df


def test_settings_are_put_back(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    with spark_conf(spark, {"spark.sql.shuffle.partitions": "7", "my.key": "x"}):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "7" and spark.conf.get("my.key") == "x"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and spark.conf.get("my.key", None) is None


def test_settings_are_put_back_after_errors(spark):
    with pytest.raises(RuntimeError), spark_conf(spark, {"my.key": "x"}):
        raise RuntimeError
    assert spark.conf.get("my.key", None) is None
    with pytest.raises(AnalysisException, match="spark.sql.warehouse.dir"), spark_conf(
        spark, {"my.key": "x", "spark.sql.warehouse.dir": "/nowhere"}
    ):
        pass
    assert spark.conf.get("my.key", None) is None


def test_default_database_is_put_back(spark, database):
    before = spark.catalog.currentDatabase()
    with default_namespace(spark, catalog="spark_catalog", database=database):
        spark.range(1).write.saveAsTable("here")
        assert spark.catalog.currentDatabase() == database
    assert spark.catalog.currentDatabase() == before and spark.catalog.tableExists(f"{database}.here")
    with pytest.raises(AnalysisException), default_namespace(spark, database="no_such_database"):
        pass
    assert spark.catalog.currentDatabase() == before


def test_default_catalog_is_put_back():
    """With a stand-in, since a test session has a single catalog."""

    class Catalog:
        calls: list = []

        def currentCatalog(self):
            return "one"

        def currentDatabase(self):
            return "main"

        def setCurrentCatalog(self, name):
            self.calls.append(("catalog", name))

        def setCurrentDatabase(self, name):
            self.calls.append(("database", name))

    class Session:
        catalog = Catalog()

    with default_namespace(Session(), catalog="two", database="work"):
        pass
    assert Catalog.calls == [("catalog", "two"), ("database", "work"), ("catalog", "one"), ("database", "main")]


def test_stored_results_lie_in_the_shared_folder(spark):
    df = stored(spark.range(5).withColumn("half", F.col("id") / 2), "check")
    assert df.count() == 5 and df.columns == ["id", "half"]
    assert all(shared_dir(spark) in f for f in df.inputFiles())


def test_scratch_can_be_dropped(spark):
    name, path = scratch_database(spark)
    spark.range(1).write.saveAsTable(f"{name}.t")
    df = stored(spark.range(5), "check")
    (file, *_) = df.inputFiles()
    drop_scratch(spark)
    assert not spark.catalog.databaseExists(name)
    assert not Path(path).exists() and not Path(file.removeprefix("file:")).exists()


def test_scratch_lies_in_the_shared_folder():
    class Session:
        conf = {"spark.sql.warehouse.dir": "hdfs://store/warehouse/"}

    assert shared_dir(Session) == "hdfs://store/warehouse"
    Session.conf = Session.conf | {"spark.checkpoint.dir": "hdfs://store/shared"}
    assert shared_dir(Session) == "hdfs://store/shared"



def test_a_failed_overwrite_keeps_the_rows_of_the_run_before(spark, database):
    dataset = Dataset(f"{database}.kept", TABLE)
    publish(dataset, spark.range(5).toDF("n"))
    halfway = spark.range(0, 1000, 1, 8).select(F.when(F.col("id") == 900, F.raise_error(F.lit("stop"))).otherwise("x").alias("other"))
    with pytest.raises(Exception, match="stop"):
        publish(dataset, halfway)
    assert rows(spark.table(dataset.name)) == [(n,) for n in range(5)]
    assert [t.name for t in spark.catalog.listTables(database)] == ["kept"]
    publish(dataset, spark.range(2).select(F.lit("new").alias("other"), "id"))
    assert rows(spark.table(dataset.name)) == [("new", 0), ("new", 1)]
    assert [t.name for t in spark.catalog.listTables(database)] == ["kept"]


def test_an_overwrite_may_read_the_table_it_replaces(spark, database):
    dataset = Dataset(f"{database}.`odd_name`", TABLE, format="parquet")
    publish(dataset, spark.range(3).toDF("n"))
    publish(dataset, spark.table(dataset.name).selectExpr("n + 1 AS n"))
    assert rows(spark.table(dataset.name)) == [(1,), (2,), (3,)]
