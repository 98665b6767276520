from __future__ import annotations

import os
import subprocess
import sys
import threading
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace import Dataset, Flow, Pipeline, PipelineError, from_scripts, load_project, plan, report, run


def clean(df):
    return df.filter(F.col("amount") > 0).withColumn("order_date", F.to_date("orderDate"))


def daily(df):
    return df.groupBy("region", "order_date").agg(F.count(F.lit(1)).alias("order_count"), F.sum("amount").alias("total_amount"))


EXPECTED = [("Bergen", "2031-01-07", 2, 6.75), ("Bergen", "2031-02-28", 1, 10.0)]


def shown(df):
    return rows(df.withColumn("order_date", F.col("order_date").cast("string")))


def test_callback_pipeline(spark, database, orders):
    orders.write.saveAsTable(f"{database}.orders_source")
    pipeline = Pipeline(
        "orders",
        [Dataset("orders_clean", "table"), Dataset("daily_orders", "materialized_view")],
        [
            Flow("daily_orders", "daily_orders", lambda c: daily(c.read("orders_clean")), ("orders_clean",)),
            Flow("clean_orders", "orders_clean", lambda c: clean(c.read("orders_source")), ("orders_source",)),
        ],
        database=database,
    )
    results = run(spark, pipeline)
    assert [tuple(r) for r in results] == [(0, "clean_orders", "orders_clean", 3), (1, "daily_orders", "daily_orders", 2)]
    assert shown(spark.table(f"{database}.daily_orders")) == EXPECTED
    assert rows(report(spark, results).select("seq", "flow", "rows")) == [(1, "clean_orders", 3), (2, "daily_orders", 2)]
    assert rows(report(spark, run(spark, pipeline)).select("rows")) == [(2,), (3,)]
    assert spark.catalog.currentDatabase() == "default"


def test_views_only(spark, orders):
    orders.createOrReplaceTempView("orders_source")
    pipeline = Pipeline(
        "views",
        [Dataset("orders_clean", "temporary_view"), Dataset("daily_orders", "temporary_view")],
        [
            Flow("clean", "orders_clean", lambda c: clean(c.read("orders_source")), ("orders_source",)),
            Flow("daily", "daily_orders", lambda c: daily(c.read("orders_clean")), ("orders_clean",)),
        ],
    )
    assert [r.rows for r in run(spark, pipeline)] == [None, None]
    assert shown(spark.table("daily_orders")) == EXPECTED
    assert spark.table("daily_orders").where("order_count = 1").head().total_amount == 10.0
    for view in ("orders_source", "orders_clean", "daily_orders"):
        spark.catalog.dropTempView(view)


SCRIPTS = {
    "a_readings.sql": """-- one row per reading; a view
        create temp view readings as
        select * from values ('oak', 3, 1.5), ('oak', 3, 2.5), ('elm', 4, 0.25), ('elm', 4, null) as t(tree, month, growth);""",
    "b/known.SQL": """set spark.sql.shuffle.partitions = 2;
        Create Or Replace Materialized View known As
        With readings As (Select tree, month, growth From readings Where growth Is Not Null) Select * From readings""",
    "c/totals.sql": """CREATE MATERIALIZED VIEW totals AS SELECT tree, count(*) AS n, sum(growth) AS growth FROM known GROUP BY tree;
        INSERT INTO TABLE sink SELECT tree, n, growth FROM totals;""",
}


def test_script_project(spark, database, tmp_path):
    for name, text in SCRIPTS.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    spark.sql(f"CREATE TABLE {database}.sink (tree STRING, n BIGINT, growth DOUBLE) USING parquet")
    pipeline = load_project(spark, "trees", [str(tmp_path)], database=database, conf={"my.conf": "1"})
    assert dict(pipeline.flows[1].conf) == {"spark.sql.shuffle.partitions": "2"}
    expected = [("elm", 1, 0.25), ("oak", 2, 4.0)]
    for times in (1, 2):
        results = run(spark, pipeline)
        assert [(r.stage, r.flow, r.rows) for r in results] == [
            (0, "sql_flow_001_readings", None),
            (1, "sql_flow_002_known", 3),
            (2, "sql_flow_003_totals", 2),
            (3, "sql_flow_004_sink", 2),
        ]
        assert [(t, n, float(g)) for t, n, g in rows(spark.table(f"{database}.totals"))] == expected
        assert rows(spark.table(f"{database}.sink")) == sorted(expected * times)
    assert spark.conf.get("my.conf", None) is None
    spark.catalog.dropTempView("readings")


def test_a_name_of_two_kinds_is_refused(spark):
    scripts = spark.createDataFrame([("a.sql", "INSERT INTO x SELECT 1; CREATE MATERIALIZED VIEW x AS SELECT 2")], "path string, text string")
    with pytest.raises(PipelineError, match="'x' is a table and, in a.sql, also a materialized_view"):
        from_scripts("p", scripts)
    both = [Dataset("x", "table"), Dataset("X", "temporary_view"), Dataset("a.v", "temporary_view")]
    problems = Pipeline("p", both, [Flow("f", "x", print), Flow("g", "a.v", print)]).problems()
    assert any("declared as table and as temporary_view" in p for p in problems)
    assert "temporary view 'a.v' has a qualified name" in problems


@pytest.mark.parametrize("concurrent", [1, 3])
def test_writers_wait_for_a_retry_after_a_failure(spark, database, concurrent):
    broken = [True]

    def first(context):
        if broken[0]:
            raise ValueError("boom")
        return context.spark.range(0, 1)

    flows = [Flow("first", "sink", first), Flow("second", "sink", lambda c: c.spark.range(1, 2))]
    pipeline = Pipeline("p", [Dataset("sink", "table")], flows, database=database)
    spark.range(1, 3).write.saveAsTable(f"{database}.sink")
    for _ in range(2):
        with pytest.raises(PipelineError, match="flow 'first' failed: boom"):
            run(spark, pipeline, max_concurrent_flows=concurrent)
        assert rows(spark.table(f"{database}.sink")) == [(1,), (2,)]
    broken[0] = False
    run(spark, pipeline, max_concurrent_flows=concurrent)
    assert rows(spark.table(f"{database}.sink")) == [(0,), (1,)]


@pytest.mark.parametrize(("mode", "times"), [("overwrite", 1), ("append", 2)])
def test_a_backfill_is_never_lost(spark, database, mode, times):
    flows = [Flow("old", "t", lambda c: c.spark.range(0, 2), mode="once"), Flow("new", "t", lambda c: c.spark.range(2, 3))]
    pipeline = Pipeline("p", [Dataset("t", "table")], flows, database=database)
    for _ in range(2):
        run(spark, pipeline, mode, once_log=f"{database}.log")
    assert rows(spark.table(f"{database}.t")) == sorted([(0,), (1,)] + [(2,)] * times)


def test_once_flows_side_by_side_are_all_remembered(spark, database):
    flows = [Flow(f"f{i}", f"t{i}", lambda c, i=i: c.spark.range(i + 1), mode="once") for i in range(6)]
    pipeline = Pipeline("p", [Dataset(f"t{i}", "table") for i in range(6)], flows, database=database)
    log = f"{database}.log"
    assert len(run(spark, pipeline, "append", max_concurrent_flows=6, once_log=log)) == 6
    assert run(spark, pipeline, "append", max_concurrent_flows=6, once_log=log) == []
    assert [spark.table(f"{database}.t{i}").count() for i in range(6)] == [1, 2, 3, 4, 5, 6]


def test_invalid_pipelines_do_not_start(spark):
    ran = []
    pipeline = Pipeline("p", [Dataset("a", "table")], [Flow("f", "b", lambda c: ran.append(1))])
    with pytest.raises(PipelineError, match="not valid: flow 'f' writes undeclared dataset 'b'; no flow writes dataset 'a'"):
        run(spark, pipeline)
    assert ran == []


@pytest.mark.parametrize("concurrent", [1, 3])
def test_a_failure_lets_the_wave_finish_and_stops_later_ones(spark, database, concurrent):
    def fail(context):
        raise ValueError("boom")

    pipeline = Pipeline(
        "p",
        [Dataset(n, "table") for n in ("bad", "good", "later")],
        [
            Flow("bad", "bad", fail),
            Flow("good", "good", lambda c: c.spark.range(2)),
            Flow("later", "later", lambda c: c.read("good"), ("good", "bad")),
        ],
        database=database,
        conf={"my.conf": "1"},
    )
    with pytest.raises(PipelineError, match="flow 'bad' failed: boom") as error:
        run(spark, pipeline, max_concurrent_flows=concurrent)
    assert isinstance(error.value.__cause__, ValueError)
    assert spark.catalog.tableExists(f"{database}.good") and not spark.catalog.tableExists(f"{database}.later")
    assert spark.conf.get("my.conf", None) is None and spark.catalog.currentDatabase() == "default"


def test_missing_and_streaming_results(spark, database):
    for result, message in ((lambda c: None, "no DataFrame"), (lambda c: c.spark.readStream.format("rate").load(), "streaming")):
        pipeline = Pipeline("p", [Dataset("v", "temporary_view")], [Flow("f", "v", result)])
        with pytest.raises(PipelineError, match=message):
            run(spark, pipeline)
    assert not spark.catalog.tableExists("v")


@pytest.mark.parametrize("concurrent", [1, 4])
def test_several_writers_add_up(spark, database, concurrent):
    flows = [Flow(f"w{i}", "sink", lambda c, i=i: c.spark.range(i, i + 1)) for i in range(4)]
    pipeline = Pipeline("p", [Dataset("sink", "table")], flows, database=database)
    for _ in range(2):
        run(spark, pipeline, max_concurrent_flows=concurrent)
        assert rows(spark.table(f"{database}.sink")) == [(0,), (1,), (2,), (3,)]
    run(spark, pipeline, "append")
    assert spark.table(f"{database}.sink").count() == 8
    assert [r.rows for r in run(spark, pipeline, "ignore")] == [None] * 4
    assert spark.table(f"{database}.sink").count() == 8
    with pytest.raises(PipelineError, match="ALREADY_EXISTS"):
        run(spark, pipeline, "errorifexists")


def test_declared_schema_comes_first(spark, database):
    schema = StructType([StructField("id", LongType()), StructField("note", LongType())])
    pipeline = Pipeline(
        "p", [Dataset("t", "table", schema=schema)], [Flow("f", "t", lambda c: c.spark.range(2))], database=database
    )
    for mode, count in (("append", 2), ("ignore", 2)):
        spark.sql(f"DROP TABLE IF EXISTS {database}.t")
        if mode == "ignore":
            pipeline = Pipeline(
                "p",
                [Dataset("t", "table", schema=StructType(schema.fields[:1]))],
                [Flow("f", "t", lambda c: c.spark.range(2))],
                database=database,
            )
        else:
            with pytest.raises(PipelineError):
                run(spark, pipeline, mode)
            assert spark.table(f"{database}.t").columns == ["id", "note"]
            continue
        run(spark, pipeline, mode)
        assert spark.table(f"{database}.t").count() == count


def test_once_flows_with_and_without_memory(spark, database):
    pipeline = Pipeline(
        "p", [Dataset("t", "table")], [Flow("f", "t", lambda c: c.spark.range(2), mode="once")], database=database
    )
    for _ in range(2):
        run(spark, pipeline, "append")
    assert spark.table(f"{database}.t").count() == 4
    done = [len(run(spark, pipeline, "append", once_log=f"{database}.log")) for _ in range(3)]
    assert done == [1, 0, 0] and spark.table(f"{database}.t").count() == 6


def test_flows_side_by_side_keep_their_settings_apart(spark, database):
    key, seen, together = "spark.sql.shuffle.partitions", {}, threading.Barrier(2, timeout=30)

    def plain(name):
        def build(context):
            together.wait()
            seen[name] = context.spark.conf.get(key)
            return context.spark.range(1)

        return build

    def special(context):
        seen["special"] = context.spark.conf.get(key)
        return context.spark.range(1)

    flows = [
        Flow("special", "special", special, conf={key: "9"}),
        Flow("one", "one", plain("one")),
        Flow("two", "two", plain("two")),
    ]
    pipeline = Pipeline("p", [Dataset(f.name, "table") for f in flows], flows, database=database, conf={key: "3"})
    results = run(spark, pipeline, max_concurrent_flows=2)
    assert [r.flow for r in results] == ["special", "one", "two"]
    assert seen == {"special": "9", "one": "3", "two": "3"}


def test_writers_with_and_without_settings_add_up(spark, database):
    flows = [
        Flow("special", "sink", lambda c: c.spark.range(0, 1), conf={"spark.sql.shuffle.partitions": "2"}),
        Flow("plain", "sink", lambda c: c.spark.range(1, 2)),
        Flow("a", "a", lambda c: c.spark.range(1)),
        Flow("b", "b", lambda c: c.spark.range(1)),
    ]
    pipeline = Pipeline("p", [Dataset(n, "table") for n in ("sink", "a", "b")], flows, database=database)
    for _ in range(2):
        run(spark, pipeline, max_concurrent_flows=3)
        assert rows(spark.table(f"{database}.sink")) == [(0,), (1,)]


def test_plans_are_listed_without_running(spark):
    ran = []
    flows = [
        Flow("daily", "daily_orders", lambda c: ran.append(1), ("orders_clean",)),
        Flow("clean", "orders_clean", lambda c: ran.append(1), ("orders_source",)),
    ]
    pipeline = Pipeline("p", [Dataset("daily_orders", "table"), Dataset("orders_clean", "table")], flows)
    assert rows(plan(spark, pipeline)) == [("p", 0, "clean", "orders_clean"), ("p", 1, "daily", "daily_orders")]
    assert ran == []
    with pytest.raises(PipelineError, match="not valid"):
        plan(spark, Pipeline("p", [Dataset("a", "table")]))


def test_six_flows_with_settings_of_their_own_at_once(spark, database):
    key, seen, together = "spark.sql.shuffle.partitions", {}, threading.Barrier(6, timeout=60)
    before = spark.conf.get(key)
    spark.udf.register("plus_one", lambda x: x + 1, "bigint")
    spark.range(3).createOrReplaceTempView("shared_ids")
    spark.range(1).write.saveAsTable(f"{database}.t0")
    assert spark.table(f"{database}.t0").count() == 1

    def build(number):
        def query(context):
            together.wait()
            seen[number] = context.spark.conf.get(key)
            if number == 5:
                raise ValueError("boom")
            return context.sql("SELECT plus_one(id) AS id FROM shared_ids").repartition("id")

        return query

    flows = [Flow(f"f{i}", f"t{i}", build(i), conf={key: str(i + 11)}) for i in range(6)]
    pipeline = Pipeline("p", [Dataset(f"t{i}", "table") for i in range(6)], flows, database=database)
    with pytest.raises(PipelineError, match="flow 'f5' failed: boom"):
        run(spark, pipeline, max_concurrent_flows=6)
    assert seen == {i: str(i + 11) for i in range(6)}
    assert spark.conf.get(key) == before and spark.catalog.currentDatabase() == "default"
    assert [rows(spark.table(f"{database}.t{i}")) for i in range(5)] == [[(1,), (2,), (3,)]] * 5
    spark.catalog.dropTempView("shared_ids")


def test_a_query_of_another_session_runs_alone_with_its_settings(spark, database):
    key, seen = "spark.sql.shuffle.partitions", []

    def outside(context):
        seen.append(spark.conf.get(key))
        return spark.range(2)

    flows = [Flow("outside", "a", outside, conf={key: "9"}), Flow("b", "b", lambda c: c.spark.range(1))]
    pipeline = Pipeline("p", [Dataset("a", "table"), Dataset("b", "table")], flows, database=database, conf={key: "3"})
    assert [r.rows for r in run(spark, pipeline, max_concurrent_flows=2)] == [2, 1]
    assert seen == ["3", "9"]


@pytest.mark.parametrize("mode", ["append", "overwrite"])
def test_a_stop_between_rows_and_record_repeats_nothing(spark, database, monkeypatch, mode):
    flows = [
        Flow("old", "t", lambda c: c.spark.range(0, 2), mode="once"),
        Flow("new", "t", lambda c: c.spark.range(2, 3)),
    ]
    pipeline = Pipeline("p", [Dataset("t", "table", run_column="attempt")], flows, database=database)

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        patched.setattr(sys.modules["millrace.run"], "_record", stop)
        for _ in range(2):
            with pytest.raises(KeyboardInterrupt):
                run(spark, pipeline, mode, once_log=f"{database}.log")
    news = 2 if mode == "append" else 1
    assert rows(spark.table(f"{database}.t").select("id")) == sorted([(0,), (1,)] + [(2,)] * news)
    for times in (1, 2):
        run(spark, pipeline, mode, once_log=f"{database}.log")
        news = 2 + times if mode == "append" else 1
        assert rows(spark.table(f"{database}.t").select("id")) == sorted([(0,), (1,)] + [(2,)] * news)


def test_rows_are_those_of_the_files(spark, database):
    spark.sql(f"CREATE TABLE {database}.sink (id BIGINT, part STRING) USING parquet PARTITIONED BY (part)")
    spark.sql(f"INSERT INTO {database}.sink VALUES (7, 'a b'), (8, 'c=d/é')")
    flows = [
        Flow("sink", "sink", lambda c: c.spark.range(5).selectExpr("id", "CASE WHEN id < 2 THEN 'a b' ELSE 'c=d/é' END")),
        Flow("none", "none", lambda c: c.spark.range(0)),
        Flow("orc", "orc", lambda c: c.spark.range(4)),
        Flow("json", "json", lambda c: c.spark.range(6)),
    ]
    datasets = [
        Dataset("sink", "table", write="insert"),
        Dataset("none", "table"),
        Dataset("orc", "table", format="orc"),
        Dataset("json", "table", format="json"),
    ]
    for mode in ("overwrite", "append"):
        results = run(spark, Pipeline("p", datasets, flows, database=database), mode)
        assert {r.flow: r.rows for r in results} == {"sink": 5, "none": 0, "orc": 4, "json": 6}
    assert spark.table(f"{database}.sink").count() == 12


RETRIED = """
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from millrace import Dataset, Flow, Pipeline, run

spark = SparkSession.builder.master("local[2,3]").config("spark.sql.warehouse.dir", sys.argv[1]).config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")

def once_bad(batches):
    for batch in batches:
        yield batch
    if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() == 1:
        raise ValueError("lost")

query = lambda c: c.spark.range(0, 1000, 1, 4).mapInArrow(once_bad, "id bigint")
result = run(spark, Pipeline("p", [Dataset("t", "table")], [Flow("f", "t", query)]))
print("ROWS", result[0].rows, spark.table("t").count())
"""


def test_rows_after_a_task_that_is_retried(tmp_path):
    env = {**os.environ, "PYTHONPATH": str(Path(__file__).parents[1])}
    done = subprocess.run(
        [sys.executable, "-c", RETRIED, str(tmp_path)], capture_output=True, text=True, timeout=300, env=env, cwd=tmp_path
    )
    assert "ROWS 1000 1000" in done.stdout, done.stderr[-2000:]
