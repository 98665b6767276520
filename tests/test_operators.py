from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import joins
from millrace.operators.joins import anti, band_join, full_outer, semi
from millrace.operators.windows import framed, numbered, ranked
from millrace.plans import checks, lineage
from millrace.settings import spark_conf


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under one key, a null key, ties and null values."""
    rng = random.Random(3)
    data = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{rng.randint(0, 200)}"
        data.append((i, key, rng.randint(0, 400), None if rng.random() < 0.05 else rng.randint(-5, 5)))
    return spark.createDataFrame(data, "id bigint, key string, at int, v bigint").repartition(7).cache()


@pytest.mark.parametrize("slices", [1, 4, 60])
def test_frames_agree_with_plain_windows(spark, skewed, slices):
    order = ["at", "id"]
    with spark_conf(spark, {"spark.sql.shuffle.partitions": str(slices)}):
        got = framed(skewed, ["key"], order, number="n", running={"total": "v"}, lag={"before": "v"}, lead={"after": "v"})
    window = Window.partitionBy("key").orderBy(*order)
    expected = skewed.select(
        "*",
        F.sum("v").over(window.rowsBetween(Window.unboundedPreceding, 0)).alias("total"),
        F.lag("v").over(window).alias("before"),
        F.lead("v").over(window).alias("after"),
        F.row_number().over(window).cast("bigint").alias("n"),
    )
    assert rows(got.select(expected.columns)) == rows(expected)


def test_running_sums_of_doubles(skewed):
    window = Window.partitionBy("key").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    doubles = skewed.withColumn("v", F.col("v") / 7)
    got = framed(doubles, ["key"], ["at", "id"], running={"total": "v"}).select("id", F.round("total", 9).alias("total"))
    assert rows(got) == rows(doubles.select("id", F.round(F.sum("v").over(window), 9).alias("total")))


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("slices", [1, 4, 60])
def test_ranks_agree_with_plain_windows(spark, skewed, slices, descending):
    with spark_conf(spark, {"spark.sql.shuffle.partitions": str(slices)}):
        got = ranked(skewed, ["key"], "v", "id", descending)
    value = F.desc("v") if descending else F.asc("v")
    by_value = Window.partitionBy("key").orderBy(value)
    expected = skewed.select(
        "*",
        F.row_number().over(Window.partitionBy("key").orderBy(value, "id")).cast("bigint").alias("row_number"),
        F.rank().over(by_value).cast("bigint").alias("rank"),
        F.dense_rank().over(by_value).cast("bigint").alias("dense_rank"),
    )
    assert rows(got.select(expected.columns)) == rows(expected)


def test_a_value_that_fills_many_slices(spark):
    """Ties across borders: one value over most slices, a null value, a null key, keys of one row."""
    data = [("a", 5, i) for i in range(400)] + [("a", 6, 1000 + i) for i in range(50)] + [("a", None, 2000 + i) for i in range(90)]
    data += [(None, 1, 3000 + i) for i in range(70)] + [(f"s{i}", i, 4000 + i) for i in range(30)]
    df = spark.createDataFrame(data, "key string, v int, id int").repartition(5)
    for descending, value in ((False, F.asc("v")), (True, F.desc("v"))):
        with spark_conf(spark, {"spark.sql.shuffle.partitions": "40"}):
            got = ranked(df, ["key"], "v", "id", descending)
        by_value = Window.partitionBy("key").orderBy(value)
        expected = df.select(
            "*",
            F.row_number().over(by_value.orderBy(value, "id")).cast("bigint").alias("row_number"),
            F.rank().over(by_value).cast("bigint").alias("rank"),
            F.dense_rank().over(by_value).cast("bigint").alias("dense_rank"),
        )
        assert rows(got) == rows(expected)


def test_windows_read_their_slices_without_another_exchange(spark, skewed):
    for df in (ranked(skewed, ["key"], "v", "id"), framed(skewed, ["key"], ["at", "id"], number="n", running={"total": "v"})):
        plan = df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan[0] or "bucketed" in plan[0].lower()
        # Only the borders are exchanged: by their names, never the rows of a slice.
        moved = [line for line in plan[1].splitlines() if "Exchange hashpartitioning" in line]
        assert moved and all("__key_" in line for line in moved)


def test_numbers_follow_the_global_order(skewed):
    got = numbered(skewed.select("at", "id"), ["at", "id"], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 3001))
    assert [(r.at, r.id) for r in got] == sorted((r.at, r.id) for r in got)
    assert numbered(skewed.filter("id < 0").select("id"), ["id"], "n").count() == 0


def test_full_outer(skewed, spark):
    left = skewed.select("key", "id")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("new", 3), (None, 4)], "key string, w int")
    assert rows(full_outer(left, right, ["key"])) == rows(left.join(right, "key", "full"))


def test_semi_and_anti(skewed, spark):
    left = spark.createDataFrame([("hot", 1), ("k1", 2), ("new", 3), (None, 4)], "key string, w int")
    assert rows(semi(left, skewed, ["key"])) == rows(left.join(skewed, "key", "left_semi"))
    assert rows(anti(left, skewed, ["key"])) == rows(left.join(skewed, "key", "left_anti"))


@pytest.mark.parametrize("width", [1.0, 7.5, 1000.0])
def test_band_join_lists_each_pair_once(spark, width):
    rng = random.Random(5)
    points = [(i, round(rng.uniform(-50, 50), 1)) for i in range(200)]
    bands = [(i, low, low + rng.randint(0, 30)) for i, low in enumerate(float(rng.randint(-60, 60)) for _ in range(40))]
    got = band_join(
        spark.createDataFrame(points, "p int, x double"),
        F.col("x"),
        spark.createDataFrame(bands, "b int, low double, high double"),
        "low",
        "high",
        width,
    ).select("p", "b")
    assert rows(got) == sorted(((p, b) for p, x in points for b, low, high in bands if low <= x <= high), key=repr)


def test_bands_of_any_length_in_one_join(spark):
    rng = random.Random(9)
    bands = [(i, low, low + length) for i, length in enumerate([1, 2, 3, 7, 64, 1000, 10**6 + 3, 10**9, 10**9 - 1, 0] * 3) for low in [rng.randint(-(10**9), 10**9)]]
    bands += [(100, -5, -6), (101, None, 3), (102, 3, None)]
    points = [(i, rng.randint(-(10**9), 2 * 10**9)) for i in range(300)]
    points += [(1000 + k, x) for k, (_, low, high) in enumerate(bands[:30]) for x in (low, high, high + 1)] + [(5000, None)]
    df = spark.createDataFrame(bands, "b int, low bigint, high bigint")
    got = band_join(spark.createDataFrame(points, "p int, x bigint"), F.col("x"), df, "low", "high", 1.0).select("p", "b")
    inside = [(p, b) for p, x in points for b, low, high in bands if None not in (x, low, high) and low <= x <= high]
    assert rows(got) == sorted(inside, key=repr)
    cells = df.filter("low <= high").select((F.col("high") - F.col("low") + 1).alias("n"), F.size(joins._dyadic(F.col("low"), F.col("high"))).alias("listed"))
    assert all(r.listed <= max(1, 2 * r.n.bit_length()) for r in cells.collect())
    none = df.filter("b > 1000")
    assert rows(band_join(spark.createDataFrame(points, "p int, x bigint"), F.col("x"), none, "low", "high", 1.0)) == []


LOW_SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.shuffle.partitions": "12",
}


def splits(df):
    """Whether a join of the plan that ran was split; the rows are written, since only then the plan is final."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def uneven(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 997))
    rows_of = spark.range(120_000).select("id", key.alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("w"))
    return rows_of.repartition(12).cache()


@pytest.mark.parametrize("join", [semi, anti, full_outer])
def test_hot_keys_are_split(spark, uneven, join):
    few = spark.createDataFrame([("hot", 1), ("k1", 2), ("new", 3)], "key string, x int")
    with spark_conf(spark, LOW_SKEW):
        assert splits(join(uneven, few, ["key"]))
        assert join is not full_outer or splits(join(few, uneven, ["key"]))


def test_hot_datasets_are_split(spark, uneven):
    flows = spark.createDataFrame([("a", "hot"), ("b", "k1")], "flow string, target string")
    flows = flows.withColumns({"mode": F.lit("once"), "decl_no": F.lit(1)})
    reads = uneven.select(F.col("w").alias("flow"), F.col("key").alias("dataset"))
    writes = uneven.select(F.col("w").alias("flow"), F.col("key").alias("target"), F.lit("once").alias("mode"))
    views = spark.createDataFrame([("hot", "temporary_view", 1), ("k2", "table", 2)], "name string, kind string, decl_no int")
    with spark_conf(spark, LOW_SKEW):
        assert splits(lineage.external_inputs(flows, reads))
        assert splits(checks.undefined_target(views, writes))
        assert splits(checks.once_mode(views, writes))
