"""Checks of declarations: each returns violations as ``(check, object, detail)``.

Inputs are ``datasets(name, kind, decl_no)`` and ``flows(flow, target, mode,
decl_no)``. Where a name is declared twice, the first declaration counts, as
when a pipeline is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from millrace.operators.joins import anti
from millrace.operators.windows import numbered
from millrace.settings import SIZES, spark_conf
from millrace.storage import stored

VIEWS = ("materialized_view", "temporary_view")


def undefined_target(datasets: DataFrame, flows: DataFrame) -> DataFrame:
    """Flows that write a dataset nobody declared."""
    missing = anti(flows, datasets.select(F.col("name").alias("target")), ["target"])
    return _violations(missing, "undefined_target", F.col("flow"), F.col("target"))


def no_producer(datasets: DataFrame, flows: DataFrame) -> DataFrame:
    """Declared datasets that no flow writes."""
    written = flows.select(F.col("target").alias("name")).distinct()
    idle = first_kinds(datasets).join(written, "name", "left_anti")
    return _violations(idle, "no_producer", F.col("name"), F.col("kind"))


def single_writer(datasets: DataFrame, flows: DataFrame) -> DataFrame:
    """Views with several writers (views with none are found by ``no_producer``)."""
    writers = flows.groupBy(F.col("target").alias("name")).agg(F.count(F.lit(1)).alias("writers"))
    crowded = writers.filter(F.col("writers") > 1).join(_views(datasets), "name")
    return _violations(crowded, "single_writer", F.col("name"), F.col("writers").cast("string"))


def once_mode(datasets: DataFrame, flows: DataFrame) -> DataFrame:
    """One-time flows into views, which only accept recurring ones."""
    # Stored, so that a view with many writers can be split in the join.
    views = stored(_views(datasets).withColumnRenamed("name", "target"), "views")
    wrong = flows.filter(F.col("mode") == "once").join(views, "target")
    return _violations(wrong, "once_mode", F.col("flow"), F.col("target"))


def duplicates(datasets: DataFrame, flows: DataFrame) -> DataFrame:
    """Names declared more than once, among datasets and among flows."""
    names = datasets.select(F.lit("duplicate_dataset").alias("check"), F.col("name").alias("object")).unionAll(
        flows.select(F.lit("duplicate_flow"), F.col("flow"))
    )
    counts = names.groupBy("check", "object").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > 1).select("check", "object", F.col("n").cast("string").alias("detail"))


def mixed_kinds(datasets: DataFrame) -> DataFrame:
    """Names declared with different kinds, which would take the kind of the first."""
    kinds = datasets.groupBy("name").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    return _violations(kinds.filter(F.size("kinds") > 1), "mixed_kinds", F.col("name"), F.array_join("kinds", ","))


def view_name(datasets: DataFrame) -> DataFrame:
    """Temporary views with a qualified name, which Spark refuses to create."""
    kinds = first_kinds(datasets)
    wrong = kinds.filter((F.col("kind") == "temporary_view") & F.col("name").contains("."))
    return _violations(wrong, "view_name", F.col("name"), F.col("kind"))


def blocked(blocked_flows: DataFrame) -> DataFrame:
    """Flows on or behind a cycle, as found by ``lineage.blocked_flows``."""
    return _violations(blocked_flows, "cycle", F.col("flow"), F.lit("never ready"))


def all_checks(datasets: DataFrame, flows: DataFrame) -> DataFrame:
    """All checks that need no graph walk, from one row per name and the flows that a check has to name.

    Kinds go by numbers, so that names and their writers are counted in hash
    tables of plain numbers; both meet in one join. Its rows tell whether any
    name is declared with several kinds or missing; only then declarations or
    flows are looked at again. Flow names are counted by their hashes first.
    """
    spark = flows.sparkSession
    with spark_conf(spark, SIZES):
        kinds = stored(numbered(datasets.select("kind").distinct().filter("kind IS NOT NULL"), ["kind"], "kind_no"), "kinds")
        declared = datasets.join(kinds, "kind", "left").groupBy("name").agg(
            F.min_by("kind_no", "decl_no").alias("kind_no"),
            F.min("kind_no").alias("least"),
            F.max("kind_no").alias("most"),
            F.count(F.lit(1)).alias("n"),
        )
        writers = flows.groupBy(F.col("target").alias("name")).agg(F.count(F.lit(1)).alias("writers"))
        state = Observation()
        both = declared.join(writers, "name", "full").join(kinds, "kind_no", "left")
        undefined, mixed = F.col("kind").isNull() & F.col("writers").isNotNull(), F.col("least") < F.col("most")
        counts = F.count_if(undefined).alias("undefined"), F.count_if(mixed).alias("mixed")
        names = stored(both.select("name", "kind", "least", "most", "n", "writers").observe(state, *counts), "names")
        alike = flows.groupBy(F.xxhash64("flow").alias("hash")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        alike = stored(alike.select("hash"), "alike")
    is_view = F.col("kind").isin(*VIEWS)

    def violation(when: Column, check: str, what: str, detail: Column) -> Column:
        fields = F.lit(check).alias("check"), F.col(what).alias("object"), detail.alias("detail")
        return F.when(when, F.struct(*fields))

    by_name = F.array(
        violation(F.col("writers").isNull(), "no_producer", "name", F.col("kind")),
        violation(is_view & (F.col("writers") > 1), "single_writer", "name", F.col("writers").cast("string")),
        violation(F.col("n") > 1, "duplicate_dataset", "name", F.col("n").cast("string")),
        violation(
            (F.col("kind") == "temporary_view") & F.col("name").contains("."), "view_name", "name", F.col("kind")
        ),
    )
    found = names.select(F.explode(by_name).alias("v")).filter("v IS NOT NULL").select("v.*")
    views = names.filter(is_view).select(F.col("name").alias("target"))
    once = flows.filter(F.col("mode") == "once").join(views, "target")
    found = found.unionByName(_violations(once, "once_mode", F.col("flow"), F.col("target")))
    if state.get["mixed"]:
        several = datasets.join(names.filter(mixed).select(F.col("name").alias("of")), F.col("name").eqNullSafe(F.col("of")), "left_semi")
        found = found.unionByName(mixed_kinds(several))
    if state.get["undefined"]:
        missing = names.filter(undefined).select(F.col("name").alias("of"))
        missing = flows.join(missing, F.col("target").eqNullSafe(F.col("of")), "left_semi")
        found = found.unionByName(_violations(missing, "undefined_target", F.col("flow"), F.col("target")))
    if not alike.isEmpty():
        repeated = flows.select("flow").withColumn("hash", F.xxhash64("flow")).join(alike, "hash", "left_semi")
        repeated = repeated.groupBy("flow").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        found = found.unionByName(_violations(repeated, "duplicate_flow", F.col("flow"), F.col("n").cast("string")))
    return found


def first_kinds(datasets: DataFrame) -> DataFrame:
    """``(name, kind)``: one row per name, as first declared."""
    return datasets.groupBy("name").agg(F.min_by("kind", "decl_no").alias("kind"))


def _views(datasets: DataFrame) -> DataFrame:
    return first_kinds(datasets).filter(F.col("kind").isin(*VIEWS))


def _violations(df: DataFrame, check: str, what: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), what.alias("object"), detail.alias("detail"))
