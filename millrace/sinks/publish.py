"""Publish a flow result as a view, a saved table or an insert."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.model import INSERT, TEMPORARY_VIEW, Dataset, PipelineError

SAVE_MODES = ("overwrite", "append", "ignore", "errorifexists")


def publish(dataset: Dataset, df: DataFrame, save_mode: str = "overwrite") -> None:
    """Publish ``df`` under the dataset's name.

    * temporary view: registered, no job runs;
    * insert target: appended by column position to a table that must exist;
    * anything else: saved with ``save_mode``. ``overwrite`` replaces data and
      schema once all rows are written, ``append`` matches columns by name.
    """
    if save_mode not in SAVE_MODES:
        raise PipelineError(f"save mode must be one of {', '.join(SAVE_MODES)}, not {save_mode!r}")
    if dataset.kind == TEMPORARY_VIEW:
        df.createOrReplaceTempView(dataset.name)
    elif dataset.write == INSERT:
        _gathered(dataset.name, df).write.mode("append").insertInto(dataset.name)
    elif save_mode == "overwrite" and df.sparkSession.catalog.tableExists(dataset.name):
        _replace(dataset, df)
    else:
        _writer(dataset, df, save_mode).saveAsTable(dataset.name)


def counted(dataset: Dataset, df: DataFrame, save_mode: str) -> int:
    """Publish ``df`` and return how many rows its committed files hold.

    Parquet and ORC tell their numbers of rows without being read; only files
    that were not there before are asked. In other formats, which would have
    to be read once more, the rows are counted on their way into the files, and
    a task that is repeated may count its rows again.
    """
    spark = df.sparkSession
    before = _files(spark, dataset) if save_mode == "append" or dataset.write == INSERT else set()
    seen = Observation()
    publish(dataset, df.observe(seen, F.count(F.lit(1)).alias("rows")), save_mode)
    table = spark.table(dataset.name)
    files = _files(spark, dataset)
    if not files or not all(f.endswith((".parquet", ".orc")) for f in files):
        return seen.get["rows"]
    if before:
        # Every job gives its files names that no other job uses; by name the rest is left out before anything is opened.
        table = table.filter(F.col("_metadata.file_name").isin(*{f.rsplit("/", 1)[1] for f in files - before}))
    return table.count()


def take_back(spark: SparkSession, dataset: Dataset, marks: Iterable[str]) -> None:
    """Remove the rows of attempts that were not finished; each is a partition, so no other rows are touched."""
    if not spark.catalog.tableExists(dataset.name):
        return
    for mark in marks:
        spark.sql(f"ALTER TABLE {dataset.name} DROP IF EXISTS PARTITION (`{dataset.run_column}` = '{mark}')")


def _files(spark: SparkSession, dataset: Dataset) -> set[str]:
    return set(spark.table(dataset.name).inputFiles()) if spark.catalog.tableExists(dataset.name) else set()


def _writer(dataset: Dataset, df: DataFrame, save_mode: str) -> DataFrameWriter:
    writer = df.write.mode(save_mode)
    if dataset.run_column:
        writer = writer.partitionBy(dataset.run_column)
    return writer.format(dataset.format) if dataset.format else writer


def _replace(dataset: Dataset, df: DataFrame) -> None:
    """Write the rows beside the table and put them in its place when all are there.

    An overwrite of a table drops it before the job. Here a job that fails
    leaves the table with its earlier rows, and readers see either the earlier
    rows or the new ones; between the two renames, which move no rows, the name
    is missing for a moment. What a failure between them leaves is put back.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex
    *where, name = split_name(dataset.name)
    beside = {kind: ".".join(f"`{p}`" for p in [*where, f"{name}__{kind}_{mark}"]) for kind in ("new", "old")}
    own = ".".join(f"`{p}`" for p in [*where, name])
    try:
        _writer(dataset, df, "errorifexists").saveAsTable(beside["new"])
        spark.sql(f"ALTER TABLE {own} RENAME TO {beside['old']}")
        try:
            spark.sql(f"ALTER TABLE {beside['new']} RENAME TO {own}")
        except Exception:
            spark.sql(f"ALTER TABLE {beside['old']} RENAME TO {own}")
            raise
        if dataset.run_column:
            # Some catalogs rename a table without its partitions' places.
            spark.sql(f"MSCK REPAIR TABLE {own} SYNC PARTITIONS")
    finally:
        for left in beside.values():
            spark.sql(f"DROP TABLE IF EXISTS {left}")


def split_name(name: str) -> list[str]:
    """The parts of a name, back-quoted or not."""
    return [quoted.replace("``", "`") if quoted else bare for quoted, bare in re.findall(r"`((?:[^`]|``)+)`|([^.`]+)", name)]


def bootstrap(spark: SparkSession, dataset: Dataset) -> bool:
    """Create the dataset's table empty if it declares a schema and does not exist yet."""
    if dataset.kind == TEMPORARY_VIEW or dataset.write == INSERT or dataset.schema is None:
        return False
    publish(dataset, spark.createDataFrame([], dataset.schema), "ignore")
    return True


def _gathered(table: str, df: DataFrame) -> DataFrame:
    """Bring rows of one table partition together before an insert.

    Otherwise every task writes a file into every partition it meets. The
    rebalance hint lets adaptive execution split a partition value that holds
    most of the rows and merge small ones.
    """
    columns = df.sparkSession.catalog.listColumns(table)
    partitions = [c.name for c in columns if c.isPartition]
    if not partitions or len(columns) != len(df.columns):
        return df
    return df.toDF(*[c.name for c in columns]).hint("rebalance", *partitions)
