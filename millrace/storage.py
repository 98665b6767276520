"""Data that must survive the loss of an executor: stored results and scratch databases."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.settings import spark_conf

#: With it Spark removes the shuffle files of a query when the query ends.
_SHORT_LIVED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

_PATHS: list[str] = []
_DATABASES: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or else the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir", None)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A folder name of its own in the shared folder, remembered for ``drop_scratch``."""
    path = f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back: the lineage ends at the files.

    Unlike a checkpoint of rows, the files keep column pruning, filter pushdown
    and a size that the optimizer can see. What was shuffled on the way is not
    needed any more and leaves the disks at once.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    with spark_conf(spark, _SHORT_LIVED):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def bucketed(df: DataFrame, column: str, label: str) -> DataFrame:
    """Like ``stored``, with one bucket per value of ``spark.sql.shuffle.partitions``: work per ``column`` needs no exchange.

    The files belong to a table in a scratch database, since only tables remember their buckets.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"{_tables(spark)}.t_{uuid.uuid4().hex}", new_path(spark, label)
    with spark_conf(spark, _SHORT_LIVED):
        df.write.format("parquet").bucketBy(buckets, column).option("path", path).saveAsTable(name)
    return spark.table(name)


def _tables(spark: SparkSession) -> str:
    """The scratch database for bucketed results of this process."""
    for name in _DATABASES:
        if name.startswith("millrace_buckets_") and spark.catalog.databaseExists(name):
            return name
    return scratch_database(spark, "millrace_buckets_")[0]


def discard(*results: DataFrame) -> None:
    """Delete the files of results of ``stored`` that nothing will read any more."""
    for df in results:
        _PATHS.remove(df.stored_at)
        _delete(df.sparkSession, df.stored_at)


def scratch_database(spark: SparkSession, prefix: str = "millrace_") -> tuple[str, str]:
    """Create a database of its own in the shared folder; return its name and location."""
    path = new_path(spark, "db")
    name = prefix + path.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {name} LOCATION '{path}'")
    _DATABASES.append(name)
    return name, path


def drop_scratch(spark: SparkSession) -> None:
    """Remove the databases and folders that this process has made here.

    To be called when the results that read them are done with; DataFrames are
    lazy, so nothing is removed earlier on its own.
    """
    while _DATABASES:
        spark.sql(f"DROP DATABASE IF EXISTS {_DATABASES.pop()} CASCADE")
    while _PATHS:
        _delete(spark, _PATHS.pop())


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
