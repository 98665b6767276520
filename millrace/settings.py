"""Settings that hold for one run or one flow and are put back afterwards."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Rows of two names shrink to a few bytes in files and shuffles and to some hundreds in a task's sorts and hash tables,
#: so tasks get less than Spark's usual bytes. Many small joins in a row are broadcast only while they are tiny.
SIZES = {
    "spark.sql.files.maxPartitionBytes": "8m",
    "spark.sql.files.openCostInBytes": "1m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16m",
    "spark.sql.autoBroadcastJoinThreshold": "256k",
}


@contextmanager
def spark_conf(spark: SparkSession, overrides: Mapping[str, str]) -> Iterator[None]:
    """Apply SQL settings, then restore earlier values and unset new keys.

    A key that Spark refuses (static or core settings) raises Spark's own error,
    which names the key; the keys set before it are restored.
    """
    before: dict[str, str | None] = {}
    try:
        for key, value in overrides.items():
            earlier = spark.conf.get(key, None)
            spark.conf.set(key, value)
            before[key] = earlier
        yield
    finally:
        for key, earlier in before.items():
            if earlier is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, earlier)


def own_session(spark: SparkSession) -> SparkSession:
    """A session with the settings, views, functions and default database of ``spark``, which then go their own way.

    Tables and databases are shared; what one session caches of a table's files
    has to be refreshed when the other writes it.
    """
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.catalog.setCurrentCatalog(spark.catalog.currentCatalog())
    own.catalog.setCurrentDatabase(spark.catalog.currentDatabase())
    return own


@contextmanager
def default_namespace(spark: SparkSession, catalog: str | None = None, database: str | None = None) -> Iterator[None]:
    """Resolve unqualified names in ``catalog`` and ``database`` while the block runs."""
    old_catalog, old_database = spark.catalog.currentCatalog(), spark.catalog.currentDatabase()
    try:
        if catalog is not None:
            spark.catalog.setCurrentCatalog(catalog)
        if database is not None:
            spark.catalog.setCurrentDatabase(database)
        yield
    finally:
        if catalog is not None:
            spark.catalog.setCurrentCatalog(old_catalog)
        spark.catalog.setCurrentDatabase(old_database)
