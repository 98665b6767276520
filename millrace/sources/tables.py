"""Reading published datasets and typed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A table of the catalog, ``db.table`` of the metastore, or a view of the session."""
    return spark.table(name)


def read_path(spark: SparkSession, path: str) -> DataFrame:
    """A published table read back from its directory."""
    return spark.read.parquet(path)


def typed_records(spark: SparkSession, records: list[tuple], schema: StructType | str) -> DataFrame:
    """Rows of a typed record list written in the program text."""
    return spark.createDataFrame(records, schema)
