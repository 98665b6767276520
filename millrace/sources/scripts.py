"""Folders of SQL scripts as rows."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: script files are recognised by this suffix, in any case.
SCRIPT_FILES = "*.[sS][qQ][lL]"


def read_scripts(spark: SparkSession, directories: list[str]) -> DataFrame:
    """All scripts below ``directories`` as ``(path, text, library)``, one row per file.

    ``library`` is the position of the directory in the list. A file that lies
    below several of them belongs to the first one, found by comparing path
    prefixes, so no row has to be shuffled to drop repeats.
    """
    roots = list(dict.fromkeys(_qualified(spark, d) for d in directories))
    parts = []
    for position, root in enumerate(roots):
        found = (
            spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=SCRIPT_FILES)
            .select(_decoded(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"))
            .withColumn("library", F.lit(position))
        )
        for earlier in roots[:position]:
            if _below(root, earlier) or _below(earlier, root):
                found = found.filter(~F.regexp_replace("path", AUTHORITY, "/").startswith(_inside(earlier)))
        parts.append(found)
    return reduce(DataFrame.unionByName, parts)


# Scheme and host in front of a path, as in hdfs://name:8020/.
AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?/+"


def _qualified(spark: SparkSession, directory: str) -> str:
    """The one full form of a path: with its file system, so that two spellings of a folder are one root."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory.rstrip("/") or "/")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _below(path: str, root: str) -> bool:
    return path.startswith(root + "/")


def _inside(root: str) -> str:
    return re.sub(AUTHORITY, "/", unquote(root) if ":/" in root else root) + "/"


def _decoded(uri: Column) -> Column:
    """Readable paths: percent escapes resolved, local files without their scheme."""
    plain = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^file:/+", "/")
