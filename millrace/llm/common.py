"""What several operators share: stored intermediate tables, shared files, ordering and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from millrace.storage import discard, new_path, stored

WORD = r"[^\x20\x09-\x0D]+"


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_order(df: DataFrame, *order: str | Column) -> DataFrame:
    """Range partitions in ascending order, each sorted; the column ``part`` numbers them."""
    ranged = df.repartitionByRange(partitions(df), *order).sortWithinPartitions(*order)
    return ranged.withColumn("part", F.spark_partition_id())


def offsets(parts: DataFrame, keys: list[str], order: str, size: str, name: str) -> DataFrame:
    """``keys, order, name``: for each (keys, order) the sum of ``size`` over smaller ``order`` of the same keys.

    Meant for one row per partition (and key), which a partition's task has
    summed up before: the window sees partitions, not rows.
    """
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.groupBy(*keys, order).agg(F.sum(size).alias("__size")).select(
        *keys, order, F.coalesce(F.sum("__size").over(before), F.lit(0)).cast("bigint").alias(name)
    )


def new_file(folder: str, name: str) -> str:
    """A file name no other task attempt uses, so a repeated task never writes into the file of another."""
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def open_output(uri: str):
    """A binary output stream at ``uri`` in any store that Arrow reaches; folders are made."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def open_input(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def as_uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` with the smallest node of each connected component, for every node of ``edges(a, b)``.

    Alternates large-star and small-star: every step links neighbours to the
    smallest node they know, until each node either has one neighbour, a smaller
    one, or none that is smaller; then every component is a star around its
    smallest node. Before each round the links of every Arrow batch become links
    to the smallest node of their component in that batch, which needs no
    exchange and spares most rounds. Work and memory are per edge; the
    neighbours of a node are only ever reduced to their least and greatest. A
    step is one job that writes its edges, so lineage ends there.
    """
    current = stored(_gathered(edges), "edges")
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        state = Observation()
        ends = both.groupBy("a").agg(F.min("b").alias("__least"), F.max("b").alias("__most"))
        ends = ends.observe(state, F.count_if((F.col("__least") < F.col("a")) & (F.col("__least") < F.col("__most"))).alias("open"))
        least = stored(ends.select("a", F.least("a", "__least").alias("m")), "least")
        if not state.get["open"]:
            discard(current)
            return least.select(F.col("a").alias("node"), F.col("m").alias("root"))
        # As many as before; which of them are equal shows after the second step.
        half = stored(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), "edges")
        discard(current, least)
        # Stored: a join right on an aggregate of its key could not be split, and most edges may end at one node.
        least = stored(half.groupBy("a").agg(F.min("b").alias("m")), "least")
        linked = half.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = stored(_down(linked.unionByName(least.select("a", F.col("m").alias("b")))), "edges")
        discard(half, least)
        current = stored(_gathered(small), "edges")
        discard(small)


def _down(edges: DataFrame) -> DataFrame:
    """Edges as (larger, smaller), once each."""
    a, b = F.greatest("a", "b"), F.least("a", "b")
    return edges.select(a.alias("a"), b.alias("b")).filter("a <> b").distinct()


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the least one that links lead to."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _gathered(edges: DataFrame) -> DataFrame:
    """Edges of the same components, as (larger, smaller): from each node of a batch to the least one of its component in the batch."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, place = np.unique(np.concatenate([batch.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
            label = forest(len(nodes), *np.split(place, 2))
            at = np.flatnonzero(label < np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(nodes[label[at]])], names=["a", "b"])

    return edges.select("a", "b").filter("a <> b").mapInArrow(gather, "a bigint, b bigint")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, whatever others there are that differ in case only."""
    place = {n: i for i, n in reversed(list(enumerate(df.columns)))}
    return plain(df).select(*[F.col(f"c{place[n]}").alias(n) for n in names])


def plain(df: DataFrame) -> DataFrame:
    """The columns as c0, c1, ..., so that no name can clash with one that is added."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


__all__ = [
    "WORD", "as_uri", "components", "discard", "forest", "in_order", "new_file", "new_path", "offsets", "open_input", "open_output",
    "partitions", "pick", "plain", "stored",
]
