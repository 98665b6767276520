"""Lineage over tables of declarations.

Inputs are ``flows(flow, target, mode, decl_no)`` with unique flow names and
``flow_inputs(flow, dataset)``, which may also hold the flow's ``target`` if
the flows are all declared and no row comes twice. A table may have many writers and many readers,
so the work here goes through the datasets between flows; flow-to-flow pairs
are listed only by ``edges``, whose result they are.

The jobs run under ``SIZES`` and their results are stored, so that a task's
memory and what the driver receives do not grow with the number of flows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.operators.joins import keys_of
from millrace.operators.windows import framed, numbered
from millrace.settings import SIZES, spark_conf
from millrace.storage import stored


def _sized(job: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Run ``job`` and store its result under ``SIZES``."""

    @wraps(job)
    def run(flows: DataFrame, flow_inputs: DataFrame) -> DataFrame:
        with spark_conf(flows.sparkSession, SIZES):
            return stored(job(flows, flow_inputs), job.__name__.replace("_", "-"))

    return run


def producers(flows: DataFrame) -> DataFrame:
    """``(dataset, producer_no, flow)``: the writers of each dataset in declaration order.

    One row per writer instead of a list per dataset, which would put all
    writers of a popular table into one value.
    """
    order = ["decl_no", "flow"]
    return framed(flows, ["target"], order, number="producer_no").select(
        F.col("target").alias("dataset"), "producer_no", "flow"
    )


def edges(flows: DataFrame, flow_inputs: DataFrame) -> DataFrame:
    """``(upstream, downstream)``: flow pairs where the second reads what the first writes.

    A flow has one target, so a pair can only meet in one dataset and the join
    yields it once. Inputs that nothing writes, which may be most, are left out
    before. The join stays an ordinary equality join that adaptive execution
    can split at hot datasets.
    """
    writers = flows.select(F.col("target").alias("dataset"), F.col("flow").alias("upstream"))
    return _readers(flows, flow_inputs).join(writers, "dataset").select("upstream", "downstream")


@_sized
def _readers(flows: DataFrame, flow_inputs: DataFrame) -> DataFrame:
    """``(dataset, downstream)``: who reads the datasets that some flow writes."""
    readers = flow_inputs.select("dataset", F.col("flow").alias("downstream")).distinct()
    produced = _hashed_keys(flows.select(F.col("target").alias("dataset")))
    return readers.join(produced, "dataset", "left_semi").select("dataset", "downstream")


def _hashed_keys(datasets: DataFrame) -> DataFrame:
    """The distinct names, as a hash table per task of the join: the other side passes by unsorted, however many rows a name has there."""
    return keys_of(datasets, ["dataset"]).hint("shuffle_hash")


def degrees(flows: DataFrame, flow_inputs: DataFrame) -> DataFrame:
    """``(flow, n_upstream, n_downstream)``: the sizes of the direct neighbourhoods.

    Counted per dataset and never as pairs: the upstream flows of a flow are
    the writers of its inputs, the downstream ones the readers of its target.
    """
    readers = flow_inputs.select("flow", "dataset").distinct()
    # Both counts are stored, so that popular datasets can be split in the joins.
    n_writers = stored(flows.groupBy(F.col("target").alias("dataset")).agg(F.count(F.lit(1)).alias("n")), "writers")
    n_readers = stored(
        readers.groupBy(F.col("dataset").alias("target")).agg(F.count(F.lit(1)).alias("n_downstream")), "readers"
    )
    upstream = readers.join(n_writers, "dataset").groupBy("flow").agg(F.sum("n").alias("n_upstream"))
    return (
        flows.select("flow", "target")
        .join(n_readers, "target", "left")
        .join(upstream, "flow", "left")
        .select(
            "flow",
            F.coalesce("n_upstream", F.lit(0)).alias("n_upstream"),
            F.coalesce("n_downstream", F.lit(0)).alias("n_downstream"),
        )
    )


def external_inputs(flows: DataFrame, flow_inputs: DataFrame) -> DataFrame:
    """``(flow, dataset)`` for inputs that no flow writes; they order nothing. As for ``edges``, the last join is lazy."""
    inputs, targets = _distinct_inputs(flows, flow_inputs), flows.select(F.col("target").alias("dataset"))
    return inputs.join(_hashed_keys(targets), "dataset", "left_anti").select("flow", "dataset")


@_sized
def _distinct_inputs(flows: DataFrame, flow_inputs: DataFrame) -> DataFrame:
    return flow_inputs.select("flow", "dataset").distinct()


@_sized
def stage_levels(flows: DataFrame, flow_inputs: DataFrame) -> DataFrame:
    """``(flow, stage)``: the length of the longest path from a flow without upstream flows.

    Worked out between datasets: a flow is an edge from each produced input to
    its target, so a table with many writers and many readers costs their sum.
    A flow comes one stage after the latest of its inputs. Flows on or behind a
    cycle are missing from the result. Datasets go by numbers given to their
    names first, which sort and hash faster; names meet three times only.
    """
    names = flows.select(F.col("target").alias("dataset")).distinct()
    ids = stored(names.withColumn("id", F.monotonically_increasing_id()), "names")
    reads = _reads(flows, flow_inputs, ids)
    down = ids.select(F.col("dataset").alias("target"), F.col("id").alias("down")).hint("shuffle_hash")
    edges = reads.select(F.col("dataset").alias("up"), "target").distinct().join(down, "target").select("up", "down")
    return _staged(flows, reads, dataset_levels(ids.select(F.col("id").alias("dataset")), edges))


def _staged(flows: DataFrame, reads: DataFrame, levels: DataFrame) -> DataFrame:
    # Each flow on its own comes at stage 0, so one grouping by flow does without a join back to the flows.
    alone = flows.select("flow", F.lit(0).alias("stage"), F.lit(False).alias("waits"))
    seen = reads.join(levels, "dataset", "left").select("flow", (F.col("level") + 1).alias("stage"), F.col("level").isNull().alias("waits"))
    latest = alone.unionByName(seen).groupBy("flow").agg(F.max("stage").alias("stage"), F.bool_or("waits").alias("waits"))
    return latest.filter("NOT waits").select("flow", F.col("stage").cast("int").alias("stage"))


def _reads(flows: DataFrame, flow_inputs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``(flow, target, dataset)``: the inputs of flows that some flow writes. Stored.

    Inputs that come with their flow's ``target``, and each once, need neither be made distinct nor meet the flows.
    With ``ids(dataset, id)`` of all targets, ``dataset`` is the input's number instead of its name.
    """
    known = "target" in flow_inputs.columns
    inner = flow_inputs if known else flow_inputs.select("flow", "dataset").distinct()
    if ids is None:
        inner = inner.join(_hashed_keys(flows.select(F.col("target").alias("dataset"))), "dataset", "left_semi")
    else:
        inner = inner.join(ids.hint("shuffle_hash"), "dataset").withColumn("dataset", F.col("id"))
    inner = inner if known else flows.select("flow", "target").join(inner, "flow")
    return stored(inner.select("flow", "target", "dataset"), "reads")


def _dataset_edges(reads: DataFrame) -> DataFrame:
    return reads.select(F.col("dataset").alias("up"), F.col("target").alias("down")).distinct()


def dataset_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(dataset, level)``: the longest path to each of ``nodes(dataset)`` along ``edges(up, down)``, without those on or behind cycles.

    Each round contracts the graph. A dataset without edges into it is placed.
    One with a single edge into it waits for that one alone; chains and trees of
    such datasets are shortened by pointer doubling to the placed or branching
    dataset they hang from, at a known distance, and leave the graph. Edges
    from either kind are handed to what they hang from, equal ones become the
    longer one, and edges from placed datasets become numbers. What is left are
    the datasets with several edges into them, so used edges are read once and
    a chain of n costs about log n jobs. At the end the datasets that left are
    put back, latest round first.
    """
    left = stored(edges.select("up", "down", F.lit(1).alias("w")), "edges")
    open_ = nodes.select("dataset", F.lit(0).alias("base"))
    placed: list[DataFrame] = []
    hanging: list[DataFrame] = []
    while True:
        into = left.groupBy(F.col("down").alias("dataset")).agg(
            F.count(F.lit(1)).alias("n"), F.min("up").alias("root"), F.min("w").alias("w")
        )
        state = Observation()
        counts = [F.count_if(c).alias(n) for n, c in (("roots", F.col("n") == 0), ("single", F.col("n") == 1), ("many", F.col("n") > 1))]
        degrees = open_.join(into, "dataset", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        degrees = stored(degrees.observe(state, *counts), "degrees")
        if not state.get["roots"] and not state.get["single"]:
            break
        roots = degrees.filter("n = 0").select("dataset", F.col("base").alias("level"))
        hung = None
        if state.get["single"]:
            shortened = _shortened(degrees.filter("n = 1").select("dataset", "root", "w", "base"))
            still = Observation()
            both = shortened.join(roots.withColumnRenamed("dataset", "root"), "root", "left")
            both = stored(both.observe(still, F.count_if(F.col("level").isNull()).alias("n")), "hanging")
            at_once = F.greatest(F.col("base"), F.col("level") + F.col("w")).alias("level")
            roots = roots.unionByName(both.filter("level IS NOT NULL").select("dataset", at_once))
            if still.get["n"]:
                hung = both.filter("level IS NULL").drop("level")
                hanging.append(hung)
        placed.append(roots)
        if not state.get["many"]:
            break
        # What an edge starts from: a placed dataset, one that hangs from another, or one that stays.
        starts = roots.select(F.col("dataset").alias("up"), F.lit(None).cast(edges.schema["up"].dataType).alias("root"), F.lit(0).alias("more"), F.col("level").alias("base"))
        if hung is not None:
            starts = starts.unionByName(hung.select(F.col("dataset").alias("up"), "root", F.col("w").alias("more"), "base"))
        starts = starts.withColumn("left", F.lit(True))
        staying = degrees.filter("n > 1").select(F.col("dataset").alias("down"), "base")
        moved = left.join(staying.select("down"), "down", "left_semi").join(starts, "up", "left")
        moved = moved.select(
            "down",
            F.when(F.col("left").isNull(), F.col("up")).otherwise(F.col("root")).alias("up"),
            (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"),
            (F.col("base") + F.col("w")).alias("known"),
        )
        moved = stored(moved.groupBy("down", "up").agg(F.max("w").alias("w"), F.max("known").alias("known")), "moved")
        known = moved.groupBy("down").agg(F.max("known").alias("known"))
        open_ = staying.join(known, "down", "left").select(
            F.col("down").alias("dataset"), F.greatest("base", F.coalesce("known", F.lit(0))).alias("base")
        )
        left = moved.filter("up IS NOT NULL").select("up", "down", "w")
    found = placed[0] if placed else nodes.limit(0).select("dataset", F.lit(0).alias("level"))
    for more in placed[1:]:
        found = found.unionByName(more)
    for hung in reversed(hanging):
        # What hangs from a placed dataset of any round, or from one put back before, is placed; the rest is blocked.
        found = stored(found, "placed")
        level = F.greatest(F.col("base"), F.col("level") + F.col("w"))
        found = found.unionByName(hung.join(found.withColumnRenamed("dataset", "root"), "root").select("dataset", level.alias("level")))
    return stored(found, "levels")


def _shortened(single: DataFrame) -> DataFrame:
    """``single(dataset, root, w, base)`` with ``root`` moved up to the first dataset that is not itself in ``single``.

    A dataset's level is the greater of ``base`` and the root's level plus
    ``w``, and two such steps make one. Every job doubles the steps twice. On a
    cycle the steps never end; it is left when nothing but cycles is left.
    """
    last = None
    current = stored(single, "single")
    while True:
        current = stored(_doubled(_doubled(current)), "single")
        going = current.join(current.select(F.col("dataset").alias("root")), "root", "left_semi").count()
        if going in (0, last):
            return current
        last = going


def _doubled(single: DataFrame) -> DataFrame:
    above = single.select(F.col("dataset").alias("root"), F.col("root").alias("__root"), F.col("w").alias("__w"), F.col("base").alias("__base"))
    joined = single.join(above, "root", "left")
    return joined.select(
        "dataset",
        F.coalesce("__root", "root").alias("root"),
        (F.col("w") + F.coalesce("__w", F.lit(0))).alias("w"),
        F.greatest("base", F.coalesce(F.col("__base") + F.col("w"), F.lit(0))).alias("base"),
    )


@_sized
def cycles(flows: DataFrame, flow_inputs: DataFrame) -> DataFrame:
    """``(flow, cycle_id)`` of the flows that can never start: the first name on their cycle, or null for those behind one.

    Datasets from which each other can be reached are found by colouring: the
    least number that leads to each dataset is its colour, and those of a colour
    that lead back to that number are one cycle with it. What is left goes on
    without the datasets that are no longer on or behind a cycle. Flows on
    one cycle are those that read and write datasets of one such group.
    """
    reads = _reads(flows, flow_inputs)
    names = flows.select(F.col("target").alias("dataset")).distinct()
    levels = dataset_levels(names, _dataset_edges(reads))
    blocked = blocked_flows(flows, stored(_staged(flows, reads, levels), "stages"))
    # In the order of hashes, so that a walk along a cycle meets smaller numbers soon.
    numbers = numbered(names, [F.xxhash64("dataset"), "dataset"], "id")
    up, down = (numbers.select(F.col("dataset").alias(n), F.col("id").alias(i)) for n, i in (("up", "a"), ("down", "b")))
    rest = _unplaced(_dataset_edges(reads), levels)
    groups: DataFrame | None = None
    while not rest.isEmpty():
        edges = stored(rest.join(up, "up").join(down, "down").select("a", "b"), "edges")
        colour = least_leading(edges)
        inside = edges.join(colour.select(F.col("node").alias("a"), F.col("least").alias("x")), "a")
        inside = inside.join(colour.select(F.col("node").alias("b"), F.col("least").alias("y")), "b").filter("x = y")
        back = least_leading(stored(inside.select(F.col("b").alias("a"), F.col("a").alias("b")), "edges"))
        same = colour.join(back.withColumnRenamed("least", "leads_to"), "node").filter("least = leads_to")
        found = stored(same.join(numbers.withColumnRenamed("id", "node"), "node").select("dataset", F.col("least").alias("group")), "groups")
        groups = found if groups is None else groups.unionByName(found)
        gone = found.select("dataset")
        rest = rest.join(gone.withColumnRenamed("dataset", "up"), "up", "left_anti").join(gone.withColumnRenamed("dataset", "down"), "down", "left_anti")
        rest = stored(rest, "edges")
        ends = rest.select(F.col("up").alias("dataset")).union(rest.select("down")).distinct()
        rest = _unplaced(rest, dataset_levels(ends, rest))
    if groups is None:
        return blocked.select("flow", F.lit(None).cast("string").alias("cycle_id"))
    read, written = groups.withColumnRenamed("group", "read"), groups.select(F.col("dataset").alias("target"), F.col("group").alias("written"))
    on_cycle = reads.join(read, "dataset").join(written, "target").filter("read = written").select("flow", F.col("read").alias("group")).distinct()
    on_cycle = stored(on_cycle, "on-cycle")
    named = stored(on_cycle.groupBy("group").agg(F.min("flow").alias("cycle_id")), "named")
    return blocked.select("flow").join(on_cycle.join(named, "group").select("flow", "cycle_id"), "flow", "left")


def _unplaced(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """The edges between datasets on or behind cycles. Stored."""
    placed = levels.select("dataset")
    from_blocked = edges.join(placed.withColumnRenamed("dataset", "up"), "up", "left_anti")
    return stored(from_blocked.join(placed.withColumnRenamed("dataset", "down"), "down", "left_anti"), "blocked-edges")


def least_leading(edges: DataFrame) -> DataFrame:
    """``(node, least)``: the least number from which each node of ``edges(a, b)`` can be reached, itself included. Stored.

    A round takes the least that the nodes before know, and what the least one
    known so far knows itself, so the stretch looked back on grows by a factor.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    current, seen = stored(nodes.withColumn("least", F.col("node")), "least"), None
    while True:
        before = edges.join(current.select(F.col("node").alias("a"), F.col("least").alias("l")), "a").select(F.col("b").alias("node"), "l")
        further = current.select(F.col("node").alias("least"), F.col("least").alias("l"))
        further = current.join(further, "least").select("node", "l")
        state = Observation()
        least = before.unionByName(further).groupBy("node").agg(F.min("l").alias("least"))
        current = stored(least.observe(state, F.sum(F.col("least").cast("decimal(38,0)")).alias("s")), "least")
        if state.get["s"] == seen:
            return current
        seen = state.get["s"]


@_sized
def hubs(flows: DataFrame, flow_inputs: DataFrame) -> DataFrame:
    """``(dataset, side, flow)``: the edges through datasets, each dataset with its writers and its readers.

    Every writer of a dataset is upstream of every reader, so these rows hold
    what ``edges`` lists, with the sum of both numbers in place of their product.
    """
    reads = _reads(flows, flow_inputs)
    read = _hashed_keys(reads)
    writers = flows.select(F.col("target").alias("dataset"), "flow").join(read, "dataset", "left_semi")
    return writers.select("dataset", F.lit("writer").alias("side"), "flow").unionByName(
        reads.select("dataset", F.lit("reader").alias("side"), "flow")
    )


def blocked_flows(flows: DataFrame, levels: DataFrame, *also: str) -> DataFrame:
    """``(flow)`` that can never start: on a cycle, behind one, or reading its own target; with what ``also`` names of it."""
    return flows.select("flow", *also).join(levels, "flow", "left_anti")


def plan_listing(name: str, flows: DataFrame, levels: DataFrame) -> DataFrame:
    """``(pipeline, stage, flow, target)`` in the order of execution, which is one global sort of the listing."""
    return (
        flows.join(levels, "flow")
        .orderBy("stage", "decl_no", "flow")
        .select(F.lit(name).alias("pipeline"), "stage", "flow", "target")
    )
