"""Near-duplicate vectors by an epsilon grid order join.

Vectors of length one whose cosine is c are ``sqrt(2 - 2 c)`` apart, so links
are pairs within a distance epsilon. Vectors are projected on leading principal
axes, which brings none of them further apart, and a grid of width epsilon is
laid over the projections. All vectors are sorted by their cells and cut into
blocks of the sequence. Intervals of blocks, each with the box of its
projections, are joined from the top: a pair of intervals whose boxes are more
than epsilon apart holds no link and is dropped with everything below it,
another one is divided, down to pairs of blocks. A strip of blocks then
meets each partner block of its own once. Cosines are computed in double
precision; a quick single-precision product only shows which rows have none.

Rows with the same vector are folded into one before and counted as so many.
Of a pair of blocks no list of links leaves the task: only how many links each
vector has, and for each linked vector one edge to the first of its component
within the pair, which is what components need.

Null vectors, vectors of length zero, with null or non-finite components, of a
length that double precision can't hold, and vectors without an id link with
nothing: they have no links and are a component of their own. Vectors with
different numbers of components do not meet. Repeated rows and rows with equal
ids are vectors of their own; a component is named by the smallest id in it,
and all its rows with this id are kept. An empty table gives an empty result.
Other columns are left out.

The axes are learned from ``SAMPLE`` vectors (those with the smallest hashes);
they decide what can be skipped, not what is found. Where vectors are spread
evenly over many dimensions no block is far from another one, and every pair of
blocks is computed: then the products grow with the square of the input, while
what is moved grows with the number of strips times the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import components, forest, in_order, offsets, pick, stored

SIMILAR = 0.9
#: Vectors that the principal axes are learned from.
SAMPLE = 2_000
AXES = 8
BLOCK = 2_048
#: Intervals are divided by so many at a time.
FAN = 8
#: Blocks that meet their partners together, and partners that a task takes for them.
STRIP, PARTNERS = 4, 8
#: Rows of a block that are compared at a time.
TILE = 512
#: Wider than the rounding errors of single and double precision.
ROUGH, FINE = 1e-4, 1e-12


def vectors(table: DataFrame) -> DataFrame:
    """``(row, vec_id, embedding, sound)``; stored."""
    rows = pick(table, "vec_id", "embedding").withColumn("row", F.monotonically_increasing_id())
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    square = F.reduce(
        "embedding", F.lit(0.0), lambda s, v: s + F.coalesce(v.cast("double"), F.lit(0.0)) * F.coalesce(v.cast("double"), F.lit(0.0))
    )
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & (square > 1e-300) & (square < 1e300)
    return stored(rows.select("row", F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", F.coalesce(sound, F.lit(False)).alias("sound")), "vectors")


def axes(distinct: DataFrame, sample: int = SAMPLE, most: int = AXES) -> dict[int, np.ndarray]:
    """Leading principal axes as columns, for each vector length in the sample."""
    chosen = distinct.orderBy(F.xxhash64("embedding"), "node").limit(sample).select("embedding").toArrow()["embedding"].to_pylist()
    by_length: dict[int, list] = {}
    for v in chosen:
        by_length.setdefault(len(v), []).append(v)
    found = {}
    for length, own in by_length.items():
        units = _units(np.array(own, dtype=np.float64).reshape(len(own), length))
        spread = np.cov(units, rowvar=False, bias=True).reshape(length, length)
        found[length] = np.linalg.eigh(spread)[1][:, ::-1][:, :most]
    return found


def _units(values: np.ndarray) -> np.ndarray:
    return values / np.sqrt(np.einsum("ij,ij->i", values, values))[:, None]


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)


def placed(distinct: DataFrame, known: dict[int, np.ndarray], epsilon: float, most: int = AXES) -> DataFrame:
    """``distinct`` with ``size``, the projections ``p`` (always ``most`` of them) and their ``cells``."""

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for length in np.unique(lengths).tolist():
                some = batch.filter(pa.array(lengths == length))
                units = _units(_matrix(some.column("embedding"), length).astype(np.float64))
                own = known.get(length, np.eye(length)[:, :most])
                p = np.zeros((len(units), most))
                p[:, : own.shape[1]] = units @ own
                cells = np.floor(p / epsilon).astype(np.int32)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), most).cast(pa.list_(t)) for x, t in ((p, pa.float64()), (cells, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([length] * len(some), pa.int32()), *lists], names=[*names, "size", "p", "cells"])

    names = distinct.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.schema)
    return distinct.mapInArrow(projected, f"{kinds}, size int, p array<double>, cells array<int>")


def blocks(ordered: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(b, size, low, high, nodes, weights, wide, data)``: the sequence in blocks, numbered from 0. Stored."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(some: pa.Table) -> Iterator[pa.RecordBatch]:
            for first in range(0, some.num_rows, block):
                own = some.slice(first, block).combine_chunks()
                size = own["size"][0].as_py()
                p = _matrix(own["p"].combine_chunks(), AXES)
                values = _matrix(own["embedding"].combine_chunks(), size)
                row = {
                    "part": own["part"][0].as_py(), "size": size, "low": p.min(axis=0).tolist(), "high": p.max(axis=0).tolist(),
                    "nodes": own["node"].to_numpy().astype("<i8").tobytes(), "weights": own["weight"].to_numpy().astype("<i8").tobytes(),
                    "wide": values.dtype.itemsize == 8, "data": np.ascontiguousarray(values).tobytes(), "n": 1,
                }
                yield pa.RecordBatch.from_pylist([row], schema=_BLOCK)

        def whole() -> Iterator[pa.RecordBatch]:
            yield from flush(pa.Table.from_batches(held))
            held.clear()

        size, rows = None, 0
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
            for first, last in zip(cuts, cuts[1:], strict=False):
                while first < last:
                    if held and (sizes[first] != size or rows == block):
                        yield from whole()
                        rows = 0
                    size = sizes[first]
                    some = batch.slice(first, min(last - first, block - rows))
                    held.append(some)
                    rows += len(some)
                    first += len(some)
        if held:
            yield from whole()

    made = stored(ordered.select("part", "size", "p", "embedding", "node", "weight").mapInArrow(packed, BLOCKS), "blocks")
    local = made.select("part", F.monotonically_increasing_id().alias("id"), *[c for c in made.columns if c not in ("part", "n")])
    # A file may be read in another order than it was written in: numbers only have to follow the parts.
    numbered = stored(local, "numbered")
    firsts = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    bases = offsets(firsts, [], "part", "n", "base")
    within = F.row_number().over(Window.partitionBy("part").orderBy(*[F.col("low")[k] for k in range(AXES)], "id")) - 1
    places = numbered.select("part", "id", "low").withColumn("place", within).join(bases, "part")
    return stored(numbered.join(places.select("id", (F.col("base") + F.col("place")).alias("b")), "id").drop("part", "id"), "sequence")


BLOCKS = "part int, size int, low array<double>, high array<double>, nodes binary, weights binary, wide boolean, data binary, n int"
_BLOCK = pa.schema(
    [("part", pa.int32()), ("size", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("nodes", pa.binary()),
     ("weights", pa.binary()), ("wide", pa.bool_()), ("data", pa.binary()), ("n", pa.int32())]
)


def near_blocks(sequence: DataFrame, epsilon: float, fan: int = FAN) -> DataFrame:
    """``(a, b)`` with ``a <= b``: the blocks whose boxes, and those of all intervals above, are within ``epsilon``."""
    # The number of components is a further side of the box, on which only equal places are near.
    sides = [F.col("size").cast("double"), *[F.col("low")[k] for k in range(AXES)]], [F.col("size").cast("double"), *[F.col("high")[k] for k in range(AXES)]]
    lows, highs = [[s.alias(f"{n}{k}") for k, s in enumerate(own)] for n, own in zip("lh", sides, strict=True)]
    levels = [stored(sequence.select("b", *lows, *highs), "boxes")]
    count = levels[0].count()
    while count > 1:
        ends = [F.min(f"l{k}").alias(f"l{k}") for k in range(AXES + 1)] + [F.max(f"h{k}").alias(f"h{k}") for k in range(AXES + 1)]
        levels.append(stored(levels[-1].groupBy(F.expr(f"b DIV {fan}").alias("b")).agg(*ends), "boxes"))
        count = -(-count // fan)
    top = levels.pop()
    pairs = top.select(F.col("b").alias("a"), "b")
    reach = epsilon * epsilon + FINE
    while levels:
        below = levels.pop()
        left, right = (below.select(*[F.col(c).alias(f"{c}_{n}") for c in below.columns]) for n in "xy")
        gaps = [F.greatest(F.lit(0.0), F.col(f"l{k}_x") - F.col(f"h{k}_y"), F.col(f"l{k}_y") - F.col(f"h{k}_x")) for k in range(AXES + 1)]
        apart = sum((g * g for g in gaps[1:]), F.lit(0.0))
        near = (F.col("b_x") <= F.col("b_y")) & (gaps[0] == 0) & (apart <= reach)
        divided = pairs.join(left, F.expr(f"b_x DIV {fan}") == F.col("a")).join(right, F.expr(f"b_y DIV {fan}") == F.col("b"))
        pairs = stored(divided.filter(near).select(F.col("b_x").alias("a"), F.col("b_y").alias("b")), "near-blocks")
    return pairs


class Block:
    def __init__(self, row: dict):
        self.b, self.size = row["b"], row["size"]
        self.nodes, self.weights = (np.frombuffer(row[n], dtype="<i8") for n in ("nodes", "weights"))
        values = np.frombuffer(row["data"], dtype="<f8" if row["wide"] else "<f4").reshape(len(self.nodes), self.size)
        self.values = values.astype(np.float64)
        self.length = np.sqrt(np.einsum("ij,ij->i", self.values, self.values))
        self.units = self.values / self.length[:, None]
        self.rough = self.units.astype(np.float32)


def linked(a: Block, b: Block, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """The places in ``a`` and ``b`` of all links between them; within one block each pair once."""
    left, right = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for first in range(0, len(a.nodes), TILE):
        hit = a.rough[first : first + TILE] @ b.rough.T >= similar - ROUGH
        rows = np.flatnonzero(hit.any(axis=1))
        if not len(rows):
            continue
        columns = np.flatnonzero(hit[rows].any(axis=0))
        cosines = a.units[first + rows] @ b.units[columns].T
        found = cosines >= similar
        for i, j in zip(*np.nonzero(np.abs(cosines - similar) < FINE), strict=True):
            x, y = first + rows[i], columns[j]
            found[i, j] = a.values[x] @ b.values[y] / (a.length[x] * b.length[y]) >= similar
        i, j = np.nonzero(found)
        i, j = first + rows[i], columns[j]
        if a is b:
            i, j = i[i < j], j[i < j]
        left.append(i)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def compare(a: Block, b: Block, similar: float) -> pa.RecordBatch | None:
    """``(node, n, first)``: how many vectors of the other block each linked one has, and one of its component here."""
    i, j = linked(a, b, similar)
    if not len(i):
        return None
    shift = 0 if a is b else len(a.nodes)
    nodes, weights = (a.nodes, a.weights) if a is b else (np.concatenate([a.nodes, b.nodes]), np.concatenate([a.weights, b.weights]))
    j = j + shift
    n = np.zeros(len(nodes), dtype=np.int64)
    np.add.at(n, i, weights[j])
    np.add.at(n, j, weights[i])
    label = forest(len(nodes), i, j)
    at = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(n[at]), pa.array(nodes[label[at]])], names=["node", "n", "first"])


def matches(sequence: DataFrame, pairs: DataFrame, similar: float, strip: int = STRIP, partners: int = PARTNERS) -> DataFrame:
    """``(node, n, first)`` of all pairs of blocks; stored."""
    own = F.expr(f"a DIV {strip}").alias("strip")
    # A strip's partners, at most ``strip`` of its blocks for each, and the slot in which it meets them.
    wanted = pairs.groupBy(own, "b").agg(F.collect_set("a").alias("of")).withColumn("slot", F.expr(f"b DIV {partners}"))
    wanted = stored(wanted, "partners")
    held = wanted.select("strip", "slot", F.explode("of").alias("b")).distinct().withColumn("of", F.lit(None).cast("array<bigint>"))
    asked = held.select("strip", "slot", "b", "of").unionByName(wanted.select("strip", "slot", "b", "of"))
    rows = sequence.drop("low", "high").join(stored(asked, "asked"), "b")
    dealt = rows.repartition("strip", "slot").sortWithinPartitions("strip", "slot", F.col("of").isNotNull(), "b")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, here = None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                if key != (row["strip"], row["slot"]):
                    key, here = (row["strip"], row["slot"]), {}
                if row["of"] is None:
                    here[row["b"]] = Block(row)
                    continue
                other = here.get(row["b"]) or Block(row)
                for a in sorted(row["of"]):
                    if (found := compare(here[a], other, similar)) is not None:
                        yield found

    return stored(dealt.mapInArrow(met, "node bigint, n bigint, first bigint"), "matches")


def near_duplicates(table: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``table(vec_id, embedding)``."""
    epsilon = math.sqrt(2 - 2 * similar)
    rows = vectors(table)
    sound = rows.filter("sound")
    distinct = stored(sound.groupBy("embedding").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least")), "distinct")
    order = ["size", *[F.col("cells")[k] for k in range(AXES)], "node"]
    sequence = blocks(in_order(placed(distinct.drop("least"), axes(distinct), epsilon), *order))
    found = matches(sequence, near_blocks(sequence, epsilon), similar)
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("node").alias("a"), F.col("first").alias("b")))
    nodes = stored(distinct.join(roots, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node")), "nodes")
    named = stored(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    classes = stored(nodes.join(named, "root").select("embedding", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"), "classes")
    inside = sound.join(classes, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter("NOT sound").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return inside.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
