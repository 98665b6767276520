"""Exact top-k search by inner product with KD-trees.

Vectors are dealt to shards of a few thousand, and a shard's tree halves them
at the median of its widest dimension until a leaf holds a few dozen. Every
node keeps the tight box of its vectors; the largest inner product that a query
can have in a box bounds what is below it. A query visits boxes best first and
stops when the next bound is below its k-th score. To start with a high k-th
score, every shard first looks into one leaf per query; the best of these
scores bounds the search in all shards.

Components become floor(1024 * x). Rows with a null id and vectors that are
null, or hold null or non-finite components, take no part; vectors of different lengths do not meet.
Rows with equal ids are different candidates, and a query leaves out only its
own row. Scores have to fit into a long. Ties go to the smaller id. Queries
and candidates come in blocks, so no task holds all of either. An empty table
gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import pick, stored

SHARD = 4_096
LEAF = 64
QUERY_BLOCK = 256
#: Blocks of queries that one copy of a tree serves.
TREE_BLOCKS = 16
SCALE = 1_024
#: Below it, sums of products are exact in double precision.
EXACT = 1 << 53


class Tree:
    """Vectors in leaf order; nodes in preorder with their rows, children and boxes."""

    def __init__(self, ids, rows, vectors, first, last, left, right, low, high):
        self.ids, self.rows, self.vectors, self.first, self.last = ids, rows, vectors, first, last
        self.left, self.right, self.low, self.high = left, right, low, high

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.arange(len(ids))
        nodes: list[list] = []

        def grow(first: int, last: int) -> int:
            own = vectors[order[first:last]]
            low, high = own.min(axis=0), own.max(axis=0)
            me = len(nodes)
            nodes.append([first, last, -1, -1, low, high])
            widest = int(np.argmax(high - low)) if len(low) else 0
            if last - first > leaf and len(low) and high[widest] > low[widest]:
                middle = (last - first) // 2
                order[first:last] = order[first:last][np.argpartition(own[:, widest], middle, kind="introselect")]
                nodes[me][2] = grow(first, first + middle)
                nodes[me][3] = grow(first + middle, last)
            return me

        grow(0, len(ids))
        columns = [np.array(c) for c in zip(*nodes, strict=True)]
        return cls(ids[order], rows[order], vectors[order], *columns)

    _NAMES = ("ids", "rows", "vectors", "first", "last", "left", "right", "low", "high")

    def dump(self) -> bytes:
        return _pack({n: getattr(self, n) for n in self._NAMES})

    @classmethod
    def load(cls, data: bytes) -> Tree:
        return cls(**_unpack(data))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product of each query with a point of each node's box."""
        return _product(np.maximum(queries, 0), self.high) + _product(np.minimum(queries, 0), self.low)

    def first_leaf(self, bounds: np.ndarray) -> int:
        node = 0
        while self.left[node] >= 0:
            node = max(self.left[node], self.right[node], key=lambda n: bounds[n])
        return int(node)

    def leaf(self, node: int, query: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of a leaf's vectors without the row ``own``."""
        part = slice(self.first[node], self.last[node])
        scores = _product(query[None, :], self.vectors[part])[0]
        other = self.rows[part] != own
        return scores[other], self.ids[part][other]

    def search(self, query: np.ndarray, bounds: np.ndarray, own: int, k: int, known: int | None) -> list[tuple[int, int]]:
        """The k best ``(score, id)`` of this shard, without those below ``known``."""
        best_scores, best_ids = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        kth = known
        open_nodes = [(-bounds[0], 0)]
        while open_nodes:
            bound, node = heapq.heappop(open_nodes)
            if kth is not None and -bound < kth:
                break
            if self.left[node] >= 0:
                for child in (int(self.left[node]), int(self.right[node])):
                    if kth is None or bounds[child] >= kth:
                        heapq.heappush(open_nodes, (-bounds[child], child))
                continue
            scores, ids = self.leaf(node, query, own)
            if kth is not None:
                good = scores >= kth
                scores, ids = scores[good], ids[good]
            if not len(scores):
                continue
            best_scores, best_ids = np.concatenate([best_scores, scores]), np.concatenate([best_ids, ids])
            order = np.lexsort((best_ids, -best_scores))[:k]
            best_scores, best_ids = best_scores[order], best_ids[order]
            if len(best_scores) == k:
                kth = int(best_scores[-1]) if kth is None else max(kth, int(best_scores[-1]))
        return list(zip(best_scores.tolist(), best_ids.tolist(), strict=True))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact ``a @ b.T`` of integers: through doubles where no sum can pass 2 to the 53rd, else in longs."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[-1])
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _pack(arrays: dict[str, np.ndarray]) -> bytes:
    sink = io.BytesIO()
    np.savez(sink, **arrays)
    return sink.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as arrays:
        return {n: arrays[n] for n in arrays.files}


def usable(table: DataFrame) -> DataFrame:
    """``(vec_id, row, vector)`` of the vectors that take part, the components as whole numbers."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(
        "embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    )
    numbered = pick(table, "vec_id", "embedding").select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("embedding")).filter(sound)
    vector = F.transform("embedding", lambda v: F.floor(v * SCALE).cast("bigint"))
    return stored(numbered.select("vec_id", F.monotonically_increasing_id().alias("row"), vector.alias("vector")), "vectors")


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
    """Ids, rows, vectors and further columns, up to ``size`` of one length together."""
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            same = held.setdefault(len(row[2]), [])
            same.append(row)
            if len(same) == size:
                yield _arrays(held.pop(len(row[2])))
    for same in held.values():
        yield _arrays(same)


def _arrays(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    ids, numbers, vectors, *more = zip(*rows, strict=True)
    return np.array(ids, dtype=np.int64), np.array(numbers, dtype=np.int64), np.array(vectors, dtype=np.int64).reshape(len(ids), -1), more


def trees(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """``(shard, dims, tree)``: the trees of all shards, stored."""

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows, own, _ in _blocks(batches, shard):
            yield pa.RecordBatch.from_pylist([{"dims": own.shape[1], "tree": Tree.build(ids, rows, own).dump()}])

    shards = max(1, -(-vectors.count() // shard))
    made = vectors.repartition(shards).mapInArrow(grown, "dims bigint, tree binary")
    return stored(made.select(F.monotonically_increasing_id().alias("shard"), "dims", "tree"), "trees")


def query_blocks(queries: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """``(dims, queries)``: queries ``(vec_id, row, vector, known)`` packed in blocks."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows, own, (known,) in _blocks(batches, block):
            there = np.array([k is not None for k in known])
            least = np.array([k if k is not None else 0 for k in known], dtype=np.int64)
            data = _pack({"ids": ids, "rows": rows, "vectors": own, "there": there, "least": least})
            yield pa.RecordBatch.from_pylist([{"dims": own.shape[1], "queries": data}])

    blocks = max(1, -(-queries.count() // block))
    return stored(queries.repartition(blocks).mapInArrow(packed, "dims bigint, queries binary"), "queries")


def _meet(trees_of: DataFrame, blocks: DataFrame, visit, schema: str) -> DataFrame:
    """Every block of queries with every tree of its length.

    Blocks travel to the trees. A tree is sent once per group of up to
    ``TREE_BLOCKS`` blocks and stands first in its group, so a task holds one
    tree and one block at a time.
    """
    groups = max(1, -(-blocks.count() // TREE_BLOCKS))
    numbered = blocks.withColumn("group", F.pmod(F.xxhash64("queries"), F.lit(groups)))
    shards = trees_of.select("shard", F.col("dims").alias("__dims"))
    listed = numbered.join(shards, F.col("dims") == F.col("__dims")).select(
        "shard", "group", F.lit(1).alias("kind"), F.col("queries").alias("data")
    )
    each = F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))
    copies = trees_of.select("shard", F.explode(each).alias("group"), F.lit(0).alias("kind"), F.col("tree").alias("data"))
    together = copies.unionByName(listed).repartition("shard", "group").sortWithinPartitions("shard", "group", "kind")

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py()
                if batch.column(0)[i].as_py() == 0:
                    tree = Tree.load(data)
                    continue
                found = visit(tree, _unpack(data))
                if found:
                    yield pa.RecordBatch.from_pylist(found)

    return together.select("kind", "data").mapInArrow(visited, schema)


def _probe(k: int):
    def probe(tree: Tree, queries: dict[str, np.ndarray]) -> list[dict]:
        bounds, found = tree.bounds(queries["vectors"]), []
        for i, own in enumerate(queries["rows"].tolist()):
            scores, _ = tree.leaf(tree.first_leaf(bounds[i]), queries["vectors"][i], own)
            if len(scores) >= k:
                found.append({"row": own, "known": int(np.partition(scores, len(scores) - k)[len(scores) - k])})
        return found

    return probe


def _search(k: int):
    def search(tree: Tree, queries: dict[str, np.ndarray]) -> list[dict]:
        bounds, found = tree.bounds(queries["vectors"]), []
        for i, own in enumerate(queries["rows"].tolist()):
            known = int(queries["least"][i]) if queries["there"][i] else None
            best = tree.search(queries["vectors"][i], bounds[i], own, k, known)
            query = int(queries["ids"][i])
            found += [{"query_id": query, "row": own, "vec_id": v, "score": s} for s, v in best]
        return found

    return search


def top_k(table: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id ``every`` divides, its ``k`` best other rows."""
    vectors = usable(table)
    forest = trees(vectors)
    queries = vectors.filter(F.pmod("vec_id", F.lit(every)) == 0)
    unbound = query_blocks(queries.withColumn("known", F.lit(None).cast("bigint")))
    # The best k-th score of any one leaf is at most the true k-th score, so it may stop the search everywhere.
    known = _meet(forest, unbound, _probe(k), "row bigint, known bigint").groupBy("row").agg(F.max("known").alias("known"))
    bound = query_blocks(queries.join(known, "row", "left").select("vec_id", "row", "vector", "known"))
    found = _meet(forest, bound, _search(k), "query_id bigint, row bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
