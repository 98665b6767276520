"""The trie of conversation prefixes: which conversations begin with the same turns, and what sharing them saves.

A prefix is known by a digest of its turns: hashes of (place, role, text) added
up, twice with different seeds, 128 bits in all. Sums can be made in any order,
so a conversation of any length is summed up in pieces: each range of the sorted
turns adds up its own, and the conversation that a range begins with gets the
sum of its turns in earlier ranges.

Count-min screening: all digests are counted in two rows of saturating
counters. A counter is never less than the true count, so a prefix with an
estimate of one belongs to one conversation alone, as does everything below it.
The nodes below such a prefix are therefore known from their own conversation
(one member, one leaf, nothing saved) and are emitted where they stand. Only
prefixes that may be shared, and the first unshared one of a conversation, are
shuffled and grouped exactly; an estimate that is too high costs a shuffle of
that row and changes no result. The sketch has ``CELLS`` counters per prefix up
to ``MOST_CELLS`` in all, which bounds what is sent to each task; beyond it more
prefixes are shuffled.

Sums over subtrees need no walk over levels. Of a conversation's nodes those in
which it is not the smallest member come first, since members only leave on the
way down. Its share of the saved tokens below a node is thus the length of its
turns from there to the last such node, and a leaf counts for the smallest
member that ends in it. Both are one number per conversation, which is joined
to its shared prefixes and added up per node.

Turns are in the order of ``turn``, null first; equal turns are ordered by role
and text. Null role or text becomes empty. Rows without a ``conv_id`` belong to no
conversation and are left out. Repeated rows are turns of their own. An empty
table gives an empty result, without a root. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import in_order, offsets, pick, stored

#: Counters per prefix and row of the sketch, and bytes of both rows together at most.
CELLS, MOST_CELLS = 4, 1 << 25
#: Counters that are merged at a time.
STRETCH = 1 << 16
#: Characters of joined ids that travel as one row to the task that hashes a node's list.
CHUNK = 1 << 16
SEEDS = (11, 29)


def turns(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, g, role, text)``, numbered in order, and ``(conv_id, first, n)`` per conversation. Both stored."""
    rows = pick(table, "conv_id", "turn", "role", "text").filter("conv_id IS NOT NULL")
    rows = rows.withColumns({"conv_id": F.col("conv_id").cast("bigint"), "role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    ordered = in_order(rows, "conv_id", F.asc_nulls_first("turn"), "role", "text").withColumn("id", F.monotonically_increasing_id())
    # The lower 33 bits of the id are the row's place in its partition.
    placed = ordered.withColumn("place", F.col("id").bitwiseAND((1 << 33) - 1)).drop("id", "turn")
    placed = stored(placed, "turns")
    bases = offsets(placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")), [], "part", "n", "base")
    numbered = placed.join(bases, "part").withColumn("g", F.col("base") + F.col("place")).select("conv_id", "g", "role", "text")
    counted = numbered.groupBy("conv_id").agg(F.min("g").alias("first"), F.count(F.lit(1)).alias("n"))
    return numbered, stored(counted, "conversations")


def plain(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: ``(conv_id, pos, role, text)`` and ``(conv_id, n)``."""
    numbered, counted = turns(table)
    rows = numbered.join(counted, "conv_id").select("conv_id", (F.col("g") - F.col("first")).alias("pos"), "role", "text", "n")
    return rows, counted.select("conv_id", "n")


def with_heads(table: DataFrame, group: int, most: int, taken: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``taken`` turns (below ``most``) are those of the first one of their ``group`` ids.

    ``taken`` is an expression over ``conv_id``. The head has all turns of the
    first conversation if there are fewer, and none if there is no such conversation.
    """
    numbered, counted = turns(table)
    base = (F.col("conv_id") - F.col("conv_id") % group).alias("base")
    own = counted.select("conv_id", "first", "n", base, taken.cast("bigint").alias("taken"))
    of = counted.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    head = F.least("taken", F.coalesce("base_n", F.lit(0)))
    rest = F.greatest(F.col("n") - F.col("taken"), F.lit(0))
    rebuilt = own.join(of, "base", "left").select("conv_id", "first", "base", "taken", head.alias("head"), (head + rest).alias("n"))
    rebuilt = stored(rebuilt, "rebuilt")
    placed = numbered.join(rebuilt, "conv_id").withColumn("at", F.col("g") - F.col("first"))
    tails = placed.filter("at >= taken").select("conv_id", (F.col("at") - F.col("taken") + F.col("head")).alias("pos"), "role", "text", "n")
    # Whose turns are a head, and which, is known before any text is moved.
    givers = placed.filter((F.col("conv_id") == F.col("base")) & (F.col("at") < most)).select("base", F.col("at").alias("pos"), "role", "text")
    heads = rebuilt.select("conv_id", "base", "head", "n").join(stored(givers, "heads"), "base").filter("pos < head")
    rows = tails.unionByName(heads.select("conv_id", "pos", "role", "text", "n"))
    return rows, rebuilt.select("conv_id", "n")


_PREFIX = "conv_id bigint, d bigint, n bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, chars bigint, upto bigint, part int, edge boolean"


def prefixes(rows: DataFrame) -> DataFrame:
    """A row per conversation and depth ``d``: the digests of the prefix and its parent, and its length ``upto`` in characters.

    The sums are still those of the turns in the row's own ``part``; ``edge``
    marks the last rows of a part's first and last conversation.
    """
    narrow = rows.select(
        "conv_id", "pos", "n", F.length("text").cast("bigint").alias("chars"), *[F.xxhash64(F.lit(s), "pos", "role", "text").alias(f"h{s}") for s in SEEDS]
    )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, carry, first_of_all = None, None, True
        for batch in batches:
            conv, pos, n, chars, *hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(6))
            if not len(conv):
                continue
            starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            index = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(conv))))
            goes_on = carry is not None and carry[0] == conv[0]
            sums = []
            for k, values in enumerate((*(h.view(np.uint64) for h in hashes), chars.astype(np.uint64))):
                whole = np.cumsum(values, dtype=np.uint64)
                before = (whole[starts] - values[starts])[index]
                own = whole - before
                if goes_on:
                    own[: starts[1] if len(starts) > 1 else len(own)] += carry[1][k]
                sums.append((own, own - values))
            carry = (conv[-1], [s[0][-1] for s in sums])
            edge = np.zeros(len(conv), dtype=bool)
            if held is not None:
                # The last row of the batch before ends a conversation; it is at the edge if that is the first one.
                held[1][-1] = first_of_all and not goes_on
                first_of_all = first_of_all and goes_on
                yield _batch(*held, part)
            if first_of_all and len(starts) > 1:
                edge[starts[1] - 1] = True
                first_of_all = False
            held = ([conv, pos + 1, n, sums[0][0], sums[1][0], sums[0][1], sums[1][1], chars, sums[2][0]], edge)
        if held is not None:
            held[1][-1] = True
            yield _batch(*held, part)

    ordered = in_order(narrow, "conv_id", "pos").drop("part").select("conv_id", "pos", "n", "chars", *[f"h{s}" for s in SEEDS])
    return stored(ordered.mapInArrow(summed, _PREFIX), "prefixes")


def _batch(columns: list[np.ndarray], edge: np.ndarray, part: int) -> pa.RecordBatch:
    arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns]
    arrays += [pa.array(np.full(len(edge), part, dtype=np.int32)), pa.array(edge)]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _PREFIX.split(", ")])


def carries(local: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """For each part whose first conversation begins in an earlier one: that conversation and its sums so far.

    At most two rows per partition reach the driver.
    """
    edges = local.filter("edge").select("part", "d", "conv_id", "k1", "k2", "upto").collect()
    found: dict[int, tuple[int, np.ndarray]] = {}
    going: tuple[int, np.ndarray] | None = None
    last_part = None
    for part, _, conv, *sums in sorted(edges, key=lambda r: (r["part"], r["conv_id"], r["d"])):
        own = np.array(sums, dtype=np.int64).view(np.uint64)
        if part != last_part and going is not None and going[0] == conv:
            found[part] = going
            own = own + going[1]
        going, last_part = (conv, own), part
    return found


def _whole(batch: pa.RecordBatch, carried: dict[int, tuple[int, np.ndarray]]) -> dict[str, np.ndarray]:
    """The columns of ``prefixes`` with the sums of whole conversations."""
    columns = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
    parts = columns["part"]
    for part in set(np.unique(parts).tolist()) & carried.keys():
        conv, sums = carried[part]
        at = (parts == part) & (columns["conv_id"] == conv)
        for name, k in (("k1", 0), ("p1", 0), ("k2", 1), ("p2", 1), ("upto", 2)):
            columns[name] = np.where(at, (columns[name].view(np.uint64) + sums[k]).view(np.int64), columns[name])
    return columns


class Sketch:
    """Two rows of counters that stop at two."""

    def __init__(self, cells: int):
        self.cells = cells

    def places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return k1.view(np.uint64) % np.uint64(self.cells), k2.view(np.uint64) % np.uint64(self.cells) + np.uint64(self.cells)

    def counted(self, spark: SparkSession, local: DataFrame, carried) -> np.ndarray:
        """The counters of all prefixes: every task counts its own, stretches of counters are merged by tasks."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 * self.cells, dtype=np.uint8)
            for batch in batches:
                columns = _whole(batch, carried)
                for at in self.places(columns["k1"], columns["k2"]):
                    where, n = np.unique(at, return_counts=True)
                    total[where] = np.minimum(2, total[where] + np.minimum(2, n))
            for first in range(0, len(total), STRETCH):
                own = total[first : first + STRETCH]
                if own.any():
                    yield pa.RecordBatch.from_pydict({"at": [first // STRETCH], "counters": [own.tobytes()]})

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, total = None, None
            for batch in batches:
                for i in range(batch.num_rows):
                    here, own = batch.column(0)[i].as_py(), np.frombuffer(batch.column(1)[i].as_py(), dtype=np.uint8)
                    if here != at:
                        if total is not None:
                            yield pa.RecordBatch.from_pydict({"at": [at], "counters": [total.tobytes()]})
                        at, total = here, own
                    else:
                        total = np.minimum(2, total + own)
            if total is not None:
                yield pa.RecordBatch.from_pydict({"at": [at], "counters": [total.tobytes()]})

        kind = "at bigint, counters binary"
        parts = local.select("k1", "k2", "p1", "p2", "upto", "conv_id", "part").mapInArrow(count, kind)
        merged = parts.repartition("at").sortWithinPartitions("at").mapInArrow(merge, kind)
        whole = np.zeros(2 * self.cells, dtype=np.uint8)
        for at, own in merged.collect():
            whole[at * STRETCH : at * STRETCH + len(own)] = np.frombuffer(own, dtype=np.uint8)
        return whole


_SCREENED = "conv_id bigint, d bigint, n bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, chars bigint, upto bigint, own boolean"


def screened(local: DataFrame, cells: int = CELLS, most: int = MOST_CELLS) -> DataFrame:
    """``local`` with whole sums, and ``own`` for prefixes below one that a single conversation has. Stored."""
    spark = local.sparkSession
    carried = carries(local)
    sketch = Sketch(max(1, min(cells * local.count(), most // 2)))
    counters = spark.sparkContext.broadcast(sketch.counted(spark, local, carried))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _SCREENED.split(", ")]
        for batch in batches:
            columns = _whole(batch, carried)
            first, second = sketch.places(columns["p1"], columns["p2"])
            alone = np.minimum(counters.value[first], counters.value[second]) < 2
            columns["own"] = alone & (columns["d"] > 1)
            yield pa.RecordBatch.from_arrays([pa.array(columns[n]) for n in names], names=names)

    return stored(local.drop("edge").mapInArrow(screen, _SCREENED), "screened")


def end_lists(ends: DataFrame) -> DataFrame:
    """``(k1, k2, ends_sha256)``: for each node the hash of the ids in ``ends(k1, k2, conv_id)``, ascending, joined by commas.

    Ranges of the sorted ids are joined into chunks first, so a list of any
    length reaches the task that hashes it in few rows, one after the other.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, None, [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]]), pa.array([key[1]]), pa.array([first]), pa.array([",".join(held)])], names=["k1", "k2", "first", "chunk"]
            )

        out = []
        for batch in batches:
            for k1, k2, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key is not None and (key != (k1, k2) or size > CHUNK):
                    out.append(flush())
                    held, size = [], 0
                if not held:
                    key, first = (k1, k2), conv
                held.append(str(conv))
                size += len(held[-1]) + 1
            if out:
                yield from out
                out = []
        if held:
            yield flush()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            found = {"k1": [], "k2": [], "ends_sha256": []}
            for k1, k2, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key == (k1, k2):
                    state.update(b"," + chunk.encode())
                    continue
                if key is not None:
                    for name, value in zip(found, (*key, state.hexdigest()), strict=True):
                        found[name].append(value)
                key, state = (k1, k2), hashlib.sha256(chunk.encode())
            if found["k1"]:
                yield pa.RecordBatch.from_pydict(found)
        if key is not None:
            yield pa.RecordBatch.from_pydict({"k1": [key[0]], "k2": [key[1]], "ends_sha256": [state.hexdigest()]})

    joined = in_order(ends, "k1", "k2", "conv_id").drop("part").mapInArrow(chunks, "k1 bigint, k2 bigint, first bigint, chunk string")
    dealt = stored(joined, "chunks").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").drop("first")
    return dealt.mapInArrow(hashed, "k1 bigint, k2 bigint, ends_sha256 string")


def trie(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of the conversations ``rows(conv_id, pos, role, text, n)``; ``conversations(conv_id, n)`` lists all of them.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``
    """
    every = screened(prefixes(rows))
    is_end = F.col("d") == F.col("n")
    no_ends = F.sha2(F.lit(""), 256)
    tail = every.filter("own").select(
        "conv_id",
        F.col("d").alias("depth"),
        F.col("conv_id").alias("parent_conv_id"),
        F.lit(1).cast("bigint").alias("n_convs"),
        F.when(is_end, 0).otherwise(1).cast("bigint").alias("n_children"),
        F.lit(1).cast("bigint").alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_tokens"),
        F.when(is_end, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(no_ends).alias("ends_sha256"),
    )
    shared = every.filter("NOT own").drop("own")
    key = ["k1", "k2"]
    found = shared.groupBy(*key).agg(
        F.min("conv_id").alias("least"),
        F.count(F.lit(1)).alias("n_convs"),
        F.count(F.when(is_end, 1)).alias("n_ends"),
        *[F.first(c).alias(c) for c in ("d", "p1", "p2", "chars")],
    )
    nodes = stored(found, "nodes")
    members = stored(shared.join(nodes.select(*key, "least", "n_convs", "n_ends"), key), "members")
    not_least = F.col("conv_id") != F.col("least")
    leaf = (F.col("n_convs") == F.col("n_ends")) & ~not_least
    # Up to where a conversation is not the smallest member, and whether it stands for a leaf; ends in tails all do.
    own = members.groupBy("conv_id").agg(
        F.max(F.when(not_least, F.col("upto")).otherwise(0)).alias("saved_upto"),
        F.min(F.when(is_end & ~leaf, 0).otherwise(1)).alias("leaf"),
    )
    own = stored(own, "shares")
    saved = F.greatest(F.col("saved_upto") - F.col("upto") + F.col("chars"), F.lit(0))
    below = members.join(own, "conv_id").groupBy(*key).agg(F.sum("leaf").cast("bigint").alias("n_leaves"), F.sum(saved).cast("bigint").alias("saved_tokens"))
    children = nodes.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("__children"))
    children = children.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.col("__children").alias("shared_children"))
    hashes = end_lists(shared.filter(is_end).select(*key, "conv_id"))
    parents = stored(nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("least").alias("parent")), "parents")
    # Whether children were shuffled depends on their parent alone; if not, it is one conversation's, with one child or none.
    alone = (F.col("n_convs") > F.col("n_ends")).cast("bigint")
    inner = (
        nodes.join(stored(below, "below"), key)
        .join(stored(children, "children"), key, "left")
        .join(stored(hashes, "ends"), key, "left")
        .join(parents, ["p1", "p2"], "left")
    )
    whole = conversations.agg(F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n_convs"), F.count(F.when(F.col("n") == 0, 1)).alias("empty"))
    shares = own.agg(F.sum("leaf").alias("leaves"), F.sum("saved_upto").alias("saved"))
    top = nodes.filter("d = 1").agg(F.count(F.lit(1)).alias("n_children"))
    root_least, n_convs, empty = whole.first()
    if root_least is None:
        return tail
    leaves, all_saved = shares.first()
    n_top = top.first()[0]
    shown = inner.select(
        F.col("least").alias("conv_id"),
        F.col("d").alias("depth"),
        F.when(F.col("d") == 1, F.lit(root_least)).otherwise(F.coalesce("parent", "least")).cast("bigint").alias("parent_conv_id"),
        "n_convs",
        F.coalesce("shared_children", alone).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", no_ends).alias("ends_sha256"),
    )
    # Conversations without a turn end in the root, which is a leaf itself if there are no others.
    of_root = conversations.filter("n = 0").select(F.lit(0).cast("bigint").alias("k1"), F.lit(0).cast("bigint").alias("k2"), "conv_id")
    root = conversations.sparkSession.range(1).select(
        F.lit(root_least).cast("bigint").alias("conv_id"),
        F.lit(0).cast("bigint").alias("depth"),
        F.lit(None).cast("bigint").alias("parent_conv_id"),
        F.lit(n_convs).cast("bigint").alias("n_convs"),
        F.lit(n_top).cast("bigint").alias("n_children"),
        F.lit(leaves if n_top else 1).cast("bigint").alias("n_leaves"),
        F.lit(all_saved or 0).cast("bigint").alias("saved_tokens"),
        (F.lit(end_lists(of_root).first()["ends_sha256"]) if empty else no_ends).alias("ends_sha256"),
    )
    return shown.unionByName(tail).unionByName(root)


def rebuilt_trie(table: DataFrame) -> DataFrame:
    """The trie of all conversations with the heads that their hundred ids share."""
    checksum = F.crc32(F.col("conv_id").cast("string").cast("binary"))
    return trie(*with_heads(table, 100, 5, checksum % 6))
