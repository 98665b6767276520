"""Documents packed into as few sequences of a fixed length as possible, by fitted length patterns.

Only the histogram of lengths decides: patterns of a few lengths that fill a
sequence exactly are enumerated, their repeat counts are fitted to the
histogram by non-negative least squares and rounded down, and what is left is
packed best fit. Both the histogram and the patterns are bounded by the
sequence length, whatever the number of documents. Every piece then finds its
place by its number among the pieces of its length.

Null text is an empty document, that is its end token. Equal documents and ids
are packed like any others. An empty table gives an empty result. Columns
besides ``doc_id`` and ``text`` are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import offsets, pick, stored
from millrace.llm.token_files import encoded

#: Patterns of three lengths that are tried; more of them leave less to the rounding of each.
TRIPLES = 3_000
ROUNDS = 400


def pieces(docs: DataFrame, tokenizer: str, end: int, size: int) -> DataFrame:
    """Pieces of at most ``size`` tokens: whole documents, or longer ones cut, the shorter piece first.

    ``local`` numbers the pieces of one length within a task, from 0.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            for first, rows, ids, sizes in encoded(batch, tokenizer, end):
                owner, piece, start, length = cuts(sizes, size)
                places = (np.cumsum(sizes) - sizes)[owner] + start
                tokens = ids.astype("<u4")
                crc = [zlib.crc32(tokens[p : p + n]) for p, n in zip(places, length, strict=True)]
                order = np.argsort(length, kind="stable")
                runs = length[order]
                begins = np.searchsorted(runs, runs)
                local = np.empty(len(length), dtype=np.int64)
                local[order] = np.arange(len(runs)) - begins + seen[runs]
                seen += np.bincount(length, minlength=size + 1)
                names = batch.column("doc_id").slice(first, rows).take(pa.array(owner))
                columns = [piece.astype(np.int32), start, length, np.array(crc, dtype=np.int64), local]
                yield pa.RecordBatch.from_arrays(
                    [names, *map(pa.array, columns), pa.array(np.full(len(length), part, dtype=np.int32))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "local", "part"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, local bigint, part int"
    return stored(pick(docs, "doc_id", "text").mapInArrow(cut, schema), "pieces")


def cuts(sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(document, piece, start, length)`` of all pieces of documents of these sizes."""
    count = -(-sizes // size)
    owner = np.repeat(np.arange(len(sizes)), count)
    piece = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    first = sizes - (count - 1) * size
    start = np.where(piece == 0, 0, first[owner] + (piece - 1) * size)
    return owner, piece, start, np.where(piece == 0, first[owner], size)


def plan(histogram: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used; together they hold every piece of ``histogram[length]`` once."""
    left = histogram.astype(np.int64).copy()
    used = [((size,), int(left[size]))]
    left[size] = 0
    patterns = _patterns(np.flatnonzero(left), size)
    if len(patterns):
        for lengths, times in zip(patterns, np.floor(_fit(patterns, left)).astype(np.int64), strict=True):
            own = [n for n in lengths.tolist() if n]
            need = np.bincount(own, minlength=size + 1)
            times = min([int(times), *(int(left[n] // need[n]) for n in own)])
            if times > 0:
                left -= times * need
                used.append((tuple(sorted(own, reverse=True)), times))
    used += _best_fit(left, size)
    return [(lengths, times) for lengths, times in used if times]


def _patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """Two or three of the lengths that add up to ``size``, one pattern a row, zero for none."""
    there = np.zeros(size + 1, dtype=bool)
    there[lengths] = True
    a = lengths[(lengths <= size // 2) & there[size - lengths]]
    pairs = np.stack([a, size - a, np.zeros_like(a)], axis=1)
    x, y = np.meshgrid(lengths, lengths, indexing="ij")
    z = size - x - y
    ok = (x <= y) & (y <= z) & there[np.clip(z, 0, size)]
    triples = np.stack([x[ok], y[ok], z[ok]], axis=1)
    if len(triples) > TRIPLES:
        triples = triples[np.linspace(0, len(triples) - 1, TRIPLES).astype(np.int64)]
    return np.concatenate([pairs, triples])


def _fit(patterns: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative repeat counts whose lengths come near the histogram, by projected scaled gradient steps.

    What is missing counts by length, as short pieces find a place later more easily.
    """
    n = len(histogram)
    goal = histogram.astype(np.float64)
    goal[0] = 0
    flat = patterns.ravel()
    real = (patterns > 0).astype(np.float64)
    rows = np.maximum(np.bincount(flat, weights=real.ravel(), minlength=n), 1)
    price = np.arange(n) / (n - 1)
    columns = (real * price[patterns]).sum(axis=1)
    x = np.zeros(len(patterns))
    for _ in range(ROUNDS):
        now = np.bincount(flat, weights=(real * x[:, None]).ravel(), minlength=n)
        step = ((goal - now) / rows * price)[patterns] * real
        x = np.maximum(0, x + step.sum(axis=1) / columns)
    return x


def _best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Fill a sequence from the longest piece down, an exact pair for the rest where there is one; repeat while it fits."""
    left = left.copy()
    used = []
    longest = size
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            return used
        own, room = [longest], size - longest
        left[longest] -= 1
        while room:
            there = left[: room + 1] > 0
            if there[room]:
                pick = [room]
            else:
                pair = np.flatnonzero(there & there[::-1])
                pair = pair[(pair > 0) & (pair <= room - pair)]
                pair = [a for a in pair.tolist() if 2 * a != room or left[a] > 1]
                below = np.flatnonzero(there)
                pick = [room - pair[0], pair[0]] if pair else below[-1:].tolist()
            pick = [n for n in pick if n]
            if not pick:
                break
            for n in pick:
                left[n] -= 1
                room -= n
            own += pick
        need = np.bincount(own, minlength=size + 1)
        more = int(min(left[n] // need[n] for n in set(own)))
        left -= more * need
        used.append((tuple(own), 1 + more))


def places(used: list[tuple[tuple[int, ...], int]], size: int) -> dict[str, np.ndarray]:
    """For each slot of each pattern the first of the pieces that go there, by length and number, sorted."""
    given = np.zeros(size + 1, dtype=np.int64)
    rows, base = [], 0
    for lengths, times in used:
        at = 0
        for n in lengths:
            rows.append((n, given[n], base, at))
            given[n] += times
            at += n
        base += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return {"key": table[:, 0] << 48 | table[:, 1], "first": table[:, 1], "base": table[:, 2], "offset": table[:, 3]}


def packed(docs: DataFrame, tokenizer: str, end: int = 2, size: int = 1024) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for every piece of every document.

    What reaches the driver is one count per length, and what goes back to the
    tasks is one row per slot of a pattern: at most some thousand.
    """
    cut = pieces(docs, tokenizer, end, size)
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    numbers = stored(offsets(counts, ["length"], "part", "n", "before"), "offsets")
    histogram = np.zeros(size + 1, dtype=np.int64)
    for row in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        histogram[row["length"]] = row["n"]
    slots = places(plan(histogram, size), size)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            slot = np.searchsorted(slots["key"], length << 48 | rank, side="right") - 1
            sequence = slots["base"][slot] + rank - slots["first"][slot]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(slots["offset"][slot])], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    ranked = cut.join(numbers, ["length", "part"]).withColumn("rank", F.col("before") + F.col("local"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, schema)
