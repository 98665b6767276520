"""Near duplicates by SimHash: fingerprints that differ in at most two bits, found through a grid of bit counts.

A fingerprint is cut into 16 segments of four bits, and the number of ones in
each segment makes a point in 16 dimensions. Two fingerprints that differ in d
bits are at most d apart there by Manhattan distance, so a range join on the
grid of these points has every pair, and few others. Points two apart share a
neighbour, hence each point is placed in its own cell and the (at most 32)
cells next to it, and only cells with several fingerprints go on. The exact
check works in the same way on the bits: within its crowded cells a fingerprint
is placed at itself and at all words one flipped bit away, and fingerprints
that meet at a word are at most two bits apart, and all that are do meet.
Nothing is ever listed as pairs of a group, so a large group costs what its
members cost.

Two bits is about an equal text. ``one_of_each`` can also link texts whose sets
of five words in a row have a Jaccard similarity of 0.8 or more; these differ in
ten bits and more, where a range search meets nearly everything, so they are
found by the MinHash bands of ``passages`` and checked exactly.

Texts without words, null ones included, have fingerprint zero and link like
any other. Repeated rows and equal ids are kept, each with its component. A
component's id is its smallest ``doc_id`` that is not null, or null. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import passages
from millrace.llm.common import components, discard, pick, plain, stored

SHINGLE = 3
SEED = 42
SEGMENT = 4
#: Shingles whose bits are unpacked at a time.
BLOCK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The bits set in over half of the hashes of all word shingles, as an unsigned number."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    n = max(1, len(words) - shingle + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        some = hashes[at : at + BLOCK]
        ones += np.unpackbits(some.view(np.uint8).reshape(len(some), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.large_binary()).to_pylist()
            fp = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp)], names=[*keep, "fp"])

    chosen = docs.select(*keep, F.col(text).alias("__text"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return chosen.mapInArrow(hashed, f"{kinds}, fp bigint")


def bit_counts(fp: Column) -> Column:
    """Ones per four-bit segment, each count in the segment's own four bits."""
    lowest = F.lit(0x1111111111111111)
    return reduce(add, (F.shiftrightunsigned(fp, bit).bitwiseAND(lowest) for bit in range(SEGMENT)))


def _cells(distinct: DataFrame) -> DataFrame:
    """``(fp, cell, segment, up)``: the own cell (segment null) and the cells one step away in one segment."""
    count = bit_counts(F.col("fp"))
    own = F.struct(F.col("counts").alias("cell"), F.lit(None).cast("int").alias("segment"), F.lit(False).alias("up"))
    around = [own]
    for segment in range(64 // SEGMENT):
        here = F.shiftrightunsigned("counts", SEGMENT * segment).bitwiseAND(F.lit(15))
        step = F.lit(1 << SEGMENT * segment)
        # Counts stay between 0 and 4, so no step carries into another segment.
        for up, room, cell in ((True, here < SEGMENT, F.col("counts") + step), (False, here > 0, F.col("counts") - step)):
            next_to = F.struct(cell.alias("cell"), F.lit(segment).alias("segment"), F.lit(up).alias("up"))
            around.append(F.when(room, next_to))
    placed = distinct.withColumn("counts", count).select("fp", F.explode(F.array(*around)).alias("c"))
    return placed.filter("c is not null").select("fp", "c.cell", "c.segment", "c.up")


def links(fps: DataFrame) -> DataFrame:
    """``(a, b)`` such that the components of these pairs are those of all pairs at most two bits apart."""
    distinct = stored(fps.select("fp").distinct(), "fingerprints")
    cells = _cells(distinct)
    crowded = stored(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cell"), "crowded")
    near = cells.join(crowded, "cell", "left_semi")
    flips = []
    for bit in range(SEGMENT):
        mask = F.expr(f"shiftleft(1L, segment * {SEGMENT} + {bit})")
        is_one = F.col("fp").bitwiseAND(mask) != 0
        flips.append(F.when(F.col("segment").isNotNull() & (is_one != F.col("up")), F.col("fp").bitwiseXOR(mask)))
    here = F.when(F.col("segment").isNull(), F.col("fp"))
    words = stored(near.select("fp", F.explode(F.array(here, *flips)).alias("word")).filter("word is not null"), "words")
    least = words.groupBy("word").agg(F.min("fp").alias("b"), F.max("fp").alias("other")).filter("b <> other")
    return words.join(stored(least.select("word", "b"), "least"), "word").select(F.col("fp").alias("a"), "b").filter("a <> b")


def _texts(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The columns ``keep`` and ``fp``, and what ``passages.links`` takes of whole texts. Stored."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, len(batch) * passages.SLICE_BYTES // max(passages.SLICE_BYTES, batch.column("__text").nbytes))
            for begin in range(0, len(batch), step):
                some = batch.slice(begin, step)
                texts = some.column("__text")
                fp = np.array([fingerprint(t) for t in texts.cast(pa.large_binary()).to_pylist()], dtype=np.uint64).view(np.int64)
                low, bands, lower = passages.whole(texts)
                columns = [*some.columns[:-1], pa.array(fp), pa.array(low.view(np.int64)), bands, lower.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "fp", "low", "bands", "paragraph"])

    chosen = docs.select(*keep, F.col(text).alias("__text"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return stored(chosen.mapInArrow(hashed, f"{kinds}, fp bigint, low bigint, bands array<bigint>, paragraph string"), "documents")


def similar(texts: DataFrame) -> DataFrame | None:
    """``(a, b)`` such that the components of these fingerprints are those of all similar ``texts``; None without any."""
    roots = passages.links(texts.select("low", "bands"), texts.filter(F.size("bands") > 0).select("low", "paragraph"))
    if roots is None:
        return None
    alike = stored(texts.select(F.col("low").alias("node"), "fp").join(roots, "node").select("root", "fp").distinct(), "alike")
    least = stored(alike.groupBy("root").agg(F.min("fp").alias("b")), "least")
    return alike.join(least, "root").select(F.col("fp").alias("a"), "b").filter("a <> b")


def groups(fps: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """``fps`` with the column ``root``, one value per component of the links and the pairs ``more(a, b)``."""
    pairs = links(fps) if more is None else links(fps).unionByName(more)
    roots = components(pairs).select(F.col("node").alias("fp"), "root")
    return fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs(doc_id, text)``."""
    rows = pick(docs, "doc_id", "text")
    rooted = stored(groups(stored(fingerprints(rows, ["doc_id"], "text"), "documents")), "rooted")
    named = stored(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "components")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rooted.join(named, "root").select("doc_id", shown, "component_id")


def one_of_each(docs: DataFrame, by_words: bool = False) -> DataFrame:
    """The rows of ``docs`` without those whose component has another row that is kept.

    With ``by_words`` texts with similar sets of five words are linked, too.

    The row with the smallest ``doc_id`` stays, a null id last; of rows equal
    in id the one whose text has the smallest hash, and of rows equal in both
    any one.
    """
    doc_id, text = (f"c{docs.columns.index(n)}" for n in ("doc_id", "text"))
    keyed = plain(docs).withColumns({"last": F.col(doc_id).isNull(), "hash": F.xxhash64(text)})
    key = ["last", doc_id, "hash"]
    if by_words:
        texts = _texts(keyed, key, text)
        rooted = groups(texts.select(*key, "fp"), similar(texts))
    else:
        texts = stored(fingerprints(keyed, key, text), "documents")
        rooted = groups(texts)
    kept = stored(rooted.groupBy("root").agg(F.min(F.struct(*key)).alias("k")).select("k.*"), "kept")
    # All texts a second time, which would lie on the disks beside the shuffles below and the stages after this one.
    discard(texts)
    same = [keyed[c].eqNullSafe(kept[c]) for c in key]
    return keyed.join(kept, same, "left_semi").dropDuplicates(key).drop("last", "hash").toDF(*docs.columns)
