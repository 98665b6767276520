"""Documents repeated so that each source has its share of the words, by dependent rounding.

A source whose target is m times its size asks for m copies of each of its
documents: the whole part for all, the fraction as a probability. Pivotal
rounding meets two documents at a time and moves words of probability from one
to the other, in a random direction that keeps both expectations, until one of
them is settled. Documents that are not very short, from the longest on, meet all
shorter ones of their bucket together, as one, so that the last one is short. A source's expected words never change by that, so only the
one document that is left last is rounded by itself, to the nearer side,
and where a bucket holds all that is open of a source, one more document is
taken or left if that brings the words nearer to the target. Documents meet in buckets
of a few thousand, and what each bucket leaves over meets in the buckets of the
next level, down to one per source.

Randomness comes from the ids, sources and levels alone, and rows that are
equal in source, id and size are told apart by number, so reruns agree however
the table is split. Null text has size 0 and is taken 0 times, null sources are
one source that comes last, null ids are ids like others. An empty table gives
an empty result. Other columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, pick, plain, stored

WEIGHTS = (5, 2, 1)
MOST = 3
#: Documents that meet in one bucket, on average, and residuals in one bucket of a later level.
BUCKET = 4_096
FAN_IN = 256
#: Times the average size from which a document meets all shorter ones of its bucket at once.
LONG = 0.25


def sized(docs: DataFrame, *keep: str) -> DataFrame:
    """``(doc_id, source, size)``: words per document, after the columns ``keep``."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select(*keep, "doc_id", "source", size.alias("size"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``(source, source_size, target, documents)`` per source.

    The share is by weight. Where it passes ``most`` times the source's size it
    stops there, and what is too much is shared among the others by weight:
    there is one level of target per weight at which everything is given out.
    Sources are few next to documents, so their order needs no distribution.
    """
    sources = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("documents")
    )
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int") + 1)
    cap = F.col("source_size") * float(most)
    weighed = sources.withColumn("weight", weight).withColumn("cap", cap).withColumn("level", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy("level", F.asc_nulls_last("source"))
    before, all_rows = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    stopped = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    filled = weighed.withColumn("share", (F.sum("source_size").over(all_rows) - stopped) / F.sum("weight").over(after))
    # Sources come by the level at which they stop; the first that isn't reached sets the level of all after it.
    free = filled.withColumn("reach", F.when(F.col("share") <= F.col("level"), F.col("share")))
    level = F.first("reach", ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return free.withColumn("all", level).select(
        "source", "source_size", F.least("cap", F.col("all") * F.col("weight")).alias("target"), "documents"
    )


def meet(p: float, a: float, q: float, b: float, draw: float) -> tuple[float, float]:
    """One meeting: odds ``p`` of a words and ``q`` of b words become odds of which one is 0 or 1.

    The words p * a + q * b stay, and so does the expectation of each.
    """
    up, down = min(a - p * a, q * b), min(p * a, b - q * b)
    if draw * (up + down) < down:
        return (1.0, q - (a - p * a) / b) if a - p * a <= q * b else (p + q * b / a, 0.0)
    return (0.0, q + p * a / b) if p * a <= b - q * b else (p - (b - q * b) / a, 1.0)


def settle_long(sizes: list[int], odds: float, draws: list[float]) -> tuple[list[float], int]:
    """Let each document, from the longest down to a part of the average, meet all shorter ones at once.

    ``sizes`` descend and all odds are equal, so the others stay equal. Returns
    the odds and the number of long documents; without this a long one would
    stay open to the end and a source could miss its target by it.
    """
    rest, bound = float(sum(sizes)), LONG * sum(sizes) / max(1, len(sizes))
    settled: list[float] = []
    for size, draw in zip(sizes, draws, strict=False):
        if size <= bound or size >= rest or not 0 < odds < 1:
            break
        rest -= size
        own, odds = meet(odds, size, odds, rest, draw)
        settled.append(own)
    return settled + [odds] * (len(sizes) - len(settled)), len(settled)


def pivot(sizes: list[int], odds: list[float], draws: list[float]) -> int:
    """Settle all but one of ``odds`` by meetings of two; return the place of the open one, or -1."""
    left = -1
    for i, here in enumerate(odds):
        if not 0 < here < 1:
            continue
        if left < 0:
            left = i
            continue
        odds[left], odds[i] = meet(odds[left], sizes[left], here, sizes[i], draws[i])
        left = next((k for k in (i, left) if 0 < odds[k] < 1), -1)
    return left


def repair(sizes: list[int], odds: list[float], wanted: float) -> None:
    """Take or leave one more document if that brings the words of settled ``odds`` nearer to ``wanted``."""
    missing = wanted - sum(n for p, n in zip(odds, sizes, strict=True) if p >= 1)
    free = [i for i, p in enumerate(odds) if (p < 1) == (missing > 0)]
    best = min(free, key=lambda i: abs(abs(missing) - sizes[i]), default=None)
    if best is not None and abs(abs(missing) - sizes[best]) < abs(missing):
        odds[best] = float(missing > 0)


def _settle(seed: int, level: int):
    def settle(group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "descending"), ("tie", "ascending"), ("number", "ascending")])
        bucket, buckets, source = (group[c][0].as_py() for c in ("bucket", "buckets", "source_tie"))
        sizes, odds = group["size"].to_pylist(), group["odds"].to_pylist()
        draws = np.random.default_rng([seed, level, bucket, source & (2**63 - 1)]).random(2 * len(sizes)).tolist()
        wanted = sum(p * n for p, n in zip(odds, sizes, strict=True))
        if level == 0:
            odds, _ = settle_long(sizes, odds[0], draws)
        left = pivot(sizes, odds, draws[len(sizes) :])
        if buckets == 1:
            if left >= 0:
                odds[left], left = float(odds[left] >= 0.5), -1
            repair(sizes, odds, wanted)
        at = group.schema.get_field_index("odds")
        return group.set_column(at, "odds", pa.array(odds, pa.float64())).append_column(
            "open", pa.array(np.arange(len(sizes)) == left)
        )

    return settle


def decided(sizes: DataFrame, weights: tuple[float, ...], most: float, seed: int) -> DataFrame:
    """``(doc_id, source, size, number, source_size, target, copies)`` for stored ``sizes``; ``number`` tells equal rows apart."""
    wanted = stored(targets(sizes, weights, most), "targets")
    # Equal rows are counted and told apart by number, a million of them per row at first.
    same = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    million = 1_000_000
    tens = same.withColumn("__block", F.explode(F.expr(f"sequence(0L, (n - 1) div {million})")))
    numbered = tens.withColumn(
        "number", F.explode(F.expr(f"sequence(__block * {million}, least(n, (__block + 1) * {million}) - 1)"))
    ).drop("n", "__block")
    ratio = F.least(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)), F.lit(float(most)))
    chosen = numbered.join(wanted, numbered["source"].eqNullSafe(wanted["source"])).drop(wanted["source"])
    chosen = chosen.withColumn("ratio", ratio).withColumn("whole", F.floor("ratio"))
    chosen = chosen.withColumn("odds", F.when(F.col("size") > 0, F.col("ratio") - F.col("whole")).otherwise(F.lit(0.0)))
    tie = F.xxhash64(F.lit(seed), "doc_id", "size", "number")
    buckets = F.greatest(F.lit(1), F.ceil(F.col("documents") / BUCKET)).cast("bigint")
    current = chosen.select(
        "doc_id", "source", "size", "source_size", "target", "whole", "odds", "number",
        tie.alias("tie"), F.xxhash64("source").alias("source_tie"), buckets.alias("buckets"),
        F.when(F.col("size") > 0, F.pmod(tie, buckets)).otherwise(F.pmod(tie, F.greatest(buckets, F.lit(64)))).alias("bucket"),
    )
    # Documents without words need no rounding and meet nobody.
    idle, current = current.filter("size = 0"), current.filter("size > 0")
    done = [idle]
    level = 0
    most_buckets = math.ceil((wanted.agg(F.max("documents")).first()[0] or 0) / BUCKET)
    while True:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in current.schema) + ", open boolean"
        settled = stored(current.groupBy("source", "bucket").applyInArrow(_settle(seed, level), schema), "settled")
        done.append(settled.filter("not open").drop("open"))
        if most_buckets <= 1:
            break
        most_buckets = math.ceil(most_buckets / FAN_IN)
        current = settled.filter("open").drop("open").withColumns(
            {"bucket": F.expr(f"bucket div {FAN_IN}"), "buckets": F.expr(f"(buckets + {FAN_IN - 1}) div {FAN_IN}")}
        )
        level += 1
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.round("odds")).otherwise(F.lit(0)).cast("bigint")
    return rows.select("doc_id", "source", "size", "number", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 1) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` for every document."""
    rows = decided(stored(sized(pick(docs, "doc_id", "source", "text")), "sizes"), weights, most, seed)
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", taken)


def repeated(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 1) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns."""
    whole = stored(plain(docs).withColumn("row", F.monotonically_increasing_id()), "documents")
    named = [F.col(f"c{docs.columns.index(n)}").alias(n) for n in ("doc_id", "source", "text")]
    sizes = stored(sized(whole.select("row", *named), "row"), "sizes")
    same = Window.partitionBy("doc_id", "source", "size").orderBy("row")
    numbered = sizes.withColumn("number", (F.row_number().over(same) - 1).cast("bigint"))
    rows = decided(sizes.drop("row"), weights, most, seed).select("doc_id", "source", "size", "number", "copies")
    keys = [numbered[c].eqNullSafe(rows[c]) for c in ("doc_id", "source", "size", "number")]
    copies = numbered.join(rows, keys).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return whole.join(stored(copies.select("row"), "copies"), "row").drop("row").toDF(*docs.columns)
