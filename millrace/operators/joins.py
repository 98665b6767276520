"""Joins for which Spark's own choice needs help."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.storage import stored

#: Bands of up to 2 to this power cells.
LONGEST = 48


def full_outer(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join either side of which may hold a hot key.

    Adaptive execution can split a skewed key on both sides of an inner join
    and on the left of an anti join, but not in a full outer join. So: the
    inner join, and the rows of each side without a partner. That reads both
    sides twice, which is the price of a hot key that no task has to hold.
    """
    matched = left.join(right, on)
    left_only, right_only = anti(left, right, on), anti(right, left, on)
    both = matched.unionByName(left_only, allowMissingColumns=True)
    return both.unionByName(right_only, allowMissingColumns=True)


def semi(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` with a partner."""
    return left.join(keys_of(right, on), on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` without a partner."""
    return left.join(keys_of(right, on), on, "left_anti")


def keys_of(df: DataFrame, on: list[str]) -> DataFrame:
    """The distinct keys, stored: a join that sits right on an aggregate of its key could not be split."""
    return stored(df.select(*on).distinct(), "keys")


def band_join(points: DataFrame, point: Column, bands: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Pairs with ``low <= point <= high``, as an equality join on dyadic intervals of cells of ``width``.

    A band is the union of intervals of 1, 2, 4, ... cells that begin at a
    multiple of their length, at most two of each length, so a band of n cells
    is listed about 2 log2 n times, however long it is. A point lies in one
    interval of each length that occurs and in one of a band's intervals at
    most, so each pair appears once. ``width`` should be about the shortest
    band's length. Which lengths occur is the only thing asked before the join
    (63 numbers at most). Bands with a null end, or ending before they begin, hold nothing.
    """
    spread = bands.withColumn("__dyadic", F.explode(_dyadic(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    lengths = sorted(r[0] for r in spread.select("__dyadic.exponent").distinct().collect())
    placed = points.withColumn("__point", point).withColumn("__cell", F.floor(F.col("__point") / width))
    own = [F.struct(F.lit(k).alias("exponent"), F.shiftright("__cell", k).alias("cell")) for k in lengths]
    listed = placed.withColumn("__dyadic", F.explode(F.array(*own))) if own else placed.withColumn("__dyadic", _no_interval()).limit(0)
    inside = F.col("__point").between(F.col(low), F.col(high))
    return listed.join(spread, "__dyadic").filter(inside).drop("__cell", "__point", "__dyadic")


def _no_interval() -> Column:
    return F.struct(F.lit(0).alias("exponent"), F.lit(0).cast("bigint").alias("cell"))


def _dyadic(first: Column, last: Column) -> Column:
    """The intervals ``(exponent, cell)`` that the cells from ``first`` to ``last`` consist of.

    With intervals of 2^k cells, those wholly inside are the ones from
    ceil(first / 2^k) to floor((last + 1) / 2^k) - 1; the outer ones that begin
    or end at an odd place have no longer interval to be part of.
    """

    def of(k: int) -> list[Column]:
        left = F.shiftright(first + ((1 << k) - 1), k)
        right = F.shiftright(last + 1, k)
        interval = lambda cell: F.struct(F.lit(k).alias("exponent"), cell.alias("cell"))
        # Both can only be the same if one of the two places is even.
        return [
            F.when((left < right) & (left.bitwiseAND(F.lit(1)) == 1), interval(left)),
            F.when((left < right) & (right.bitwiseAND(F.lit(1)) == 1), interval(right - 1)),
        ]

    return F.filter(F.array(*[c for k in range(LONGEST) for c in of(k)]), lambda i: i.isNotNull())
