"""Numbering, running totals, neighbours and ranks that no single key can overload.

A plain window puts all rows of a key into one task. Here all rows are cut into
slices that follow the window's keys and order (one range shuffle) and written
in buckets, a slice in one bucket, so that the windows read them without another
exchange. A slice holds many whole keys; only its first and its last one may go
on in a neighbour, so at most two keys per slice are shifted by what lies in the
slices before. These borders, two rows per slice, are all that is shuffled and
broadcast after the range shuffle. A key of any size takes this path. There are as
many buckets as slices; a bucket gets several slices by chance, as hashes fall.

The order has to be total (it ends in a unique column); ranks, which are about
equal values, take the value and the tie breaker separately. Running sums of
doubles are added slice by slice, so the last digits of a key that crosses a
border may depend on where the border lies.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.storage import bucketed, stored

_SLICE = "__slice"
_LOCAL = "__local"


def numbered(df: DataFrame, order: Sequence[str | Column], name: str, drop: Sequence[str] = ()) -> DataFrame:
    """Number all rows from 1 in one global order, without gathering them in one task.

    One range shuffle; Spark's increasing id holds the partition number in its
    upper bits and the row's place in the lower 33. The offsets are one row
    per partition, worked out once. Columns in ``drop`` are not kept.
    """
    ids = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(_LOCAL, F.monotonically_increasing_id())
    placed = stored(
        ids.withColumn(_SLICE, F.shiftright(_LOCAL, 33)).withColumn(_LOCAL, F.col(_LOCAL).bitwiseAND((1 << 33) - 1)).drop(*drop),
        "numbered",
    )
    before = Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(
        placed.groupBy(_SLICE)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(_SLICE, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset")),
        "offsets",
    )
    return (
        placed.join(F.broadcast(offsets), _SLICE)
        .withColumn(name, F.col("__offset") + F.col(_LOCAL) + 1)
        .drop(_SLICE, _LOCAL, "__offset")
    )


def framed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    number: str | None = None,
    running: Mapping[str, str] | None = None,
    lag: Mapping[str, str] | None = None,
    lead: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add window columns per key: row number, running sums, previous and next values.

    The mappings go from new column to source column. Null counts as a key.
    ``df`` is computed once, apart from the sampling of the sort.
    """
    running, lag, lead = running or {}, lag or {}, lead or {}
    slices = _sliced(df, keys, order)
    local = _window(slices, [_SLICE, *keys], order, _LOCAL, running, lag, lead)
    offsets = _offsets(local, keys, running, lag, lead)
    same = _same_border(keys)
    joined = local.join(F.broadcast(offsets), same, "left")
    first, last = F.col(_LOCAL) == 1, F.col(_LOCAL) == F.col("__size")
    columns = {
        new: F.when(F.col(f"__before_{new}").isNull(), F.col(new)).otherwise(
            F.col(f"__before_{new}") + F.coalesce(F.col(new), F.lit(0))
        )
        for new in running
    }
    columns |= {new: F.when(first, F.col(f"__prev_{new}")).otherwise(F.col(new)) for new in lag}
    columns |= {new: F.when(last, F.col(f"__next_{new}")).otherwise(F.col(new)) for new in lead}
    if number:
        columns[number] = F.coalesce("__rows_before", F.lit(0)) + F.col(_LOCAL)
    added = [*running, *lag, *lead, *([number] if number else [])]
    return joined.withColumns(columns).select(*df.columns, *added)


def ranked(df: DataFrame, keys: Sequence[str], value: str, tie: str, descending: bool = False) -> DataFrame:
    """Add ``row_number``, ``rank`` and ``dense_rank`` per key by ``value``; ``tie`` orders equal values.

    All three come from the same slices. Equal values may fill several slices;
    the rank of the first rows of a slice is then that of the slice in which
    their value began, and their value counts once.
    """
    direction = F.desc(value) if descending else F.asc(value)
    slices = _sliced(df, keys, [direction, F.asc(tie)])
    by_value = Window.partitionBy(_SLICE, *keys).orderBy(direction)
    local = slices.withColumns(
        {
            _LOCAL: F.row_number().over(by_value.orderBy(direction, F.asc(tie))).cast("bigint"),
            "__rank": F.rank().over(by_value).cast("bigint"),
            "__dense": F.dense_rank().over(by_value).cast("bigint"),
        }
    )
    named, same = [f"__key_{k}" for k in keys], _same_border(keys)
    end = {"__size": F.col(_LOCAL), "__values": F.col("__dense"), "__last_rank": F.col("__rank"), "__last": F.col(value)}
    heads = _borders(local, keys, {"__first": F.col(value)}, end)
    along = Window.partitionBy(*named).orderBy("__at")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    goes_on = (F.row_number().over(along) > 1) & F.col("__first").eqNullSafe(F.lag("__last").over(along))
    heads = heads.withColumns({"__rows_before": F.coalesce(F.sum("__size").over(before), F.lit(0)), "__goes_on": goes_on})
    # Where the last value of a slice began: in it, unless it is also its first and goes on from the slice before.
    begins = F.when(~F.col("__goes_on") | (F.col("__values") > 1), F.col("__rows_before") + F.col("__last_rank"))
    offsets = heads.select(
        "__at",
        *named,
        "__rows_before",
        "__goes_on",
        F.last(begins, ignorenulls=True).over(before).alias("__began"),
        (
            F.coalesce(F.sum("__values").over(before), F.lit(0))
            - F.sum(F.col("__goes_on").cast("bigint")).over(along.rowsBetween(Window.unboundedPreceding, 0))
        ).alias("__values_before"),
    )
    joined = local.join(F.broadcast(offsets), same, "left")
    moved = F.coalesce("__rows_before", F.lit(0))
    columns = {
        "row_number": moved + F.col(_LOCAL),
        "rank": F.when(F.col("__goes_on") & (F.col("__dense") == 1), F.col("__began")).otherwise(moved + F.col("__rank")),
        "dense_rank": F.coalesce("__values_before", F.lit(0)) + F.col("__dense"),
    }
    return joined.withColumns(columns).select(*df.columns, *columns)


def _sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """All rows in slices along keys and order, a slice in one bucket. Stored."""
    return bucketed(df.repartitionByRange(*keys, *order).withColumn(_SLICE, F.spark_partition_id()), _SLICE, "slices")


def _same_border(keys: Sequence[str]) -> list[Column]:
    return [F.col(_SLICE) == F.col("__at")] + [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys]


def _window(df, keys, order, number, running, lag, lead) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = {new: F.sum(source).over(upto) for new, source in running.items()}
    columns |= {new: F.lag(source).over(window) for new, source in lag.items()}
    columns |= {new: F.lead(source).over(window) for new, source in lead.items()}
    if number:
        columns[number] = F.row_number().over(window).cast("bigint")
    return df.withColumns(columns) if columns else df


def _borders(local: DataFrame, keys: Sequence[str], start: Mapping[str, Column], end: Mapping[str, Column]) -> DataFrame:
    """What the first (``start``) and the last row (``end``) of the first and of the last key of each slice hold.

    At most two rows per slice, from one pass over the slices where they lie.
    """
    at_start = F.struct(*[column.alias(name) for name, column in start.items()])
    at_end = F.struct(*[F.col(k).alias(f"__key_{k}") for k in keys], *[column.alias(name) for name, column in end.items()])
    up, down = F.struct(*keys, F.col(_LOCAL)), F.struct(*keys, -F.col(_LOCAL))
    low, high = (F.min_by, up, down), (F.max_by, down, up)
    ends = local.groupBy(F.col(_SLICE).alias("__at")).agg(
        *[
            F.struct(*([pick(at_start, first).alias("start")] if start else []), pick(at_end, last).alias("end")).alias(name)
            for name, (pick, first, last) in (("low", low), ("high", high))
        ]
    )
    listed = ends.select("__at", F.explode(F.array_distinct(F.array("low", "high"))).alias("b"))
    return listed.select("__at", *(["b.start.*"] if start else []), "b.end.*")


def _offsets(local, keys, running, lag, lead) -> DataFrame:
    """What lies before and after each slice of the keys at its borders; two rows per slice at most."""
    named = [f"__key_{k}" for k in keys]
    end = {"__size": F.col(_LOCAL)}
    end |= {f"__sum_{new}": F.col(new) for new in running} | {f"__last_{new}": F.col(source) for new, source in lag.items()}
    heads = _borders(local, keys, {f"__first_{new}": F.col(source) for new, source in lead.items()}, end)
    along = Window.partitionBy(*named).orderBy("__at")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    return heads.select(
        "__at",
        *named,
        "__size",
        F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__rows_before"),
        *[F.sum(f"__sum_{new}").over(before).alias(f"__before_{new}") for new in running],
        *[F.lag(f"__last_{new}").over(along).alias(f"__prev_{new}") for new in lag],
        *[F.lead(f"__first_{new}").over(along).alias(f"__next_{new}") for new in lead],
    )
