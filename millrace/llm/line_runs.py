"""Repeated runs of lines, found through a suffix array of line ids, and texts without the later copies.

Every line that holds a word gets an id; the ids of all documents, in the order
of ``doc_id``, are one long sequence. Prefix doubling ranks its suffixes by
their first 1, 2, 4, ... lines: the rank of twice as many lines is the order of
the pairs of two ranks, and the rank of a group of equal pairs is the number of
suffixes before it, so a group is an interval of the suffix array. Suffixes
that equal no other, or end with their document, take no further part, so a
round costs what is repeated and not what there is.

A run counts if it has at least ``words`` words. Every line of a maximal repeated
run, however long, that stands further ahead already is deleted. To that end the
shortest run with so many words from each line on is looked at, and the shortest
one that ends at each line: they are runs of at most ``words`` lines, and those
within a maximal run cover all of its lines, its last ones by a run that ends
there. All suffixes that share such a run form an interval of common prefixes;
all but the first of them in the sequence are later copies.

Lines without a word are neither compared nor deleted. Null text stays null. A
document without any line left has the empty text. Of repeated rows and equal
ids the one that was read first comes first; null ids come last. An empty table
gives an empty result. Further columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, in_order, offsets, stored

#: Fewer words in a row are often equal by chance.
WORDS = 10
LINE_END = "\n"


def lines(docs: DataFrame, words: int, ends: bool) -> DataFrame:
    """``(row, at, end, h1, h2, length, covers)`` of the lines with words of ``docs(row, doc_id, text)``.

    ``at`` numbers all lines in order and ``end`` is that of the document's
    end. ``length`` is the number of lines of the shortest run from here with
    enough words, null if the document ends before, and ``covers`` lists the
    places of its lines in the text. With ``ends`` there are ``back`` and
    ``behind``, the same for the shortest run that ends here, null if that is not
    longer than the shortest run from its first line on.
    """
    line = lambda x, i: F.struct(
        i.alias("place"),
        F.xxhash64(x).alias("h1"),
        F.xxhash64(F.lit(7), x).alias("h2"),
        F.regexp_count(x, F.lit(WORD)).alias("words"),
    )
    cut = F.filter(F.transform(F.split("text", LINE_END, -1), line), lambda x: x["words"] > 0)
    found = docs.select("row", "doc_id", F.posexplode(cut).alias("seq", "line")).select("row", "doc_id", "seq", "line.*")
    found = stored(found, "lines")
    heads = found.groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    order = [F.asc_nulls_last("doc_id"), F.asc("row")]
    sorted_heads = stored(in_order(heads, *order), "heads")
    bases = running(sorted_heads, order, "n", "base").select("row", "base", (F.col("base") + F.col("n")).alias("end"))
    numbered = found.drop("doc_id").join(stored(bases, "bases"), "row")
    here = Window.partitionBy("row").orderBy("seq")
    length = back = F.lit(None).cast("int")
    # A line has a word at least, so no more than ``words`` lines are ever needed.
    for n in range(words, 0, -1):
        span = here.rowsBetween(Window.currentRow, n - 1)
        length = F.when((F.sum("words").over(span) >= words) & (F.count(F.lit(1)).over(span) == n), F.lit(n)).otherwise(length)
        span = here.rowsBetween(1 - n, Window.currentRow)
        # If it is too short without its last line, it is the shortest run from its first line on, too.
        other = F.when(F.sum("words").over(span) - F.col("words") >= words, F.lit(n))
        back = F.when((F.sum("words").over(span) >= words) & (F.count(F.lit(1)).over(span) == n), other).otherwise(back)
    ahead = F.collect_list("place").over(here.rowsBetween(Window.currentRow, words - 1))
    before = F.collect_list("place").over(here.rowsBetween(1 - words, Window.currentRow))
    whole = numbered.withColumns({"length": length, "ahead": ahead})
    if ends:
        whole = whole.withColumns({"back": back, "before": before})
    at = (F.col("base") + F.col("seq")).alias("at")
    covers = F.when(F.col("length").isNotNull(), F.slice("ahead", 1, F.coalesce("length", F.lit(1)))).alias("covers")
    kept = ["row", at, "end", "h1", "h2", "length", covers]
    if ends:
        behind = F.when(F.col("back").isNotNull(), F.slice("before", -F.coalesce("back", F.lit(1)), F.coalesce("back", F.lit(1)))).alias("behind")
        kept += ["back", behind]
    return stored(whole.select(*kept), "numbered")


def running(ordered: DataFrame, order: list, size: str, name: str) -> DataFrame:
    """``name``: the sum of ``size`` over all rows before, for rows from ``in_order`` that were stored."""
    before = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    base = offsets(ordered, [], "part", size, "__base")
    within = ordered.withColumn("__within", F.coalesce(F.sum(size).over(before), F.lit(0)))
    return within.join(base, "part").withColumn(name, F.col("__base") + F.col("__within")).drop("part", "__base", "__within")


def ranked(members: DataFrame, keys: list[str]) -> DataFrame:
    """``(at, end, rank)`` of the rows whose ``keys`` are not alone; ``rank`` counts the rows with smaller keys."""
    groups = stored(in_order(members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), *keys), "groups")
    repeated = running(groups, [F.asc(k) for k in keys], "n", "rank").filter("n > 1").drop("n")
    return stored(members.join(stored(repeated, "ranks"), keys).select("at", "end", "rank"), "suffixes")


def suffix_ranks(numbered: DataFrame, longest: int) -> list[DataFrame]:
    """Ranks by the first 1, 2, 4, ... lines, up to ``longest``; only suffixes that share so many lines with another."""
    levels = [ranked(numbered.select("at", "end", "h1", "h2"), ["h1", "h2"])]
    while 2 ** len(levels) <= longest:
        half = 2 ** (len(levels) - 1)
        level = levels[-1]
        second = level.select((F.col("at") - half).alias("at"), F.col("rank").alias("second"))
        pairs = level.join(second, "at").filter(F.col("at") + 2 * half <= F.col("end"))
        levels.append(ranked(pairs.withColumnRenamed("rank", "first"), ["first", "second"]))
    return levels


def later_copies(numbered: DataFrame, words: int) -> DataFrame:
    """``(row, covers)`` for every run of ``numbered`` that stands further ahead already."""
    levels = suffix_ranks(numbered, words)
    starts = numbered.filter("length IS NOT NULL").select("at", "row", "length", "covers")
    if "back" in numbered.columns:
        first = (F.col("at") - F.col("back") + 1).alias("at")
        ending = numbered.filter("back IS NOT NULL").select(first, "row", F.col("back").alias("length"), F.col("behind").alias("covers"))
        starts = starts.unionByName(ending)
    found = None
    for k, level in enumerate(levels):
        own = starts.filter((F.col("length") >= 2**k) & (F.col("length") < 2 ** (k + 1)))
        # The run is its first and its last 2^k lines, which overlap.
        tail = level.select(F.col("at").alias("tail"), F.col("rank").alias("last"))
        both = own.join(level.select("at", F.col("rank").alias("first")), "at")
        both = both.withColumn("tail", F.col("at") + F.col("length") - 2**k).join(tail, "tail")
        both = stored(both.select("at", "row", "covers", "length", "first", "last"), "runs")
        earliest = both.groupBy("length", "first", "last").agg(F.min("at").alias("earliest"), F.count(F.lit(1)).alias("n"))
        earliest = stored(earliest.filter("n > 1").drop("n"), "intervals")
        later = both.join(earliest, ["length", "first", "last"]).filter("at > earliest").select("row", "covers")
        found = later if found is None else found.unionByName(later)
    return found


def without_copies(docs: DataFrame, words: int = WORDS, ends: bool = True) -> DataFrame:
    """``docs`` with the later copies of repeated runs deleted from ``text``, and ``n_lines`` and ``n_removed``.

    Without ``ends`` the last lines of a repeated run stay if they have fewer words together.
    """
    columns = docs.columns
    named = [f"c{i}" for i in range(len(columns))]
    rows = docs.toDF(*named).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "documents")
    id_column, text_column = named[columns.index("doc_id")], named[columns.index("text")]
    numbered = lines(rows.select("row", F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), words, ends)
    copies = later_copies(numbered, words).select("row", F.explode("covers").alias("place")).distinct()
    deleted = stored(copies.groupBy("row").agg(F.sort_array(F.collect_list("place")).alias("deleted")), "deleted")
    # The same plan at every size: texts are moved once and not sorted, the lists of a partition are hashed.
    joined = rows.join(deleted.hint("shuffle_hash"), "row", "left").select(*named, "deleted")
    at = named.index(text_column)
    kinds = [f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(named, columns, strict=True)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = batch.column(at), batch.column(batch.num_columns - 1)
            counts = [len(d) if d else 0 for d in removed.to_pylist()]
            total = [0] * len(counts)
            new = texts.to_pylist()
            for i, places in enumerate(removed.to_pylist()):
                if new[i] is None:
                    continue
                own = new[i].split(LINE_END)
                total[i] = sum(1 for line in own if line.encode().strip(b" \t\n\x0b\x0c\r"))
                if places:
                    gone = set(places)
                    new[i] = LINE_END.join(line for place, line in enumerate(own) if place not in gone)
            arrays = [*batch.columns[:at], pa.array(new, pa.string()), *batch.columns[at + 1 : -1]]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(total), pa.array(counts)], names=[*named, "n_lines", "n_removed"])

    schema = ", ".join(kinds) + ", n_lines bigint, n_removed bigint"
    return joined.mapInArrow(cut, schema).toDF(*columns, "n_lines", "n_removed")
