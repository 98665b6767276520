"""SimHash fingerprints of texts and of their edited versions, and the search for near ones in permuted block tables.

All of it is DataFrame expressions. Every word of a text votes, with its weight,
for the ones and against the zeros of its 64-bit hash; a bit of the fingerprint
is one if its votes have the majority of the text's weight. The votes of two
bits share a long, so 32 sums hold them all, and words are summed up where they
are read.

A search within a Hamming radius r cuts fingerprints into r + 2 blocks: two
fingerprints at most r bits apart agree in two blocks at least. For each pair
of blocks there is a table keyed by these two; a query looks into every table
and the distance is checked.

Null text counts as empty, and texts without words have fingerprint zero. Null
ids come first in the order. Rows with equal ids follow each other in the order
of their texts' hashes. The next of the only document is itself. An empty table
gives an empty result. Other columns are left out.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import partitions, pick, stored

RADIUS = 3
#: Documents whose id it divides look for near ones.
EVERY = 20
#: Words longer than this weigh no more.
LONGEST = 12
#: Slices of the order per shuffle partition, so that tasks come out even.
SLICES = 4


def weight(word: Column) -> Column:
    """Long words are rarer and say more: squared length, nothing for the empty word."""
    size = F.least(F.length(word), F.lit(LONGEST)).cast("bigint")
    return size * size


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``fp`` per row; the keys have to tell the rows apart."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    words = rows.select(*keys, F.explode(F.split(spaced, " ")).alias("word"))
    hashed = words.select(*keys, F.xxhash64("word").alias("h"), weight(F.col("word")).alias("w"))
    both = F.lit((1 << 32) + 1)
    sums = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(both) * F.col("w")).alias(f"s{j}") for j in range(32)]
    voted = hashed.groupBy(*keys).agg(F.sum("w").alias("w"), *sums)
    low = F.lit((1 << 32) - 1)
    bits = []
    for j in range(32):
        for bit, votes in ((j, F.col(f"s{j}").bitwiseAND(low)), (j + 32, F.shiftrightunsigned(f"s{j}", 32))):
            one = F.lit((1 << bit) - (1 << 64 if bit == 63 else 0))
            bits.append(F.when(votes * 2 > F.col("w"), one).otherwise(F.lit(0).cast("bigint")))
    return voted.select(*keys, reduce(Column.bitwiseOR, bits).alias("fp"))


def first_ids(docs: DataFrame, slices: int) -> list:
    """The first id of each range of ids but the lowest; there are fewer than ``slices`` of them."""
    ranged = docs.select("doc_id").filter("doc_id IS NOT NULL").repartitionByRange(slices, "doc_id")
    firsts = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min("doc_id").alias("first"))
    return sorted(row["first"] for row in firsts.collect())[1:]


def _slice(bounds: list) -> Column:
    """How many of the sorted ``bounds`` are at most the id, by bisection; null ids come before all."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col("doc_id") < F.lit(bounds[middle]), among(low, middle)).otherwise(among(middle + 1, high))

    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(among(0, len(bounds)))


def with_next(docs: DataFrame) -> DataFrame:
    """``(slice, place, ahead, doc_id, text, next_text)`` in the order of ids.

    The order is cut into slices that start at a given id. A slice also gets
    the row that follows it, marked ``ahead``, and the last slice the first row
    of all. So each text moves once, whatever the size of the table.
    """
    rows = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    bounds = first_ids(rows, SLICES * partitions(rows))
    lowest = rows.agg(F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls"), F.min("doc_id").alias("first")).first()
    is_first = F.col("doc_id").isNull() if lowest["nulls"] else F.col("doc_id").eqNullSafe(F.lit(lowest["first"]))
    own = F.col("own")
    begins = own.isNotNull() & (own > 0) & F.col("doc_id").isin(bounds) if bounds else F.lit(False)
    target = lambda at, ahead: F.struct(at.cast("int").alias("slice"), F.lit(ahead).alias("ahead"))
    goes = F.array(
        target(own, 0), F.when(begins, target(own - 1, 1)), F.when(is_first, target(F.lit(len(bounds)), 2))
    )
    dealt = rows.withColumn("own", _slice(bounds)).withColumn("to", F.explode(goes)).filter("to IS NOT NULL")
    order = Window.partitionBy("slice").orderBy("ahead", "doc_id", "tie")
    return (
        dealt.select("to.slice", "to.ahead", "doc_id", "text", F.xxhash64("text").alias("tie"))
        .withColumn("place", F.row_number().over(order))
        .withColumn("next_text", F.lead("text").over(order))
    )


def likeness(a: str, b: str) -> Column:
    return F.lit(1.0) - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64.0)


def shown(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def compared(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp)`` for every document.

    The edited text has its last half replaced by as much of the beginning of
    the next document's text.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("next_text", F.lit(1), half))
    rows = with_next(docs).withColumn("n_chars", F.length("text"))
    rows = rows.withColumn("edited", F.when(F.col("ahead") == 0, edited))
    # The row ahead only lends its fingerprint; it has no edited text of its own.
    version = lambda kind, text: F.struct(F.lit(kind).alias("kind"), F.col(text).alias("t"))
    both = F.array(version(0, "text"), F.when(F.col("ahead") == 0, version(1, "edited")))
    sha = F.when(F.col("ahead") == 0, F.unhex(F.sha2("edited", 256)))
    versions = rows.withColumn("sha", sha).withColumn("v", F.explode(both)).filter("v IS NOT NULL")
    keys = ["slice", "place", "ahead", "doc_id", "n_chars", "sha", "kind"]
    by_version = fingerprints(versions.select(*keys[:-1], "v.kind", "v.t"), keys, "t")
    is_own = F.col("kind") == 0
    by_row = by_version.groupBy(*keys[:-1]).agg(F.max(F.when(is_own, F.col("fp"))).alias("fp"), F.max(F.when(~is_own, F.col("fp"))).alias("edited_fp"))
    following = Window.partitionBy("slice").orderBy("place")
    found = by_row.withColumn("next_fp", F.lead("fp").over(following)).filter("ahead = 0")
    return found.select("doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), F.lower(F.hex("sha")).alias("edited_sha256"), "fp", "edited_fp", "next_fp")


def blocks(radius: int) -> list[int]:
    """Masks that part 64 bits into ``radius + 2`` blocks of nearly equal width."""
    count = radius + 2
    ends = [64 * i // count for i in range(count + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(ends, ends[1:], strict=False)]


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask)


def _tables(fps: DataFrame, radius: int) -> DataFrame:
    """Each fingerprint once per pair of blocks, with the bits of the two."""
    keys = [F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(_signed(a | b)).alias("key")) for i, (a, b) in enumerate(combinations(blocks(radius), 2))]
    return fps.withColumn("t", F.explode(F.array(*keys))).select("t.table", "t.key", *fps.columns)


def near_counts(queries: DataFrame, fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fp, near)`` for each distinct ``queries(fp)``: the rows of ``fps(fp)`` at most ``radius`` bits away, equal ones included.

    Equal fingerprints are counted first and meet as one. A pair that agrees in
    several tables is taken in the first of them only.
    """
    stock = _tables(fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), radius)
    asked = _tables(queries.select("fp").distinct(), radius).withColumnRenamed("fp", "q")
    differ = F.col("fp").bitwiseXOR(F.col("q"))
    masks = [_signed(a | b) for a, b in combinations(blocks(radius), 2)]
    first = reduce(lambda rest, i: F.when(differ.bitwiseAND(masks[i]) == 0, F.lit(i)).otherwise(rest), range(len(masks) - 1, -1, -1), F.lit(-1))
    near = (F.bit_count(differ) <= radius) & (F.col("table") == first)
    pairs = stock.join(asked, ["table", "key"]).filter(near)
    return pairs.groupBy(F.col("q").alias("fp")).agg(F.sum("n").alias("near"))


def fingerprinted(docs: DataFrame, radius: int = RADIUS, every: int = EVERY) -> DataFrame:
    """The likenesses of every document, and for ids divisible by ``every`` how many other documents are near.

    ``near_documents`` counts the other documents whose fingerprint is at most
    ``radius`` bits away; it is null for documents that do not ask.
    """
    rows = stored(compared(docs), "fingerprints")
    asks = F.pmod("doc_id", F.lit(every)) == 0
    near = stored(near_counts(rows.filter(asks), rows, radius), "near")
    return rows.join(near, "fp", "left").select(
        "doc_id", "n_chars", "edited_sha256", shown("fp").alias("fingerprint"), shown("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
        F.when(asks, F.col("near") - 1).alias("near_documents"),
    )
