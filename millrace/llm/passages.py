"""Passages that repeat across a collection, equal or nearly so, found by MinHash banding of short paragraphs.

A text is cut into paragraphs at line ends and sentence ends, so that a passage
is found wherever it was put in. Paragraphs are compared by their sets of five
words in a row, in lower case; a Jaccard similarity of 0.8 or more is a link.
Equal paragraphs are folded. Shorter ones that follow each other and have five
words together are compared as the shortest windows of five words or more from
each of them on, by equality only; a stretch of fewer words neither is compared
nor parts a passage. A paragraph with fewer than four such sets has no
other link, unless a word comes again within three words: n sets within n + 1 have
a similarity of n / (n + 1), which is 0.8 from four on. Longer ones get MinHash
signatures, bands of which meet in a join, wide ones first and narrow ones
among those that meet; either are tuned so that a pair at the threshold is
missed with a chance of ``MISS`` at most. Candidates are checked exactly, and
components of links are classes.

In a crowded band nothing is paired with everything: members of the first few
bands, then those that are still in several classes in any band, meet a few
leaders, those that are then in one class need not meet again, and the rest
goes on with more leaders, so all links between classes are found.

A class's first paragraph in the order of ``doc_id`` stays and the later ones
are copies. Copies that follow each other in a text are one passage; passages
of fewer than ``LEAST`` words are left alone.

Null and empty texts have no passages. Repeated rows are copies like others;
of equal ids the one read first comes first, and null ids come last. An empty
table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import components, discard, pick, stored

SHINGLE = 5
SIMILAR = 0.8
MISS = 0.0035
#: Words from which a paragraph can be similar to another one without being equal: n sets of five words within n + 1.
LONG = math.ceil(round(SIMILAR / (1 - SIMILAR), 9)) + SHINGLE - 1
#: Words of the shortest passage that counts.
LEAST = 25
#: At most so many bands for all paragraphs, and for those that share one of the first.
FIRST, SECOND = 8, 50
#: So many of the second bands are met first.
TRIAL = 4
#: Times more leaders in a band in each further round; the first has one.
GROWTH = 16
SLICE_BYTES = 2 << 20
#: The number of a paragraph's sets, null if not known, and the bits they flip.
SKETCH = ("sets", "s0", "s1")
#: What parts words in Python and not in Arrow's splitting by ASCII blanks.
OTHER_BLANKS = "[\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"

_ODD = np.uint64(0x9E3779B97F4A7C15)


def bands(most: int, similar: float = SIMILAR, miss: float = MISS) -> tuple[int, int]:
    """Number of bands and rows per band: as many rows as ``most`` bands allow while pairs at ``similar`` are found."""
    for rows in range(8, 0, -1):
        count = math.ceil(math.log(miss) / math.log(1 - similar**rows))
        if count <= most:
            return count, rows
    return most, 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _constants(n: int, salt: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.uint64(salt)) | np.uint64(1)


def paragraphs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Paragraphs of all texts with the white space that ends them, and the text of each; together they are the texts."""
    plain = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\x1e", " ")
    cut = pc.split_pattern(pc.replace_substring_regex(plain, r"([.!?]+[ \t\r\n]+|\n[ \t\r\n]*)", "\\1\x1e"), "\x1e")
    return cut.values, np.repeat(np.arange(len(cut)), np.diff(np.asarray(cut.offsets)))


def described(texts: pa.Array, banding: bool = True) -> dict[str, np.ndarray | pa.Array]:
    """For all paragraphs of at least five words and windows of shorter ones: text number, place, characters, words, two hashes, bands and words.

    ``at`` numbers the first word in the text.
    """
    parts, owner = paragraphs(texts)
    sizes = pc.utf8_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    first_of_text = np.searchsorted(owner, owner)
    starts = ends - sizes - (ends - sizes)[first_of_text]
    lower = pc.ascii_trim_whitespace(pc.utf8_lower(parts))
    words, bounds = _words(lower)
    # An empty paragraph is split into one empty word.
    count = np.where(pc.equal(lower, "").to_numpy(zero_copy_only=False), 0, np.diff(bounds))
    words = words[np.repeat(count > 0, np.diff(bounds))]
    real = np.flatnonzero(count > 0)
    sizes_of, text = count[real], owner[real]
    upto = np.concatenate([[0], np.cumsum(sizes_of)])
    last = np.searchsorted(upto, upto[:-1] + SHINGLE) - 1
    short = sizes_of < SHINGLE
    # Short ones in a row are one stretch, which a window doesn't leave; each other paragraph is its own.
    joined = short[1:] & short[:-1] & (text[1:] == text[:-1])
    stretch = np.cumsum(np.concatenate([[True], ~joined])[: len(real)])
    kept = np.flatnonzero((last < len(real)) & (stretch[np.minimum(last, len(real) - 1)] == stretch))
    last, begins = last[kept], upto[kept]
    own = upto[last + 1] - begins
    at = begins - upto[np.searchsorted(text, text)][kept]
    texts_of, first = text[kept], real[kept]
    banded = (own >= LONG) & ~short[kept]
    # Sets can be equal without the words being so only if they recur.
    for step in range(1, LONG - SHINGLE + 1):
        banded |= (words[begins] == words[begins + step]) & ~short[kept]
    high, low, keys = _hashed(words, begins, own, banded & banding)
    seq = np.arange(len(kept)) - np.searchsorted(texts_of, texts_of)
    return {
        "text": texts_of, "seq": seq, "start": starts[first], "end": (starts + sizes)[real[last]], "at": at, "words": own,
        "high": high, "low": low, "long": banded, "bands": keys, "paragraph": lower.take(pa.array(first)),
    }


def whole(texts: pa.Array) -> tuple[np.ndarray, pa.ListArray, pa.Array]:
    """Whole texts as ``links`` takes paragraphs: a hash, bands and words; a text of fewer than five words has no bands."""
    lower = pc.ascii_trim_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    words, bounds = _words(lower)
    own = np.diff(bounds)
    high, low, keys = _hashed(words, bounds[:-1], own, own >= SHINGLE)
    return low, keys, lower


def _hashed(words: np.ndarray, begins: np.ndarray, own: np.ndarray, banded: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """Two hashes of each piece of ``own`` words from ``begins`` on, and the bands of those that are ``banded``."""
    longest = int(own.max(initial=0))
    heads = np.cumsum(own) - own
    place = np.arange(int(own.sum())) - np.repeat(heads, own)
    chosen = words[np.repeat(begins, own) + place]
    high, low = (np.add.reduceat(_mix(chosen + _constants(longest, salt)[place]), heads) if len(heads) else chosen for salt in (1, 2))
    signatures = _bands(chosen, heads[banded], own[banded], *bands(FIRST))
    offsets = np.concatenate([[0], np.cumsum(np.where(banded, signatures.shape[1], 0))]).astype(np.int32)
    return _mix(high + own.astype(np.uint64)), _mix(low), pa.ListArray.from_arrays(pa.array(offsets), pa.array(signatures.ravel().view(np.int64)))


def _words(paragraphs_of: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and where each paragraph's begin."""
    lists = pc.ascii_split_whitespace(paragraphs_of).cast(pa.large_list(pa.large_string()))
    coded = pc.dictionary_encode(lists.values)
    digest = xxhash.xxh64_intdigest
    by_word = np.array([digest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], dtype=np.uint64)
    words = by_word[coded.indices.to_numpy(zero_copy_only=False)] if len(by_word) else np.empty(0, dtype=np.uint64)
    return words, np.asarray(lists.offsets)


def _bands(words: np.ndarray, heads: np.ndarray, counts: np.ndarray, number: int, rows: int) -> np.ndarray:
    """The band keys of each paragraph: hashes of the least values of a few functions over its sets of words."""
    if not len(heads):
        return np.empty((0, number), dtype=np.uint64)
    sets, first = _sets(words, heads, counts)
    factors, keys = _constants(number * rows, 4), np.empty((len(heads), number), dtype=np.uint64)
    for band in range(number):
        key = np.full(len(heads), band + 1, dtype=np.uint64) * _ODD
        for row in range(rows):
            least = np.minimum.reduceat(_mix(sets * factors[band * rows + row]), first)
            key = _mix(key * _ODD + least)
        keys[:, band] = key
    return keys


def _sets(words: np.ndarray, heads: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all five words in a row, and where each paragraph's begin."""
    n = counts - SHINGLE + 1
    first = np.cumsum(n) - n
    at = np.repeat(heads, n) + np.arange(int(n.sum())) - np.repeat(first, n)
    sets = np.zeros(len(at), dtype=np.uint64)
    for j, c in enumerate(_constants(SHINGLE, 3)):
        sets += words[at + j] * c
    return _mix(sets), first


def _sketches(words: np.ndarray, heads: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of different sets of each paragraph, and 128 bits of which each set flips one.

    Two sketches differ in as many bits as there are sets in one paragraph only, or in fewer.
    """
    if not len(heads):
        return np.empty(0, dtype=np.int32), np.empty((0, 2), dtype=np.uint64)
    sets, first = _sets(words, heads, counts)
    owner = np.repeat(np.arange(len(heads)), counts - SHINGLE + 1)
    order = np.lexsort((sets, owner))
    own = sets[order]
    # Sorted by paragraph first, so each one's sets stay where they were as a whole.
    again = np.concatenate([[False], (own[1:] == own[:-1]) & (owner[1:] == owner[:-1])])
    bit = np.where(again, np.uint64(0), np.uint64(1) << (own & np.uint64(63)))
    upper = (own >> np.uint64(6)) & np.uint64(1) == 1
    halves = [np.bitwise_xor.reduceat(np.where(side, bit, np.uint64(0)), first) for side in (~upper, upper)]
    return np.add.reduceat(~again, first, dtype=np.int32), np.stack(halves, axis=1)


def units(docs: DataFrame) -> DataFrame:
    """One row per paragraph of at least five words or window of shorter ones; long ones with their bands. Stored."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            step = max(1, len(texts) * SLICE_BYTES // max(SLICE_BYTES, texts.nbytes))
            for begin in range(0, len(texts), step):
                some = batch.slice(begin, step)
                found = described(some.column("text"))
                owner = pa.array(found["text"])
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("row").take(owner), some.column("doc_id").take(owner),
                        *(pa.array(found[c].astype(np.int32)) for c in ("seq", "start", "end", "at", "words")),
                        *(pa.array(found[c].view(np.int64)) for c in ("high", "low")),
                        found["bands"],
                    ],
                    names=["row", "doc_id", "seq", "start", "end", "at", "words", "high", "low", "bands"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"row bigint, doc_id {kind}, seq int, start int, end int, at int, words int, high bigint, low bigint, bands array<bigint>"
    )
    rows = pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return stored(rows.mapInArrow(cut, schema), "paragraphs")


def long_texts(docs: DataFrame) -> DataFrame:
    """``(low, paragraph)`` of the paragraphs that have bands, once per slice, cut once more so that no table of all texts is kept."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            step = max(1, len(texts) * SLICE_BYTES // max(SLICE_BYTES, texts.nbytes))
            for begin in range(0, len(texts), step):
                found = described(texts.slice(begin, step), banding=False)
                whole = np.flatnonzero(found["long"])
                # Each once, since the copies of all texts would meet in one task.
                whole = whole[np.unique(found["low"][whole], return_index=True)[1]]
                columns = [pa.array(found["low"].view(np.int64)[whole]), found["paragraph"].take(pa.array(whole)).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["low", "paragraph"])

    return pick(docs, "text").mapInArrow(cut, "low bigint, paragraph string")


def similarity(a: str, b: str) -> float:
    """Jaccard similarity of the sets of five words in a row."""
    x, y = ({tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``(a, b)``: the classes of those of ``pairs(a, b, a_root, b_root)`` that are similar."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similarity(x, y) >= SIMILAR for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a_root", "b_root"]).filter(pa.array(ok, pa.bool_())).rename_columns(["a", "b"])

    x, y = (texts.select(F.col("low").alias(n), F.col("paragraph").alias(t)) for n, t in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a_root", "b_root", "x", "y").mapInArrow(check, "a bigint, b bigint")


def _crowded(banded: DataFrame) -> DataFrame:
    """The rows of ``banded(band, low, …)`` whose band has several paragraphs."""
    crowded = banded.groupBy("band").agg(F.min("low").alias("a"), F.max("low").alias("b")).filter("a <> b").select("band")
    return banded.join(stored(crowded, "crowded"), "band", "left_semi")


def _second_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paragraph = batch.column("paragraph").cast(pa.large_string())
        words, bounds = _words(paragraph)
        keys = _bands(words, bounds[:-1], np.diff(bounds), *bands(SECOND))
        offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1])
        lists = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64)))
        sets, sketch = _sketches(words, bounds[:-1], np.diff(bounds))
        # Where ``similarity`` sees other words, nothing is known of the sets.
        sets = pa.array(sets, mask=pc.match_substring_regex(paragraph, OTHER_BLANKS).to_numpy(zero_copy_only=False))
        columns = [batch.column("low"), batch.column("n"), sets, *(pa.array(sketch[:, i].view(np.int64)) for i in (0, 1)), lists]
        yield pa.RecordBatch.from_arrays(columns, names=["low", "n", *SKETCH, "bands"])


def links(parts: DataFrame, all_texts: DataFrame) -> DataFrame | None:
    """``(node, root)``: the classes of paragraphs that are similar to others without being equal; None if none are.

    ``parts`` has the columns ``low`` and ``bands``, ``all_texts`` has ``low`` and ``paragraph``.

    The first bands are few and wide, so they are cheap for all paragraphs. The
    paragraphs that share one get many narrow bands, which pairs far below the
    threshold hardly ever share.
    """
    long_ones = parts.filter(F.size("bands") > 0)
    banded = long_ones.select("low", F.explode("bands").alias("band"))
    copies = _crowded(banded).groupBy("band", "low").agg(F.count(F.lit(1)).alias("n"))
    survivors = copies.groupBy("low").agg(F.max("n").alias("n"))
    survivors = stored(survivors, "survivors")
    texts = stored(all_texts.join(survivors, "low").dropDuplicates(["low"]), "texts")
    discard(survivors)
    second = texts.select("low", "n", "paragraph").mapInArrow(
        _second_bands, "low bigint, n bigint, sets int, s0 bigint, s1 bigint, bands array<bigint>"
    )
    narrow = stored(second, "bands")
    of_bands = F.explode("bands").alias("band")
    # Near copies share almost all of their bands. A few bands bring most of them together, and so spare the others.
    trial = stored(_crowded(narrow.select("low", "n", *SKETCH, F.explode(F.slice("bands", 1, TRIAL)).alias("band"))).withColumn("root", F.col("low")), "members")
    roots = None if trial.isEmpty() else _joined(_met(trial, _leaders(trial, 1)), texts, None)
    round_of = stored(_open(_rooted(narrow.select("low", "n", *SKETCH, of_bands), roots)), "members")
    discard(narrow, trial)
    members, per_band = round_of, 1
    while not members.isEmpty():
        leaders = _leaders(members, per_band)
        roots = _joined(_met(members, leaders), texts, roots)
        rest = members.drop("root").join(leaders.select("band", F.col("b").alias("low")), ["band", "low"], "left_anti")
        members = stored(_open(_rooted(rest, roots)), "members")
        discard(round_of)
        round_of = members
        per_band *= GROWTH
    discard(texts, round_of)
    return roots


def _leaders(members: DataFrame, per_band: int) -> DataFrame:
    """``(band, b, b_root, …)``: up to ``per_band`` leaders of each band, the most copied paragraph of each slot: the others are often its variants."""
    slot = F.pmod(F.xxhash64("low"), F.lit(per_band))
    leaders = members.groupBy("band", slot.alias("slot")).agg(F.max(F.struct("n", "low", "root", *SKETCH)).alias("first"))
    return leaders.select("band", F.col("first.low").alias("b"), *[F.col(f"first.{c}").alias(f"b_{c}") for c in ("root", *SKETCH)])


def _met(members: DataFrame, leaders: DataFrame) -> DataFrame:
    """``(a, b, a_root, b_root)``: the members of a band with its leaders of other classes, once each, and the two classes.

    Leaders of one band meet from both sides, so the smaller paragraph and the smaller class come first.

    Of sets that are similar few enough are in one of them only, and the sketches show at least some of these. Variants of
    one paragraph that share bands and are not similar mostly part here, in the join, and never become rows.
    """
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"b_{c}"))) for c in SKETCH[1:]), F.lit(0))
    near = apart * (1 + SIMILAR) <= (F.col("sets") + F.col("b_sets")) * (1 - SIMILAR) + 1e-6
    pairs = members.join(leaders, "band").filter((F.col("root") != F.col("b_root")) & F.coalesce(near, F.lit(True)))
    ends = (("a", "b", "low", "b"), ("a_root", "b_root", "root", "b_root"))
    return pairs.select(*[f(x, y).alias(n) for m, n, x, y in ends for f, n in ((F.least, m), (F.greatest, n))]).distinct()


def _joined(pairs: DataFrame, texts: DataFrame, roots: DataFrame | None) -> DataFrame | None:
    """The classes ``roots(node, root)`` after those of ``pairs`` that are similar are linked. Only classes that change are looked at."""
    new = stored(_linked(pairs, texts), "links")
    if new.isEmpty():
        return roots
    found = components(new)
    discard(new)
    if roots is None:
        return found
    moved = roots.join(found.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    # A class of one paragraph has no row so far.
    alone = found.join(roots, "node", "left_anti")
    return stored(moved.select("node", F.coalesce("to", "root").alias("root")).unionByName(alone), "roots")


def _rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return members.withColumn("root", F.col("low"))
    return members.join(roots.withColumnRenamed("node", "low"), "low", "left").withColumn("root", F.coalesce("root", "low"))


def _open(rooted: DataFrame) -> DataFrame:
    """The members of the bands that have several classes, which go on."""
    crowded = rooted.groupBy("band").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("band")
    return rooted.join(stored(crowded, "crowded"), "band", "left_semi").select("band", "low", "n", "root", *SKETCH)


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``(doc_id, start, end, words, removed, class_id, first_doc_id)`` of every repeated passage.

    ``start`` and ``end`` are characters of the text. ``removed`` says that it
    is a later copy; the first one is listed too. ``class_id`` is the class of
    the passage's longest paragraph and ``first_doc_id`` the document that has
    that class first.
    """
    parts = units(docs)
    narrow = parts.select("row", "doc_id", "seq", "start", "end", "at", "words", "high", "low")
    roots = links(parts, long_texts(docs))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "seq")
    # Equal paragraphs are equal in both hashes; linked ones have a common root.
    by_hash = narrow.groupBy("low", "high").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("r"))
    if roots is None:
        classes = by_hash.filter("n > 1").select("low", "high", F.col("low").alias("class_id"))
    else:
        named = by_hash.join(roots.withColumnRenamed("node", "low"), "low", "left")
        classes = named.filter("n > 1 OR root IS NOT NULL").select("low", "high", F.coalesce("root", "low").alias("class_id"))
    repeated = stored(narrow.join(stored(classes, "classes"), ["low", "high"]).drop("low", "high"), "repeated")
    first = stored(repeated.groupBy("class_id").agg(F.min(place).alias("first")), "first")
    marked = repeated.join(first, "class_id").withColumn("removed", (F.col("first.row") != F.col("row")) | (F.col("first.seq") != F.col("seq")))
    by_place = Window.partitionBy("row").orderBy("seq")
    breaks = (F.col("seq") - F.lag("seq", 1).over(by_place) == 1) & (F.col("removed") == F.lag("removed", 1).over(by_place))
    runs = marked.withColumn("new", F.when(F.coalesce(breaks, F.lit(False)), 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    longest = F.max(F.struct("words", F.col("class_id"), F.col("first.doc_id").alias("doc_id")))
    passages = runs.groupBy("row", "doc_id", "run", "removed").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max(F.col("at") + F.col("words")) - F.min("at")).cast("bigint").alias("words"), longest.alias("longest")
    )
    return passages.filter(F.col("words") >= least).select(
        "doc_id", "start", "end", "words", "removed", F.col("longest.class_id").alias("class_id"), F.col("longest.doc_id").alias("first_doc_id")
    )
