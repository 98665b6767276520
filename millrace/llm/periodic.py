"""Periodic runs of words within a document: a stretch that repeats its first words at least four times.

A run is a stretch of consecutive words whose smallest period is q (words q
apart are identical), that has at least ``max(6, 4 q)`` words, and that no
neighbouring word extends keeping the period.

Seeds: the words of a run agree with the words q further on over at least
``max(6, 4 q) - q`` places. The lags are taken in classes (1, 2, 3-4, 5-8, ...);
in each class k is the least of these overlaps, so every run of the class holds
a k-gram at some place and again q words later. As k is no less than q, and a
run's first q words are not periodic themselves, no copy of the k-gram lies in
between: only occurrences that follow one another in a document are looked at,
n of them and not all pairs. K-grams get exact numbers by prefix doubling, a
k-gram from two shorter ones that overlap; places whose shorter k-gram occurs
once take no further part.

Extension: a pair of occurrences is a point on the diagonal of its lag and is
extended along it both ways. Seeds come in the order of the text, and a table
holds for each lag how far its diagonal is covered, so a run is walked once.

Words are those of ``[^\\x20\\x09-\\x0D]+``. Null text, empty text and text without
a word have no runs; the collapsed text of a null text is empty. A null
``doc_id`` is an ordinary value here. Repeated rows are rows of their own. An
empty table gives an empty result. Other columns are left out.

A text is worked on as a whole by one task, in a few arrays of a long per word;
small texts are worked on together.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD, pick

#: A run has so many periods, and so many words, at least.
PERIODS, LEAST = 4, 6
#: Characters worked on at a time.
SLICE_BYTES = 4 << 20

RUN = "struct<start:bigint,length:bigint,period:bigint>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def lag_classes(most: int) -> Iterator[tuple[int, int, int]]:
    """``(lowest lag, highest lag, k)`` up to the lag ``most``."""
    low, high = 1, 1
    while low <= most:
        yield low, high, min(max(LEAST, PERIODS * q) - q for q in range(low, min(high, low + LEAST) + 1))
        low, high = high + 1, 2 * high


def _numbers(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number per distinct key, and which keys occur more than once."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return inverse, counts[inverse] > 1


class Grams:
    """Numbers of the k-grams of a sequence, at the places whose k-gram occurs at least twice."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        number, again = _numbers(words)
        self.k = 1
        self._keep(np.flatnonzero(again), number[again])

    def _keep(self, places: np.ndarray, numbers: np.ndarray) -> None:
        self.places, self.numbers = places, numbers
        self.at = np.full(self.n + 1, -1, dtype=np.int64)
        self.at[places] = numbers

    def lengthen(self, k: int) -> None:
        """Go on to k-grams, at most twice as long as now."""
        while self.k < k and len(self.places):
            step = min(k, 2 * self.k) - self.k
            places = self.places[self.places + step < self.n]
            first, second = self.at[places], self.at[places + step]
            both = second >= 0
            places = places[both]
            number, again = _numbers(first[both] * self.n + second[both])
            self._keep(places[again], number[again])
            self.k += step
        self.k = k

    def neighbours(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """``(place, lag)`` of occurrences that follow one another, ``low`` to ``high`` words apart."""
        order = np.argsort(self.numbers, kind="stable")
        places, numbers = self.places[order], self.numbers[order]
        lags = np.diff(places)
        near = (np.diff(numbers) == 0) & (lags >= low) & (lags <= high)
        return places[:-1][near], lags[near]


def _agree(words: np.ndarray, a: int, lag: int, step: int) -> int:
    """How many places from ``a`` on, forwards or backwards, hold the word that stands ``lag`` further on."""
    done, size = 0, 64
    while True:
        if step > 0:
            end = min(a + done + size, len(words) - lag)
            same = words[a + done : end] == words[a + done + lag : end + lag]
        else:
            begin = max(a - done - size + 1, 0)
            same = (words[begin : a - done + 1] == words[begin + lag : a - done + 1 + lag])[::-1]
        wrong = np.flatnonzero(~same)
        if len(wrong):
            return done + int(wrong[0])
        done += len(same)
        if len(same) < size:
            return done
        size = min(2 * size, 1 << 16)


def runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of a sequence of numbers, by start and period."""
    found, grams = [], Grams(words)
    for low, high, k in lag_classes(len(words) // PERIODS):
        grams.lengthen(k)
        if not len(grams.places):
            break
        places, lags = grams.neighbours(low, high)
        order = np.lexsort((places, lags))
        covered, of = 0, 0
        for place, lag in zip(places[order].tolist(), lags[order].tolist(), strict=True):
            if lag != of:
                covered, of = 0, lag
            if place < covered:
                continue
            start = place - _agree(words, place - 1, lag, -1) if place else 0
            covered = place + _agree(words, place, lag, 1)
            length = covered + lag - start
            if length >= max(LEAST, PERIODS * lag):
                found.append((start, length, lag))
    return sorted(found, key=lambda r: (r[0], r[2]))


def of_texts(texts: list[bytes | None]) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words and runs of each text. The texts stand in one sequence, each followed by a number that occurs once."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    split = [t.split() if t else [] for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    ends = np.cumsum(sizes + 1)
    sequence = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    at = 0
    for i, words in enumerate(split):
        # The counter goes on, so that a k-gram of another text is another one.
        number.clear()
        sequence[at : at + len(words)] = [number[w] for w in words]
        sequence[at + len(words)] = -1 - i
        at += len(words) + 1
    of: list[list[tuple[int, int, int]]] = [[] for _ in split]
    for start, length, period in runs(sequence):
        i = int(np.searchsorted(ends, start, side="right"))
        of[i].append((start - int(ends[i] - sizes[i] - 1), length, period))
    yield from zip(split, of, strict=True)


def kept(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that stand in no run after its first period, joined by one space."""
    if found:
        gone = np.zeros(len(words), dtype=bool)
        for start, length, period in found:
            gone[start + period : start + length] = True
        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    return b" ".join(words)


def periodic(docs: DataFrame) -> DataFrame:
    """``(doc_id, runs, collapsed)``: every run of each text, and the text with each run cut to its first period."""

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            step = max(1, len(texts) * SLICE_BYTES // max(SLICE_BYTES, texts.nbytes))
            for first in range(0, len(texts), step):
                some = texts.slice(first, step).cast(pa.large_binary()).to_pylist()
                listed, collapsed = [], []
                for words, found in of_texts(some):
                    listed.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                    collapsed.append(kept(words, found))
                columns = [pa.array(listed, pa.list_(_RUN)), pa.array(collapsed, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, step), *columns], names=["doc_id", "runs", "collapsed"])

    rows = pick(docs, "doc_id", "text")
    return rows.mapInArrow(worked, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, runs array<{RUN}>, collapsed string")


def with_echo(doc_id: Column, text: Column) -> Column:
    """The text, or for every tenth checksum of an id its words with a period from some word on (see the query)."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def rewritten(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        # Bound once, as an argument of its own, and not computed for every word.
        place = F.struct(a.alias("a"), p.alias("p"))
        repeat = lambda at: F.array_join(
            F.transform(words, lambda w, i: F.when(i < at["a"], w).otherwise(F.get(words, at["a"] + (i - at["a"]) % at["p"]))), " "
        )
        return F.element_at(F.transform(F.array(place), repeat), 1)

    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    some = F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, rewritten(ws)).otherwise(""))
    return F.when(h % 10 == 0, F.element_at(some, 1)).otherwise(text)


def longest(found: Column) -> Column:
    """The run with the greatest length by period; of equal ones the first, then the one with the smallest period."""

    def better(best: Column, run: Column) -> Column:
        # Runs come by start and period, so a later one has to be greater.
        greater = best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
        return F.when(greater, run).otherwise(best)

    return F.reduce(found, F.lit(None).cast(RUN), better)


def digests(docs: DataFrame) -> DataFrame:
    """The runs of ``docs`` with ``with_echo``, per document as numbers and checksums."""
    rows = pick(docs, "doc_id", "text")
    echoed = rows.select("doc_id", with_echo(F.col("doc_id"), F.col("text")).alias("text"))
    best = periodic(echoed).withColumn("best", longest(F.col("runs")))
    line = F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return best.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
