"""The language of whole texts, also where it changes within them.

A word's script says which languages come into question. Among these, hashed
character n-grams of the word give a score per language, learned from labelled
documents, and the best path of languages through all words of a text, with a
penalty for every change (Viterbi), labels spans. A text's language is the one
whose spans hold most letters.

Learned from are at most ``SAMPLE`` documents per language, those with the
smallest hash of their id, each id once; the model has a row of ``BUCKETS`` numbers per
language. Everything else covers all texts and whole texts. Null texts and
texts without a letter are ``und`` with score 0, and so is everything if
nothing is labelled. Texts in scripts that no learned language uses have score 0.
Ties go to the language first by name. Repeated rows are
labelled alike, null ids teach nothing and are not held out. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import pick, plain

SAMPLE = 2_000
#: Hashes are counted by so many upper bits to find where a language's sample ends.
STRETCH_BITS = 12
BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
#: N-grams of a word overlap, so each counts as part of an independent one.
WEIGHT = 0.4
SWITCH = 12.0
#: A script is possible for a language if at least this share of its sample's words use it.
SCRIPT_SHARE = 0.001
IMPOSSIBLE = -8.0
#: Texts below this score have no known language; half of a text in one language is far above it.
LEAST = 0.2
UNKNOWN = "und"
#: Text that is worked on at a time, and words whose n-grams are.
SLICE_BYTES = 2 << 20
SLICE_WORDS = 50_000

# First and last code points of scripts, from the Unicode block list.
SCRIPTS = (
    (0x0041, 0x024F, "latin"), (0x0250, 0x02FF, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"), (0x0600, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"), (0x0A00, 0x0A7F, "gurmukhi"), (0x0A80, 0x0AFF, "gujarati"), (0x0B80, 0x0BFF, "tamil"),
    (0x0C00, 0x0C7F, "telugu"), (0x0C80, 0x0CFF, "kannada"), (0x0D00, 0x0D7F, "malayalam"), (0x0E00, 0x0E7F, "thai"),
    (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"), (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"),
    (0x3040, 0x30FF, "kana"), (0x3400, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"), (0xF900, 0xFAFF, "han"),
)
_NAMES = sorted({name for _, _, name in SCRIPTS})
_STARTS = np.array([first for first, _, _ in SCRIPTS])
_ENDS = np.array([last for _, last, _ in SCRIPTS])
_SCRIPT = np.array([_NAMES.index(name) for _, _, name in SCRIPTS])
OTHER_SCRIPT = len(_NAMES)


def scripts(code_points: np.ndarray) -> np.ndarray:
    """The script number of each code point; those outside the table share the last number."""
    at = np.searchsorted(_STARTS, code_points, side="right") - 1
    return np.where((at >= 0) & (code_points <= _ENDS[at]), _SCRIPT[at], OTHER_SCRIPT)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words in lower case, the place of each word of the texts among them, and words per text."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, r"[^\p{L}\p{M}]+", " "))
    # Pieces without a letter are left out: lone marks, and the empty ones at the ends of a text.
    coded = pc.dictionary_encode(lists.values)
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lettered = pc.match_substring_regex(coded.dictionary, r"\p{L}").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    real = lettered[index] if len(index) else np.zeros(0, dtype=bool)
    return coded.dictionary, index[real], np.bincount(owner[real], minlength=len(lists))


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in parts of about ``SLICE_BYTES``."""
    step = max(1, len(texts) * SLICE_BYTES // max(SLICE_BYTES, texts.nbytes))
    return (texts.slice(i, step) for i in range(0, len(texts), step))


def ngrams(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, the word of each, and the first code point of each word."""
    texts = words.to_pylist()
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in texts).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    sizes = np.array(list(map(len, texts)), dtype=np.int64) + 2
    owner = np.repeat(np.arange(len(texts)), sizes)
    hashes, owners = [], []
    rolling = np.zeros(len(points), dtype=np.uint64)
    for n in ORDERS:
        shift = n - 1
        rolling = rolling[: len(points) - shift] * np.uint64(0x9E3779B97F4A7C15) + points[shift:] + np.uint64(n)
        same = owner[: len(points) - shift] == owner[shift:]
        mixed = rolling ^ (rolling >> np.uint64(29))
        hashes.append(((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48))[same].astype(np.int64) % BUCKETS)
        owners.append(owner[: len(points) - shift][same])
    starts = np.cumsum(sizes) - sizes
    first = points[np.minimum(starts + 1, len(points) - 1)] if len(texts) else points
    return np.concatenate(hashes), np.concatenate(owners), first.astype(np.int64)


@dataclass
class Model:
    """``weights[bucket, language]`` and which scripts each language uses."""

    languages: list[str]
    weights: np.ndarray
    uses: np.ndarray

    @classmethod
    def from_counts(cls, languages: list[str], counts: np.ndarray, script_counts: np.ndarray) -> Model:
        """Counts per language and bucket, and words per language and script."""
        if not languages:
            return cls(languages, np.zeros((BUCKETS, 0), dtype=np.float32), np.zeros((OTHER_SCRIPT + 1, 0), dtype=bool))
        logs = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).T
        share = script_counts / np.maximum(1, script_counts.sum(axis=1, keepdims=True))
        return cls(languages, (WEIGHT * (logs - logs.mean(axis=1, keepdims=True))).astype(np.float32), (share >= SCRIPT_SHARE).T)

    def scores(self, words: pa.Array) -> np.ndarray:
        """A row of scores per word, their mean 0; languages that don't use the word's script are far behind."""
        parts = [self._scores(words.slice(i, SLICE_WORDS)) for i in range(0, len(words), SLICE_WORDS)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), dtype=np.float32)

    def known(self, words: pa.Array) -> np.ndarray:
        """Whether any language uses the word's script."""
        first = np.array([ord(w[0]) if w else 0 for w in words.to_pylist()], dtype=np.int64)
        return self.uses[scripts(first)].any(axis=1)

    def _scores(self, words: pa.Array) -> np.ndarray:
        hashes, owner, first = ngrams(words)
        count = len(self.languages)
        scores = np.stack([np.bincount(owner, weights=self.weights[hashes, k], minlength=len(words)) for k in range(count)], axis=1)
        possible = self.uses[scripts(first)]
        none = ~possible.any(axis=1, keepdims=True)
        scores = np.where(possible, scores, IMPOSSIBLE)
        return np.where(none, 0.0, scores).astype(np.float32)


def best_paths(scores: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each word on the best path of its text; texts one after the other, ``sizes`` words each.

    All texts take a step together, the longest first in order, so that those
    that have ended are at the end of the arrays.
    """
    languages = scores.shape[1]
    order = np.argsort(-sizes, kind="stable")
    ordered, starts = sizes[order], (np.cumsum(sizes) - sizes)[order]
    longest = int(ordered[0]) if len(ordered) else 0
    running = np.searchsorted(-ordered, -np.arange(longest), side="left")
    path = np.zeros(len(scores), dtype=np.uint8)
    came: list[np.ndarray] = []
    state = scores[starts[: running[0]]].copy() if longest else scores[:0]
    stay = np.arange(languages, dtype=np.uint8)
    final = np.zeros(len(sizes), dtype=np.uint8)
    for t in range(1, longest):
        n = running[t]
        if n < len(state):
            final[n : len(state)] = state[n:].argmax(axis=1)
            state = state[:n]
        best = state.argmax(axis=1)
        changed = state[np.arange(n), best] - switch
        change = changed[:, None] > state
        came.append(np.where(change, best[:, None], stay).astype(np.uint8))
        state = np.where(change, changed[:, None], state) + scores[starts[:n] + t]
    if longest:
        final[: len(state)] = state.argmax(axis=1)
    now = final.copy()
    for t in range(longest - 1, -1, -1):
        n = running[t]
        path[starts[:n] + t] = now[:n]
        if t:
            now[:n] = came[t - 1][np.arange(n), now[:n]]
    return path


def labelled(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text.

    The score is the share of letters in spans of that language, times the
    probability of the language by the scores of all words. Letters of scripts that
    no learned language uses are in no span.
    """
    words, index, sizes = split(texts)
    count = len(model.languages)
    if not len(index) or not count:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    by_word = model.scores(words)
    letters = pc.utf8_length(words).to_numpy(zero_copy_only=False)[index].astype(np.float64)
    scores = by_word[index]
    path = best_paths(scores, sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    spoken = np.where(model.known(words)[index], letters, 0)
    held = np.bincount(owner * count + path, weights=spoken, minlength=len(sizes) * count).reshape(-1, count)
    total = np.stack([np.bincount(owner, weights=scores[:, k], minlength=len(sizes)) for k in range(count)], axis=1)
    # Equal shares go to the language with the better score.
    best = np.where(held == held.max(axis=1, keepdims=True), total, -np.inf).argmax(axis=1)
    rows = np.arange(len(sizes))
    odds = np.exp(total - total.max(axis=1, keepdims=True))
    # Spans of another language may outweigh a text's own by score; the path decides, so its odds count within its span.
    sure = np.maximum(odds[rows, best] / odds.sum(axis=1), np.where(held[rows, best] > 0, _span_odds(scores, path, owner, best, len(sizes)), 0))
    score = held[rows, best] / np.maximum(1, np.bincount(owner, weights=letters, minlength=len(sizes))) * sure
    names = [model.languages[b] if n else UNKNOWN for b, n in zip(best, sizes, strict=True)]
    return names, np.where(sizes > 0, np.clip(score, 0, 1), 0)


def _span_odds(scores: np.ndarray, path: np.ndarray, owner: np.ndarray, best: np.ndarray, texts: int) -> np.ndarray:
    """The probability of the chosen language by the words of its own spans."""
    own = path == best[owner]
    total = np.stack([np.bincount(owner[own], weights=scores[own, k], minlength=texts) for k in range(scores.shape[1])], axis=1)
    odds = np.exp(total - total.max(axis=1, keepdims=True))
    return odds[np.arange(texts), best] / odds.sum(axis=1)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept out of learning, by the checksum of its id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounds(hashed: DataFrame, sample: int) -> DataFrame:
    """``(lang, bound)``: the hash up to which ``sample`` rows of each language lie, its greatest one if it has fewer.

    Rows are counted by the upper bits of their hashes first, so only those of
    the stretch in which the sample ends, and of those before, are ordered,
    however many rows a language has.
    """
    stretch = F.shiftright("h", 64 - STRETCH_BITS)
    counts = hashed.groupBy("lang", stretch.alias("stretch")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lowest = counts.withColumn("before", before).filter(F.col("before") < sample).groupBy("lang").agg(F.max("stretch").alias("last"))
    some = hashed.withColumn("stretch", stretch).join(lowest, "lang").filter("stretch <= last")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return some.withColumn("place", place).filter(F.col("place") <= sample).groupBy("lang").agg(F.max("h").alias("bound"))


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit the model to labelled documents that are not held out, at most ``sample`` per language."""
    usable = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out())
    hashed = usable.withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    # Which documents is decided by hashes alone; only the chosen ones' texts move.
    chosen = hashed.join(bounds(hashed.select("lang", "h"), sample), "lang").filter(F.col("h") <= F.col("bound")).dropDuplicates(["lang", "h"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            names = batch.column("lang")
            for lang in names.unique().to_pylist():
                own = sums.setdefault(lang, [np.zeros(BUCKETS), np.zeros(OTHER_SCRIPT + 1)])
                for texts in slices(batch.column("text").filter(pc.equal(names, lang))):
                    words, index, _ = split(texts)
                    times = np.bincount(index, minlength=len(words)).astype(np.float64)
                    for i in range(0, len(words), SLICE_WORDS):
                        hashes, owner, first = ngrams(words.slice(i, SLICE_WORDS))
                        some = times[i : i + SLICE_WORDS]
                        own[0] += np.bincount(hashes, weights=some[owner], minlength=BUCKETS)
                        own[1] += np.bincount(scripts(first), weights=some, minlength=OTHER_SCRIPT + 1)
        for lang, (grams, by_script) in sums.items():
            both = np.concatenate([grams, by_script])
            at = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(both[at])], names=["lang", "at", "n"])

    parts = chosen.select("lang", "text").mapInArrow(counted, "lang string, at bigint, n double")
    rows = parts.groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    names = rows["lang"].to_numpy()
    languages = sorted(set(names))
    counts = np.zeros((len(languages), BUCKETS + OTHER_SCRIPT + 1))
    if languages:
        counts[np.searchsorted(languages, names.astype(str)), rows["at"].to_numpy()] = rows["n"].to_numpy()
    return Model.from_counts(languages, counts[:, :BUCKETS], counts[:, BUCKETS:])


def predict(model: Model, docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the columns ``lang_pred`` and ``score`` for the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for texts in slices(batch.column(at)):
                names, scores = labelled(model, texts)
                columns = [c.slice(first, len(texts)) for c in batch.columns]
                first += len(texts)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores)], names=columns_out)

    at, columns_out = docs.columns.index(text), [*docs.columns, "lang_pred", "score"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every document."""
    rows = pick(docs, "doc_id", "text", "lang")
    shown = predict(learn(rows), rows.select("doc_id", held_out().alias("held_out"), "text"), "text")
    return shown.select("doc_id", "held_out", "lang_pred", "score")


def accepted(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of at least ``least``, with all their columns."""
    model = learn(pick(docs, "doc_id", "text", "lang"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for texts in slices(batch.column(at)):
                names, scores = labelled(model, texts)
                kept = [name != UNKNOWN and score >= least for name, score in zip(names, scores.tolist(), strict=True)]
                some = batch.slice(first, len(texts))
                first += len(texts)
                yield some if all(kept) else some.filter(pa.array(kept, pa.bool_()))

    rows, at = plain(docs), docs.columns.index("text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(chosen, kinds).toDF(*docs.columns)
