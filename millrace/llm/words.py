"""Token ids of whole texts, from the tokenizers library, with every distinct piece of text encoded once.

Natural text repeats its words, and encoding is by far the dearest step. A text
is therefore cut where the tokenizer cuts for certain, Arrow finds the distinct
pieces of a batch, and the library encodes those that are not known yet. Texts
in which a certain cut can't be told are encoded whole. The ids are those of
``encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: Pieces remembered by one Python worker (some 110 MB); beyond it the memory starts anew, which costs time and changes no id.
REMEMBERED = 600_000

# Plain texts hold letters, digits, single full stops and commas, and one blank or line end between words. Marked ones
# may hold other signs, in runs, but no apostrophe. All others are taken apart one by one.
_NOT_PLAIN_WORDS = r"[^\p{L}\p{N} \n.,]|[.,][.,]"
_NOT_PLAIN_BYTES = r"[^\p{L}\p{N} \n.,]|[.,][.,]|[ \n][ \n.,]|[ \n]$|^[ \n]"
_NOT_MARKED_WORDS = r"[^ -~\n\x{a1}-\x{12f}]|'|<\|"
_NOT_MARKED_BYTES = r"[^ -~\n\x{a1}-\x{12f}]|'|<\||[ \n][ \n]|[ \n]$|^[ \n]"
_SPACE, _LINE = "\x02", "\x03"
# White space that libraries class differently, the marks used here, and what may be a special token: encoded whole.
_UNCERTAIN = regex.compile(r"[\x02\x03\x1c-\x1f\x85\u180e]|<\|")
# How the two kinds of vocabulary cut a text, as their public files and descriptions state it.
_CUTS_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_CUTS_BYTES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Below it, lower case and composition change one character at a time and alike in every library.
_LATIN_END = "\u0130"
_LATIN = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")


def _byte_chars() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(other)) for b in range(256)}


_BYTE_CHARS = _byte_chars()


def _changing_letters() -> str:
    """Letters and digits of which composition or lower case makes several characters or a mark, as a class of a pattern."""
    found = []
    for c in map(chr, itertools.chain(range(0x80, 0xD800), range(0xE000, 0x30000))):
        if unicodedata.category(c)[0] in "LN":
            composed = unicodedata.normalize("NFC", c)
            lower = "".join(x.lower() for x in composed)
            if len(lower) != 1 or unicodedata.category(lower)[0] not in "LN":
                found.append(f"\\x{{{ord(c):x}}}")
    return "".join(found)
_ASCII_LETTERS = re.compile("[A-Za-z]+")


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        #: Of the two kinds of vocabulary: white space dropped and lower case, or white space kept in front of words.
        self.drops_space = self.tokenizer.normalizer is not None
        # A sign next to what such a letter becomes is cut in another way, so texts that hold one are not plain.
        self.not_plain = rf"{_NOT_PLAIN_WORDS}|[{_changing_letters()}]" if self.drops_space else _NOT_PLAIN_BYTES
        self.forget()

    def forget(self) -> None:
        #: A number for each known piece; its ids are ``lengths[number]`` ones from ``starts[number]`` on.
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty) one after the other, and the number of ids of each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        match = pc.match_substring_regex
        marked = match(texts, self.not_plain)
        odd = pc.and_(marked, match(texts, _NOT_MARKED_WORDS if self.drops_space else _NOT_MARKED_BYTES))
        shown = pc.if_else(marked, self._spaced_signs(pc.if_else(pc.and_not(marked, odd), texts, "")), self._spaced(pc.if_else(marked, "", texts)))
        lists = pc.ascii_split_whitespace(shown).cast(pa.large_list(pa.large_string()))
        coded = pc.dictionary_encode(lists.values)
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        flat, counts = self._expand(self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        n = bounds[np.asarray(lists.offsets)]
        sizes = np.diff(n)
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(at):
            return flat, sizes
        parts, last = [], 0
        for i in at:
            own = self._odd(texts[int(i)].as_py())
            parts += [flat[last : n[i]], own]
            last, sizes[i] = n[i], len(own)
        return np.concatenate([*parts, flat[last:]]), sizes

    def _spaced(self, texts: pa.Array) -> pa.Array:
        """Plain texts with white space at every cut; the blank in front of a word becomes a mark of the word."""
        if self.drops_space:
            texts, signs = pc.ascii_lower(texts), ((".", "."), (",", ","))
        else:
            texts, signs = pc.replace_substring(texts, " ", f" {_SPACE}"), ((".", "."), (",", ","), ("\n", _LINE))
        for sign, sign_shown in signs:
            texts = pc.replace_substring(texts, sign, f" {sign_shown} ")
        return texts

    def _spaced_signs(self, texts: pa.Array) -> pa.Array:
        """The same for marked texts."""
        if self.drops_space:
            return pc.replace_substring_regex(pc.ascii_lower(texts), r"([^\p{L}\p{N}\s]+)", r" \1 ")
        texts = pc.replace_substring(texts, " ", f" {_SPACE}")
        texts = pc.replace_substring_regex(texts, r"(\x02?[^\p{L}\p{N}\s\x02]+)", r" \1 ")
        return pc.replace_substring(texts, "\n", f" {_LINE} ")

    def _numbers(self, pieces: Sequence[str]) -> np.ndarray:
        """The numbers of the pieces; new ones are encoded."""
        if len(self.known) > REMEMBERED:
            self.forget()
        known, found = self.known, list(map(self.known.get, pieces))
        new: dict[str, Sequence[int]] = {}
        whole = []
        tokenize = self.model.tokenize
        for piece, number in zip(pieces, found, strict=True):
            if number is None and piece not in new:
                simple = self._simple(piece)
                if simple is None:
                    whole.append(piece)
                    new[piece] = ()
                else:
                    new[piece] = [t.id for t in tokenize(simple)]
        for start in range(0, len(whole), 10_000):
            some = whole[start : start + 10_000]
            texts = some if self.drops_space else [p.replace(_SPACE, " ").replace(_LINE, "\n") for p in some]
            for piece, e in zip(some, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
                new[piece] = e.ids
        if new:
            lengths = np.fromiter(map(len, new.values()), dtype=np.int64, count=len(new))
            ids = np.fromiter(itertools.chain.from_iterable(new.values()), dtype=np.uint32, count=int(lengths.sum()))
            known.update(zip(new, itertools.count(len(known))))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.lengths, self.ids = np.concatenate([self.lengths, lengths]), np.concatenate([self.ids, ids])
            found = map(known.__getitem__, pieces)
        return np.fromiter(found, dtype=np.int64, count=len(pieces))

    def _expand(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pieces one after the other, and how many each has."""
        counts = self.lengths[numbers]
        before = np.cumsum(counts) - counts
        place = np.repeat(self.starts[numbers] - before, counts) + np.arange(int(counts.sum()))
        return self.ids[place].astype(np.int64), counts

    def _simple(self, piece: str) -> str | None:
        """The piece as the model takes it, if it is one word of plain letters; else None."""
        if self.drops_space:
            if not _LATIN.fullmatch(piece):
                return None
            return piece if piece.isascii() else "".join(map(_BYTE_CHARS.__getitem__, piece.encode()))
        spaced = piece[:1] in (_SPACE, " ") and piece != ""
        word = piece[1:] if spaced else piece
        if not word.isalpha():
            return None
        if word.isascii():
            return f"{_BYTE_CHARS[32]}{word}" if spaced else word
        return "".join(map(_BYTE_CHARS.__getitem__, (" " + word if spaced else word).encode()))

    def _odd(self, text: str) -> np.ndarray:
        if _UNCERTAIN.search(text) or (self.drops_space and max(text) >= _LATIN_END):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.int64)
        pieces = _CUTS_WORDS.findall(text.lower()) if self.drops_space else _CUTS_BYTES.findall(text)
        return self._expand(self._numbers(pieces))[0]


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file, so that what it knows outlives a task."""
    return Encoder(path)
