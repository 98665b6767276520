"""Token ids of all documents in compressed files that answer questions without being unpacked first.

A file holds one shard: whole documents in ascending id order, their ids and
lengths, and the token sequence as a wavelet matrix, that is one bit plane per
bit of a token id, each plane's tokens stably parted by the plane before, with
the number of ones before each block of bits. It gives the token at a place
(access), the number of a token before a place (rank), the place of the k-th
one (select), and all tokens back.

Null text counts as empty; null ids come first, as in Spark's ascending order;
equal ids stay side by side. An empty table writes no file. Other columns are
left out, so their names can't clash.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from millrace.llm.common import as_uri, in_order, new_file, new_path, offsets, open_input, open_output, partitions, pick, stored
from millrace.llm.words import encoder

MAGIC = b"MRWM0001"
#: A shard ends with the slice of documents that reaches so many tokens; its arrays then take some hundred MB at most.
SHARD_TOKENS = 1 << 23
#: Bits per entry of a plane's directory of ones.
BLOCK = 512
#: Characters encoded at a time.
SLICE_BYTES = 2 << 20

MANIFEST = "part int, shard int, path string, docs bigint, tokens bigint, before bigint"


class WaveletMatrix:
    """Planes from the highest bit down. ``zeros[l]`` is the number of zeros in plane l."""

    def __init__(self, planes: list[np.ndarray], ones: list[np.ndarray], zeros: list[int], size: int):
        self.planes, self.ones, self.zeros, self.size = planes, ones, zeros, size
        self.width = len(planes)

    @classmethod
    def build(cls, tokens: np.ndarray, width: int) -> WaveletMatrix:
        current = tokens.astype(np.uint16 if width <= 16 else np.uint32)
        planes, ones, zeros = [], [], []
        for shift in range(width - 1, -1, -1):
            bit = ((current >> shift) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            planes.append(packed)
            ones.append(_directory(packed))
            zeros.append(int(len(bit) - np.count_nonzero(bit)))
            current = np.concatenate([current[~bit], current[bit]])
        return cls(planes, ones, zeros, len(tokens))

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def _ones_before(self, level: int, i: int) -> int:
        block = i // BLOCK
        first = block * BLOCK // 8
        part = np.unpackbits(self.planes[level][first : (i + 7) // 8], bitorder="little")
        return int(self.ones[level][block]) + int(np.count_nonzero(part[: i - block * BLOCK]))

    def access(self, i: int) -> int:
        if not 0 <= i < self.size:
            raise IndexError(i)
        token = 0
        for level in range(self.width):
            bit, ones = self._bit(level, i), self._ones_before(level, i)
            token = token << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return token

    def _interval(self, token: int, end: int) -> tuple[int, int]:
        """Where the copies of ``token`` among the first ``end`` tokens stand below the last plane."""
        low, high = 0, end
        for level in range(self.width):
            a, b = self._ones_before(level, low), self._ones_before(level, high)
            if token >> (self.width - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, token: int, end: int) -> int:
        """How often ``token`` stands before place ``end``."""
        if token >> self.width:
            return 0
        low, high = self._interval(token, min(end, self.size))
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.size)

    def select(self, token: int, k: int) -> int:
        """The place of the k-th copy of ``token``, counted from 0."""
        if token >> self.width or not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._interval(token, self.size)[0] + k
        for level in range(self.width - 1, -1, -1):
            bit = token >> (self.width - 1 - level) & 1
            i = self._place(level, bit, i - self.zeros[level] if bit else i)
        return i

    def _place(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th one or zero of a plane."""
        before = self.ones[level].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * BLOCK - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        first = block * BLOCK
        bits = np.unpackbits(self.planes[level][first // 8 : (first + BLOCK) // 8], bitorder="little")
        return first + int(np.flatnonzero(bits[: self.size - first] == bit)[k - int(before[block])])

    def tokens(self) -> np.ndarray:
        """All tokens, from the last plane up: each plane says which of the two halves its next token comes from."""
        current = np.zeros(self.size, dtype=np.uint16 if self.width <= 16 else np.uint32)
        for level in range(self.width - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.size, bitorder="little").astype(bool)
            above = np.empty_like(current)
            above[~bit] = current[: self.zeros[level]]
            above[bit] = current[self.zeros[level] :] | current.dtype.type(1 << (self.width - 1 - level))
            current = above
        return current.astype(np.uint32)


def _directory(packed: np.ndarray) -> np.ndarray:
    """Ones before each block, with one entry more than there are blocks begun."""
    blocks = len(packed) * 8 // BLOCK + 1
    whole = np.zeros(blocks * BLOCK // 8, dtype=np.uint8)
    whole[: len(packed)] = packed
    counts = np.bitwise_count(whole).reshape(blocks, -1).sum(axis=1, dtype=np.int64)
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32)


def dump(ids: pa.Array, lengths: np.ndarray, matrix: WaveletMatrix) -> bytes:
    pack = zstandard.ZstdCompressor(level=1).compress
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as writer:
        writer.write_batch(pa.record_batch([ids], names=["id"]))
    parts = [pack(sink.getvalue()), pack(lengths.astype("<u4").tobytes())]
    for plane, ones in zip(matrix.planes, matrix.ones, strict=True):
        parts += [pack(plane.tobytes()), pack(ones.astype("<u4").tobytes())]
    head = json.dumps({"size": matrix.size, "zeros": matrix.zeros, "parts": list(map(len, parts))}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(parts)


def load(data: bytes) -> tuple[pa.Array, np.ndarray, WaveletMatrix]:
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    (n,) = struct.unpack_from("<I", data, 8)
    head = json.loads(data[12 : 12 + n])
    unpack, parts, at = zstandard.ZstdDecompressor().decompress, [], 12 + n
    for size in head["parts"]:
        parts.append(unpack(data[at : at + size]))
        at += size
    ids = pa.ipc.open_stream(parts[0]).read_all()["id"].combine_chunks()
    planes = [np.frombuffer(p, dtype=np.uint8) for p in parts[2::2]]
    ones = [np.frombuffer(p, dtype="<u4") for p in parts[3::2]]
    matrix = WaveletMatrix(planes, ones, head["zeros"], head["size"])
    return ids, np.frombuffer(parts[1], dtype="<u4").astype(np.int64), matrix


def encoded(batch: pa.RecordBatch, path: str, end: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, rows, ids, sizes)`` of slices of a batch with the column ``text``; each text's ids end in ``end``."""
    texts = batch.column("text")
    step = max(1, len(texts) * SLICE_BYTES // max(SLICE_BYTES, texts.nbytes))
    for first in range(0, len(texts), step):
        some = texts.slice(first, step)
        ids, sizes = encoder(path).encode(some)
        ids = np.insert(ids, np.cumsum(sizes), end)
        yield first, len(some), ids, sizes + 1


def write(docs: DataFrame, tokenizer: str, end: int, width: int, folder: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write ``docs(doc_id, text)`` into token files below ``folder``; return the list of files.

    Each task writes the files of its range of ids. The list names the files of
    the attempts that succeeded and is stored, so a task that is run again
    leaves at most an unlisted file behind.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            names = pa.concat_arrays([h[0] for h in held])
            tokens, lengths = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            path = new_file(folder, f"{part:06d}-{shard:04d}")
            with open_output(path) as out:
                out.write(dump(names, lengths, WaveletMatrix.build(tokens, width)))
            row = {"part": part, "shard": shard, "path": path, "docs": len(names), "tokens": len(tokens), "before": before}
            return pa.RecordBatch.from_pylist([row], schema=_MANIFEST)

        for batch in batches:
            for first, rows, ids, sizes in encoded(batch, tokenizer, end):
                held.append((batch.column("doc_id").slice(first, rows), ids.astype(np.uint32), sizes))
                size += len(ids)
                if size >= shard_tokens:
                    yield flush()
                    shard, before, size = shard + 1, before + size, 0
                    held = []
        if held:
            yield flush()

    sorted_docs = in_order(pick(docs, "doc_id", "text"), "doc_id").drop("part")
    return stored(sorted_docs.mapInArrow(shards, MANIFEST), "token-files")


_MANIFEST = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("before", pa.int64())]
)


def read(manifest: DataFrame, id_type: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, path)`` per document, from the files of ``write``."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_input(row["path"]) as file:
                    ids, lengths, matrix = load(file.read())
                tokens = matrix.tokens().astype("<u4")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(tokens[e - n : e]) for e, n in zip(ends, lengths, strict=True)]
                start = ends - lengths + row["base"] + row["before"]
                paths = pa.array([row["path"]] * len(ids), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(start), pa.array(lengths), pa.array(crc, pa.int64()), paths],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "path"],
                )

    bases = offsets(manifest, [], "part", "tokens", "base")
    files = manifest.join(bases, "part").repartition(partitions(manifest)).select("path", "before", "base")
    schema = f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint, path string"
    return files.mapInArrow(documents, schema)


def token_files(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """Write all documents and give back what the files hold of each."""
    spark = docs.sparkSession
    width = max(1, max(encoder(tokenizer).tokenizer.get_vocab_size() - 1, end).bit_length())
    manifest = write(docs, tokenizer, end, width, as_uri(new_path(spark, "tokens")))
    return read(manifest, docs.schema["doc_id"].dataType.simpleString())
