"""Packing documents into token sequences along a space-filling curve.

The hashed token vector of a document, root counts scaled to length one, is projected to a few dimensions by fixed
random directions. The Hilbert key of that point sorts the documents by range over the tasks; each task packs its
stretch of the curve in order, so that a sequence holds documents that are near one another. Documents are cut where a
sequence is full. The last tokens of a task make sequences whose lengths are powers of two, so nothing is padded.

A null or empty text is the end token alone. Repeated rows are packed each for itself; a null id sorts first. Other
columns take no part. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens.llm.common import stored
from echolens.llm.tokens import tokenizer

LENGTH = 2048
END = 1
DIMENSIONS, BITS = 4, 12
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)
#: A task numbers its sequences from its place times this.
SEQUENCES_PER_TASK = 1 << 36


def directions(size: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, DIMENSIONS)).astype(np.float32)


def point(ids: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The document's place in few dimensions, each between 0 and 1."""
    tokens, counts = np.unique(ids, return_counts=True)
    weight = np.sqrt(counts.astype(np.float32))
    projected = weight @ axes[tokens] / max(float(np.sqrt(counts.sum())), 1.0)
    return 1 / (1 + np.exp(-1.7 * projected))


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places along the Hilbert curve through cells of side 2**-bits; points: [n, dimensions] in 0 to 1."""
    x = np.minimum((points * (1 << bits)).astype(np.int64), (1 << bits) - 1).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations from the coarsest bit down
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    keys = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            keys = (keys << 1) | ((x[i] >> bit) & 1)
    return keys


class Packer:
    """Cuts a run of documents into full sequences; what is left over goes to sequences of powers of two."""

    def __init__(self, length: int, first: int) -> None:
        self.length, self.sequence = length, first
        self.open: list[tuple[int | None, int, np.ndarray, int]] = []  # id, start, tokens, tokens of the document
        self.filled = 0
        self.made: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        start, total = 0, len(ids)
        while start < total:
            n = min(self.length - self.filled, total - start)
            self.open.append((doc_id, start, ids[start:start + n], total))
            self.filled += n
            start += n
            if self.filled == self.length:
                self._close(self.open)
                self.open, self.filled = [], 0

    def end(self) -> None:
        """Splits the sequence that is not full by the binary digits of its length."""
        left = self.open
        while left:
            size = sum(len(piece[2]) for piece in left)
            take, now = 1 << (size.bit_length() - 1), []
            while take:
                doc_id, start, ids, total = left.pop(0)
                now.append((doc_id, start, ids[:take], total))
                if len(ids) > take:
                    left.insert(0, (doc_id, start + take, ids[take:], total))
                take -= min(take, len(ids))
            self._close(now)
        self.open, self.filled = [], 0

    def _close(self, pieces: list[tuple[int | None, int, np.ndarray, int]]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            raw = ids.astype("<u4").tobytes()
            self.made.append((doc_id, start, len(ids), zlib.crc32(raw), total, self.sequence, offset, raw))
            offset += len(ids)
        self.sequence += 1

    def taken(self) -> list[tuple]:
        made, self.made = self.made, []
        return made


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, the bytes of the token ids with the end token, and the Hilbert key."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        end, axes = np.array([END], words.dtype).tobytes(), directions(words.tokenizer.get_vocab_size())
        for batch in batches:
            for part in (batch.slice(a, 500) for a in range(0, batch.num_rows, 500)):
                ids = [words.ids(text or "") + end for text in part.column(1).to_pylist()]
                keys = hilbert_keys(np.stack([point(np.frombuffer(x, words.dtype), axes) for x in ids]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array(keys, pa.int64())], ["doc_id", "ids", "key"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(made, "doc_id long, ids binary, key long")


def pack(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """The pieces of all documents in sequences of ``length`` tokens; ``ids`` (little-endian, 32 bits) if asked for."""
    names = [field.split()[0] for field in PIECES.split(", ")]
    names = names if with_ids else names[:-1]
    schema = PIECES if with_ids else PIECES.rpartition(", ")[0]
    rows = stored(tokenized(docs, path), "tokens")  # the sample of keys for the ranges would make all tokens twice
    along = rows.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, dtype = Packer(length, TaskContext.get().partitionId() * SEQUENCES_PER_TASK), tokenizer(path).dtype

        def batch() -> pa.RecordBatch:
            columns = list(zip(*packer.taken())) or [()] * 8
            kinds = [pa.int64()] * 7 + [pa.binary()]
            arrays = [pa.array(column, kind) for column, kind, _ in zip(columns, kinds, names)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for rows in batches:
            for doc_id, ids in zip(rows.column(0).to_pylist(), rows.column(1)):
                packer.add(doc_id, np.frombuffer(ids.as_buffer(), dtype))
            yield batch()
        packer.end()
        yield batch()

    return along.mapInArrow(packed, schema)
