"""Tokenised chunks of a corpus, and packed integer arrays for exchanging facts about them.

Documents of a task are gathered into chunks of about as many tokens; a chunk is one row of a Parquet
table in the shared folder, with its own vocabulary and token numbers. Facts that depend on the whole
corpus are found by request and reply: chunks send packed arrays of their distinct keys, sorted and cut
into groups of bounded size; each group is settled by one task; replies go back in the order of the
request. The table is written once, so chunk numbers mean the same in every later pass; it is bucketed by
them, so that chunks stay where they are while replies come to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import as_bytes, bucketed

#: Tokens after which a chunk ends, and keys of a group.
CHUNK_TOKENS, GROUP_KEYS = 2_000_000, 2_000_000
#: Stands for a null id: no id is larger, so it is never the smaller one.
NO_ID = np.iinfo(np.int64).max


def pack(values: np.ndarray) -> bytes:
    """An integer array as zstandard-compressed byte planes; high planes of small numbers cost nothing."""
    width = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(bytes([width]) + np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1).T).reshape(-1).view(dtype)


def pack_sorted(values: np.ndarray) -> bytes:
    """A sorted array of 64-bit numbers by its differences."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpack(data, dtype), dtype=dtype)


def stretches(group: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(group, from, to) of each run of equal numbers; none without numbers."""
    cuts = np.flatnonzero(np.diff(group, prepend=group[:1] - 1)).tolist()
    for lo, hi in zip(cuts, [*cuts[1:], len(group)][: len(cuts)], strict=True):
        yield int(group[lo]), lo, hi


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def chunked(df: DataFrame, id_col: str, text_col: str, lower: bool, tokens: int = CHUNK_TOKENS) -> DataFrame:
    """(chunk, size, ids, lens, vocab, tokens): chunk and size (its words) numbers, the others packed.

    ids and lens have an entry per document, tokens one per word: its number in vocab, the chunk's
    words joined by spaces. A document is never cut, so a very long one makes a chunk of its size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, count = TaskContext.get().partitionId(), 0
        numbers, ids, lens, parts, size = Numbers(), [], [], [], 0

        def row() -> pa.RecordBatch:
            words = b" ".join(numbers)
            all_tokens = np.concatenate(parts) if parts else np.empty(0, np.uint32)
            cols = (pack(np.array(ids, np.int64)), pack(np.array(lens, np.uint32)), zstandard.ZstdCompressor(level=1).compress(words), pack(all_tokens))
            return pa.RecordBatch.from_arrays([pa.array([(task << 24) + count], pa.int64()), pa.array([len(all_tokens)], pa.int64()), *(pa.array([c], pa.binary()) for c in cols)], names=["chunk", "size", "ids", "lens", "vocab", "tokens"])

        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                words = ((data or b"").lower() if lower else data or b"").split()
                ids.append(NO_ID if doc is None else doc)
                lens.append(len(words))
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                size += len(words) + 1
                if size >= tokens:
                    yield row()
                    count, numbers, ids, lens, parts, size = count + 1, Numbers(), [], [], [], 0
        if ids:
            yield row()

    made = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "chunk bigint, size bigint, ids binary, lens binary, vocab binary, tokens binary")
    return bucketed(made, "chunks", "chunk")


class Chunk:
    """One row of the table, unpacked."""

    def __init__(self, ids: bytes, lens: bytes, vocab: bytes, tokens: bytes):
        self.ids = unpack(ids, np.int64)
        self.lens = unpack(lens, np.uint32).astype(np.int64)
        self.words = zstandard.ZstdDecompressor().decompress(vocab).split()
        self.tokens = unpack(tokens, np.uint32)
        self.starts = np.cumsum(self.lens) - self.lens

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the vocabulary."""
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, one unpacked at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(column[i].as_py() for column in batch.columns)
