"""Alignment of two tokenizers' tokens over the bytes of the same texts.

Both tokenizations of a document are laid over its bytes: np.repeat gives each byte the number of the token of A, and of
B, that owns it. Where neighbouring bytes have another pair of owners, a new overlap begins; where both owners change at
once, the tokens of both end together and a group ends. All of this is done on whole arrays of a document.

How often a pair of ids is linked in the whole corpus is summed in a shuffle of per-chunk sums; a chunk is as many
documents as have about CHUNK_LINKS links. The counts go back by two ways: those of the HOT most frequent pairs, a
number that is fixed, are broadcast; chunks ask for the others in a join on the pair, whose sides have no hot key left.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from seqloom.llm import bytebpe
from seqloom.llm.common import bucketed, prepare, scratch, stored
from seqloom.llm.corpus import pack, unpack

FIRST = os.environ.get("SEQLOOM_BYTE_BPE", "") or public_tokenizers.path("byte_bpe_50k.json")
SECOND = os.environ.get("SEQLOOM_PIECES", "") or public_tokenizers.path("piece_bpe_32k.model")
#: Links after which a chunk ends; pairs whose counts are broadcast, at most.
CHUNK_LINKS, HOT = 1_000_000, 1 << 15
#: A pair is a number: the id of B, then that of A in so many bits, so that pairs of an id of B are neighbours.
BITS = 20


class Vocabulary:
    """Byte lengths of ids, and their decimal digits followed by room for a separator."""

    def __init__(self, tokens: list[bytes]):
        if len(tokens) > 1 << BITS:
            raise ValueError(f"a vocabulary of more than {1 << BITS} ids does not fit a pair")
        self.bytes = tokens
        self.lengths = np.array([len(t) for t in tokens], np.int32)
        digits = [str(i).encode() for i in range(len(tokens))]
        self.width = max(map(len, digits), default=1) + 1
        self.digits = np.frombuffer(b"".join(d.ljust(self.width) for d in digits), np.uint8).reshape(-1, self.width)
        self.n_digits = np.array([len(d) for d in digits], np.int8)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


def owners(lengths: np.ndarray) -> np.ndarray:
    """For each byte the number of the token that owns it; tokens without bytes own none."""
    return np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, together) of owner arrays of the same bytes: the last byte of each pair of owners that overlaps, and whether both end there.

    The pairs themselves are a[positions] and b[positions], each overlapping pair of tokens once.
    """
    if not len(a):
        return np.empty(0, np.int64), np.empty(0, bool)
    new_a, new_b = a[1:] != a[:-1], b[1:] != b[:-1]
    last = np.append(np.flatnonzero(new_a | new_b), len(a) - 1)
    return last, np.append((new_a & new_b)[last[:-1]], True)


def groups_text(a_ids: np.ndarray, b_ids: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, first: Vocabulary, second: Vocabulary) -> bytes:
    """`a1,a2|b1;a3|b2,b3`: decimal ids of the tokens of each group; a_ends and b_ends: the last token of each group in A and B."""
    n_a, n_b = np.diff(a_ends, prepend=-1), np.diff(b_ends, prepend=-1)
    before_b, before_a = np.cumsum(n_b) - n_b, np.cumsum(n_a)
    at_a = np.arange(len(a_ids)) + np.repeat(before_b, n_a)
    at_b = np.arange(len(b_ids)) + np.repeat(before_a, n_b)
    width = max(first.width, second.width)
    out = np.full((len(a_ids) + len(b_ids), width), ord(","), np.uint8)
    size = np.empty(len(out), np.int8)
    for at, ids, ends, vocabulary, mark in ((at_a, a_ids, a_ends, first, "|"), (at_b, b_ids, b_ends, second, ";")):
        out[at, : vocabulary.width] = vocabulary.digits[ids]
        size[at] = vocabulary.n_digits[ids]
        separator = np.full(len(ids), ord(","), np.uint8)
        separator[ends] = ord(mark)
        out[at, size[at]] = separator
    return out[np.arange(width) <= size[:, None]].tobytes()[:-1]


class Aligner:
    """Both encoders and their vocabularies, for the documents of a task."""

    def __init__(self, first: tuple[str, bytes], second: tuple[str, bytes]):
        self.first = bytebpe.encoder(*first, special=False)
        self.second = bytebpe.encoder(*second, special=False)
        if not isinstance(self.first, bytebpe.ByteLevel) or not isinstance(self.second, bytebpe.Pieces):
            raise ValueError("the first tokenizer is a byte-level .json file, the second a .model file")
        self.a, self.b = Vocabulary(self.first.token_bytes()), Vocabulary(self.second.token_bytes())
        self.kept = bytebpe.Kept(lambda part: np.array(self.first.encode(part), np.int32).tobytes())

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of A for space+text and of B for text; None where the bytes of either are not those of space+text."""
        if not text:
            return None
        whole = " " + text
        ids_a = np.frombuffer(b"".join(b"".join(map(self.kept.__getitem__, some)) for some in self.first.parts(whole)), np.int32)
        ids_b = np.array(self.second.library.encode(text), np.int32)
        data = whole.encode()
        return (ids_a, ids_b) if self.a.joined(ids_a) == data and self.b.joined(ids_b) == data else None


def aligned(text: str | None, aligner: Aligner, overlapping: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(ids of A, ids of B, linked tokens of A, of B, groups as text) of a text; nothing where it has no tokens.

    Linked are tokens whose byte ranges end together; with overlapping, all that have a byte in common.
    """
    none = np.empty(0, np.int32)
    ids = aligner.encode(text or "")
    if ids is None:
        return none, none, none, none, b""
    a, b = owners(aligner.a.lengths[ids[0]]), owners(aligner.b.lengths[ids[1]])
    last, together = overlaps(a, b)
    ends = last[together]
    linked = last if overlapping else ends
    return *ids, a[linked], b[linked], groups_text(*ids, a[ends], b[ends], aligner.a, aligner.b)


_MADE: dict[tuple, Aligner] = {}


def _aligner(first: tuple[str, bytes], second: tuple[str, bytes]) -> Aligner:
    key = tuple((name, hashlib.sha256(data).digest()) for name, data in (first, second))
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Aligner(first, second)
    return _MADE[key]


def tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: str = FIRST, second: str = SECOND) -> DataFrame:
    """One row per row of df: id, a_ids, b_ids, and overlaps as two arrays (a, b) of token numbers from 0, in order; together says which pairs end together."""
    spark = df.sparkSession
    prepare(spark)
    one, two = (spark.sparkContext.broadcast(bytebpe.load(path)) for path in (first, second))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _aligner((first, one.value), (second, two.value))
        for batch in batches:
            for i in range(batch.num_rows):
                ids = tool.encode(batch.column(1)[i].as_py() or "") or (np.empty(0, np.int32), np.empty(0, np.int32))
                a, b = owners(tool.a.lengths[ids[0]]), owners(tool.b.lengths[ids[1]])
                last, together = overlaps(a, b)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.array([x]) for x in (*ids, a[last], b[last], together))], names=["id", "a_ids", "b_ids", "a", "b", "together"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, a_ids array<int>, b_ids array<int>, a array<int>, b array<int>, together array<boolean>").withColumnRenamed("id", id_col)


def _chunks(df: DataFrame, id_col: str, text_col: str, first: str, second: str, overlapping: bool, size: int) -> DataFrame:
    """(chunk, ids, sizes, digests, pairs, counts, links, per): a chunk's documents, its distinct pairs with how often it has them, and each document's pairs by their places in that list."""
    spark = df.sparkSession
    one, two = (spark.sparkContext.broadcast(bytebpe.load(path)) for path in (first, second))
    kind = df.schema[id_col].dataType
    names = ["chunk", "ids", "sizes", "digests", "pairs", "counts", "links", "per"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tool = _aligner((first, one.value), (second, two.value))
        task, count, total = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        sizes: list = []
        digests: list = []
        links: list = []

        def row() -> pa.RecordBatch:
            pairs, places, counts = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
            per = np.array([len(x) for x in links], np.int64)
            cols = [pa.array([ids], pa.list_(id_type)), pa.array([pack(np.array(sizes, np.int64).ravel())]), pa.array([digests], pa.list_(pa.string()))]
            cols += [pa.array([x]) for x in (pairs, counts)] + [pa.array([pack(places.astype(np.uint32))]), pa.array([pack(per)])]
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + count], pa.int64()), *cols], names=names)

        for batch in batches:
            id_type = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                a_ids, b_ids, a, b, groups = aligned(text.as_py(), tool, overlapping)
                ids.append(doc)
                sizes.append((len(a_ids), len(b_ids), groups.count(b"|")))
                digests.append(hashlib.sha256(groups).hexdigest() if groups else "")
                links.append(b_ids[b].astype(np.int64) << BITS | a_ids[a])
                total += len(a) + 1
                if total >= size:
                    yield row()
                    ids, sizes, digests, links, total, count = [], [], [], [], 0, count + 1
        if ids:
            yield row()

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"chunk bigint, ids array<{kind.simpleString()}>, sizes binary, digests array<string>, pairs array<bigint>, counts array<bigint>, links binary, per binary")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, n, best): how many links hold each pair of ids, and whether that is the most of its id of B, ties included.

    A B id has a window of its own, of as many rows as A has ids at most.
    """
    each = chunks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", BITS)))
    return each.select("pair", "n", (F.col("n") == most).alias("best"))


def links_by_pair(counts: DataFrame) -> DataFrame:
    """(a_id, b_id, n, best) of pair_counts."""
    return counts.select(F.col("pair").bitwiseAND((1 << BITS) - 1).alias("a_id"), F.shiftright("pair", BITS).alias("b_id"), "n", "best")


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: str = FIRST, second: str = SECOND, overlapping: bool = False, chunk_links: int = CHUNK_LINKS, hot: int = HOT) -> DataFrame:
    """One row per row of df: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is the tokenizer of `first` over a space and the text, B that of `second` over the text, which puts the space there
    itself; special strings are plain text. n_groups: groups of tokens between byte offsets where tokens of both end.
    n_links: pairs of tokens whose byte ranges end together, or with overlapping that share a byte. n_best: links whose
    pair of ids is the one most often linked for its id of B, in all documents, ties included; count_sum: that
    frequency, summed over links. groups_sha256: of the groups' ids as text.

    Null and empty texts, and those whose tokens do not spell a space and the text (white space that B's normaliser
    changes, a visible space), have no tokens: zeros, and an empty groups_sha256. Null and repeated ids are rows like others,
    and repeated rows count as often as they come. An empty table gives no rows. Other columns are not looked at,
    whatever their names. A document is never cut: a very long one is a chunk of its own, some 30 bytes per byte of text.
    """
    spark = df.sparkSession
    prepare(spark)
    with scratch(spark) as keep:
        chunks = bucketed(_chunks(df, id_col, text_col, first, second, overlapping, chunk_links), "aligned", "chunk")
        counts = stored(pair_counts(chunks), "pairs", "snappy")
        top = stored(counts.orderBy(F.desc("n"), "pair").limit(hot), "pairs", "snappy")
        ordered = sorted((r.pair, r.n, r.best) for r in top.collect())
        known = spark.sparkContext.broadcast(tuple(np.array([x[k] for x in ordered], kind) for k, kind in enumerate((np.int64, np.int64, bool))))
        rest = counts.join(top.select("pair"), "pair", "left_anti")
        ask = chunks.select("chunk", F.posexplode("pairs").alias("place", "pair"))
        replies = ask.join(rest, "pair").groupBy("chunk").agg(F.collect_list(F.struct("place", "n", "best")).alias("replies"))
        whole = chunks.drop("counts").join(replies, "chunk", "left")
        return keep(stored(_settled(whole, known, df.schema[id_col].dataType).withColumnRenamed("id", id_col), "alignment", "snappy"))


def _settled(whole: DataFrame, known, kind: T.DataType) -> DataFrame:
    """Rows of documents, from chunks with the counts of the pairs that were not broadcast."""
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, tops = known.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                pairs = row["pairs"].values.to_numpy()
                n, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
                    found = keys[at] == pairs
                    n[found], best[found] = times[at[found]], tops[at[found]]
                if row["replies"].is_valid:
                    place, more, top = row["replies"].values.flatten()
                    n[place.to_numpy()], best[place.to_numpy()] = more.to_numpy(), top.to_numpy(zero_copy_only=False)
                per, links = unpack(row["per"].as_py(), np.int64), unpack(row["links"].as_py(), np.uint32)
                ends = np.cumsum(per)
                sums = [(total := np.concatenate([[0], np.cumsum(x[links])]))[ends] - total[ends - per] for x in (best, n)]
                sizes = unpack(row["sizes"].as_py(), np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([row["ids"].values, *(pa.array(x) for x in (*sizes.T, per, *sums)), row["digests"].values], names=names)

    return whole.select("ids", "sizes", "digests", "pairs", "links", "per", "replies").mapInArrow(run, f"id {kind.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
