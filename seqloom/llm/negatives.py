"""Hard negatives of anchors: rows of other labels that score just below a positive.

Vectors are integers, so scores are exact and ties are real ties. Every anchor meets every row, in blocks: rows are
packed into blocks of at most BLOCK_ROWS, bucketed by their numbers, and stay where they are; anchors are packed into
blocks of at most BLOCK_ANCHORS, and each goes to each block of rows, a task's input being one pair of blocks at a time.
For a pair, each anchor's scores are sorted by score and id; its positives are the first rows of its label. With
the positives of all blocks merged, the pairs of blocks are gone through again: a binary search finds where the scores
that don't exceed a positive's begin, and the entries of other labels that follow, as long as they are above the lower
limit, are its negatives. A block gives each positive as many entries as are wanted in all, so that merging them by score and
id leaves what a sort over all rows would give; Spark keeps the first ones of each key before it shuffles them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.llm.common import bucketed, prepare, scratch, stored

#: Rows of a block of rows, anchors of a block of anchors, anchors scored at a time.
BLOCK_ROWS, BLOCK_ANCHORS, SLICE = 16_384, 1024, 32
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, as 64-bit integers, or as Python integers where those don't hold them."""
    with np.errstate(over="ignore"):
        out = np.floor(values * scale)
    if not len(out) or np.abs(out).max(initial=0) < 2**62:
        return out.astype(np.int64)
    whole = [int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in values.ravel().tolist()]
    return np.array(whole, object).reshape(values.shape)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: by a product of doubles where 53 bits hold every sum, of 64-bit integers where those do, of Python integers beyond."""
    most = int(np.abs(anchors).max(initial=0)) * int(np.abs(rows).max(initial=0)) * anchors.shape[1]
    if most < 2**53:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return anchors.astype(np.int64) @ rows.astype(np.int64).T
    return anchors.astype(object) @ rows.astype(object).T


def by_score(score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places in descending order of score, ties by smaller id."""
    if score.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-score[i], ids[i])), np.int64)
    return np.lexsort((ids, ~score))  # ~x falls as x rises, and holds the smallest integer as well


def first_at_most(ordered: np.ndarray, limit: int) -> int:
    """Where, in descending scores, those begin that don't exceed the limit."""
    lo, hi = 0, len(ordered)
    while lo < hi:
        mid = (lo + hi) // 2
        if int(ordered[mid]) > limit:
            lo = mid + 1
        else:
            hi = mid
    return lo


def usable(vector: str | Column) -> Column:
    """Whether a vector is there and all its components are, and are finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """(block, width, ids, labels, vectors): rows of one width as blocks of at most `most`, vectors as one array of doubles behind one another."""
    names = ["block", "width", "ids", "labels", "vectors"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, count = TaskContext.get().partitionId(), 0
        open_blocks: dict[int, tuple[list, list, list]] = {}

        def row(width: int) -> pa.RecordBatch:
            nonlocal count
            ids, labels, vectors = open_blocks.pop(width)
            count += 1
            number = (task << 32) + count
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([width], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.int64())), pa.array([np.array(vectors, np.float64).tobytes()])], names=names)

        for batch in batches:
            for vec, label, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, labels, vectors = open_blocks.setdefault(len(v), ([], [], []))
                ids.append(vec)
                labels.append(label)
                vectors.append(v)
                if len(ids) == most:
                    yield row(len(v))
        for width in list(open_blocks):
            yield row(width)

    return rows.mapInArrow(run, "block bigint, width int, ids array<bigint>, labels array<bigint>, vectors binary")


def _matrix(row: dict, side: str, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (row[f"{side}{name}"].values.to_numpy() for name in ("ids", "labels"))
    return ids, labels, scaled(np.frombuffer(row[f"{side}vectors"].as_py(), np.float64).reshape(len(ids), row["width"].as_py()), scale)


def clipped(score: int) -> int:
    return min(max(int(score), LEAST), MOST)


def key(score: int) -> bytes | None:
    """Bytes that sort as integers do, for those that a 64-bit column may not hold; None for others."""
    score = int(score)
    if abs(score) < 2**62:
        return None
    size = abs(score)
    raw = size.to_bytes((size.bit_length() + 7) // 8, "big")
    data = len(raw).to_bytes(2, "big") + raw
    return b"\1" + data if score >= 0 else b"\0" + bytes(255 - x for x in data)


def unkey(data: bytes | None, score: int) -> int:
    """The integer of a pair of columns."""
    if data is None:
        return score
    return int.from_bytes(data[3:], "big") if data[0] else -int.from_bytes(bytes(255 - x for x in data[3:]), "big")


def _pairs(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple]:
    """(row, anchors, rows) of each pair of blocks; the latter two as ids, labels and integer vectors."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
            yield row, _matrix(row, "a_", scale), _matrix(row, "", scale)


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def _meetings(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each block of rows with each block of anchors of its width: the stated query set against all rows, in blocks.

    Blocks of anchors go to the numbers of the blocks of rows, dealt over as many keys as shuffles have partitions; those
    of rows stay in their buckets.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = rows.select("block", "width", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("deal"))
    sent = anchors.select(F.col("width"), F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("deal"), *[F.col(c).alias(f"a_{c}") for c in anchors.columns if c != "width"])
    return sent.join(numbers, ["width", "deal"]).drop("width", "deal").join(rows, "block")


def mine(
    df: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 5,
    least: int = 80,
    scale: int = 256,
    block_rows: int = BLOCK_ROWS,
    block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    anchors: which rows are anchors, as a condition on df. A component x becomes floor(scale * x); a score is an integer
    inner product. Higher scores come first, ties by smaller id. An anchor's positives are its first rows of the same label
    and another id; to each belong the first `negatives` rows of other labels with
    least * positive_score <= 100 * negative_score <= 100 * positive_score. A positive with none gives no row.

    Rows with a null id, label or vector or a null, NaN or infinite component take no part. Vectors are compared with
    those of as many components alone; those without any score 0 with one another. Of repeated ids, each row is a candidate,
    none is another's positive, and each that is an anchor gives its own rows. Scores beyond 64 bits are compared exactly, and
    written as the nearest 64-bit number. A table without rows or anchors gives none. Other columns are not looked at.
    """
    spark = df.sparkSession
    prepare(spark)
    with scratch(spark) as keep:
        good = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(vector_col))
        columns = [F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("v")]
        rows = bucketed(_packed(good.select(columns), block_rows), "rows", "block")
        asked = stored(_packed(good.where(anchors).select(columns), block_anchors), "anchors")

        def first_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row, (a_ids, a_labels, a), (ids, labels, v) in _pairs(batches, scale):
                out = []
                for lo in range(0, len(a), SLICE):
                    for i, score in enumerate(scores(a[lo : lo + SLICE], v), lo):
                        own = np.flatnonzero((labels == a_labels[i]) & (ids != a_ids[i]))
                        for j in own[by_score(score[own], ids[own])[:positives]].tolist():
                            out.append((row["a_block"].as_py(), i, int(ids[j]), clipped(score[j]), key(score[j])))
                yield _batch(out, {"a_block": pa.int64(), "anchor": pa.int32(), "id": pa.int64(), "score": pa.int64(), "fine": pa.binary()})

        def next_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row, (a_ids, a_labels, a), (ids, labels, v) in _pairs(batches, scale):
                wanted: dict[int, list[tuple[int, int, int]]] = {}
                for x in row["a_chosen"].as_py():
                    wanted.setdefault(x["anchor"], []).append((x["place"], x["id"], unkey(x["fine"], x["score"])))
                out = []
                for lo in range(0, len(a), SLICE):
                    some = [i for i in range(lo, min(lo + SLICE, len(a))) if i in wanted]
                    for i, score in zip(some, scores(a[some], v), strict=True):
                        other = np.flatnonzero(labels != a_labels[i])
                        other = other[by_score(score[other], ids[other])]
                        ordered = score[other]
                        for place, positive, limit in wanted[i]:
                            at = first_at_most(ordered, limit)
                            for j in other[at : at + negatives].tolist():
                                if 100 * int(score[j]) < least * limit:
                                    break
                                out.append((row["a_block"].as_py(), i, int(a_ids[i]), place, positive, clipped(limit), int(ids[j]), clipped(score[j]), key(score[j])))
                yield _batch(out, {"a_block": pa.int64(), "anchor": pa.int32(), "anchor_id": pa.int64(), "place": pa.int32(), "positive_id": pa.int64(), "positive_score": pa.int64(), "negative_id": pa.int64(), "score": pa.int64(), "fine": pa.binary()})

        found = _meetings(rows, asked).select("a_block", "a_ids", "a_labels", "a_vectors", "width", "ids", "labels", "vectors").mapInArrow(first_positives, "a_block bigint, anchor int, id bigint, score bigint, fine binary")
        best = Window.partitionBy("a_block", "anchor").orderBy(F.desc("score"), F.desc("fine"), "id")
        chosen = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
        limits = stored(chosen.groupBy(F.col("a_block").alias("block")).agg(F.collect_list(F.struct("anchor", "place", "id", "score", "fine")).alias("chosen")), "positives")
        near = _meetings(rows, asked.join(limits, "block")).mapInArrow(next_negatives, "a_block bigint, anchor int, anchor_id bigint, place int, positive_id bigint, positive_score bigint, negative_id bigint, score bigint, fine binary")
        closest = Window.partitionBy("a_block", "anchor", "place").orderBy(F.desc("score"), F.desc("fine"), "negative_id")
        ranked = near.withColumn("rank", F.row_number().over(closest)).where(F.col("rank") <= negatives)
        return keep(stored(ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score")), "negatives", "snappy"))
