"""Token counts of whole texts, by two tiers of part lengths.

A tokenizer's ids of a text are those of its pre-tokens (bytebpe). The first tier is a table of the lengths, in tokens,
of the most frequent pre-tokens, made once and broadcast; what it doesn't have is encoded by the tokenizer's library and
kept in the worker's own cache, the second tier, which is emptied when it is full. Both give what the library
gives, so results rest on neither. Nothing but a bounded sample of texts is ever shuffled: pre-tokens stay in the task
that reads their text.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm import bytebpe
from seqloom.llm.common import prepare

TOKENIZER = os.environ.get("SEQLOOM_BYTE_BPE", "") or public_tokenizers.path("byte_bpe_50k.json")
#: Pre-tokens of the broadcast table; texts that it is learned from, dealt to so many tasks.
FREQUENT, SAMPLE_TEXTS, SAMPLE_TASKS = 65_536, 20_000, 8
#: Different pre-tokens a task counts before the rarest half of them goes.
COUNTED = 1_000_000
#: Stands for the second tier's caches in this process, by table.
_TIERS: dict[tuple, Lengths] = {}


class Lengths(dict):
    """The first tier; what it lacks is asked of the second, which encodes what it lacks itself."""

    def __init__(self, table: dict[str, int], second: bytebpe.Kept):
        super().__init__(table)
        self.second = second

    def __missing__(self, part: str) -> int:
        return self.second[part]


def packed(table: dict[str, int]) -> bytes:
    """A table as two compact columns: lengths in 16 bits, and pre-tokens behind one another with a NUL in front."""
    keys = [k for k in table if "\0" not in k]
    return zstandard.ZstdCompressor().compress(len(keys).to_bytes(4, "little") + np.array([table[k] for k in keys], np.uint16).tobytes() + "\0".join(keys).encode())


def unpacked(data: bytes) -> dict[str, int]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:4], "little")
    return dict(zip(raw[4 + 2 * n :].decode().split("\0"), np.frombuffer(raw, np.uint16, n, 4).tolist(), strict=True)) if n else {}


def frequent(df: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER, most: int = FREQUENT, sample: int = SAMPLE_TEXTS) -> dict[str, int]:
    """The most frequent pre-tokens of a sample of about `sample` texts, with their lengths in tokens.

    The sample's texts are dealt to SAMPLE_TASKS tasks, each of which sends its `most` most frequent pre-tokens: what
    comes to the driver is bounded by these parameters, whatever the number of rows. Parts longer than
    bytebpe.PART_LONGEST characters don't come into the table. A table without rows, or most or sample 0, gives none.
    """
    spark = df.sparkSession
    rows = df.count() if most and sample else 0
    if not rows:
        return {}
    data = spark.sparkContext.broadcast(bytebpe.load(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, counts = bytebpe.encoder(tokenizer, data.value).parts, Counter()
        for batch in batches:
            for text in batch.column(0):
                for some in parts(text.as_py() or ""):
                    counts.update(x for x in some if len(x) <= bytebpe.PART_LONGEST)
                if len(counts) > COUNTED:
                    counts = Counter(dict(counts.most_common(COUNTED // 2)))
        top = counts.most_common(most)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["part", "n"])

    texts = df.select(F.col(text_col).alias("t"))
    drawn = texts if rows <= sample else texts.sample(sample / rows, 7)
    total: Counter = Counter()
    for part, n in drawn.repartition(SAMPLE_TASKS).mapInArrow(run, "part string, n bigint").toLocalIterator():
        total[part] += n
    tool = bytebpe.encoder(tokenizer, data.value)
    best = sorted(total, key=lambda x: (-total[x], x))[:most]
    return {x: n for x in best if (n := len(tool.encode(x))) < 1 << 16}


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, limit: int = 1024, table: dict[str, int] | None = None) -> DataFrame:
    """One row per row of df: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    tokenizer: a .json file of the tokenizers library (byte level, no normaliser) or a .model file of sentencepiece;
    no begin, end or added special tokens, no truncation; special strings inside texts are what the library takes
    them for. table: the first tier, by default learned from df.

    Null and empty texts have no bytes and no tokens. Null and repeated ids are rows like others, repeated rows give repeated
    rows. An empty table gives no rows. Other columns are not looked at, whatever their names. Long texts are cut at
    bounded stretches; a run without white space is one part, and takes what the library takes for it.
    """
    spark = df.sparkSession
    prepare(spark)
    first = spark.sparkContext.broadcast(packed(frequent(df, text_col, tokenizer) if table is None else table))
    data = spark.sparkContext.broadcast(bytebpe.load(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = bytebpe.encoder(tokenizer, data.value)
        key = (tokenizer, hash(first.value))
        if key not in _TIERS:
            _TIERS.clear()
            _TIERS[key] = Lengths(unpacked(first.value), bytebpe.Kept(lambda part: len(tool.encode(part))))
        length = _TIERS[key].__getitem__
        for batch in batches:
            counts = [sum(sum(map(length, some)) for some in tool.parts(t.as_py() or "")) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    made = df.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"), text.alias("t")).mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return made.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
