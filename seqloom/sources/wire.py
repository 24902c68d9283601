"""Exchange of results and requests: hits as Arrow streams, statistics as JSON, search requests as text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def packed(rows: DataFrame) -> DataFrame:
    """(n, content): each batch of rows as one Arrow stream, nested and null fields as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["n", "content"])

    return rows.mapInArrow(run, "n bigint, content binary")


def unpacked(streams: DataFrame, schema: StructType) -> DataFrame:
    """The rows of packed(): a stream that is cut short raises an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = list(pa.ipc.open_stream(content.as_buffer()))
                if sum(b.num_rows for b in found) != n:
                    raise ValueError("a stream holds fewer rows than it says")
                yield from found

    return streams.select("n", "content").mapInArrow(run, schema)


def as_json(row: Column) -> Column:
    return F.to_json(row, {"ignoreNullFields": "false"})


def from_json(text: Column, schema: str) -> Column:
    """A row from its JSON; text that is none raises an error."""
    return F.from_json(text, schema, {"mode": "FAILFAST"})


def parsed_request(text: Column) -> dict[str, Column]:
    """A request `@--option value ... newline >name newline letters //` as columns: options (a map), name, seq, problem (null if it is fine).

    Options without a value map to an empty string. A request that starts without @, has no name or no letters, or
    does not end in // is a problem.
    """
    first = F.regexp_extract(text, r"^@([^\n]*)", 1)
    words = F.filter(F.split(F.regexp_replace(first, r"(^|\s+)(--?[A-Za-z])", "\u0001$2"), "\u0001"), lambda w: F.trim(w) != "")
    pairs = F.transform(words, lambda w: F.struct(F.regexp_extract(F.trim(w), r"^(\S+)", 1).alias("key"), F.regexp_extract(F.trim(w), r"^\S+\s+(.*)$", 1).alias("value")))
    name = F.regexp_extract(text, r"\n>(\S+)", 1)
    seq = F.regexp_replace(F.regexp_extract(text, r"\n>[^\n]*\n([\s\S]*?)//\s*$", 1), r"\s", "")
    problem = F.when(~F.startswith(text, F.lit("@")), "no options").when(name == "", "no name").when(~F.rlike(text, F.lit(r"//\s*$")), "no end").when(seq == "", "no letters")
    return {"options": F.map_from_entries(pairs), "name": name, "seq": seq, "problem": problem}


def of_shard(key: Column, shard: int, shards: int) -> Column:
    """Whether a row is one of a shard's: keys are dealt in turn."""
    return F.pmod(key, F.lit(shards)) == shard
