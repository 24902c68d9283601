"""Long targets that arrive in pieces, and requests that are answered as they come.

A target's pieces may come in any order and more than once; state holds the last letters of what has been passed on, and pieces
whose predecessors are missing. What is passed on begins with these letters, so that a match across two pieces is found, and says
how many they are, so that none is found twice and no residue counted twice: results don't depend on how a target was cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from seqloom.operators import search as R
from seqloom.operators.profile import single_sequence
from seqloom.sources.wire import parsed_request

#: State of several values needs this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
PIECE = "target string, start bigint, piece string, context int"


class Continued(StatefulProcessor):
    """Puts the last letters of a target's pieces before the next one, in order of their numbers from 0."""

    def __init__(self, context: int):
        self.context = context

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.passed = handle.getValueState("passed", "next bigint, letters bigint, tail string")
        self.waiting = handle.getMapState("waiting", "number bigint", "part string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        number, letters, tail = self.passed.get() if self.passed.exists() else (0, 0, "")
        fresh: dict[int, str] = {}
        for pdf in rows:
            for n, part in zip(pdf.number, pdf.part, strict=True):
                if pd.notna(n) and n >= number:
                    fresh.setdefault(int(n), part or "")
        out = []
        while True:
            if number in fresh:
                part = fresh.pop(number)
            elif self.waiting.containsKey((number,)):
                (part,) = self.waiting.getValue((number,))
                self.waiting.removeKey((number,))
            else:
                break
            if part:
                out.append((key[0], letters - len(tail) + 1, tail + part, len(tail)))
            letters, number = letters + len(part), number + 1
            tail = (tail + part)[-self.context :] if self.context else ""
        for n, part in fresh.items():
            if not self.waiting.containsKey((n,)):
                self.waiting.updateValue((n,), (part,))
        self.passed.update((number, letters, tail))
        yield pd.DataFrame(out, columns=["target", "start", "piece", "context"])

    def close(self) -> None:
        pass


def continued(parts: DataFrame, context: int) -> DataFrame:
    """(target, start, piece, context) of a stream of parts(target, number, part): each part once, after the `context` letters before it; start is the piece's first position.

    A null target, number or part: rows without a target or number are left out, a null part is empty. Of parts with one number, the
    first counts. State of a target: `context` letters and the parts that came too early.
    """
    some = parts.where("target is not null and number is not null").select(F.col("target").cast("string").alias("target"), F.col("number").cast("bigint").alias("number"), "part")
    parts.sparkSession.conf.set(*STORE)
    return some.groupBy("target").transformWithStateInPandas(Continued(context), PIECE, "Append", "None")


def matches(pieces: DataFrame, patterns: list[str]) -> DataFrame:
    """(target, pattern, pos) of patterns in continued pieces: those that end among a piece's new letters. Patterns may be a letter longer than the context."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for target, start, piece, context in zip(pdf.target, pdf.start, pdf.piece, pdf.context, strict=True):
                for p in patterns:
                    at = piece.find(p, max(0, context - len(p) + 1))
                    while at >= 0:
                        out.append((target, p, start + at))
                        at = piece.find(p, at + 1)
            yield pd.DataFrame(out, columns=["target", "pattern", "pos"])

    return pieces.mapInPandas(run, "target string, pattern string, pos bigint")


def residues(pieces: DataFrame) -> DataFrame:
    """(target, n) of new letters alone."""
    return pieces.groupBy("target").agg(F.sum(F.length("piece") - F.col("context")).alias("n"))


ANSWER = "request string, problem string, seq_id bigint, name string, score double, lnp double, evalue double, rank int"


def answered(requests: DataFrame, collection: DataFrame, config: R.Config | None = None) -> DataFrame:
    """ANSWER rows of a batch of requests(request, text) against a collection (seq_id, name, seq), which the caller keeps in memory.

    A request's -E replaces the largest E-value reported. One that says nothing searchable gives a row with its problem alone.
    """
    config = config or R.Config()
    columns = parsed_request(F.col("text"))
    read = requests.select(F.col("request").cast("string").alias("request"), *[c.alias(n) for n, c in columns.items()]).withColumn("problem", F.when(F.col("options").isNull(), "no text").otherwise(F.col("problem")))
    rows = read.collect()  # a micro-batch of requests
    bad = [(r.request, r.problem) for r in rows if r.problem]
    out = requests.sparkSession.createDataFrame(bad, "request string, problem string").select("request", "problem", *[F.lit(None).cast(t).alias(n) for n, t in (x.split(" ") for x in ANSWER.split(", ")[2:])])
    good = {r.request: r for r in rows if not r.problem}
    if not good:
        return out
    most = {k: float(r.options["-E"]) if r.options.get("-E") else config.e for k, r in good.items()}
    wide = R.replace(config, e=max(most.values()))
    hits = R.thresholded(R.raw_hits(collection, [single_sequence(k, r.seq.upper()) for k, r in good.items()], wide), wide)
    limit = F.create_map(*[F.lit(x) for pair in most.items() for x in pair])[F.col("model")]
    kept = R.ranked(hits).where(F.col("evalue") <= limit)
    return out.unionByName(kept.select(F.col("model").alias("request"), F.lit(None).cast("string").alias("problem"), "seq_id", "name", "score", "lnp", "evalue", "rank"))


def served(requests: DataFrame, collection: DataFrame, out: str, checkpoint: str, config: R.Config | None = None, once: bool = False) -> StreamingQuery:
    """A query that answers a stream of requests, a folder of `out` for each batch; a batch that is run again replaces its own folder."""

    def answer(batch: DataFrame, number: int) -> None:
        answered(batch, collection, config).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
