"""Intervals on targets: windows, merging, duplicates, seeds and k-mer lookup."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windows(df: DataFrame, seq: str, size: int, overlap: int) -> DataFrame:
    """df with (start, part): windows of a size that share an overlap, from position 1; a short rest is kept."""
    step = size - overlap
    n = F.length(seq)
    last = F.greatest(F.lit(0), F.ceil((n - overlap) / step).cast("int") - 1)
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: (i * step + 1).cast("int"))
    out = df.where(n > 0).withColumn("start", F.explode(starts))
    return out.withColumn("part", F.substring(F.col(seq), F.col("start"), F.lit(size)))


def extended(df: DataFrame, keys: list[str], grow: Column, length: str) -> DataFrame:
    """(keys, start, end) grown on both sides and clipped to 1..length."""
    return df.withColumn("start", F.greatest(F.lit(1), F.col("start") - grow)).withColumn("end", F.least(F.col(length), F.col("end") + grow))


def merged(df: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping or touching intervals as one: (keys, start, end, n). One window per target and strand."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= before + 1, 0).otherwise(1)).over(w)
    marked = df.withColumn("island", island)
    return marked.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island")


def without_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hits less those that repeat the hit kept before: same ends, or within it, of worse or equal P.

    A pass in order of position, as each decision depends on the last. A hit is only ever held against one that
    it overlaps, so a target is cut at its gaps first: a task walks over one stretch of overlapping hits.
    """
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = df.withColumn("_island", F.sum(F.when(F.col("start") <= before, 0).otherwise(1)).over(w))
    stretch = [*keys, "_island"]
    rows = island.repartition(*stretch).sortWithinPartitions(*stretch, "start", "end", "lnp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A pass over all stretches of a task; a row goes once the next one that is kept can't replace it."""
        held: pd.DataFrame | None = None  # the row kept last
        here: tuple = ()
        for pdf in batches:
            if not len(pdf):
                continue
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            same = np.ones(len(pdf), bool)
            for c in stretch:
                own, missing = pdf[c].to_numpy(), pdf[c].isna().to_numpy()
                same[1:] &= (own[1:] == own[:-1]) | (missing[1:] & missing[:-1])
            same[0] = False
            kept: list[int] = []
            for i, (start, end, lnp, on) in enumerate(zip(pdf.start.tolist(), pdf.end.tolist(), pdf.lnp.tolist(), same.tolist(), strict=True)):
                if on and (start == here[0] or end == here[1] or (start >= here[0] and end <= here[1])):
                    if lnp < here[2]:
                        kept[-1], here = i, (start, end, lnp)
                    continue
                kept.append(i)
                here = (start, end, lnp)
            held = pdf.iloc[kept[-1:]]
            yield pdf.iloc[kept[:-1]].drop(columns="_island")
        if held is not None:
            yield held.drop(columns="_island")

    return rows.mapInPandas(run, df.schema)


def kmers(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """(key, pos, kmer): every k-mer of a sequence, from position 1. Long sequences are cut first, as a substring costs its position."""
    cut = windows(df.where(F.length(seq) >= k).select(key, F.col(seq).alias("whole")), "whole", 256 + k - 1, k - 1)
    starts = F.sequence(F.lit(1), F.length("part") - (k - 1))
    out = cut.where(F.length("part") >= k).select(key, "start", F.explode(F.transform(starts, lambda i: F.struct(i.alias("i"), F.substring(F.col("part"), i, F.lit(k)).alias("kmer")))).alias("x"))
    return out.select(key, (F.col("start") + F.col("x.i") - 1).alias("pos"), "x.kmer")


#: Bytes of patterns up to which one automaton over all of them goes to every worker.
PATTERN_BYTES = 32 << 20


def _by_automaton(targets: DataFrame, some: DataFrame) -> DataFrame:
    """exact_matches() with one automaton over all patterns, which goes to every worker."""
    by: dict[str, list] = {}
    for r in some.select("query", "pattern").collect():
        by.setdefault(r.pattern, []).append(r.query)
    shared = targets.sparkSession.sparkContext.broadcast(by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for pattern, ids in shared.value.items():
            machine.add_word(pattern, (len(pattern), ids))
        machine.make_automaton()
        for pdf in batches:
            out = [(t, q, end - n + 2) for t, s in zip(pdf.target, pdf.seq, strict=True) if s and shared.value for end, (n, ids) in machine.iter(s) for q in ids]
            yield pd.DataFrame(out, columns=["target", "query", "pos"])

    types = targets.schema["target"].dataType.simpleString(), some.schema["query"].dataType.simpleString()
    return targets.select("target", "seq").mapInPandas(run, f"target {types[0]}, query {types[1]}, pos bigint")


def exact_matches(targets: DataFrame, queries: DataFrame, k: int = 12) -> DataFrame:
    """(target, query, pos) of every place where a query (query, pattern) occurs in a target (target, seq).

    Few patterns, by a check of their bytes, form one automaton, and each target is read once. Beyond
    that, the queries' first k-mers join the targets' k-mers, and whole patterns are checked; work then
    follows the seeds found. Patterns shorter than k are searched by automata of their own, group by group.
    """
    some = queries.where("pattern is not null and pattern <> ''")
    size = lambda q: q.agg(F.sum(F.octet_length("pattern")).alias("n")).first().n or 0
    if size(some) <= PATTERN_BYTES:
        return _by_automaton(targets, some)
    short = some.where(F.length("pattern") < k)
    groups = 2 * -(-size(short) // max(1, PATTERN_BYTES))  # of about half the size each
    few = [_by_automaton(targets, short.where(F.pmod(F.xxhash64("pattern"), F.lit(groups)) == g)) for g in range(groups)]
    some = some.where(F.length("pattern") >= k)
    seeds = some.select("query", "pattern", F.substring("pattern", 1, k).alias("kmer"))
    whole = kmers(targets, "target", "seq", k).join(seeds, "kmer").join(targets, "target")
    found = whole.where(F.substring(F.col("seq"), F.col("pos"), F.length("pattern")) == F.col("pattern")).select("target", "query", F.col("pos").cast("bigint").alias("pos"))
    for part in few:
        found = found.unionByName(part)
    return found
