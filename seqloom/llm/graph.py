"""Connected components of a link table, labelled with the smallest vertex reachable."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import checkpointed, removed, scratch


def forest(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Each vertex of the pairs that isn't its tree's smallest, with that smallest vertex."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (p := parent.get(v, v)) != v:
            parent[v] = parent.get(p, p)
            v = p
        return v

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {v: root(v) for v in parent}


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each task's links: as a combiner, it leaves at most one link per vertex."""
    def pairs():
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

    found = forest(pairs())
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["v", "m"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(v, m) for every vertex of links(a, b) other than its component's smallest, m being that one.

    Links are contracted in each task, then large-star and small-star steps alternate until nothing
    changes; every step is one aggregation and one join on a vertex, kept in the shared folder. Self
    links, nulls and repeated links change nothing. No task gathers more than its share of links.
    """
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))
    edges = checkpointed(edges.mapInArrow(_contracted, "v bigint, m bigint").distinct())
    before = _state(edges)
    while before[0]:
        with scratch(spark) as keep:
            both = edges.select(F.col("v").alias("u"), F.col("m").alias("w")).union(edges.select(F.col("m").alias("u"), F.col("v").alias("w")))
            least = checkpointed(both.groupBy("u").agg(F.min("w").alias("x")).select("u", F.least("u", "x").alias("least")))
            large = both.join(least, "u").where("w > u").select(F.col("w").alias("v"), F.col("least").alias("m")).where("v <> m").distinct()
            large = checkpointed(large)
            low = checkpointed(large.groupBy("v").agg(F.min("m").alias("least")))
            small = large.join(low, "v").select(F.col("m").alias("v"), F.col("least").alias("m")).where("v <> m").union(low.select("v", F.col("least").alias("m"))).distinct()
            following = keep(checkpointed(small))
        removed(spark, edges.table_path)
        edges, after = following, _state(following)
        if after == before:
            break
        before = after
    return edges
