"""Profile search over a stream of sequences, and windowed counts of its hits.

A stream has no final number of targets, so Z must be given. The filter is stateless and keeps event time;
counts are windowed aggregations with a watermark, so late data beyond it is dropped and state is bounded.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.profile import Model
from seqloom.operators.search import Config, raw_hits


def hits(stream: DataFrame, models: list[Model], z: float, config: Config | None = None) -> DataFrame:
    """(seq_id, name, model, score, lnp, evalue) of a stream's sequences (seq_id, name, seq); null sequences never match."""
    config = replace(config or Config(), z=z)
    raw = raw_hits(stream, models, config).where("kind = 'hit'")
    scored = raw.select("seq_id", "name", "model", "score", "lnp", (F.exp("lnp") * z).alias("evalue"))
    return scored.where(F.col("evalue") <= config.e)


def windowed_counts(events: DataFrame, time_col: str, key: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, n) per tumbling window, as soon as the watermark has passed it."""
    counted = events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late).groupBy(F.window(time_col, size).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), key, "n")
