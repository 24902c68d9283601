"""P-values far out in the tail of Forward scores, by importance sampling at several temperatures.

A random sequence hardly ever scores what a real match does, so counting random sequences stops at a thousandth or so. Here sequences
are drawn as a model would emit them at a temperature: a path and its residues, in proportion to the background times exp(score / T).
What such a sequence weighs is how much less likely the background makes it, which Forward at that temperature says exactly. Samples
of all temperatures, the infinite one (the background itself) among them, are put together with the weights of their mixture, so that each
part of the tail rests on the samples that reach it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import kernels as K
from seqloom.operators.ensemble import sampled
from seqloom.operators.profile import Model, Profile, configure

#: Temperatures of the mixture; samples of a task's batch.
TEMPERATURES = (0.4, 0.7, 1.0, 1.6, 3.0, float("inf"))
BATCH = 250


def tempered(p: Profile, t: float) -> Profile:
    """The profile with the model's scores divided by a temperature; flanks stay as they are."""
    return replace(p, msc=p.msc / t, tsc=p.tsc / t, entry=p.entry / t)


class Tempered:
    """A model at a temperature: draws of sequences of a length, and how much likelier they are than under the background."""

    def __init__(self, model: Model, t: float, length: int, multihit: bool = True):
        self.t, self.length, self.f = t, length, model.bg
        self.flat = not np.isfinite(t)
        if self.flat:
            return
        self.p = tempered(configure(model, multihit=multihit), t)
        k = len(self.f)
        odds = self.f[:, None] * np.exp(self.p.msc[:k])
        total = odds.sum(0)
        with np.errstate(divide="ignore"):
            self.mean = replace(self.p, msc=np.tile(np.log(total), (k + 1, 1)))  # over all residues at once
        score, self.lattice = K.forward(self.mean, np.zeros((1, length), np.int64), np.array([length]), keep=True)
        self.z = float(score[0])
        self.letters = np.cumsum(odds / np.where(total > 0, total, 1), axis=0)

    def draw(self, n: int, rng: np.random.Generator) -> np.ndarray:
        """n sequences as rows of residue codes."""
        x = rng.choice(len(self.f), (n, self.length), p=self.f)
        if self.flat:
            return x
        matched: list[np.ndarray] = []
        sampled(self.mean, self.lattice, self.length, n, rng, matched)
        row, at, node = np.concatenate(matched).T
        x[row, at - 1] = (self.letters[:, node] < rng.random(len(node))).sum(0).clip(0, len(self.f) - 1)
        return x

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        """ln of how much likelier sequences are to be drawn here than from the background."""
        return np.zeros(len(x)) if self.flat else K.forward(self.p, x, np.full(len(x), self.length)) - self.z


def samples(spark: SparkSession, model: Model, length: int = 100, n: int = 2000, temperatures: tuple[float, ...] = TEMPERATURES, seed: int = 42, multihit: bool = True) -> DataFrame:
    """(i, temperature, bits, weight) of n sequences of a length for each temperature; a weight times a sample's share is the background's probability. Batches draw from generators of their own."""
    if not temperatures or n <= 0 or length <= 0:
        raise ValueError("samples need a temperature, a number and a length")
    null = length * np.log(length / (length + 1)) + np.log(1 / (length + 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, at = configure(model, multihit=multihit), [Tempered(model, t, length, multihit) for t in temperatures]
        for pdf in batches:
            for job in pdf.id.tolist():
                which, part = divmod(job, -(-n // BATCH))
                count = min(BATCH, n - part * BATCH)
                x = at[which].draw(count, np.random.default_rng([seed, which, part]))
                ratios = np.stack([a.log_ratio(x) for a in at])
                top = ratios.max(0)
                weight = np.exp(-top) / np.exp(ratios - top).mean(0)
                bits = (K.forward(p, x, np.full(count, length)) - null) / np.log(2)
                yield pd.DataFrame({"i": np.arange(count) + part * BATCH + which * n, "temperature": temperatures[which], "bits": bits, "weight": weight})

    jobs = len(temperatures) * -(-n // BATCH)
    return spark.range(0, jobs, 1, min(jobs, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(run, "i bigint, temperature double, bits double, weight double")


def p_values(drawn: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(bits, p, error): the probability that a background sequence scores thresholds(bits) or more, and its standard error.

    Samples are sorted into the thresholds that they reach last, so that each is looked at once; a null threshold is left out.
    """
    some = thresholds.select(F.col("bits").cast("double").alias("bits")).where("bits is not null").distinct()
    limits = sorted(r.bits for r in some.collect())  # the caller's thresholds
    if not limits:
        return drawn.sparkSession.createDataFrame([], "bits double, p double, error double")
    at = F.size(F.filter(F.array(*map(F.lit, limits)), lambda s: s <= F.col("bits")))
    sums = {r.at: r for r in drawn.groupBy(at.alias("at")).agg(F.sum("weight").alias("w"), F.sum(F.col("weight") ** 2).alias("ww"), F.count("*").alias("n")).collect()}
    total = sum(r.n for r in sums.values())
    rows, w, ww = [], 0.0, 0.0
    for k in range(len(limits), 0, -1):
        if k in sums:
            w, ww = w + sums[k].w, ww + sums[k].ww
        p = w / total
        rows.append((limits[k - 1], p, float(np.sqrt(max(0.0, ww / total - p * p) / total))))
    return drawn.sparkSession.createDataFrame(rows, "bits double, p double, error double")
