"""Scores, P-values, E-values and length models as Column functions, and their SQL names.

Scores are in nats, bit scores in bits. A null argument gives null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

LN2 = math.log(2)
OMEGA = 1 / 256
# Default thresholds of reporting, inclusion and the filters.
E_REPORT, E_INCLUDE = 10.0, 0.01
F1, F2, F3 = 0.02, 1e-3, 1e-5


def null1(length: Column) -> Column:
    """Log probability of a sequence's length under the null model; residues cancel out."""
    n = length.cast("double")
    return n * F.log(n / (n + 1)) + F.log(1 / (n + 1))


def bits(score: Column, null: Column) -> Column:
    return (score - null) / LN2


def gumbel_p(x: Column, mu, lam) -> Column:
    """P(X >= x) of a Gumbel distribution."""
    return -F.expm1(-F.exp(-lam * (x - mu)))


def gumbel_ln_p(x: Column, mu, lam) -> Column:
    """Its logarithm, exact in the tail where P itself underflows."""
    y = -lam * (x - mu)
    return F.when(y < -20, y).otherwise(F.log(gumbel_p(x, mu, lam)))


def exponential_p(x: Column, tau, lam) -> Column:
    """P(X >= x) of an exponential tail that starts at tau."""
    return F.exp(F.least(F.lit(0.0), -lam * (x - tau)))


def exponential_ln_p(x: Column, tau, lam) -> Column:
    return F.least(F.lit(0.0), -lam * (x - tau))


def evalue(p: Column, z: Column) -> Column:
    return p * z


def long_target_ln_p(ln_p: Column, residues: Column, window: Column) -> Column:
    """ln P of a hit among residues / window independent places."""
    return ln_p + F.log(residues.cast("double") / window)


def log_sum(a: Column, b: Column) -> Column:
    high, low = F.greatest(a, b), F.least(a, b)
    return high + F.log1p(F.exp(low - high))


def sequence_bias(n2sc: Column) -> Column:
    """The null2 correction of a sequence from its summed residue scores."""
    return log_sum(F.lit(0.0), F.lit(math.log(OMEGA)) + n2sc)


def lambda_edge(nodes: Column, entropy_bits: Column) -> Column:
    return LN2 + 1.44 / (nodes * entropy_bits)


def gumbel_mu(x: Column, lam: float) -> Column:
    """Aggregate: location by maximum likelihood, the slope known."""
    return -F.log(F.avg(F.exp(-lam * x))) / lam


def tail_shift(mu: Column, lam: Column, mass: float = 0.04) -> Column:
    """Start of an exponential tail from a fitted Gumbel and the mass that the tail holds."""
    return mu - F.log(-F.log1p(F.lit(-mass))) / lam + math.log(mass) / lam


def move_probability(length: Column, multihit: bool = True) -> Column:
    nj = 1 if multihit else 0
    return (2.0 + nj) / (length + 2.0 + nj)


def posterior_code(p: Column) -> Column:
    """A posterior probability as 0-9 or *."""
    return F.when(p + 0.05 >= 1.0, "*").otherwise(F.floor((p + 0.05) * 10).cast("string"))


def quantised(score: Column, scale: float, low: int, high: int, bias: int = 0) -> Column:
    """A score in integer units, clamped; half away from zero is rounded up in size, as C does."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.round(-scale * score) + bias)).cast("int")


SQL_NAMES = {
    "sl_null1": "(n DOUBLE) RETURNS DOUBLE RETURN n * ln(n / (n + 1)) + ln(1 / (n + 1))",
    "sl_bits": "(score DOUBLE, null_score DOUBLE) RETURNS DOUBLE RETURN (score - null_score) / ln(2)",
    "sl_gumbel_p": "(x DOUBLE, mu DOUBLE, lam DOUBLE) RETURNS DOUBLE RETURN -expm1(-exp(-lam * (x - mu)))",
    "sl_exponential_p": "(x DOUBLE, tau DOUBLE, lam DOUBLE) RETURNS DOUBLE RETURN exp(least(0, -lam * (x - tau)))",
    "sl_log_sum": "(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN greatest(a, b) + log1p(exp(least(a, b) - greatest(a, b)))",
}


def register(spark: SparkSession) -> None:
    """Temporary SQL functions, which Catalyst inlines."""
    for name, body in SQL_NAMES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
