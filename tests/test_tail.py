"""Tail probabilities by importance sampling against all sequences there are, and against counting."""

import itertools
import math

import numpy as np
import pytest

from seqloom.operators import kernels as K
from seqloom.operators import profile as P
from seqloom.operators import tail as T


@pytest.fixture(scope="module")
def small():
    return P.single_sequence("s", "ACGTCA", popen=0.05, pextend=0.3, alphabet="dna")


def every(model, length):
    """Bits of all sequences of a length, and their probabilities."""
    x = np.array(list(itertools.product(range(4), repeat=length)))
    null = length * math.log(length / (length + 1)) + math.log(1 / (length + 1))
    score = np.concatenate([K.forward(P.configure(model), part, np.full(len(part), length)) for part in np.array_split(x, 16)])
    return (score - null) / math.log(2), np.prod(model.bg[x], axis=1)


def test_ratios_are_a_distribution(small):
    """Summed over all sequences, the background times the ratio is 1: draws are what they are weighed as."""
    x = np.array(list(itertools.product(range(4), repeat=7)))
    prob = np.prod(small.bg[x], axis=1)
    for t in (1.0, 2.0, 5.0, float("inf")):
        a = T.Tempered(small, t, 7)
        ratio = np.exp(a.log_ratio(x))
        assert math.isclose((prob * ratio).sum(), 1, rel_tol=1e-6)
        drawn = a.draw(20000, np.random.default_rng(1))
        seen = np.bincount((drawn * 4 ** np.arange(6, -1, -1)).sum(1), minlength=4**7) / 20000
        top = np.argsort(-prob * ratio)[:20]
        assert np.allclose(seen[top], (prob * ratio)[top], atol=0.01)


def test_tails_are_those_of_all_sequences(spark, small):
    bits, prob = every(small, 8)
    limits = [float(np.quantile(bits, q)) for q in (0.3, 0.9, 0.99, 0.999)] + [float(np.sort(bits)[-4]) - 1e-9]
    exact = [float(prob[bits >= s].sum()) for s in limits]
    found = {r.bits: r for r in T.p_values(T.samples(spark, small, 8, 4000), spark.createDataFrame([(s,) for s in [*limits, None, limits[0]]], "bits double")).collect()}
    assert len(found) == 5 and exact[-1] < 1e-4
    for s, p in zip(limits, exact, strict=True):
        assert abs(found[s].p - p) < 5 * found[s].error + 1e-12 and found[s].error < 0.15 * p


def test_far_tails_go_on_where_counting_stops(spark):
    rng = np.random.default_rng(2)
    m = P.single_sequence("w", "".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), 25)))
    drawn = T.samples(spark, m, 60, 2000).cache()
    null = 60 * math.log(60 / 61) + math.log(1 / 61)
    counted = (K.forward(P.configure(m), rng.choice(20, (20000, 60), p=m.bg), np.full(20000, 60)) - null) / math.log(2)
    near = float(np.quantile(counted, 0.999))
    limits = [near, near + 10, near + 20, near + 30]
    p = {r.bits: (r.p, r.error) for r in T.p_values(drawn, spark.createDataFrame([(s,) for s in limits], "bits double")).collect()}
    assert 0.5e-3 < p[near][0] < 2e-3
    assert p[limits[3]][0] < 1e-9 and p[limits[3]][1] < 0.3 * p[limits[3]][0]
    slopes = [math.log(p[limits[k]][0] / p[limits[k + 1]][0]) / 10 for k in range(3)]
    assert all(abs(s - math.log(2)) < 0.15 for s in slopes)  # tails of Forward scores fall by half a bit
    again = T.samples(spark, m, 60, 2000).repartition(3)
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, again.collect()))


def test_what_cannot_be_sampled_is_refused(spark, small):
    for more in ({"n": 0}, {"length": 0}, {"temperatures": ()}):
        with pytest.raises(ValueError, match="samples need"):
            T.samples(spark, small, **more)
    assert T.p_values(T.samples(spark, small, 8, 10), spark.createDataFrame([], "bits double")).collect() == []
