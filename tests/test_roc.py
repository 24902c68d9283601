"""ROC curves whose E-values spread over hundreds of powers of ten, and their bootstrap intervals, against plain versions."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from seqloom.operators import clusters as C

SCHEMA = "id bigint, query string, target string, evalue double"


def rows(n=900, queries=12):
    rng = random.Random(3)
    out = []
    for i in range(n):
        q = f"q{rng.randrange(queries)}"
        good = rng.random() < 0.6
        e = 0.0 if i % 3 == 0 and good else 10 ** rng.uniform(-300, 1)  # a third of them ties
        out.append((i, q, f"{q}/{rng.randrange(200)}" if good else f"decoy{rng.randrange(150)}", e if good else 10 ** rng.uniform(-5, 1)))
    return out + [(n, "q1", "q2/7", 1e-9), (None, "q1", "q1/1", 1.0), (n + 1, None, "decoy1", 1.0), (n + 2, "q1", None, 1.0), (n + 3, "q1", "decoy2", None)]


def draw(name, samples, seed=42):
    out = []
    for b in range(samples):
        h = hashlib.md5(f"{seed}:{b // 4}:{name}".encode()).hexdigest()
        out.append(-math.log((int(h[8 * (b % 4) : 8 * (b % 4) + 8], 16) + 0.5) / 2**32))
    return out


def plain(data, samples, interval, steps=3, top=10.0):
    """A curve for each sample, result by result."""
    good = sorted((e, i, q, t) for i, q, t, e in data if None not in (i, q, t, e) and (t.startswith(q + "/") or t.startswith("decoy")))
    queries, targets = {x[2] for x in good}, {x[3] for x in good}
    w = {n: draw(n, samples) for n in queries | targets}
    base, last = math.floor(round(-math.log10(len(queries)) * steps, 9)), math.ceil(round(math.log10(top) * steps, 9))
    shares = {x: [] for x in range(base, last + 1)}
    for b in range(samples):
        sq, st = sum(w[q][b] for q in queries), sum(w[t][b] for t in targets)
        false, total, at = 0.0, 0.0, Counter()
        for _, _, q, t in good:
            weight = w[q][b] * w[t][b] * len(targets) / (sq * st)
            if t.startswith("decoy"):
                false += weight
            else:
                total += weight
                at[base if not false else min(last + 1, max(base, math.ceil(round(math.log10(false) * steps, 9))))] += weight
        for x in shares:
            shares[x].append(sum(v for k, v in at.items() if k <= x) / total)
    tail = int(samples * (1 - interval) / 2 + 1e-9)
    return {x: (np.mean(v), sorted(v)[tail], sorted(v)[min(samples - 1, samples - tail)]) for x, v in shares.items()}


def test_intervals_are_those_of_curves_made_one_by_one(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    for samples, interval, buckets in ((20, 0.8, 16), (7, 0.95, 1)):
        found = {r.x: (r.mean, r.lower, r.upper) for r in C.roc_intervals(df.repartition(5), samples, interval, buckets=buckets).collect()}
        expected = plain(data, samples, interval)
        assert found.keys() == expected.keys()
        assert all(np.allclose(found[x], expected[x]) for x in expected)
    assert found[max(found)][0] > found[min(found)][0]


def test_draws_are_exponential_and_a_name_has_its_own():
    x = np.concatenate([C.draws(f"n{i}", 500, 1) for i in range(40)])
    assert abs(x.mean() - 1) < 0.03 and abs((x < math.log(2)).mean() - 0.5) < 0.02
    assert np.array_equal(C.draws("a", 7, 1), C.draws("a", 500, 1)[:7]) and not np.allclose(C.draws("a", 9, 1), C.draws("a", 9, 2))


def test_without_results_there_are_no_points(spark):
    assert C.roc_intervals(spark.createDataFrame([], SCHEMA)).collect() == []
    assert C.roc_intervals(spark.createDataFrame([(1, "q", "decoy1", 1.0)], SCHEMA), 5).collect() == []


def test_ranges_hold_about_as_many_rows_each(spark):
    """Also where most E-values are tiny, and a third are equal."""
    df = spark.createDataFrame(rows(4000)[:4000], SCHEMA)
    sizes = [r["count"] for r in C.in_ranges(df, ["evalue", "id"], 16).groupBy("bucket").count().collect()]
    assert len(sizes) >= 14 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


def test_the_curve_counts_what_comes_before_decoys(spark):
    data = rows()
    good = sorted((e, i, q, t) for i, q, t, e in data if None not in (i, q, t, e) and (t.startswith(q + "/") or t.startswith("decoy")))
    false, nq, at = 0, len({x[2] for x in good}), Counter()
    for _, _, q, t in good:
        if t.startswith("decoy"):
            false += 1
        else:
            at[math.ceil(-math.log10(nq) * 3) - 1 if not false else math.ceil(round(math.log10(false / nq) * 3, 9))] += 1
    found = {r.x: r.true_positives for r in C.roc_curve(spark.createDataFrame(data, SCHEMA).where("id is not null and query is not null and target is not null and evalue is not null").where(F.col("evalue") >= 0)).collect()}
    assert found == {x: sum(v for k, v in at.items() if k <= x) for x in at}
