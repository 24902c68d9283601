"""Row weights against plain trees and clusters."""

import random

import numpy as np
import pytest

from seqloom.operators import weights as W


def plain_differences(rows):
    out = np.ones((len(rows), len(rows)))
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            n = min(sum(c.isalpha() for c in a), sum(c.isalpha() for c in b))
            same = sum(x.upper() == y.upper() and x.isalpha() for x, y in zip(a, b, strict=True))
            out[i, j] = 0 if i == j else 1 - (same / n if n else 0)
    return out


def plain_tree_weights(rows):
    """Average linkage by all pairs of members, then branches given to the leaves below in proportion to what these have."""
    d = plain_differences(rows)
    groups, height, w = [[k] for k in range(len(rows))], [0.0] * len(rows), np.zeros(len(rows))
    while len(groups) > 1:
        pairs = [(np.mean([d[x, y] for x in a for y in b]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        best = min(pairs, key=lambda p: (round(p[0], 12), p[1], p[2]))
        h, i, j = best[0] / 2, best[1], best[2]
        for k in (i, j):
            below = groups[k]
            total = w[below].sum()
            w[below] += (h - height[k]) * (w[below] / total if total > 0 else 1 / len(below))
        groups[i], height[i] = groups[i] + groups[j], h
        del groups[j], height[j]
    return w / w.sum() * len(rows) if w.sum() else np.ones(len(rows))


def some_rows(rng, n, width=12):
    seed = "".join(rng.choice("ACDEFG") for _ in range(width))
    out = []
    for _ in range(n):
        row = list(rng.choice([seed, *out]) if out else seed)
        for _ in range(rng.randint(0, 4)):
            row[rng.randrange(width)] = rng.choice("ACDEFG-")
        out.append("".join(row))
    return out


def test_branches_weigh_as_in_a_plain_tree():
    rng = random.Random(3)
    for n in (1, 2, 3, 8, 15):
        for _ in range(6):
            rows = sorted(set(some_rows(rng, n)))
            d = W.differences(rows)
            assert np.allclose(d, plain_differences(rows))
            d += np.triu(np.random.default_rng(n).uniform(0, 1e-3, d.shape), 1)  # no ties: which pair comes first is settled
            d = np.triu(d, 1) + np.triu(d, 1).T
            expected = plain_of(d)
            assert np.allclose(W.branch_weights(d, np.ones(len(rows))), expected)


def plain_of(d):
    n = len(d)
    groups, height, w = [[k] for k in range(n)], [0.0] * n, np.zeros(n)
    while len(groups) > 1:
        h, i, j = min((np.mean(d[np.ix_(a, b)]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        h /= 2
        for k in (i, j):
            below, total = groups[k], w[groups[k]].sum()
            w[below] += (h - height[k]) * (w[below] / total if total > 0 else 1 / len(below))
        groups[i], height[i] = groups[i] + groups[j], h
        del groups[j], height[j]
    return w / w.sum() * n if w.sum() else np.ones(n)


def test_repeated_rows_share_a_weight(spark):
    """Copies are leaves without branches of their own."""
    family = ["ACDEFG", "ACDEFA", "GGGEFA", "GGDAAA"]
    copies = [3, 1, 2, 1]
    rows = [(1, k, s) for k, s in enumerate(s for s, n in zip(family, copies, strict=True) for _ in range(n))]
    rows += [(2, 0, "AC"), (2, 1, "AC"), (3, 0, "A-C"), (4, 5, "--"), (4, 6, "AC"), (5, 0, None)]
    df = spark.createDataFrame(rows, "msa_id int, row_idx int, aseq string")
    found = {(r.msa_id, r.row_idx): r.weight for r in W.tree_weights(df).collect()}
    expected = plain_tree_weights([s for m, _, s in rows if m == 1])
    assert np.allclose([found[1, k] for k in range(7)], expected)
    assert [found[2, 0], found[2, 1], found[3, 0]] == [1, 1, 1] and found[4, 5] == found[4, 6] == 1 and (5, 0) not in found
    assert W.tree_weights(df.limit(0)).collect() == []


def test_large_alignments_are_refused_rather_than_cut(spark, monkeypatch):
    monkeypatch.setattr(W, "MOST", 2)
    df = spark.createDataFrame([(1, k, "ACD"[k:] + "E" * k) for k in range(3)], "msa_id int, row_idx int, aseq string")
    with pytest.raises(Exception, match="distinct rows"):
        W.tree_weights(df).collect()


def test_clusters_weigh_alike(spark):
    rows = [(1, k, s) for k, s in enumerate(["ACDEFG", "ACDEFA", "ACDEFG", "WWWWWW", "YYYYYY", "YYYYYY"])]
    found = {r.row_idx: r.weight for r in W.cluster_weights(spark.createDataFrame(rows, "msa_id int, row_idx int, aseq string")).collect()}
    assert {k: round(v, 6) for k, v in found.items()} == {0: 0.666667, 1: 0.666667, 2: 0.666667, 3: 2.0, 4: 1.0, 5: 1.0}


@pytest.mark.parametrize("block", [1024, 3])
def test_links_are_those_of_all_pairs(spark, monkeypatch, block):
    from pyspark.sql import functions as F

    from seqloom.operators import clusters as C

    monkeypatch.setattr(C, "BLOCK", block)
    rng = random.Random(6)
    rows = [(m, k, s) for m in (1, 2) for k, s in enumerate(some_rows(rng, 25) + ["------------", "acdefg------", "ACDEFG------"])] + [(3, 0, "AC"), (4, 0, None)]
    df = spark.createDataFrame(rows, "msa_id int, row_idx bigint, aseq string")
    d = C.distinct_rows(df.where("aseq is not null"))
    x, y = (d.select("msa_id", F.col("rep").alias(n), F.col("aseq").alias(f"{n}_seq")) for n in "ab")
    pid = C.identity(F.col("a_seq"), F.col("b_seq"))
    for least in (0.3, 0.62, 1.0):
        expected = {(r.msa_id, r.a, r.b, round(r.pid, 9)) for r in x.join(y, "msa_id").where("a < b").select("msa_id", "a", "b", pid.alias("pid")).where(F.col("pid") >= least).collect()}
        found = [(r.msa_id, r.a, r.b, round(r.pid, 9)) for r in C.identity_links(df, least).collect()]
        assert set(found) == expected and len(found) == len(expected) > 2
