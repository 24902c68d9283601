"""Hard negatives against a plain version."""

import math
import random

import pytest

from pyspark.sql import functions as F

from seqloom.llm import negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int, score bigint, block int, width string, a_ids int, id bigint"


def brute(rows, positives=5, most=5, least=80, scale=256):
    good = [(i, [math.floor(scale * x) if abs(x) < 2**53 else int(x) * scale for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, u, y in good:
        if a % 10:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(u, v, strict=True)), i, z) for i, v, z in good if len(v) == len(u)), key=lambda x: x[:2])
        for s, p, _ in [x for x in scored if x[2] == y and x[1] != a][:positives]:
            ok = [(n, t) for t, n, z in scored if z != y and least * -s <= 100 * -t <= 100 * -s][:most]
            out += [(a, p, k + 1, n, clip(-s), clip(-t)) for k, (n, t) in enumerate(ok)]
    return out


def clip(x):
    return min(max(x, -(2**63)), 2**63 - 1)


def make(n, width=6, seed=1, spread=1.0, labels=3):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(labels)]
    return [(i, [0.4 * c + spread * rng.gauss(0, 0.3) for c in centre[rng.randrange(labels)]], rng.randrange(labels)) for i in range(n)]


def awkward():
    rows = make(150)
    rows += [(200 + i, v, y) for i, v, y in rows[:40]]  # the same vectors again: ties
    rows += [(None, rows[0][1], 1), (300, None, 1), (310, rows[0][1], None), (320, [1.0, None, 2.0, 0.0, 0.0, 0.0], 1), (330, [math.nan] * 6, 1), (340, [math.inf] + [0.0] * 5, 1), (350, [0.0] * 6, 2)]
    rows += [(360, [], 0), (361, [], 0), (362, [], 1), (370, [1.0, 2.0], 0), (371, [1.0, 2.0], 0), (372, [1.0, 1.9], 1), (380, [5.0, 5.0, 5.0], 0)]
    return rows + [rows[10], rows[10], (20, rows[21][1], 0)]  # repeated rows, and one id with another vector


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, 1, "w", 2, 3) for r in rows], SCHEMA)


def found(spark, rows, **more):
    return sorted(map(tuple, negatives.mine(table(spark, rows).repartition(3), F.col("vec_id") % 10 == 0, **more).collect()))


@pytest.mark.parametrize(("rows_of", "anchors_of"), [(16_384, 1024), (7, 3), (1, 1)])
def test_every_anchor_has_the_negatives_of_a_sort_over_all_rows(spark, rows_of, anchors_of):
    rows = awkward() if rows_of > 1 else awkward()[150:]
    expected = sorted(brute(rows))
    assert len(expected) > (100 if rows_of > 1 else 5)
    assert found(spark, rows, block_rows=rows_of, block_anchors=anchors_of) == expected


def test_other_numbers_of_rows_and_limits(spark):
    rows = make(120, seed=4)
    for positives, most, least in ((1, 2, 50), (3, 200, 95), (200, 1, 0)):
        assert found(spark, rows, positives=positives, negatives=most, least=least, block_rows=25) == sorted(brute(rows, positives, most, least))


@pytest.mark.parametrize("spread", [1e6, 1e16, 1e150])
def test_scores_stay_exact_however_large_components_are(spark, spread):
    rows = [(i, [x * spread for x in v], y) for i, v, y in make(60, seed=8)]
    assert found(spark, rows, block_rows=20) == sorted(brute(rows))


def test_keys_of_large_scores_sort_as_they_do():
    rng = random.Random(2)
    values = sorted({rng.choice((-1, 1)) * rng.getrandbits(rng.randint(62, 900)) | 1 << 62 for _ in range(200)} | {-(2**63), 2**63, -(2**70), 2**64})
    keys = [(negatives.clipped(x), negatives.key(x)) for x in values]
    assert keys == sorted(keys, key=lambda k: (k[0], k[1] or b"")) and [negatives.unkey(k, c) for c, k in keys] == values


def test_without_rows_or_anchors_there_are_none(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).collect() == []
    assert found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
