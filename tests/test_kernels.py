"""Kernels against plain recursions, and their identities."""

import math

import numpy as np
import pytest

from seqloom.functions.alphabet import AMINO, digitize
from seqloom.operators import kernels as K
from seqloom.operators import profile as P

RNG = np.random.default_rng(7)


def model(m=6):
    seq = "".join(RNG.choice(list(AMINO), m))
    return P.single_sequence("q", seq, popen=0.1)


def plain(p, x, plus):
    """Forward or Viterbi cell by cell."""
    n, m = len(x), p.m
    t, (loop, move) = p.tsc, (float(v) for v in p.length_model(n))
    ec, ej = p.end
    low = -math.inf
    M, I, D = ([[low] * (m + 1) for _ in range(n + 1)] for _ in range(3))
    N, B, J, C = [0.0] * (n + 1), [low] * (n + 1), [low] * (n + 1), [low] * (n + 1)
    B[0] = move
    for i in range(1, n + 1):
        e = low
        for k in range(1, m + 1):
            into = B[i - 1] + p.entry[k]
            if k > 1:
                for state, step in ((M, P.MM), (I, P.IM), (D, P.DM)):
                    into = plus(into, state[i - 1][k - 1] + t[k - 1, step])
                D[i][k] = plus(M[i][k - 1] + t[k - 1, P.MD], D[i][k - 1] + t[k - 1, P.DD])
            M[i][k] = into + p.msc[x[i - 1], k]
            if k < m:
                I[i][k] = plus(M[i - 1][k] + t[k, P.MI], I[i - 1][k] + t[k, P.II])
            if p.local or k == m:
                e = plus(e, plus(M[i][k], D[i][k]))
        J[i] = plus(J[i - 1] + loop, e + ej)
        C[i] = plus(C[i - 1] + loop, e + ec)
        N[i] = N[i - 1] + loop
        B[i] = plus(N[i] + move, J[i] + move)
    return C[n] + move


def logsum(a, b):
    high, low = max(a, b), min(a, b)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


@pytest.mark.parametrize("local", [True, False])
@pytest.mark.parametrize("multihit", [True, False])
@pytest.mark.parametrize("m", [1, 2, 6])
def test_scores_equal_plain_recursions(local, multihit, m):
    p = P.configure(model(m), local, multihit)
    xs = [RNG.integers(0, 20, n) for n in (1, 4, 17, 9)]
    batch = K.batch(xs)
    for kernel, plus in ((K.viterbi, max), (K.forward, logsum)):
        want = [plain(p, x, plus) for x in xs]
        assert np.allclose(kernel(p, *batch), want, atol=1e-9)
    assert np.allclose(K._forward(p, *batch, np.logaddexp, False)[0], K.forward(p, *batch))
    assert (K.viterbi(p, *batch) <= K.forward(p, *batch) + 1e-12).all()


@pytest.mark.parametrize("local", [True, False])
def test_backward_equals_forward_and_posteriors_sum_to_one(local):
    p = P.configure(model(8), local)
    for n in (1, 5, 40):
        post = K.Posterior(p, RNG.integers(0, 20, n))
        assert math.isclose(post.score, post.back_score, abs_tol=1e-9)
        total = post.match[1:].sum(1) + post.insert[1:].sum(1) + post.n[1:] + post.j[1:] + post.c[1:]
        assert np.allclose(total, 1)
        assert math.isclose(post.btot[-1] + post.begin[-1], post.etot[-1], abs_tol=1e-6) or post.etot[-1] > 0


def test_quantised_filters_are_near_full_precision():
    p = P.configure(model(12))
    xs = [RNG.integers(0, 20, n) for n in (30, 80, 200)]
    batch = K.batch(xs)
    assert np.abs(K.viterbi_int(p, *batch) - K.viterbi(p, *batch)).max() < 1.2  # loops count 0 and 3 nats are taken at the end
    order = np.array([2, 0, 1])
    assert (K.msv(p, *K.batch([xs[i] for i in order])) == K.msv(p, *batch)[order]).all()


def test_a_planted_match_is_found_where_it_is():
    m = P.single_sequence("q", "WCHMKWYFHC")
    p = P.configure(m)
    x = np.concatenate([RNG.choice([0, 9, 15], 30), digitize("WCHMKWYFHC"), RNG.choice([0, 9, 15], 20)])
    post = K.Posterior(p, x)
    assert K.regions(post) == [(31, 40)]
    _, path = K.optimal_accuracy(p, post)
    assert [(s, k, i) for s, k, i, _ in path if s == "M"] == [("M", k, 30 + k) for k in range(1, 11)]
    assert [i for _, _, i, _ in path if i] == sorted(i for _, _, i, _ in path if i)
    assert not K.is_multidomain(post, 31, 40)
    twice = np.concatenate([x[:40], x[30:40]])
    both = K.Posterior(p, twice)
    assert K.is_multidomain(both, 31, 50) or len(K.regions(both)) == 2


def test_null2_odds_average_to_one_under_their_own_background():
    m = model(10)
    uni = P.configure(m, multihit=False)
    post = K.Posterior(uni, digitize(m.consensus))
    odds = K.null2(uni, post, 1, 10)
    assert math.isclose(float((odds[:20] * m.bg).sum()), 1, abs_tol=0.05)


def test_statistics_of_models():
    m = model(15)
    m.check()
    occ = P.occupancy(m.t)
    assert ((occ[1:] > 0) & (occ[1:] <= 1)).all()
    assert math.isclose(P.composition(m).sum(), 1)
    assert np.allclose(P.logo(m).sum(1), P.relative_entropy(m.mat, m.bg))
    assert P.consensus(m).upper() == m.consensus
    assert P.max_length(m) >= 15
    f = np.exp(P.configure(m).entry[1:])
    assert math.isclose((f * (15 - np.arange(1, 16) + 1)).sum(), 1)


def test_sampled_paths_follow_the_posterior_and_find_both_copies():
    from seqloom.operators import ensemble as E

    p = P.configure(P.single_sequence("q", "WCHMKWYFHC"))
    x = np.concatenate([digitize("WCHMKWYFHC"), RNG.choice([0, 9, 15], 6), digitize("WCHMKWYFHC")])
    _, lat = K.forward(p, x[None, :], np.array([len(x)]), keep=True)
    rng = np.random.default_rng(1)
    rows = E.sampled(p, lat, len(x), 300, rng)
    drawn = [sorted(rows[rows[:, 0] == path, 1:].tolist()) for path in range(300)]
    covered = np.zeros(len(x) + 1)
    for path in drawn:
        assert all(a[1] < b[0] for a, b in zip(path, path[1:], strict=False))
        for i, j, k, m in path:
            assert 1 <= i <= j <= len(x) and 1 <= k <= m <= 10
            covered[i : j + 1] += 1 / len(drawn)
    assert np.abs(covered - K.Posterior(p, x).mocc)[1:].max() < 0.12
    assert E.envelopes(p, x) == [(1, 10), (17, 26)]


def test_pairs_of_the_ungapped_filter_equal_single_rows():
    """Many models at once against the definition, row by row, in wide integers."""
    models = [P.single_sequence(f"m{i}", "".join(RNG.choice(list(AMINO), RNG.integers(1, 60)))) for i in range(9)]
    profiles = [P.configure(m) for m in models]
    codes = [RNG.integers(0, 21, RNG.integers(0, 90)) for _ in range(14)] + [digitize(models[8].consensus * 3), digitize(models[3].consensus)]

    def plain(p, x):
        cost, bias = P.quantise_msv(p)
        unit = lambda s: int(min(255, max(0, np.floor(-3 / np.log(2) * s + 0.5))))
        tjb, tbm, tec = unit(np.log(3 / (len(x) + 3))), unit(np.log(2 / (p.m * (p.m + 1)))), unit(np.log(0.5))
        row, xj, xb, over = [0] * (p.m + 1), 0, max(0, 190 - tjb - tbm), False
        for c in x:
            row = [0, *(max(0, min(255, max(row[k - 1], xb) + bias) - int(cost[c, k])) for k in range(1, p.m + 1))]
            over |= max(row) >= 255 - bias
            xj = max(xj, max(0, max(row[1:]) - tec))
            xb = max(0, max(190, xj) - tjb - tbm)
        return np.inf if over else (xj - tjb - 190) / (3 / np.log(2)) - 3

    got = K.msv_many(profiles, codes)
    for i, x in enumerate(codes):
        for j, p in enumerate(profiles):
            assert got[i, j] == -np.inf if not len(x) else np.isclose(got[i, j], plain(p, x))
    assert np.isinf(got[-2, 8]) and got[-2, 8] > 0


def test_bias_null_of_a_batch_equals_single_sequences():
    m = P.single_sequence("m", "WWCCHH")
    codes = [RNG.integers(0, 21, n) for n in (1, 30, 7, 7, 2)]
    odds, stay0, stay1 = np.append(P.composition(m) / m.bg, 1.0), 400 / 401, (6 / 8) / (6 / 8 + 1)
    for x, got in zip(codes, K.bias_nulls(m.bg, P.composition(m), 6, *K.batch(codes)), strict=True):
        a, b = 0.999, 0.001
        for i, c in enumerate(x):
            if i:
                a, b = a * stay0 + b * (1 - stay1), a * (1 - stay0) + b * stay1
            b *= odds[c]
        assert math.isclose(got, math.log(a + b), rel_tol=1e-9)
