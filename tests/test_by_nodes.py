"""The ungapped filter node by node: what it gives position by position, in as many passes as there are nodes and not letters."""

import numpy as np
import pytest

from seqloom.operators import kernels as K
from seqloom.operators import profile as P


def letters(rng, n):
    return "".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), n))


def position_by_position(profiles, codes):
    lengths = np.array([len(c) for c in codes])
    order = np.argsort(-lengths, kind="stable")
    xj, over = K._ungapped(profiles, [codes[i] for i in order])
    out = np.empty((len(codes), len(profiles)))
    out[order] = K._msv_nats(xj, over, lengths[order, None])
    return out


@pytest.mark.parametrize("span", [1 << 19, 700, 1])
def test_scores_are_those_of_the_filter_position_by_position(monkeypatch, span):
    monkeypatch.setattr(K, "SPAN", span)
    rng = np.random.default_rng(span)
    words = [letters(rng, n) for n in (30, 47, 90, 140, 394)]
    profiles = [P.configure(P.single_sequence("w", w)) for w in words]
    from seqloom.functions.alphabet import digitize

    seqs = [letters(rng, n) for n in (1, 2, 9, 60, 300, 2500)]
    for w in words:  # hits that raise what follows, one, several in a row, overlapping ones, and some that overflow
        for size in (5, 8, 9, 10, 11, 12, 13, 15, 30):
            seqs += [letters(rng, 40).join([w[a : a + size] for a in rng.integers(0, len(w) - size + 1, many)]) + "X" * int(rng.integers(0, 2)) for many in (2, 5, 40)]
    codes = [digitize(s) for s in seqs]
    got, want = K.msv_many(profiles, codes), position_by_position(profiles, codes)
    assert np.array_equal(got, want) and K._by_nodes(profiles, codes, np.array([len(c) for c in codes])) is not None
    floor = K._msv_nats(np.full(len(codes), 190), np.zeros(len(codes), bool), np.array([len(c) for c in codes]))[:, None]
    assert np.isinf(got).any() and ((got > floor) & np.isfinite(got)).sum() > 8  # J was of use


def test_passes_go_with_nodes_and_not_with_the_longest_sequence(monkeypatch):
    calls, plain = [], K._best_cells
    monkeypatch.setattr(K, "_best_cells", lambda gain, nodes, *more: calls.append(len(nodes)) or plain(gain, nodes, *more))
    monkeypatch.setattr(K, "_ungapped", lambda *a: pytest.fail("position by position"))
    rng = np.random.default_rng(3)
    p = P.configure(P.single_sequence("w", letters(rng, 50)))
    K.msv_many([p], [rng.integers(0, 20, n) for n in (90_000, 700, 800, 30)])
    assert calls and sum(calls) <= 50 * 20


def test_models_of_many_kinds_of_nodes_go_position_by_position():
    rng = np.random.default_rng(5)
    p = P.configure(P.single_sequence("w", letters(rng, 80)))
    p.msc[:, 1:] += rng.normal(0, 0.5, p.msc[:, 1:].shape)
    codes = [rng.integers(0, 20, n) for n in (300, 200, 5)]
    assert K._by_nodes([p], codes, np.array([300, 200, 5])) is None
    assert np.array_equal(K.msv_many([p], codes), position_by_position([p], codes))


def test_stretches_look_up_each_kind_of_node_once(monkeypatch):
    rng = np.random.default_rng(6)
    p = P.configure(P.single_sequence("w", "".join(rng.choice(list("ACGT"), 40)), popen=0.03, pextend=0.75, alphabet="dna"))
    codes = [rng.integers(0, 4, n) for n in (500, 90)] + [p.msc[:4, 1:].argmax(0)]
    want = [K.ssv_windows(p, c, 30) for c in codes]
    calls, plain = [], np.take
    monkeypatch.setattr(np, "take", lambda *a, **k: calls.append(1) or plain(*a, **k))
    assert [sorted(some) for some in K.ssv_windows_many(p, codes, 30)] == [sorted(some) for some in want] and want[2]
    assert len(calls) <= 4


def test_a_long_target_leaves_the_cascade_whole_batches(monkeypatch):
    from seqloom.operators import search as R

    rng = np.random.default_rng(7)
    model = R.calibrated(P.single_sequence("w", letters(rng, 30)))
    seqs = [letters(rng, n) for n in (20_000, *range(50, 110))]
    calls, plain = [], K.forward
    monkeypatch.setattr(K, "forward", lambda p, x, n: calls.append(len(x)) or plain(p, x, n))
    found = R.cascade(model, R.Config(f1=1.0, f2=1.0, f3=-1.0, bias=False), list(range(61)), [None] * 61, seqs)
    assert calls == [61] and found.past_fwd.tolist() == [0]
