"""Models that differ in match scores alone take the stages of a long-target search together, with the results that each has alone."""

from dataclasses import replace

import numpy as np
import pytest

from seqloom.functions.alphabet import digitize
from seqloom.operators import ensemble as E
from seqloom.operators import kernels as K
from seqloom.operators import longtarget as L
from seqloom.operators import profile as P
from seqloom.operators import search as R


def dna(rng, n):
    return "".join(rng.choice(list("ACGT"), n))


@pytest.fixture(scope="module")
def scanners():
    rng = np.random.default_rng(4)
    models = [P.single_sequence(f"m{i}", dna(rng, m), popen=popen, pextend=0.75, alphabet="dna") for i, (m, popen) in enumerate([(30, 0.03), (30, 0.03), (24, 0.03), (30, 0.01), (30, 0.03)])]
    for m in models:
        m.max_length = 50
    return [L.Scanner(R.calibrated(m)) for m in models]


@pytest.fixture(scope="module")
def targets(scanners):
    rng = np.random.default_rng(9)
    words = [s.model.consensus for s in scanners]
    return [dna(rng, 150) + w + dna(rng, 40) + w[:9] + w[:20] + w + "N" * 5 + dna(rng, 30) for w in words] + ["", "ACG", "N" * 40, dna(rng, 700)]


def rounded(found):
    return [(counts, [(c, [round(v, 6) if isinstance(v, float) else v for v in d.values()]) for c, d in hits]) for counts, hits in found]


def test_models_together_find_what_each_finds_alone(scanners, targets):
    codes = [digitize(s, "dna") for s in targets]
    for config in (L.Config(), L.Config(f1=0.2, f2=0.2, f3=0.2), L.Config(bias=False, null2=False)):
        together = L.found_in(scanners, targets, codes, config)
        assert rounded(together) == rounded([L.found_in([s], targets, codes, config)[0] for s in scanners])
        assert all(hits for _, hits in together)


def test_kin_share_their_batches(scanners, targets, monkeypatch):
    calls, plain = [], K.viterbi_crossings
    monkeypatch.setattr(K, "viterbi_crossings", lambda p, x, *more: calls.append(len(x)) or plain(p, x, *more))
    L.found_in(scanners, targets, [digitize(s, "dna") for s in targets], L.Config())
    assert len(calls) == 3 and max(calls) > 2  # three sizes or gap costs


def test_regions_sampled_together_have_the_envelopes_of_each():
    rng = np.random.default_rng(2)
    p = P.configure(P.single_sequence("w", "ACGTTGCAAGGCTTACCGATGCATTGACCA", popen=0.03, pextend=0.75, alphabet="dna"))
    word = p.msc[:4, 1:].argmax(0)
    parts = [np.concatenate([word, rng.integers(0, 4, n), word, word[:n]]) for n in (3, 8, 15, 25)] + [rng.integers(0, 4, 60)]
    targets = [len(c) + 40 for c in parts]
    together = E.envelopes_many(p, parts, targets)
    assert together == [E.envelopes(replace(p, target=n), c) for c, n in zip(parts, targets, strict=True)]
    assert max(map(len, together)) > 1
    for c, n in zip(parts, targets, strict=True):  # the paths themselves, drawn one region at a time
        x, lengths = K.batch([c])
        lat = K.lattices(p, x, lengths, np.array([n]))
        one = E.sampled(replace(p, target=n), lat, len(c), 50, np.random.default_rng(1))
        x, lengths = K.batch([c, c[:20]])
        both = E.sampled_many(p, K.lattices(p, x, lengths, np.array([n, n])), lengths, np.array([n, n]), 50, E.Same(1, 2))
        assert (both[0] == one).all()


def test_components_are_those_of_links():
    rng = np.random.default_rng(6)
    for n in (1, 2, 30, 80):
        link = np.eye(n, dtype=bool)
        for a, b in rng.integers(0, n, (n // 2, 2)):
            link[a, b] = link[b, a] = True
        label = list(range(n))
        for _ in range(n):
            label = [min(label[j] for j in range(n) if link[i, j]) for i in range(n)]
        assert E.components(link).tolist() == label


def test_best_paths_of_many_are_those_of_each():
    rng = np.random.default_rng(3)
    p = P.configure(P.single_sequence("w", "STEELPLATEDTIN"), multihit=False)
    codes = [rng.integers(0, 20, n) for n in (9, 40, 1, 25)]
    posts = [K.Posterior(p, c) for c in codes]
    for post, (score, path) in zip(posts, K.optimal_accuracies(p, posts), strict=True):
        alone = K.optimal_accuracy(p, post)
        assert alone == (score, path) and [i for s, _, i, _ in path if s in "MINCJ"] == sorted(i for s, _, i, _ in path if s in "MINCJ")
