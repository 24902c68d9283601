"""Clusters of sampled segments: the same whether their links are all held or worked out when reached, within a bound."""

import numpy as np

from seqloom.operators import ensemble as E


def test_links_of_many_segments_are_not_all_held(monkeypatch):
    rng = np.random.default_rng(1)
    i, k = rng.integers(1, 900, 600), rng.integers(1, 40, 600)
    s = np.unique(np.column_stack([i, i + rng.integers(3, 40, 600), k, k + rng.integers(3, 40, 600)]), axis=0)
    want = E.components(E.linked(s))
    assert 1 < len(np.unique(want)) < len(s)
    shapes, plain = [], E.linked
    monkeypatch.setattr(E, "linked", lambda *a, **k: shapes.append((out := plain(*a, **k)).size) or out)
    monkeypatch.setattr(E, "DENSE", 50)
    assert np.array_equal(E.clustered(s), want) and max(shapes) <= 2500
