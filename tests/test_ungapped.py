"""The ungapped filter in bytes, against the same recursion cell by cell: overflows, raised entries, models of unlike lengths, unknown residues."""

import tracemalloc

import numpy as np

from seqloom.operators import kernels as K
from seqloom.operators import profile as P

RNG = np.random.default_rng(7)


def plain(p, x):
    """(xJ, whether a cell overflowed) of one sequence, a cell at a time."""
    cost, bias = P.quantise_msv(p)
    base, jump, n = 190, K._third_bits(np.log(0.5)), len(x)
    move = K._third_bits(np.log(3 / (n + 3))) + K._third_bits(np.log(2 / (p.m * (p.m + 1))))
    row, xj, xb = [0] * (p.m + 1), 0, max(0, base - move)
    for c in x:
        new = [0] * (p.m + 1)
        for k in range(1, p.m + 1):
            new[k] = max(0, max(row[k - 1], xb) + int(bias) - int(cost[c, k]))
        if max(new) >= 255 - bias:
            return 0, True
        xj, row = max(xj, max(new) - jump), new
        xb = max(0, max(base, xj) - move)
    return xj, False


def letters(n):
    return "".join(RNG.choice(list("ACDEFGHIKLMNPQRSTVWY"), n))


def test_bytes_of_the_filter_agree_with_single_cells():
    words = [letters(n) for n in (3, 11, 30, 30, 47, 90)]
    profiles = [P.configure(P.single_sequence(w, w)) for w in words]
    digits = lambda s: np.array(["ACDEFGHIKLMNPQRSTVWY".index(c) for c in s])
    codes = [digits(letters(n)) for n in (1, 2, 9, 60, 200, 333)]
    for w in words:
        codes += [digits(w), digits(letters(20) + w[: len(w) // 2] + letters(9) + w[len(w) // 2 :] + letters(20) + w[5:15])]
    codes.append(np.append(digits(words[4][:12]), 20))  # an unknown residue: costs that no byte holds
    codes.sort(key=len, reverse=True)
    for some in (codes, [c for c in codes if c.max() < 20]):
        xj, over = K._ungapped(profiles, some)
        for i, x in enumerate(some):
            for k, p in enumerate(profiles):
                best, high = plain(p, x)
                assert bool(over[i, k]) == high
                if not high:
                    assert int(xj[i, k]) == best
        assert over.any() and not over.all()


def test_cells_of_the_filter_are_bytes():
    profiles = [P.configure(P.single_sequence("a", letters(200), bg=np.full(20, 0.05)))] * 64
    codes = [RNG.integers(0, 20, 30) for _ in range(64)]
    K._ungapped(profiles[:1], codes[:1])
    tracemalloc.start()
    K._ungapped(profiles, codes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 9 * 64 * 64 * 201
