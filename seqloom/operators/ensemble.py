"""Domains of a region from an ensemble of sampled paths: segments, single-linkage clusters, envelopes."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import replace

import numpy as np

from seqloom.operators.kernels import Lattice, batch, lattices
from seqloom.operators.profile import DD, DM, IM, II, MD, MI, MM, NEVER, Profile


#: States of a path on its way back.
C, J, E, M, I, D, B, N = range(8)
#: Regions, and cells of their lattices, that are sampled at once.
REGIONS, CELLS = 64, 1 << 19
#: Segments whose links are all held at once.
DENSE = 2048


def sampled(p: Profile, lat: Lattice, n: int, paths: int, rng: np.random.Generator, matched: list[np.ndarray] | None = None) -> np.ndarray:
    """Rows (path, i, j, k, m) of the domains of paths drawn from the posterior: first and last position, first and last node.

    matched is given rows (path, position, node) of every match on the paths.
    """
    return sampled_many(p, lat, np.array([n]), np.array([n]), paths, rng.random, matched)[0]


class Same:
    """Numbers of one generator for each of some sequences from the beginning on: each gets those that it would draw alone."""

    def __init__(self, seed: int, rows: int):
        self.rng, self.rows, self.next = np.random.default_rng(seed), rows, np.zeros(rows, np.int64)
        self.drawn = self.rng.random(1 << 14)

    def __call__(self, owner: np.ndarray) -> np.ndarray:
        """A number for each entry; owner: whose it is, in order."""
        many = np.bincount(owner, minlength=self.rows)
        at = (self.next - np.cumsum(many) + many)[owner] + np.arange(len(owner))
        self.next += many
        while self.next.max() > len(self.drawn):
            self.drawn = np.concatenate([self.drawn, self.rng.random(len(self.drawn))])
        return self.drawn[at]


def sampled_many(p: Profile, lat: Lattice, lengths: np.ndarray, targets: np.ndarray, paths: int, chances: Callable, matched: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """sampled() of each sequence of a lattice, with the length model of its target; chances: for one sequence a generator's method, else Same.

    All paths walk back at once: in each step, those that are in a state of one kind draw where they came from.
    """
    rows, span = lat.c.shape
    loop, _ = p.length_model(targets)
    to_c, to_j = p.end
    t, entry = p.tsc, p.entry
    fm, fi, fd = (x.reshape(rows * span, -1) for x in (lat.m, lat.i, lat.d))
    wide = fm.shape[1]
    flat = {id(x): x.ravel() for x in (fm, fi, fd)}
    mm, im, dm = (t[:, s].copy() for s in (MM, IM, DM))
    e, b, xn, xj, xc = (x.ravel() for x in (lat.e, lat.b, lat.n, lat.j, lat.c))
    leave = np.concatenate([fm[:, 1:], fd[:, 1:]], 1) if p.local else np.concatenate([np.full((len(fm), p.m - 1), NEVER), fm[:, -1:], np.full((len(fm), p.m - 1), NEVER), fd[:, -1:]], 1)
    top = leave.max(1, keepdims=True)
    exits = np.cumsum(np.exp(leave - np.where(np.isfinite(top), top, 0)), 1)
    owner = np.repeat(np.arange(rows), paths)
    first = owner * span  # where a path's sequence begins in the lattice

    def chance(q: np.ndarray) -> np.ndarray:
        return chances(len(q)) if rows == 1 else chances(owner[q])

    def draw(q: np.ndarray, *scores: np.ndarray) -> np.ndarray:
        w = np.array(scores)
        w -= functools.reduce(np.maximum, scores)
        np.exp(w, out=w)
        for n in range(1, len(w)):
            w[n] += w[n - 1]
        u = chance(q) * w[-1]
        way = (w[0] <= u).astype(np.int64)
        for low in w[1:-1]:
            way += low <= u
        return way

    state, at, node = np.full(rows * paths, C), np.repeat(lengths, paths), np.zeros(rows * paths, int)
    last = np.zeros((rows * paths, 2), int)
    out = []
    live = np.arange(rows * paths)
    with np.errstate(invalid="ignore"):
        while len(live):
            now = state[live]
            for kind, own, to in ((C, xc, to_c), (J, xj, to_j)):
                q = live[now == kind]
                if len(q):
                    i = first[q] + at[q]
                    stay = draw(q, np.where(at[q] > 0, own[i - 1] + loop[owner[q]], NEVER), e[i] + to) == 0
                    at[q[stay]] -= 1
                    state[q[~stay]] = E
            q = live[now == E]
            if len(q):
                c = exits[first[q] + at[q]]
                pick = (c <= (chance(q) * c[:, -1])[:, None]).sum(1).clip(0, 2 * p.m - 1)
                state[q], node[q], last[q] = np.where(pick < p.m, M, D), pick % p.m + 1, 0
            q = live[now == M]
            if len(q):
                i, k = at[q], node[q]
                if matched is not None:
                    matched.append(np.column_stack([q, i, k]))
                fresh = last[q, 0] == 0
                last[q[fresh]] = np.stack([i, k], 1)[fresh]
                inner, before = k > 1, first[q] + i - 1
                cell = before * wide + k - 1
                way = draw(q, *(np.where(inner, flat[id(f)][cell] + step[k - 1], NEVER) for f, step in ((fm, mm), (fi, im), (fd, dm))), b[before] + entry[k])
                ends = way == 3
                out += [np.column_stack([q, i, last[q, 0], k, last[q, 1]])[ends]]
                state[q] = np.array([M, I, D, B])[way]
                at[q], node[q] = i - 1, k - 1
            for kind, f1, f2, m1, m2 in ((I, fm, fi, MI, II), (D, fm, fd, MD, DD)):
                q = live[now == kind]
                if len(q):
                    i, k = at[q], node[q]
                    j, r = (k, i - 1) if kind == I else (k - 1, i)
                    cell = (first[q] + r) * wide + j
                    state[q] = np.array([M, kind])[draw(q, flat[id(f1)][cell] + t[j, m1], flat[id(f2)][cell] + t[j, m2])]
                    at[q], node[q] = r, j
            q = live[now == B]
            if len(q):
                state[q] = np.array([N, J])[draw(q, xn[first[q] + at[q]], xj[first[q] + at[q]])]
            live = live[state[live] != N]
    found = np.concatenate(out) if out else np.empty((0, 5), int)
    whose, found[:, 0] = found[:, 0] // paths, found[:, 0] % paths
    return [found[whose == r] for r in range(rows)]


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of whole numbers from 0 on, each once and in order, and which of them each one is."""
    base = int(rows.max()) + 1
    if float(base) ** rows.shape[1] >= 2.0**62:
        kinds, which = np.unique(rows, axis=0, return_inverse=True)
        return kinds, which.reshape(-1)
    key = functools.reduce(lambda n, c: n * base + c, rows.T.astype(np.int64))
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    return rows[first], which.reshape(-1)


def components(link: np.ndarray) -> np.ndarray:
    """The first entry that each one is joined with by links, itself included."""
    label = np.full(len(link), -1)
    for c in range(len(link)):
        if label[c] < 0:
            label[c] = c
            edge = np.array([c])
            while len(edge):
                edge = np.flatnonzero(link[edge].any(0) & (label < 0))
                label[edge] = c
    return label


def linked(s: np.ndarray, overlap: float = 0.8, diagonal: int = 4, others: np.ndarray | None = None) -> np.ndarray:
    """Segments x segments, or others: whether they overlap on the sequence and on the model by a share of the shorter and end or begin on near diagonals."""
    others = s if others is None else others
    kind = np.int16 if max(s.max(initial=0), others.max(initial=0)) < 1 << 14 else np.int64
    (i, j, k, m), (a, b, c, d) = (s.T.astype(kind)[..., None], others.T.astype(kind))
    on_seq = np.minimum(j, b) - np.maximum(i, a) + kind(1)
    on_model = np.minimum(m, d) - np.maximum(k, c)
    near = (np.abs((i - k) - (a - c)) <= diagonal) | (np.abs((j - m) - (b - d)) <= diagonal)
    share = lambda x: np.ceil(overlap * x).astype(kind)  # noqa: E731  (whole numbers: what is no less than a share is no less than the next of them)
    return (on_seq >= np.minimum(share(j - i + kind(1)), share(b - a + kind(1)))) & (on_model >= np.minimum(share(m - k), share(d - c))) & near


def clustered(s: np.ndarray) -> np.ndarray:
    """components() of the links of segments. Those of many are worked out for some rows at a time, when they are reached, against what is not reached yet."""
    if len(s) <= DENSE:
        return components(linked(s))
    label, rows = np.full(len(s), -1), max(1, DENSE * DENSE // len(s))
    for c in range(len(s)):
        if label[c] >= 0:
            continue
        label[c], edge = c, np.array([c])
        while len(edge):
            some, edge = edge[:rows], edge[rows:]
            free = np.flatnonzero(label < 0)
            new = free[linked(s[some], others=s[free]).any(0)]
            label[new] = c
            edge = np.concatenate([edge, new])
    return label


def envelopes(p: Profile, codes: np.ndarray, paths: int = 200, least: float = 0.25, rare: float = 0.02, seed: int = 42) -> list[tuple[int, int]]:
    """Envelopes (1-based, closed) of a region: clusters of sampled segments that enough paths share, each to the outermost ends that are not rare; of two that cover one another, the likelier."""
    return envelopes_many(p, [codes], [len(codes) if p.target is None else p.target], paths, least, rare, seed)[0]


def envelopes_many(p: Profile, codes: list[np.ndarray], targets: list[int], paths: int = 200, least: float = 0.25, rare: float = 0.02, seed: int = 42) -> list[list[tuple[int, int]]]:
    """envelopes() of regions of several targets, each with the length model of its target; regions of like lengths are sampled at once."""
    free = replace(p, target=None)
    order, out, at = sorted(range(len(codes)), key=lambda r: -len(codes[r])), [[] for _ in codes], 0
    while at < len(order):
        some = order[at : at + max(1, min(REGIONS, CELLS // ((len(codes[order[at]]) + 1) * (p.m + 1))))]
        at += len(some)
        x, n = batch([codes[r] for r in some])
        own = np.array([targets[r] for r in some])
        found = sampled_many(free, lattices(free, x, n, own), n, own, paths, Same(seed, len(some)) if len(some) > 1 else np.random.default_rng(seed).random)
        for r, s in zip(some, found, strict=True):
            out[r] = _clusters(s, paths, least, rare)
    return out


def _clusters(s: np.ndarray, paths: int, least: float, rare: float) -> list[tuple[int, int]]:
    """Envelopes of the sampled segments of a region."""
    if not len(s):
        return []
    kinds, which = distinct(s[:, 1:])
    label = clustered(kinds)
    found = []
    for c in np.unique(label):
        mine = label[which] == c
        share = len(np.unique(s[mine, 0])) / paths
        if share < least:
            continue
        floor = int(np.ceil(rare * mine.sum()))
        starts, n_start = np.unique(s[mine, 1], return_counts=True)
        ends, n_end = np.unique(s[mine, 2], return_counts=True)
        common, last = starts[n_start >= floor], ends[n_end >= floor]  # where every end is rare, the most frequent one counts
        i, j = int(common.min() if len(common) else starts[n_start.argmax()]), int(last.max() if len(last) else ends[n_end.argmax()])
        if i <= j:
            found.append((i, j, share))
    found.sort()
    kept: list[tuple[int, int, float]] = []
    for i, j, share in found:
        if kept:
            a, b, other = kept[-1]
            if min(b, j) - max(a, i) + 1 >= 0.8 * min(b - a + 1, j - i + 1):
                if share > other:
                    kept[-1] = (i, j, share)
                continue
        kept.append((i, j, share))
    return [(i, j) for i, j, _ in kept]
