"""Dynamic-programming kernels over a batch of sequences, in NumPy.

A batch is a matrix of residue codes, one row per sequence, padded with -1 at the end; rows whose
sequence has ended keep their state. Silent delete states are a scan along the model, which in log
space is a running (log-)sum of what enters, each shifted by the deletes passed: no loop over nodes.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import replace

import numpy as np

from seqloom.operators import checkpoint
from seqloom.operators.profile import DD, DM, IM, II, MD, MI, MM, NEVER, Profile, quantise_msv, quantise_viterbi


#: Sequences whose results a task keeps.
KEPT = 1 << 14


def once(f: Callable):
    """f of a sequence, worked out once for all its copies among the KEPT sequences that a task saw last."""
    return functools.lru_cache(KEPT)(f)


def batch(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(padded codes, lengths)."""
    lengths = np.array([len(c) for c in codes], np.int64)
    out = np.full((len(codes), max(1, lengths.max(initial=0))), -1, np.int64)
    for i, c in enumerate(codes):
        out[i, : len(c)] = c
    return out, lengths


def stacked(profiles: list[Profile]) -> Profile:
    """Profiles that differ in match scores alone as one: residue c of the n-th is n * (K + 1) + c, so that rows of a batch have each its own."""
    return replace(profiles[0], msc=np.concatenate([p.msc for p in profiles]))


#: Pairs of sequence and model that the ungapped filter takes at once, and models of one table of gains.
PAIRS, MODELS = 1024, 64
#: Cells (residues x nodes) of a sequence beyond which its posteriors are not all held at once.
LATTICE = 1 << 21
#: A gain that no score survives: it stands before the first node and behind the last one of short models.
CLOSED = -30000
#: Positions that the ungapped filter takes at once where it goes node by node.
SPAN = 1 << 19
#: What lies between 0 and the first entry score in a byte of the ungapped filter: no gain may take more away.
LEVEL = 60


def _third_bits(s) -> int:
    return int(min(255, max(0, np.floor(-3 / np.log(2) * s + 0.5))))


def _ungapped(profiles: list[Profile], codes: list[np.ndarray], owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(xJ, overflow), codes x profiles, of the 8-bit multihit ungapped filter; codes have one residue at least, long ones first.

    With owner, each sequence meets the profile of that number alone, and the second axis has one entry.

    The rows of all pairs lie in one array, a closed cell before each, so that a step along the diagonal is a
    shift of the whole array by one. Unsigned saturation at 0 needs no step of its own, as the entry score, which is
    no less, replaces what lies below it; saturation at 255 is an overflow, which stays one. The running best
    of each cell holds what xJ needs, unless some cell is so high that J raises the entry: then its row is looked at.

    Cells are bytes that begin LEVEL below the first entry score of their pair. Behind a short model's last node cells lose LEVEL a step, so
    that none rises above the one it came from. Models whose costs or gains leave the byte take two bytes a cell.
    """
    k, lengths, used = len(profiles[0].msc), np.array([len(c) for c in codes]), np.unique(np.concatenate(codes))
    base, jump, width = 190, _third_bits(np.log(0.5)), max(p.m for p in profiles) + 1
    gain = np.full((len(profiles) * k, width), -LEVEL, np.int16)
    enter, bias = np.empty(len(profiles), np.int16), np.empty(len(profiles), np.int16)
    for n, p in enumerate(profiles):
        cost, bias[n] = quantise_msv(p)
        gain[n * k + used, 1 : p.m + 1] = bias[n] - cost[used, 1:]
        enter[n] = _third_bits(np.log(2 / (p.m * (p.m + 1))))
    x = np.zeros((int(lengths[0]), len(codes)), np.uint8)
    for n, c in enumerate(codes):
        x[: len(c), n] = c
    which, own = (np.repeat(np.arange(len(codes)), len(profiles)), np.tile(np.arange(len(profiles)), len(codes))) if owner is None else (np.arange(len(codes)), owner)
    pairs, row = len(which), own * k
    ends = np.searchsorted(-lengths[which], -np.arange(len(x)), side="left")  # pairs that go on at each position
    move = (np.array([_third_bits(np.log(3 / (n + 3))) for n in lengths])[which] + enter[own]).astype(np.int16)
    limit, floor = (255 - bias[own]).astype(np.int16), np.maximum(0, base - move).astype(np.int16)
    under, most = floor - LEVEL, int(gain.max())
    narrow = gain.min() >= -LEVEL and int((np.maximum(limit, base + jump + 1) - under).max()) + most < 256
    kind = np.uint8 if narrow else np.int16
    if not narrow:
        for n, p in enumerate(profiles):
            gain[n * k : (n + 1) * k, p.m + 1 :] = CLOSED
    gain = gain.astype(kind)  # a byte's negative gains wrap round, and so do their sums
    known = np.repeat((np.minimum(base + jump, limit - 1) - under).astype(kind), width)  # what a cell must exceed to tell J something new
    out, least, above = np.zeros(pairs, np.int32), int(known.min()), np.empty(pairs * width, bool)
    prev, new, best = (np.zeros(pairs * width, kind) for _ in range(3))
    step = np.empty((pairs, width), kind)
    entry = np.full(pairs * width, LEVEL, kind)
    mine, xj, over, overflown = np.arange(pairs), np.zeros(pairs, np.int16), np.zeros(pairs, bool), np.zeros(pairs, bool)
    for i in range(len(x)):
        live = int(ends[i])
        if not live:
            break
        n = live * width
        np.take(gain, row[:live] + x[i][which[:live]], axis=0, out=step[:live], mode="clip")
        np.maximum(prev[: n - 1], entry[1:n], out=new[1:n])
        np.add(new[1:n], step.reshape(-1)[1:n], out=new[1:n])
        new[:n:width] = 0
        np.maximum(best[:n], new[:n], out=best[:n])
        if new[:n].max() > least and np.greater(new[:n], known[:n], out=above[:n]).any():
            at = np.unique(np.flatnonzero(above[:n]) // width)
            top = new.reshape(-1, width)[at].max(1) + under[at]
            over[at] |= top >= limit[at]
            xj[at] = top - jump
            known.reshape(-1, width)[at] = np.where(over[at], 255 if narrow else -CLOSED, np.minimum(top, limit[at] - 1) - under[at])[:, None]
            raised = np.where(over[at], floor[at], np.maximum(floor[at], xj[at] - move[at])) - under[at]
            later = raised > entry.reshape(-1, width)[at, 0]
            entry.reshape(-1, width)[at[later]] = raised[later, None]
            if 8 * np.count_nonzero(over[:live]) > live:  # an overflow stays one, whatever follows: such pairs go
                stay = np.flatnonzero(~over)
                overflown[mine[over]] = True
                prev, new, best, entry, known = (a.reshape(-1, width)[stay].ravel() for a in (prev, new, best, entry, known))
                mine, row, which, xj, under, limit, floor, move = (a[stay] for a in (mine, row, which, xj, under, limit, floor, move))
                step, over = step[: len(stay)], over[stay]
                ends = np.searchsorted(-lengths[which], -np.arange(len(x)), side="left")
        prev, new = new, prev
    overflown[mine[over]] = True
    out[mine] = np.maximum(xj, best.reshape(-1, width).max(1) + under - jump)
    return out.reshape(len(codes), -1), overflown.reshape(len(codes), -1)


def msv_int(p: Profile, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(xJ, overflow) of the 8-bit multihit ungapped filter: saturated unsigned arithmetic in third-bits."""
    xj, over = np.zeros(len(x), np.int32), np.zeros(len(x), bool)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    for lo in range(0, len(order), PAIRS):
        part = order[lo : lo + PAIRS]
        j, o = _ungapped([p], [x[i, : lengths[i]] for i in part])
        xj[part], over[part] = j[:, 0], o[:, 0]
    return xj, over


def _msv_nats(xj: np.ndarray, over: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    scale = 3 / np.log(2)
    tjb = np.floor(-scale * np.log(3 / (lengths + 3)) + 0.5).clip(0, 255)
    return np.where(over, np.inf, ((xj - tjb) - 190) / scale - 3.0)


def msv(p: Profile, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """MSV scores in nats, +inf on overflow."""
    return _msv_nats(*msv_int(p, x, lengths), lengths)


def _by_nodes(profiles: list[Profile], codes: list[np.ndarray], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """What _ungapped gives, node by node over all positions of sequences that lie end to end; None where that would be no gain or doesn't fit a byte.

    It pays where models share few kinds of nodes, as those of single sequences do: what each kind gains at each position is then looked up
    once for all of them, and a node takes four steps over bytes, however long the longest sequence is. Cells begin LEVEL below the
    entry score, like those of _ungapped. What J adds is found by going over a sequence again, with the entry
    scores that its best cells up to each position give, until these stay the same. As a position only depends on those before it, that is what one
    pass position by position gives; a sequence whose cells overflow goes, as further hits can only add to them.
    """
    k, base, jump = len(profiles[0].msc), 190, _third_bits(np.log(0.5))
    kinds: dict[bytes, int] = {}
    nodes, bias, enter = [], [], []
    for p in profiles:
        cost, own = quantise_msv(p)
        gain = (int(own) - cost[:, 1:].astype(np.int16)).T.copy()
        nodes.append([kinds.setdefault(column.tobytes(), len(kinds)) for column in gain])
        bias.append(int(own))
        enter.append(_third_bits(np.log(2 / (p.m * (p.m + 1)))))
        if len(kinds) > 64:
            return None
    gains = np.array([np.frombuffer(column, np.int16) for column in kinds])
    used = np.unique(np.concatenate(codes))
    gains = np.where(np.isin(np.arange(k), used), gains, -LEVEL)
    if gains.min() < -LEVEL or 2 * len(kinds) > sum(p.m for p in profiles):
        return None
    move = np.array([_third_bits(np.log(3 / (n + 3))) for n in lengths])[:, None] + np.array(enter)
    limit, under = 255 - np.array(bias), np.maximum(0, base - move) - LEVEL
    spare = 255 - int((np.maximum(limit, base + jump + 1) - under).max())
    every = spare // max(1, int(gains.max()))  # nodes until cells that have overflown must be brought back
    if every < 1:
        return None
    tables = [np.append(g.astype(np.uint8), np.full(256 - k, 256 - LEVEL, np.uint8)).tobytes() for g in gains]
    out, over = np.zeros((len(codes), len(profiles)), np.int32), np.zeros((len(codes), len(profiles)), bool)
    gap = np.full(-(-255 // LEVEL), k, np.uint8)  # closed places between sequences, as many as no cell survives
    order = np.argsort(-lengths, kind="stable")
    ends, widest = np.cumsum(lengths[order] + len(gap)), max(p.m for p in profiles)
    at = 0
    while at < len(order):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] - lengths[order[at]] + SPAN, side="right")))
        some = order[at:stop]
        at = stop
        text = np.concatenate([part for c in some for part in (codes[c].astype(np.uint8), gap)]).tobytes()
        whole = np.array([np.frombuffer(text.translate(t), np.uint8) for t in tables])
        start = np.cumsum(lengths[some] + len(gap)) - lengths[some] - len(gap)
        cells = np.empty(len(text) + widest, np.uint8)
        level, most = np.full(len(text), LEVEL, np.uint8), np.full(len(text), 255 - every * max(0, int(gains.max())), np.uint8)
        for n, (p, own) in enumerate(zip(profiles, nodes, strict=True)):
            best = _best_cells(whole, own, level, most, every, cells)
            top = np.maximum.reduceat(best, start).astype(np.int32)
            out[some, n] = np.maximum(0, top + under[some, n] - jump)
            over[some, n] = top + under[some, n] >= limit[n]
            # sequences in which J raises the entry: (number, where what may change begins and ends, the best cell before)
            open_ = [(int(some[w]), int(start[w]), int(start[w] + lengths[some[w]]), 0) for w in np.flatnonzero((top + under[some, n] > base + jump) & ~over[some, n])]
            entry, gain = level, whole
            while open_:
                kept, entries = [], []
                for c, i, j, peak in open_:
                    cost = int(jump + move[c, n])
                    run = np.maximum.accumulate(best[i:j])
                    raised = np.empty(j - i, np.uint8)
                    raised[0] = max(LEVEL, peak - cost)
                    np.subtract(np.maximum(run[:-1], max(peak, LEVEL + cost)), cost, out=raised[1:], casting="unsafe")
                    most_ = max(peak, int(run[-1]))
                    out[c, n], over[c, n] = max(0, most_ + under[c, n] - jump), most_ + under[c, n] >= limit[n]
                    new = raised != entry[i:j]
                    first = int(new.argmax())
                    if new[first] and not over[c, n]:
                        cut = max(0, first - p.m + 1)  # no diagonal that reaches what changes began before
                        kept.append((c, i + cut, j, max(peak, int(run[cut - 1])) if cut else peak))
                        entries += [raised[cut:], level[: len(gap)]]
                if not kept:
                    break
                sizes = [j - i + len(gap) for _, i, j, _ in kept]
                parts = [slice(i, i + size) for (_, i, _, _), size in zip(kept, sizes, strict=True)]
                entry, gain, known = np.concatenate(entries), np.concatenate([gain[:, x] for x in parts], 1), np.concatenate([best[x] for x in parts])
                best = np.maximum(known, _best_cells(gain, own, entry, most, every, cells))
                begins = np.cumsum(sizes) - sizes
                open_ = [(c, int(i), int(i) + size - len(gap), peak) for (c, _, _, peak), i, size in zip(kept, begins, sizes, strict=True)]
    return out, over


def _best_cells(gain: np.ndarray, nodes: list[int], entry: np.ndarray, most: np.ndarray, every: int, cells: np.ndarray) -> np.ndarray:
    """The best cell of each position over a model's nodes: gain has what each kind of node adds at each position, entry what a hit begins with there."""
    n = len(entry)
    best, most = np.zeros(n, np.uint8), most[:n]
    cells[:] = 0
    for k, kind in enumerate(nodes):
        some = cells[len(nodes) - 1 - k : len(nodes) - 1 - k + n]  # a diagonal keeps its cell from node to node
        np.maximum(some, entry, out=some)
        np.add(some, gain[kind], out=some)
        np.maximum(best, some, out=best)
        if k % every == every - 1:
            np.minimum(some, most, out=some)
    return best


def msv_many(profiles: list[Profile], codes: list[np.ndarray]) -> np.ndarray:
    """codes x profiles: MSV scores in nats, +inf on overflow, -inf for an empty sequence. Sequences and models of like lengths are taken together."""
    out = np.full((len(codes), len(profiles)), -np.inf)
    lengths = np.array([len(c) for c in codes], np.int64)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    found = _by_nodes(profiles, [codes[i] for i in order], lengths[order]) if len(order) and profiles else None
    if found:
        out[order] = _msv_nats(*found, lengths[order, None])
        return out
    by_size = np.argsort([p.m for p in profiles], kind="stable")
    for at in range(0, len(profiles), MODELS):
        some = by_size[at : at + MODELS]
        size = max(1, PAIRS // len(some))
        for lo in range(0, len(order), size):
            part = order[lo : lo + size]
            xj, over = _ungapped([profiles[j] for j in some], [codes[i] for i in part])
            out[np.ix_(part, some)] = _msv_nats(xj, over, lengths[part, None])
    return out


def msv_pairs(profiles: list[Profile], owner: np.ndarray, codes: list[np.ndarray]) -> np.ndarray:
    """MSV scores in nats of sequences of one residue at least, each against the profile of its owner's number; +inf on overflow."""
    out, lengths = np.empty(len(codes)), np.array([len(c) for c in codes], np.int64)
    order = np.argsort(-lengths, kind="stable")
    for lo in range(0, len(order), PAIRS):
        part = order[lo : lo + PAIRS]
        used, own = np.unique(owner[part], return_inverse=True)
        xj, over = _ungapped([profiles[j] for j in used], [codes[i] for i in part], own)
        out[part] = _msv_nats(xj[:, 0], over[:, 0], lengths[part])
    return out


def ssv_threshold(p: Profile, bits: float, length: int) -> int:
    """The third-bits that an ungapped stretch must have for the ungapped filter to give a target of a length that many bits."""
    null = length * np.log(length / (length + 1)) + np.log(1 / (length + 1))
    spent = 2 * _third_bits(np.log(3 / (length + 3))) + _third_bits(np.log(2 / (p.m * (p.m + 1)))) + _third_bits(np.log(0.5))
    return int(np.ceil((bits * np.log(2) + null + 3.0) * 3 / np.log(2) + spent))


def ssv_windows(p: Profile, x: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """(first position, last position, last node, score) of ungapped stretches with at least so many third-bits.

    A stretch begins on a diagonal where nothing was left of its score, ends at its best place, and is one until nothing
    is left again. Residues and nodes count from 1. One pass over all diagonals finds those that reach the threshold
    at all; only these are looked at by themselves.
    """
    cost, bias = quantise_msv(p)
    gain = (bias - cost).astype(np.int32)
    run, best = np.zeros(p.m + 1, np.int32), {}
    for i, c in enumerate(x, 1):
        run[1:] = np.maximum(run[:-1] + gain[c, 1:], 0)
        run[0] = 0
        for k in np.flatnonzero(run >= least):
            best[i - int(k)] = True
    out = []
    for diagonal in sorted(best):  # position less node
        first = max(1, diagonal + 1)
        positions = np.arange(first, min(len(x), diagonal + p.m) + 1)
        total = np.cumsum(gain[x[positions - 1], positions - diagonal])
        low = np.minimum.accumulate(np.concatenate(([0], total)))
        part = np.cumsum(total <= low[:-1])  # a new lowest total: nothing is left here
        score = total - low[1:]
        for s in np.unique(part[score >= least]):
            inside = np.flatnonzero((part == s) & (score > 0))
            end = inside[score[inside].argmax()]
            out.append((int(positions[inside[0]]), int(positions[end]), int(positions[end] - diagonal), int(score[end])))
    return out


def viterbi_int(p: Profile, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Scores in nats of the 16-bit gapped filter, +inf on overflow, -inf without a path.

    Sums are taken in 32 bits: no path that counts comes near the lower end of 16 bits, and the upper end is an overflow.
    """
    scale, base, low, n, m = 500 / np.log(2), 12000, -32768, len(x), p.m
    t, e = quantise_viterbi(p.tsc).astype(np.int32), quantise_viterbi(p.msc).astype(np.int32)
    passed = np.concatenate([[0, 0], np.cumsum(t[1:-1, DD])]).astype(np.int32)
    entry = quantise_viterbi(p.entry).astype(np.int32)[1:]
    order = np.argsort(-lengths, kind="stable")  # long rows first: those that go on are a prefix
    x, lengths = x[order], lengths[order]
    ends = np.searchsorted(-lengths, -np.arange(x.shape[1] + 1), side="left")
    move = np.floor(scale * np.log(3 / (lengths + 3)) - 0.5 + 1).astype(np.int32)
    half = int(np.floor(scale * np.log(0.5) + 0.5))
    mm, ii, dd, work = (np.full((n, m + 1), low, np.int32) for _ in range(4))
    xn = np.full(n, base, np.int32)
    xb, xj, xc = xn + move, np.full(n, low, np.int32), np.full(n, low, np.int32)
    over = np.zeros(n, bool)
    for i in range(x.shape[1]):
        k = int(ends[i])
        if not k:
            break
        a, b, c, w = mm[:k], ii[:k], dd[:k], work[:k]
        best = a[:, :-1] + t[:-1, MM]
        np.maximum(best, np.add(b[:, :-1], t[:-1, IM], out=w[:, :-1]), out=best)
        np.maximum(best, np.add(c[:, :-1], t[:-1, DM], out=w[:, :-1]), out=best)
        best[:, 0] = low
        np.maximum(best, np.add(xb[:k, None], entry, out=w[:, :-1]), out=best)
        best += e[x[:k, i], 1:]
        if m > 1:
            np.maximum(a[:, 1:m] + t[1:m, MI], np.add(b[:, 1:m], t[1:m, II], out=w[:, 1:m]), out=b[:, 1:m])
            np.maximum.accumulate(best[:, :-1] + (t[1:-1, MD] - passed[2:]), axis=1, out=c[:, 2:])
            c[:, 2:] += passed[2:]
        a[:, 1:] = best
        xe = np.maximum(best.max(1), c[:, 1:].max(1))
        over[:k] |= xe >= 32767
        np.maximum(xc[:k], xe + half, out=xc[:k])
        np.maximum(xj[:k], xe + half, out=xj[:k])
        np.maximum(xj[:k], xn[:k], out=xb[:k])
        xb[:k] += move[:k]
    score = (xc + move - base) / scale - 3.0
    out = np.empty(n)
    out[order] = np.where(over, np.inf, np.where(xc <= low // 2, NEVER, score))
    return out


def ssv_windows_many(p: Profile, codes: list[np.ndarray], least: int) -> list[list[tuple[int, int, int, int]]]:
    """ssv_windows of several sequences."""
    row, *found = ssv_stretches(p, codes, least)
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in codes]
    for r, *some in zip(row.tolist(), *(x.tolist() for x in found), strict=True):
        out[r].append(tuple(some))
    return out


def ssv_stretches(p: Profile, codes: list[np.ndarray], least: int) -> tuple[np.ndarray, ...]:
    """Arrays (sequence, first position, last position, last node, score) of the stretches of ssv_windows in several sequences.

    They lie end to end, a closed place before each, and nodes are taken in turn: the scores of all places at one node come from
    those at the node before, a place earlier. Diagonals that reach the threshold are looked at by themselves.
    """
    cost, bias = quantise_msv(p)
    gain = np.vstack([(bias - cost).astype(np.int32), np.full((1, p.m + 1), CLOSED, np.int32)])
    kind = np.int16 if 256 * p.m < -CLOSED else np.int32
    if kind is np.int32:
        gain[-1] = -(1 << 30)
    lengths = np.array([len(c) for c in codes], np.int64)
    starts = np.cumsum(lengths + 1) - lengths  # of each sequence, behind its closed place
    x = np.full(int((lengths + 1).sum()), len(gain) - 1, np.intp)
    for at, c in zip(starts.tolist(), codes, strict=True):
        x[at : at + len(c)] = c
    run, new, step, reached = np.zeros(len(x), kind), np.zeros(len(x), kind), np.empty(len(x), kind), []
    own, which = np.unique(gain.T[1:].astype(kind), axis=0, return_inverse=True)
    few = len(own) <= 8 and [np.take(column, x) for column in own]  # nodes of a single sequence's model are of as many kinds as there are letters
    for k in range(1, p.m + 1):
        if few:
            step = few[which[k - 1]]
        else:
            np.take(own[which[k - 1]], x, out=step, mode="clip")
        np.add(run[:-1], step[1:], out=new[1:])
        np.maximum(new, 0, out=new)
        if len(new) and new.max() >= least:
            at = np.flatnonzero(new >= least)
            row = np.searchsorted(starts, at, side="right") - 1
            reached.append(np.stack([row, at - starts[row] + 1 - k]))
        run, new = new, run
    span = len(x) + 2 * p.m  # a sequence's diagonals as numbers of their own
    found = np.unique(np.concatenate([r[0] * span + r[1] + p.m for r in reached])) if reached else np.empty(0, np.int64)
    row, diagonal = found // span, found % span - p.m
    size = max(1, LATTICE // p.m)
    parts = [stretches_of(gain, x, starts[row[lo : lo + size]], lengths[row[lo : lo + size]], diagonal[lo : lo + size], least) for lo in range(0, len(row), size)]
    which, *out = (np.concatenate(c) for c in zip(*((n + lo, *some) for lo, (n, *some) in zip(range(0, len(row), size), parts, strict=True)), strict=True)) if parts else [np.empty(0, np.int64)] * 5
    return row[which], *out


def stretches_of(gain: np.ndarray, x: np.ndarray, starts: np.ndarray, lengths: np.ndarray, diagonals: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Arrays (diagonal's number, first position, last position, last node, score) of the stretches on some diagonals (position less node).

    starts and lengths: of the sequence of each in x. Gains are closed outside of it.
    """
    nodes = np.arange(1, gain.shape[1])
    positions = diagonals[:, None] + nodes
    inside = (positions >= 1) & (positions <= lengths[:, None])
    letter = x[np.where(inside, starts[:, None] + positions - 1, 0)]
    total = np.cumsum(np.where(inside, gain[letter, nodes], CLOSED), axis=1, dtype=np.int64)
    low = np.minimum(np.minimum.accumulate(total, axis=1), 0)
    score = (total - low).ravel()
    anew = total == low  # a new lowest total: nothing is left here
    anew[:, 1:] &= total[:, 1:] <= low[:, :-1]
    anew[:, 0] = True
    begins = np.flatnonzero(anew)
    if not len(begins):
        return (np.empty(0, np.int64),) * 5
    top = np.maximum.reduceat(score, begins)
    good = top >= least
    ends = np.append(begins[1:], len(score))
    owner = np.repeat(np.flatnonzero(good), (ends - begins)[good])
    begin, many = begins[good], (ends - begins)[good]
    cells = np.repeat(begin, many) + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    at = cells[score[cells] == top[owner]]
    last = at[np.searchsorted(at, begin)]  # the first of a stretch's best cells
    first = begin + (score[begin] == 0)
    n, m = last // len(nodes), len(nodes)
    return n, diagonals[n] + first % m + 1, diagonals[n] + last % m + 1, last % m + 1, score[last]


def viterbi_least(p: Profile, nats: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """The 16-bit score at a match's end with which the gapped filter would give a target of a length so many nats."""
    scale, base = 500 / np.log(2), 12000
    move = np.floor(scale * np.log(3 / (targets + 3)) - 0.5 + 1)
    half = np.floor(scale * np.log(0.5) + 0.5)
    return np.ceil(np.minimum((nats + 3.0) * scale - half - move + base, 1 << 40)).astype(np.int64)


def viterbi_crossings(p: Profile, x: np.ndarray, lengths: np.ndarray, targets: np.ndarray, least: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each sequence (position, node) of every place where the 16-bit gapped filter reaches a score, with the length model of its target.

    Where it is reached, the nodes that have that row's best score are given, and nothing of the row is carried on: what follows is
    a match of its own. Rows between crossings are those of viterbi_int.
    """
    scale, base, low, n, m = 500 / np.log(2), 12000, -32768, len(x), p.m
    t, e = quantise_viterbi(p.tsc).astype(np.int32), quantise_viterbi(p.msc).astype(np.int32)
    passed = np.concatenate([[0, 0], np.cumsum(t[1:-1, DD])]).astype(np.int32)
    entry = quantise_viterbi(p.entry).astype(np.int32)[1:]
    order = np.argsort(-lengths, kind="stable")  # long rows first: those that go on are a prefix
    x, lengths, targets, least = x[order], lengths[order], targets[order], least[order]
    ends = np.searchsorted(-lengths, -np.arange(x.shape[1] + 1), side="left")
    move = np.floor(scale * np.log(3 / (targets + 3)) - 0.5 + 1).astype(np.int32)
    half = int(np.floor(scale * np.log(0.5) + 0.5))
    mm, ii, dd, work = (np.full((n, m + 1), low, np.int32) for _ in range(4))
    cells = np.empty((n, m), np.int32)
    xb, xj = np.full(n, base, np.int32) + move, np.full(n, low, np.int32)
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    mm_, im, dm, mi, ii_, gone = t[:-1, MM].copy(), t[:-1, IM].copy(), t[:-1, DM].copy(), t[1:m, MI].copy(), t[1:m, II].copy(), t[1:-1, MD] - passed[2:]
    e, x = np.ascontiguousarray(e[:, 1:]), x.astype(np.intp)
    for i in range(x.shape[1]):
        k = int(ends[i])
        if not k:
            break
        a, b, c, w, best = mm[:k], ii[:k], dd[:k], work[:k, 1:], cells[:k]
        np.add(a[:, :-1], mm_, out=best)
        np.maximum(best, np.add(b[:, :-1], im, out=w), out=best)
        np.maximum(best, np.add(c[:, :-1], dm, out=w), out=best)
        best[:, 0] = low
        np.maximum(best, np.add(xb[:k, None], entry, out=w), out=best)
        np.add(best, np.take(e, x[:k, i], axis=0, out=w, mode="clip"), out=best)
        if m > 1:
            np.add(b[:, 1:m], ii_, out=b[:, 1:m])
            np.maximum(b[:, 1:m], np.add(a[:, 1:m], mi, out=w[:, 1:]), out=b[:, 1:m])
            np.maximum.accumulate(np.add(best[:, :-1], gone, out=w[:, 1:]), axis=1, out=c[:, 2:])
            c[:, 2:] += passed[2:]
        np.maximum(best, low, out=a[:, 1:])  # what 16 bits hold
        xe = best.max(1)
        crossed = np.flatnonzero(xe >= least[:k])
        for r in crossed.tolist():
            found[r] += [(i + 1, int(node) + 1) for node in np.flatnonzero(best[r] == xe[r])]
            a[r] = b[r] = c[r] = low
        xe[crossed] = low - half  # nothing of it is carried on
        np.maximum(xj[:k], xe + half, out=xj[:k])
        np.add(np.maximum(xj[:k], base), move[:k], out=xb[:k])
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for row, i in enumerate(order.tolist()):
        out[i] = found[row]
    return out


class Lattice:
    """Scores of every cell of a batch: match, insert, delete by (sequence, position, node), and E N J B C."""

    def __init__(self, n: int, length: int, m: int):
        self.m, self.i, self.d = (np.full((n, length + 1, m + 1), NEVER) for _ in range(3))
        self.e, self.n, self.j, self.b, self.c = (np.full((n, length + 1), NEVER) for _ in range(5))


def _passed(t: np.ndarray) -> np.ndarray:
    """Sum of the delete-to-delete scores passed from node 1 to each node; a closed step is a large cost."""
    dd = np.where(np.isfinite(t[:, DD]), t[:, DD], -1e6)
    return np.concatenate([[0.0, 0.0], np.cumsum(dd[1:-1])])


def _forward(p: Profile, x: np.ndarray, lengths: np.ndarray, plus, keep: bool, inside: np.ndarray | None = None, targets: np.ndarray | None = None) -> tuple[np.ndarray, Lattice]:
    n, m = len(x), p.m
    span = x.shape[1] if keep else 1
    lat = Lattice(n, span, m)
    loop, move = p.length_model(lengths if targets is None else targets)
    to_c, to_j = p.end
    t, passed = p.tsc, _passed(p.tsc)
    total = plus.reduce
    mm, ii, dd = (np.full((n, m + 1), NEVER) for _ in range(3))
    xn, xb, xj, xc = np.zeros(n), move.copy(), np.full(n, NEVER), np.full(n, NEVER)
    lat.n[:, 0], lat.b[:, 0] = 0, move
    with np.errstate(invalid="ignore", divide="ignore"):
        for i in range(x.shape[1]):
            live = x[:, i] >= 0
            if not live.any():
                break
            emit = p.msc[np.maximum(x[:, i], 0)]
            nm, ni, nd = (np.full((n, m + 1), NEVER) for _ in range(3))
            into = plus(plus(mm[:, :-1] + t[:-1, MM], ii[:, :-1] + t[:-1, IM]), dd[:, :-1] + t[:-1, DM])
            into[:, 0] = NEVER
            nm[:, 1:] = plus(into, xb[:, None] + p.entry[1:]) + emit[:, 1:]
            ni[:, 1:m] = plus(mm[:, 1:m] + t[1:m, MI], ii[:, 1:m] + t[1:m, II])
            if inside is not None:
                nm[:, ~inside[i]] = ni[:, ~inside[i]] = NEVER
            if m > 1:
                nd[:, 2:] = plus.accumulate(nm[:, 1:-1] + t[1:-1, MD] - passed[2:], axis=1) + passed[2:]
            if inside is not None:
                nd[:, ~inside[i]] = NEVER
            xe = total(nm[:, 1:], axis=1)
            if p.local:
                xe = plus(xe, total(nd[:, 1:], axis=1))
            else:
                xe = plus(nm[:, m], nd[:, m])
            nj, nc, nn = plus(xj + loop, xe + to_j), plus(xc + loop, xe + to_c), xn + loop
            nb = plus(nn + move, nj + move)
            for old, new in ((mm, nm), (ii, ni), (dd, nd), (xj, nj), (xc, nc), (xn, nn), (xb, nb)):
                old[live] = new[live]
            if keep:
                at = i + 1
                for whole, new in ((lat.m, nm), (lat.i, ni), (lat.d, nd), (lat.j, nj), (lat.c, nc), (lat.n, nn), (lat.b, nb), (lat.e, xe)):
                    whole[live, at] = new[live]
    return np.where(lengths > 0, xc + move, NEVER), lat


def viterbi(p: Profile, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
    score, lat = _forward(p, x, lengths, np.maximum, keep)
    return (score, lat) if keep else score


def forward(p: Profile, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
    """Forward scores in nats; with keep, the lattice too. Scores alone are summed as scaled odds where deletes don't underflow."""
    if not keep and p.m > 1 and _passed(p.tsc).min() > -550:
        return _forward_odds(p, x, lengths)
    score, lat = _forward(p, x, lengths, np.logaddexp, keep)
    return (score, lat) if keep else score


def lattices(p: Profile, x: np.ndarray, lengths: np.ndarray, targets: np.ndarray) -> Lattice:
    """The Forward lattice of sequences, each with the length model of its target."""
    return _forward(replace(p, target=None), x, lengths, np.logaddexp, True, targets=targets)[1]


def hybrid(p: Profile, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best score of a path's end over all paths up to it: the largest match cell of the Forward lattice."""
    _, lat = _forward(p, x, lengths, np.logaddexp, True)
    return lat.m.max((1, 2))


def forward_banded(p: Profile, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
    """Forward score of one sequence over the cells of bands alone: nodes low[i]..high[i] at position i + 1; none where low exceeds high."""
    nodes = np.arange(p.m + 1)
    inside = (nodes >= low[:, None]) & (nodes <= high[:, None])
    score, _ = _forward(p, x[None, :], np.array([len(x)]), np.logaddexp, False, inside)
    return float(score[0])


def _forward_odds(p: Profile, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Forward in odds, every row divided by its own size now and then."""
    n, m = len(x), p.m
    t, e, entry, passed = np.exp(p.tsc), np.exp(p.msc), np.exp(p.entry[1:]), np.exp(_passed(p.tsc))
    loop, move = (np.exp(v) for v in p.length_model(lengths))
    to_c, to_j = (float(np.exp(v)) for v in p.end)
    mm, im, dm = t[:-1, MM], t[:-1, IM], t[:-1, DM]
    mi, ii_, gone = t[1:m, MI], t[1:m, II], t[1:-1, MD] / passed[2:]
    order = np.argsort(-lengths, kind="stable")  # long rows first: those that go on are a prefix
    x, loop, move = x[order], loop[order], move[order]
    ends = np.searchsorted(-lengths[order], -np.arange(x.shape[1] + 1), side="left")
    M, I, D = (np.zeros((n, m + 1)) for _ in range(3))
    cells, work, e = np.empty((n, m)), np.empty((n, m)), np.ascontiguousarray(e[:, 1:])
    xn, xj, xc, xb, logs = np.ones(n), np.zeros(n), np.zeros(n), move.copy(), np.zeros(n)
    for i in range(x.shape[1]):
        k = int(ends[i])  # rows longer than i
        if not k:
            break
        a, b, c, into, w = M[:k], I[:k], D[:k], cells[:k], work[:k]
        np.multiply(a[:, :-1], mm, out=into)
        into += np.multiply(b[:, :-1], im, out=w)
        into += np.multiply(c[:, :-1], dm, out=w)
        into[:, 0] = 0
        into += np.multiply(xb[:k, None], entry, out=w)
        into *= np.take(e, x[:k, i], axis=0, out=w, mode="clip")
        np.multiply(b[:, 1:m], ii_, out=b[:, 1:m])
        b[:, 1:m] += np.multiply(a[:, 1:m], mi, out=w[:, 1:])
        a[:, 1:] = into
        np.cumsum(np.multiply(into[:, :-1], gone, out=w[:, 1:]), axis=1, out=c[:, 2:])
        c[:, 2:] *= passed[2:]
        xe = into.sum(1) + c[:, 1:].sum(1) if p.local else into[:, -1] + c[:, m]
        xj[:k] = xj[:k] * loop[:k] + xe * to_j
        xc[:k] = xc[:k] * loop[:k] + xe * to_c
        xn[:k] *= loop[:k]
        xb[:k] = (xn[:k] + xj[:k]) * move[:k]
        if i % 4 == 3:
            size = np.maximum(xn[:k] + xj[:k] + xc[:k] + xe, 1e-300)
            for whole in (a, b, c):
                whole /= size[:, None]
            for part in (xn, xj, xc, xb):
                part[:k] /= size
            logs[:k] += np.log(size)
    with np.errstate(divide="ignore"):
        score = np.log(xc) + logs + np.log(move)
    out = np.full(n, NEVER)
    out[order] = np.where(lengths[order] > 0, score, NEVER)
    return out


def backward(p: Profile, x: np.ndarray) -> Lattice:
    """Backward scores of one sequence, as a lattice of one row."""
    n, m, plus = len(x), p.m, np.logaddexp
    lat = Lattice(1, n, m)
    loop, move = (float(v) for v in p.length_model(n))
    to_c, to_j = p.end
    t, passed = p.tsc, _passed(p.tsc)
    with np.errstate(invalid="ignore", divide="ignore"):
        lat.c[0, n] = move
        for i in range(n, -1, -1):
            if i < n:
                emit = p.msc[x[i]]
                later = np.full(m + 2, NEVER)
                later[: m + 1] = emit + lat.m[0, i + 1]
                lat.b[0, i] = plus.reduce(p.entry[1:] + later[1 : m + 1])
                lat.c[0, i] = lat.c[0, i + 1] + loop
                lat.j[0, i] = plus(lat.j[0, i + 1] + loop, lat.b[0, i] + move)
                lat.n[0, i] = plus(lat.n[0, i + 1] + loop, lat.b[0, i] + move)
            else:
                later = np.full(m + 2, NEVER)
            lat.e[0, i] = plus(lat.c[0, i] + to_c, lat.j[0, i] + to_j)
            if i == 0:
                break
            leave = np.full(m + 1, lat.e[0, i] if p.local else NEVER)
            leave[m] = lat.e[0, i]
            d = np.full(m + 1, NEVER)
            enters = np.full(m + 1, NEVER)  # a path that stops deleting at node k
            enters[1:m] = plus(leave[1:m], later[2 : m + 1] + t[1:m, DM])
            enters[m] = leave[m]
            d[1:] = plus.accumulate((enters[1:] + passed[1:])[::-1])[::-1] - passed[1:]
            lat.d[0, i] = d
            ins = np.full(m + 1, NEVER)
            next_i = lat.i[0, i + 1] if i < n else np.full(m + 1, NEVER)
            ins[1:m] = plus(later[2 : m + 1] + t[1:m, IM], next_i[1:m] + t[1:m, II])
            lat.i[0, i] = ins
            mat = leave.copy()
            mat[1:m] = plus(plus(mat[1:m], later[2 : m + 1] + t[1:m, MM]), plus(next_i[1:m] + t[1:m, MI], d[2 : m + 1] + t[1:m, MD]))
            mat[0] = NEVER
            lat.m[0, i] = mat
    return lat


class Posterior:
    """Posterior decoding of one sequence: match and insert by (position, node), and N, J, C by position."""

    def __init__(self, p: Profile, x: np.ndarray):
        n = len(x)
        score, f = forward(p, x[None, :], np.array([n]), keep=True)
        b = backward(p, x)
        self.score, self.back_score = float(score[0]), float(b.n[0, 0])
        loop, _ = (float(v) for v in p.length_model(n))
        to_c, _ = p.end
        with np.errstate(invalid="ignore", divide="ignore"):
            self.match = np.exp(f.m[0] + b.m[0] - self.score)
            self.insert = np.exp(f.i[0] + b.i[0] - self.score)
            passing = lambda fw, bw: np.concatenate([[0.0], np.exp(fw[:-1] + loop + bw[1:] - self.score)])
            self.n, self.j, self.c = passing(f.n[0], b.n[0]), passing(f.j[0], b.j[0]), passing(f.c[0], b.c[0])
            self.begin = np.exp(f.b[0] + b.b[0] - self.score)
            self.end = np.exp(f.e[0] + b.e[0] - self.score)
        self.mocc = 1 - (self.n + self.j + self.c)
        self.mocc[0] = 0
        # B before position i + 1 and E after position i: expected starts and ends up to each position
        self.btot = np.concatenate([[0.0], np.cumsum(self.begin[:-1])])
        self.etot = np.concatenate([[0.0], np.cumsum(self.end[1:])])


class Sweep:
    """Forward or Backward of a batch as odds, every row divided by its own size now and then.

    Rows are sorted, long ones first. log has the logarithm of what a row was divided by up to each position; n, j, c, b and e
    the special states by (row, position); with full, m and i the match and insert states by (row, position, node).
    """

    def __init__(self, rows: int, length: int, nodes: int, full: bool):
        self.log, self.n, self.j, self.c, self.b, self.e = (np.zeros((rows, length + 1)) for _ in range(6))
        self.m, self.i = (np.zeros((rows, length + 1, nodes + 1)) for _ in range(2)) if full else (None, None)


def _sweep_forward(p: Profile, x: np.ndarray, lengths: np.ndarray, targets: np.ndarray, full: bool) -> Sweep:
    rows, m = len(x), p.m
    t, emit, entry, passed = np.exp(p.tsc), np.exp(p.msc), np.exp(p.entry[1:]), np.exp(_passed(p.tsc))
    loop, move = (np.exp(v) for v in p.length_model(targets))
    to_c, to_j = (float(np.exp(v)) for v in p.end)
    mm, im, dm = t[:-1, MM], t[:-1, IM], t[:-1, DM]
    mi, ii_, gone = t[1:m, MI], t[1:m, II], t[1:-1, MD] / passed[2:]
    out = Sweep(rows, x.shape[1], m, full)
    ends = np.searchsorted(-lengths, -np.arange(x.shape[1] + 1), side="left")
    M, I, D = (np.zeros((rows, m + 1)) for _ in range(3))
    xn, xj, xc, xb, logs = np.ones(rows), np.zeros(rows), np.zeros(rows), move.copy(), np.zeros(rows)
    out.n[:, 0], out.b[:, 0] = 1, move
    for i in range(x.shape[1]):
        k = int(ends[i])
        a, b, c = M[:k], I[:k], D[:k]
        into = a[:, :-1] * mm + b[:, :-1] * im + c[:, :-1] * dm
        into[:, 0] = 0
        into += xb[:k, None] * entry
        into *= emit[x[:k, i], 1:]
        b[:, 1:m] = a[:, 1:m] * mi + b[:, 1:m] * ii_
        a[:, 1:] = into
        c[:, 2:] = np.cumsum(into[:, :-1] * gone, axis=1) * passed[2:]
        xe = into.sum(1) + c[:, 1:].sum(1)
        xj[:k] = xj[:k] * loop[:k] + xe * to_j
        xc[:k] = xc[:k] * loop[:k] + xe * to_c
        xn[:k] *= loop[:k]
        xb[:k] = (xn[:k] + xj[:k]) * move[:k]
        if i % 4 == 3:
            size = np.maximum(xn[:k] + xj[:k] + xc[:k] + xe, 1e-300)
            for whole in (a, b, c):
                whole /= size[:, None]
            for part in (xn, xj, xc, xb):
                part[:k] /= size
            xe /= size
            logs[:k] += np.log(size)
        at = i + 1
        out.log[:k, at], out.n[:k, at], out.j[:k, at], out.c[:k, at], out.b[:k, at], out.e[:k, at] = logs[:k], xn[:k], xj[:k], xc[:k], xb[:k], xe
        if full:
            out.m[:k, at], out.i[:k, at] = a, b
    return out


def _sweep_backward(p: Profile, x: np.ndarray, lengths: np.ndarray, targets: np.ndarray, full: bool) -> Sweep:
    rows, m, length = len(x), p.m, x.shape[1]
    t, emit, entry, passed = np.exp(p.tsc), np.exp(p.msc), np.exp(p.entry[1:]), np.exp(_passed(p.tsc))[1:]
    loop, move = (np.exp(v) for v in p.length_model(targets))
    to_c, to_j = (float(np.exp(v)) for v in p.end)
    mm, im, dm, mi, ii_, md = (t[1:m, s] for s in (MM, IM, DM, MI, II, MD))
    out = Sweep(rows, length, m, full)
    reach = np.searchsorted(-lengths, -np.arange(length + 1), side="right")  # rows that are at least as long as each position
    M, I = np.zeros((rows, m)), np.zeros((rows, m))  # nodes 1..M
    xn, xj, xc, logs = np.zeros(rows), np.zeros(rows), np.zeros(rows), np.zeros(rows)
    for i in range(length, -1, -1):
        k, old = int(reach[i]), int(reach[i + 1]) if i < length else 0
        xc[old:k] = move[old:k]  # rows that end here
        later, xb = np.zeros((k, m)), np.zeros(k)
        if old:
            later[:old] = M[:old] * emit[x[:old, i], 1:]
            xb[:old] = later[:old] @ entry
            xc[:old] *= loop[:old]
            xj[:old] = xj[:old] * loop[:old] + xb[:old] * move[:old]
            xn[:old] = xn[:old] * loop[:old] + xb[:old] * move[:old]
        xe = xc[:k] * to_c + xj[:k] * to_j
        enters = np.repeat(xe[:, None], m, 1)
        enters[:, :-1] += later[:, 1:] * dm
        d = np.cumsum((enters * passed)[:, ::-1], axis=1)[:, ::-1] / passed
        M[:k] = xe[:, None]
        M[:k, :-1] += later[:, 1:] * mm + I[:k, :-1] * mi + d[:, 1:] * md
        I[:k, :-1] = later[:, 1:] * im + I[:k, :-1] * ii_
        if i % 4 == 0:
            size = np.maximum(np.maximum(M[:k].max(1), xn[:k] + xj[:k] + xc[:k]), 1e-300)
            for whole in (M, I):
                whole[:k] /= size[:, None]
            for part in (xn, xj, xc):
                part[:k] /= size
            xe, xb = xe / size, xb / size
            logs[:k] += np.log(size)
        out.log[:k, i], out.n[:k, i], out.j[:k, i], out.c[:k, i], out.b[:k, i], out.e[:k, i] = logs[:k], xn[:k], xj[:k], xc[:k], xb, xe
        if full and i:
            out.m[:k, i, 1:], out.i[:k, i, 1:] = M[:k], I[:k]
    return out


class Decoded:
    """Posterior decoding of one sequence of a batch: what Posterior has, match and insert only if they were asked for."""

    def __init__(self, f: Sweep, b: Sweep, row: int, n: int, loop: float, move: float):
        at = slice(0, n + 1)
        with np.errstate(divide="ignore"):
            self.score = float(np.log(f.c[row, n]) + f.log[row, n] + np.log(move))
        scale = np.exp(f.log[row, at] + b.log[row, at] - self.score)
        step = np.exp(f.log[row, :n] + b.log[row, 1 : n + 1] - self.score) * loop
        passing = lambda fw, bw: np.concatenate([[0.0], fw[row, :n] * bw[row, 1 : n + 1] * step])
        self.n, self.j, self.c = passing(f.n, b.n), passing(f.j, b.j), passing(f.c, b.c)
        self.begin, self.end = f.b[row, at] * b.b[row, at] * scale, f.e[row, at] * b.e[row, at] * scale
        self.mocc = 1 - (self.n + self.j + self.c)
        self.mocc[0] = 0
        self.btot = np.concatenate([[0.0], np.cumsum(self.begin[:-1])])
        self.etot = np.concatenate([[0.0], np.cumsum(self.end[1:])])
        if f.m is not None:
            self.match, self.insert = f.m[row, at] * b.m[row, at] * scale[:, None], f.i[row, at] * b.i[row, at] * scale[:, None]


def decoded(p: Profile, codes: list[np.ndarray], targets: list[int] | None = None, full: bool = False, cells: int = 1 << 22) -> list:
    """Posterior decoding of many sequences at once, each with the length model of its target (its own length unless given).

    Without full, memory goes with the positions alone: enough to find regions. Batches are of like lengths and, with full,
    bounded by their cells. Glocal profiles, and those whose deletes underflow, are decoded one by one.
    """
    if not p.local or p.m < 2 or _passed(p.tsc).min() <= -550:
        return [Posterior(p if targets is None else replace(p, target=targets[i]), c) for i, c in enumerate(codes)]
    lengths = np.array([len(c) for c in codes])
    own = lengths if targets is None else np.array(targets)
    order, out, at = np.argsort(-lengths, kind="stable"), [None] * len(codes), 0
    free = replace(p, target=None)
    while full and at < len(order) and lengths[order[at]] * p.m > LATTICE:  # in stretches, as their lattices would be large
        out[order[at]] = checkpoint.Decoded(free, codes[order[at]], int(own[order[at]]))
        at += 1
    while at < len(order):
        longest = int(lengths[order[at]]) + 1
        size = max(1, min(256, cells // (longest * (4 * p.m if full else 12) + 12 * p.m)))
        part = order[at : at + size]
        at += size
        x, n = batch([codes[i] for i in part])
        loop, move = (np.exp(v) for v in free.length_model(own[part]))
        f, b = (sweep(free, x, n, own[part], full) for sweep in (_sweep_forward, _sweep_backward))
        for row, i in enumerate(part):
            out[i] = Decoded(f, b, row, int(n[row]), float(loop[row]), float(move[row]))
    return out


def regions(post: Posterior, rt1: float = 0.25, rt2: float = 0.10) -> list[tuple[int, int]]:
    """Homologous regions (1-based, closed): opened where occupancy minus new starts falls under rt2, triggered at rt1, closed where occupancy minus new ends falls under rt2."""
    out, start, on = [], -1, False
    for i in range(1, len(post.mocc)):
        if not on:
            if post.mocc[i] - (post.btot[i] - post.btot[i - 1]) < rt2 or start < 0:
                start = i
            if post.mocc[i] >= rt1:
                on = True
        elif post.mocc[i] - (post.etot[i] - post.etot[i - 1]) < rt2:
            out.append((start, i))
            start, on = -1, False
    if on:
        out.append((start, len(post.mocc) - 1))
    return out


def is_multidomain(post: Posterior, i: int, j: int, rt3: float = 0.20) -> bool:
    """Whether some position of a region has both an end before it and a start after it with expectation rt3."""
    z = np.arange(i, j + 1)
    return bool(np.minimum(post.etot[z] - post.etot[i - 1], post.btot[j] - post.btot[z - 1]).max() >= rt3)


def optimal_accuracy(p: Profile, post: Posterior) -> tuple[float, list[tuple[str, int, int, float]]]:
    """(expected correct residues, path) of the path that maximises the sum of posteriors; path as (state, node, position, posterior)."""
    return optimal_accuracies(p, [post])[0]


def optimal_accuracies(p: Profile, posts: list, cells: int = 1 << 20) -> list[tuple[float, list[tuple[str, int, int, float]]]]:
    """optimal_accuracy of several sequences; like lengths are taken together, within so many cells."""
    out = [(post.accuracy, post.path) if isinstance(post, checkpoint.Decoded) else None for post in posts]
    order = sorted((i for i, x in enumerate(out) if x is None), key=lambda i: -len(posts[i].mocc))
    at = 0
    while at < len(order):
        some = order[at : at + max(1, min(256, cells // (len(posts[order[at]].mocc) * (p.m + 1))))]
        at += len(some)
        for i, x in zip(some, _accurate(p, [posts[i] for i in some]), strict=True):
            out[i] = x
    return out


def _accurate(p: Profile, posts: list) -> list[tuple[float, list[tuple[str, int, int, float]]]]:
    """optimal_accuracy of a batch, long sequences first."""
    n, m, rows, t = len(posts[0].mocc) - 1, p.m, len(posts), p.tsc
    match, insert = (np.zeros((rows, n + 1, m + 1)) for _ in range(2))
    pn, pj, pc = (np.zeros((rows, n + 1)) for _ in range(3))
    for r, post in enumerate(posts):
        own = slice(0, len(post.mocc))
        match[r, own], insert[r, own], pn[r, own], pj[r, own], pc[r, own] = post.match, post.insert, post.n, post.j, post.c
    allow = lambda s, v: np.where(s > NEVER, v, NEVER)
    mm, ii, dd = (np.full((rows, n + 1, m + 1), NEVER) for _ in range(3))
    e, nn, jj, bb, cc = (np.full((rows, n + 1), NEVER) for _ in range(5))
    nn[:, 0] = bb[:, 0] = 0
    multi = p.end[1] > NEVER
    free_deletes = bool((t[1:-1, MD] > NEVER).all() and (t[1:-1, DD] > NEVER).all())
    for i in range(1, n + 1):
        best = np.full((rows, m + 1), NEVER)
        best[:, 1:] = np.where(p.entry[1:] > NEVER, bb[:, i - 1, None], NEVER)
        best[:, 2:] = np.maximum.reduce([best[:, 2:], allow(t[1:m, MM], mm[:, i - 1, 1:m]), allow(t[1:m, IM], ii[:, i - 1, 1:m]), allow(t[1:m, DM], dd[:, i - 1, 1:m])])
        mm[:, i, 1:] = best[:, 1:] + match[:, i, 1:]
        ii[:, i, 1:m] = np.maximum(allow(t[1:m, MI], mm[:, i - 1, 1:m]), allow(t[1:m, II], ii[:, i - 1, 1:m])) + insert[:, i, 1:m]
        if free_deletes:
            dd[:, i, 2:] = np.maximum.accumulate(mm[:, i, 1:m], axis=1)
        else:
            for k in range(2, m + 1):
                dd[:, i, k] = np.maximum(mm[:, i, k - 1] if t[k - 1, MD] > NEVER else NEVER, dd[:, i, k - 1] if t[k - 1, DD] > NEVER else NEVER)
        e[:, i] = np.maximum(mm[:, i, 1:].max(1), dd[:, i, 1:].max(1)) if p.local else np.maximum(mm[:, i, m], dd[:, i, m])
        nn[:, i] = nn[:, i - 1] + pn[:, i]
        jj[:, i] = np.maximum(jj[:, i - 1] + pj[:, i], e[:, i] if multi else NEVER)
        cc[:, i] = np.maximum(cc[:, i - 1] + pc[:, i], e[:, i])
        bb[:, i] = np.maximum(nn[:, i], jj[:, i])
    return [_accurate_path(p, post, mm[r], ii[r], dd[r], e[r], nn[r], jj[r], bb[r], cc[r]) for r, post in enumerate(posts)]


def _accurate_path(p: Profile, post: Posterior, mm: np.ndarray, ii: np.ndarray, dd: np.ndarray, e: np.ndarray, nn: np.ndarray, jj: np.ndarray, bb: np.ndarray, cc: np.ndarray) -> tuple[float, list[tuple[str, int, int, float]]]:
    n, m, t = len(post.mocc) - 1, p.m, p.tsc
    if n == 0:
        return 0.0, []
    path: list[tuple[str, int, int, float]] = []
    state, i, k = "C", n, 0
    while True:
        if state == "C":
            if cc[i] == e[i] and cc[i] > NEVER and not (i > 0 and cc[i - 1] + post.c[i] == cc[i] and post.c[i] > 0):
                state = "E"
            else:
                path.append(("C", 0, i, post.c[i]))
                i -= 1
        elif state == "J":
            if jj[i] == e[i] and not (jj[i - 1] + post.j[i] == jj[i] and post.j[i] > 0):
                state = "E"
            else:
                path.append(("J", 0, i, post.j[i]))
                i -= 1
        elif state == "E":
            if p.local:
                km, kd = int(mm[i, 1:].argmax()) + 1, int(dd[i, 1:].argmax()) + 1
                state, k = ("M", km) if mm[i, km] >= dd[i, kd] else ("D", kd)
            else:
                k = m
                state = "M" if mm[i, m] >= dd[i, m] else "D"
        elif state == "M":
            path.append(("M", k, i, post.match[i, k]))
            options = [("B", bb[i - 1] if p.entry[k] > NEVER else NEVER)]
            if k > 1:
                options += [("M", mm[i - 1, k - 1] if t[k - 1, MM] > NEVER else NEVER), ("I", ii[i - 1, k - 1] if t[k - 1, IM] > NEVER else NEVER), ("D", dd[i - 1, k - 1] if t[k - 1, DM] > NEVER else NEVER)]
            state = max(options, key=lambda o: o[1])[0]
            i, k = i - 1, k - 1
        elif state == "I":
            path.append(("I", k, i, post.insert[i, k]))
            state = "M" if mm[i - 1, k] >= ii[i - 1, k] and t[k, MI] > NEVER else "I"
            i -= 1
        elif state == "D":
            path.append(("D", k, i, 0.0))
            state = "M" if mm[i, k - 1] >= dd[i, k - 1] and t[k - 1, MD] > NEVER else "D"
            k -= 1
        elif state == "B":
            state = "N" if nn[i] >= jj[i] else "J"
        if state == "N":
            path += [("N", 0, r, post.n[r]) for r in range(i, 0, -1)]
            break
    return float(cc[n]), path[::-1]


def null2(p: Profile, post: Posterior, i: int, j: int) -> np.ndarray:
    """Odds of each residue under the composition that positions i..j (1-based) use, by expected state usage."""
    if isinstance(post, checkpoint.Decoded):
        if (i, j) != (1, len(post.mocc) - 1):
            raise ValueError("usage is known for the whole of a sequence that was decoded in stretches")
        use_m, use_i = post.usage
    else:
        use_m, use_i = post.match[i : j + 1].sum(0), post.insert[i : j + 1].sum(0)
    flank = (post.n[i : j + 1] + post.j[i : j + 1] + post.c[i : j + 1]).sum() + use_i.sum()
    total = use_m.sum() + flank
    return (np.exp(np.where(np.isfinite(p.msc), p.msc, NEVER)) @ np.where(np.arange(p.m + 1) > 0, use_m, 0) + flank) / total


def bias_nulls(f: np.ndarray, compo: np.ndarray, m: int, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """ln odds of sequences under the two-state composition null, against the background."""
    return bias_by_odds(bias_odds(f, compo), m, x, lengths)


def bias_odds(f: np.ndarray, compo: np.ndarray) -> np.ndarray:
    """Odds of each residue code in the second state of the composition null."""
    return np.append(compo / f, 1.0)


def bias_by_odds(odds: np.ndarray, m: int, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """bias_nulls with the odds of each code; those of several models may stand behind one another."""
    stay0, stay1 = 400 / 401, (m / 8) / (m / 8 + 1)
    order = np.argsort(-lengths, kind="stable")  # long rows first: those that go on are a prefix
    x, ends = x[order], np.searchsorted(-lengths[order], -np.arange(x.shape[1] + 1), side="left")
    a, b, sums = np.full(len(x), 0.999), np.full(len(x), 0.001), np.zeros(len(x))
    for i in range(x.shape[1]):
        k = int(ends[i])
        if not k:
            break
        if i:
            a[:k], b[:k] = a[:k] * stay0 + b[:k] * (1 - stay1), a[:k] * (1 - stay0) + b[:k] * stay1
        b[:k] *= odds[x[:k, i]]
        total = a[:k] + b[:k]
        sums[:k] += np.log(total)
        a[:k] /= total
        b[:k] /= total
    out = np.empty(len(x))
    out[order] = sums
    return out


def bias_null(f: np.ndarray, compo: np.ndarray, m: int, codes: np.ndarray) -> float:
    """bias_nulls of one sequence."""
    return float(bias_nulls(f, compo, m, *batch([codes]))[0])
