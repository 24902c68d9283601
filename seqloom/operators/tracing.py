"""Paths of a sequence through a profile: the best one, its score, its domains, and what its states say about composition.

A path is a list of (state, node, position): M and I have both, D a node, N, J and C the position of the residue that they
emit, if any (0 where they emit none), B and E neither.
"""

from __future__ import annotations

import numpy as np

from seqloom.operators import kernels as K
from seqloom.operators.profile import DD, DM, IM, II, MD, MI, MM, NEVER, Profile

Step = tuple[str, int, int]


def transition(p: Profile, n: int, a: Step, b: Step) -> float:
    """The score of a step from one state to the next in a target of n residues; -inf where the model has none."""
    loop, move = (float(v) for v in p.length_model(n))
    to_c, to_j = p.end
    (s, j, _), (t, k, _) = a, b
    inner = {"MM": MM, "MI": MI, "MD": MD, "IM": IM, "II": II, "DM": DM, "DD": DD}
    if s + t in inner:
        return float(p.tsc[j, inner[s + t]]) if k == j + (t != "I") else NEVER
    if s + t in ("NN", "JJ", "CC"):
        return loop
    if s + t in ("NB", "JB", "CT"):
        return move
    if s == "B" and t == "M":
        return float(p.entry[k])
    if t == "E" and s in "MD":
        return 0.0 if p.local or j == p.m else NEVER
    return {"EC": to_c, "EJ": to_j, "SN": 0.0}.get(s + t, NEVER)


def path_score(p: Profile, x: np.ndarray, path: list[Step]) -> float:
    """The score of a path: emissions and steps; it begins with N and ends with C."""
    steps = [*path, ("T", 0, 0)]
    emitted = sum(float(p.msc[x[i - 1], k]) for s, k, i in path if s == "M")
    return emitted + sum(transition(p, len(x), a, b) for a, b in zip(steps, steps[1:], strict=False))


def viterbi_path(p: Profile, x: np.ndarray) -> list[Step]:
    """The best path, walked back from the end through the lattice; of equal ways the first one named."""
    n = len(x)
    _, lat = K.viterbi(p, x[None, :], np.array([n]), keep=True)
    m, ins, dele, e, b = lat.m[0], lat.i[0], lat.d[0], lat.e[0], lat.b[0]
    nn, jj, cc = lat.n[0], lat.j[0], lat.c[0]
    loop, move = (float(v) for v in p.length_model(n))
    to_c, to_j = p.end

    def best(ways: list[tuple[float, Step]]) -> Step:
        return max(ways, key=lambda w: w[0])[1]

    path: list[Step] = []
    state, k, i = "C", 0, n
    while True:
        if state in "CJ":
            own, leave = (cc, to_c) if state == "C" else (jj, to_j)
            if i > 0 and own[i - 1] + loop >= e[i] + leave:
                path.append((state, 0, i))
                i -= 1
                continue
            path += [(state, 0, 0), ("E", 0, 0)]
            ends = [(m[i, q], ("M", q, i)) for q in range(1, p.m + 1)] + [(dele[i, q], ("D", q, i)) for q in range(2, p.m + 1)]
            state, k, _ = best(ends if p.local else [(m[i, p.m], ("M", p.m, i)), (dele[i, p.m], ("D", p.m, i))])
        elif state == "M":
            path.append(("M", k, i))
            ways = [(b[i - 1] + p.entry[k], ("B", 0, 0))]
            if k > 1:
                ways += [(m[i - 1, k - 1] + p.tsc[k - 1, MM], ("M", k - 1, 0)), (ins[i - 1, k - 1] + p.tsc[k - 1, IM], ("I", k - 1, 0)), (dele[i - 1, k - 1] + p.tsc[k - 1, DM], ("D", k - 1, 0))]
            state, k, _ = best(ways)
            i -= 1
        elif state == "I":
            path.append(("I", k, i))
            state = best([(m[i - 1, k] + p.tsc[k, MI], ("M", k, 0)), (ins[i - 1, k] + p.tsc[k, II], ("I", k, 0))])[0]
            i -= 1
        elif state == "D":
            path.append(("D", k, 0))
            state = best([(m[i, k - 1] + p.tsc[k - 1, MD], ("M", k - 1, 0)), (dele[i, k - 1] + p.tsc[k - 1, DD], ("D", k - 1, 0))])[0]
            k -= 1
        else:  # B
            path.append(("B", 0, 0))
            if nn[i] + move >= jj[i] + move:
                path += [("N", 0, r) for r in range(i, 0, -1)] + [("N", 0, 0)]
                return path[::-1]
            state = "J"


def path_domains(path: list[Step]) -> list[tuple[int, int, int, int]]:
    """(first residue, last residue, first node, last node) of each passage from B to E, by its matches."""
    out, inside = [], []
    for s, k, i in path:
        if s == "B":
            inside = []
        elif s == "M":
            inside.append((i, k))
        elif s == "E" and inside:
            out.append((inside[0][0], inside[-1][0], inside[0][1], inside[-1][1]))
    return out


def null2_of_path(p: Profile, path: list[Step]) -> np.ndarray:
    """Odds of each residue under the composition of the states that a part of a path emits from."""
    use, other = np.zeros(p.m + 1), 0
    for s, k, i in path:
        if s == "M":
            use[k] += 1
        elif i:
            other += 1
    emitted = np.exp(np.where(np.isfinite(p.msc), p.msc, NEVER))
    return (emitted @ use + other) / max(1.0, use.sum() + other)


def alignment_scores(p: Profile, model_line: str, target_line: str, x: np.ndarray, first_node: int, first_residue: int) -> np.ndarray:
    """What each column of an aligned domain adds to its score; a gap's cost stands at its last column, -inf before it.

    A match column has its emission and the plain step to it; a gap has what its steps cost beyond that plain step.
    """
    out = np.full(len(model_line), NEVER)
    node, at, column = first_node - 1, first_residue - 1, 0
    while column < len(model_line):
        if model_line[column] != "." and target_line[column] != "-":
            node, at = node + 1, at + 1
            out[column] = p.msc[x[at - 1], node] + (p.tsc[node - 1, MM] if node > 1 else 0.0)
            column += 1
            continue
        inserted = model_line[column] == "."
        width = 1
        while column + width < len(model_line) and (model_line[column + width] == "." if inserted else target_line[column + width] == "-"):
            width += 1
        if inserted:
            cost = p.tsc[node, MI] + (width - 1) * p.tsc[node, II] + p.tsc[node, IM] - p.tsc[node, MM]
            at += width
        else:
            cost = p.tsc[node, MD] + p.tsc[node + 1 : node + width, DD].sum() + p.tsc[node + width, DM] - p.tsc[node + width, MM]
            node += width
        column += width
        out[column - 1] = cost
    return out
