"""Profile models: probability form, log-odds form, quantised form, and statistics of a model.

A model has nodes 1..M. t[k] holds the probabilities mm, mi, md, im, ii, dm, dd that leave node k, with
node 0 as the begin state; mat[k] and ins[k] the emissions of node k (row 0 is unused).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from seqloom.functions.alphabet import ALPHABETS, background, digitize

MM, MI, MD, IM, II, DM, DD = range(7)
NEVER = -np.inf


@dataclass
class Model:
    name: str
    mat: np.ndarray  # (M + 1) x K
    t: np.ndarray  # (M + 1) x 7
    ins: np.ndarray | None = None
    alphabet: str = "amino"
    acc: str | None = None
    descr: str | None = None
    nseq: int | None = None
    eff_nseq: float | None = None
    max_length: int | None = None
    map: list[int] | None = None
    consensus: str | None = None
    rf: str | None = None
    mm: str | None = None
    cs: str | None = None
    checksum: int | None = None
    stats: dict[str, float] = field(default_factory=dict)
    cutoffs: dict[str, tuple[float, float]] = field(default_factory=dict)
    f: np.ndarray | None = None  # background, where it isn't the alphabet's own

    @property
    def m(self) -> int:
        return len(self.mat) - 1

    @property
    def bg(self) -> np.ndarray:
        return background(self.alphabet) if self.f is None else self.f

    def check(self) -> None:
        """Raises ValueError unless every distribution sums to one."""
        for what, part in (("match", self.mat[1:]), ("mm mi md", self.t[1:-1, :3]), ("im ii", self.t[1:-1, 3:5]), ("dm dd", self.t[1:-1, 5:])):
            if len(part) and not np.allclose(part.sum(1), 1, atol=1e-3):
                raise ValueError(f"{self.name}: {what} probabilities don't sum to 1")


def log(x):
    with np.errstate(divide="ignore"):
        return np.log(x)


def occupancy(t: np.ndarray) -> np.ndarray:
    """Probability that a path uses each node's match state, 1..M."""
    m = len(t) - 1
    occ = np.zeros(m + 1)
    occ[1] = t[0, MI] + t[0, MM]
    for k in range(2, m + 1):
        occ[k] = occ[k - 1] * (t[k - 1, MM] + t[k - 1, MI]) + (1 - occ[k - 1]) * t[k - 1, DM]
    return occ


@dataclass
class Profile:
    """Log-odds scores: msc (K + 1) x (M + 1) by residue, transitions into node k from k - 1 as in t."""

    name: str
    msc: np.ndarray
    tsc: np.ndarray  # logs of t
    entry: np.ndarray  # ln P(B -> M_k), entry[0] = -inf
    multihit: bool = True
    local: bool = True
    target: int | None = None  # length of the whole target, where a part of it is scored

    @property
    def m(self) -> int:
        return self.msc.shape[1] - 1

    def length_model(self, n) -> tuple[np.ndarray, np.ndarray]:
        """(loop, move) of N, C and J for target lengths n."""
        nj = 1.0 if self.multihit else 0.0
        n = np.asarray(n, float) if self.target is None else np.full(np.shape(n), float(self.target))
        move = (2 + nj) / (n + 2 + nj)
        return log(1 - move), log(move)

    @property
    def end(self) -> tuple[float, float]:
        """(E -> C, E -> J)."""
        return (np.log(0.5), np.log(0.5)) if self.multihit else (0.0, NEVER)


def configure(model: Model, local: bool = True, multihit: bool = True) -> Profile:
    """The search profile of a model. Ambiguous residues score the background's expectation over the alphabet."""
    f = model.bg
    m, k = model.m, model.mat.shape[1]
    msc = np.full((k + 1, m + 1), NEVER)
    msc[:k, 1:] = log(model.mat[1:] / f).T
    msc[k, 1:] = (np.where(np.isfinite(msc[:k, 1:]), msc[:k, 1:], -30) * f[:, None]).sum(0)
    entry = np.full(m + 1, NEVER)
    if local:
        occ = occupancy(model.t)
        total = (occ[1:] * (m - np.arange(1, m + 1) + 1)).sum()
        entry[1:] = log(occ[1:] / total)
    else:
        entry[1] = log(1 - model.t[0, MD])
        run = log(model.t[0, MD])
        for j in range(1, m):
            entry[j + 1] = run + log(model.t[j, DM])
            run += log(model.t[j, DD])
    return Profile(model.name, msc, log(model.t), entry, multihit, local)


def single_sequence(name: str, seq: str, joint: np.ndarray | None = None, popen: float = 0.02, pextend: float = 0.4, alphabet: str = "amino", bg: np.ndarray | None = None) -> Model:
    """A model from one sequence: emissions P(b | a) of a substitution model, constant gap probabilities."""
    f = background(alphabet) if bg is None else bg
    given = conditional(f) if joint is None else joint / joint.sum(1, keepdims=True)
    x = digitize(seq, alphabet)
    m, k = len(x), len(f)
    mat = np.zeros((m + 1, k))
    mat[1:] = np.vstack([given, f])[x]
    t = np.tile(np.array([1 - 2 * popen, popen, popen, 1 - pextend, pextend, 1 - pextend, pextend]), (m + 1, 1))
    t[m] = [1 - popen, popen, 0, 1 - pextend, pextend, 1, 0]
    t[0, DM:] = [1, 0]
    return Model(name, mat, t, np.tile(f, (m + 1, 1)), alphabet, nseq=1, eff_nseq=1.0, consensus=seq.upper(), f=bg)


def conditional(f: np.ndarray, same: float = 0.6) -> np.ndarray:
    """A plain substitution model: a residue stays with a probability, or is drawn from the background."""
    return same * np.eye(len(f)) + (1 - same) * f


# statistics of a model
def relative_entropy(mat: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Bits per match node against the background."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nansum(np.where(mat[1:] > 0, mat[1:] * np.log2(mat[1:] / f), 0), 1)


def entropy(mat: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return -np.nansum(np.where(mat[1:] > 0, mat[1:] * np.log2(mat[1:]), 0), 1)


def composition(model: Model) -> np.ndarray:
    """Mean emission over match and insert states, by how often each is used."""
    occ = occupancy(model.t)
    occ[0] = 1.0
    visits = np.divide(occ * model.t[:, MI], model.t[:, IM], out=np.zeros_like(occ), where=model.t[:, IM] > 0)
    ins = model.ins if model.ins is not None else np.tile(model.bg, (model.m + 1, 1))
    total = (occ[1:, None] * model.mat[1:]).sum(0) + (visits[:, None] * ins).sum(0)
    return total / total.sum()


def statistics(model: Model) -> dict:
    """nseq, effective nseq, length, mean relative entropy, mean information and composition divergence."""
    f = model.bg
    compo = composition(model)
    h0 = -(f * np.log2(f)).sum()
    return {"name": model.name, "accession": model.acc, "nseq": model.nseq, "eff_nseq": model.eff_nseq, "m": model.m, "relent": float(relative_entropy(model.mat, f).mean()), "info": float((h0 - entropy(model.mat)).mean()), "comp_kl": float((compo * np.log2(compo / f)).sum())}


def logo(model: Model, kind: str = "relent_all") -> np.ndarray:
    """Letter heights per node: relent_all, relent_above (letters above background share it) or score (log2 odds)."""
    f, p = model.bg, model.mat[1:]
    relent = relative_entropy(model.mat, f)[:, None]
    if kind == "relent_all":
        return relent * p
    score = np.log2(np.maximum(p, 1e-30) / f)
    if kind == "score":
        return score
    gain = np.where(p > f, p * score, 0)
    total = gain.sum(1, keepdims=True)
    return np.where(total > 0, relent * gain / np.where(total > 0, total, 1), 0)


def indels(model: Model) -> np.ndarray:
    """(insert probability, expected insert length, occupancy) per node."""
    t = model.t[1:]
    return np.stack([t[:, MI], np.where(t[:, II] < 1, 1 / np.maximum(1e-9, 1 - t[:, II]), 0), occupancy(model.t)[1:]], 1)


def consensus(model: Model, mask: str | None = None) -> str:
    """The likeliest residue of each node, upper case where it is likely; masked nodes give the any-residue."""
    letters, sure = ALPHABETS[model.alphabet], 0.5 if model.alphabet == "amino" else 0.9
    best = model.mat[1:].argmax(1)
    out = [letters[b] if model.mat[k + 1, b] >= sure else letters[b].lower() for k, b in enumerate(best)]
    anything = "x" if model.alphabet == "amino" else "n"
    return "".join(anything if mask and mask[k] == "m" else c for k, c in enumerate(out))


def fancy_consensus(model: Model, low: float = 0.0, high: float = 0.5) -> str:
    letters = ALPHABETS[model.alphabet]
    anything = "x" if model.alphabet == "amino" else "n"
    p = model.mat[1:]
    return "".join(anything if x.max() < low else letters[x.argmax()] if x.max() >= high else letters[x.argmax()].lower() for x in p)


def max_length(model: Model, beta: float = 1e-7) -> int:
    """The smallest target length whose tail mass under the model is below beta."""
    t, m = model.t, model.m
    if m == 1:
        return 1
    limit = max(m, min(20 * m, 100_000))
    mat, ins, out = np.zeros(m + 1), np.zeros(m + 1), 0.0
    dele = np.zeros(m + 1)
    for length in range(1, limit + 1):
        new_m, new_i, new_d = np.zeros(m + 1), np.zeros(m + 1), np.zeros(m + 1)
        if length == 1:
            new_m[1] = 1.0
        new_m[2:] = mat[1:-1] * t[1:-1, MM] + ins[1:-1] * t[1:-1, IM] + dele[1:-1] * t[1:-1, DM]
        new_i[1:-1] = mat[1:-1] * t[1:-1, MI] + ins[1:-1] * t[1:-1, II]
        for k in range(2, m + 1):
            new_d[k] = new_m[k - 1] * t[k - 1, MD] + new_d[k - 1] * t[k - 1, DD]
        mat, ins, dele = new_m, new_i, new_d
        ends = mat[m] + dele[m]
        out += ends
        going = (ins[1:-1] + mat[1:-1] * (1 - t[1:-1, MD]) + dele[1:-1] * (1 - t[1:-1, DD])).sum() + ends
        if length > 2 and going / (going + out) < beta:
            return length
    return limit


def window_shares(model: Model, beta: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """(prefix, suffix) of each node 1..M: the share of a match's greatest length that comes before and after it.

    A node's own length is where the tail of its insertions falls under beta; the ends have none.
    """
    m, t = model.m, model.t
    own = np.zeros(m + 1)
    for k in range(1, m):
        own[k] = 1 if t[k, MI] == 0 else 1 + int(np.log(beta / t[k, MI]) / np.log(t[k, II]))
    share = own / max(1.0, own.sum())
    prefix = np.concatenate([np.cumsum(share[:m]), [0.0]])
    suffix = np.zeros(m + 1)
    suffix[m] = share[m - 1]
    for k in range(m - 1, 0, -1):
        suffix[k] = suffix[k + 1] + share[k - 1]
    return prefix[1:], suffix[1:]


# quantised forms
def quantise_msv(p: Profile) -> tuple[np.ndarray, int]:
    """(match costs in third-bits, bias), 0 to 255."""
    scale = 3 / np.log(2)
    top = p.msc[:-1, 1:].max()
    bias = int(min(255, max(0, round(scale * top))))
    raw = np.where(np.isfinite(p.msc), -np.floor(np.abs(p.msc) * scale + 0.5) * np.sign(p.msc), 1e9)
    return np.clip(raw + bias, 0, 255).astype(np.int32), bias


def quantise_viterbi(x: np.ndarray) -> np.ndarray:
    """Scores in 1/500 bit, saturating at 16 bits."""
    scale = 500 / np.log(2)
    return np.where(np.isfinite(x), np.clip(np.floor(np.abs(x) * scale + 0.5) * np.sign(x), -32768, 32767), -32768).astype(np.int32)
