"""Random sequences: shuffles that keep what they should, draws of a sequence's own statistics, and samples of a whole profile.

Every row draws from a generator of its own, seeded by the call's seed and the row's key, so what a row gets depends neither on
partitions nor on other rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from seqloom.functions.alphabet import ALPHABETS
from seqloom.operators import build as B
from seqloom.operators.profile import DD, DM, II, IM, MD, MI, MM, Model, configure

KINDS = ("mono", "di", "markov0", "markov1", "reverse", "iid")


def generator(seed: int, key) -> np.random.Generator:
    """A row's own generator."""
    return np.random.default_rng([seed, zlib.crc32(str(key).encode()), zlib.adler32(str(key).encode())])


def pair_shuffle(seq: str, rng: np.random.Generator) -> str:
    """A random sequence of the same first and last letter that has every pair of neighbours as often as seq, all such sequences alike.

    It is a walk over the letters' graph that uses each pair once. The pair by which a letter is left last belongs to a random
    tree towards the last letter, which is drawn by walks whose loops are erased; the others come in random order.
    """
    if len(seq) < 3:
        return seq
    after: dict[str, list[str]] = defaultdict(list)
    for a, b in zip(seq, seq[1:], strict=False):
        after[a].append(b)
    final = seq[-1]
    leaves: dict[str, int] = {}  # which of its pairs a letter uses last
    inside = {final}
    for start in sorted(after):
        now, path = start, {}
        while now not in inside:
            path[now] = int(rng.integers(len(after[now])))
            now = after[now][path[now]]
        now = start
        while now not in inside:  # what is left of the walk without its loops
            leaves[now] = path[now]
            inside.add(now)
            now = after[now][path[now]]
    order = {}
    for a in sorted(after):
        ways = list(after[a])
        last = [ways.pop(leaves[a])] if a in leaves else []
        order[a] = [*(ways[i] for i in rng.permutation(len(ways))), *last][::-1]
    out = [seq[0]]
    while order.get(out[-1]):
        out.append(order[out[-1]].pop())
    return "".join(out)


def drawn(seq: str, kind: str, rng: np.random.Generator, background: tuple[str, np.ndarray]) -> str:
    """A random sequence as long as seq: its letters shuffled (mono), its pairs (di), letters drawn by their shares in it (markov0), by what follows what in it (markov1), its reverse, or letters of a background (iid)."""
    n = len(seq)
    if kind == "reverse":
        return seq[::-1]
    if n == 0:
        return ""
    if kind == "iid":
        return "".join(np.array(list(background[0]))[rng.choice(len(background[0]), n, p=background[1])])
    letters = np.array(list(seq))
    if kind == "mono":
        return "".join(letters[rng.permutation(n)])
    if kind == "di":
        return pair_shuffle(seq, rng)
    if kind == "markov0":
        return "".join(letters[rng.integers(0, n, n)])
    if kind != "markov1":
        raise ValueError(f"{kind} is none of {', '.join(KINDS)}")
    after: dict[str, list[str]] = defaultdict(list)
    for a, b in zip(seq, seq[1:] + seq[0], strict=True):  # round the end, so that every letter is followed by one
        after[a].append(b)
    out = [seq[int(rng.integers(n))]]
    while len(out) < n:
        ways = after[out[-1]]
        out.append(ways[int(rng.integers(len(ways)))])
    return "".join(out)


def shuffled_rows(sequences: DataFrame, kind: str = "mono", seed: int = 42, alphabet: str = "amino") -> DataFrame:
    """sequences(key, seq) with each sequence replaced by a random one of a kind; nulls stay."""
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {', '.join(KINDS)}")
    from seqloom.functions.alphabet import background

    f = (ALPHABETS[alphabet], background(alphabet))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(seq=[None if s is None else drawn(s, kind, generator(seed, key), f) for key, s in zip(pdf.key, pdf.seq, strict=True)])

    rows = sequences.select("key", "seq")
    return rows.mapInPandas(run, rows.schema)


def embedded(domains: list[str], length: int, rng: np.random.Generator, segment) -> tuple[str, list[tuple[int, int]]]:
    """(sequence, places from 1) of one or more domains at random places of a random background; segment(n) gives n letters of it.

    Places are drawn among the residues between domains, which keep their order; a sequence is as long as its domains at least.
    """
    rest = max(0, length - sum(map(len, domains)))
    cuts = sorted(int(x) for x in rng.integers(0, rest + 1, len(domains)))
    out, places, at = "", [], 0
    for cut, domain in zip(cuts, domains, strict=True):
        out += segment(cut - at)
        places.append((len(out) + 1, len(out) + len(domain)))
        out += domain
        at = cut
    return out + segment(rest - at), places


# profiles
def endpoints(model: Model) -> np.ndarray:
    """(first node, last node): the probability that a local domain spans just these, from 1; row and column 0 are none.

    A domain begins in a node as often as paths use it, and ends in any later one alike: all spans are equally likely where all nodes
    are used alike.
    """
    p, m = configure(model), model.m
    begin = np.exp(p.entry) * (m - np.arange(m + 1) + 1)
    begin[0] = 0
    begin /= begin.sum()
    out = np.zeros((m + 1, m + 1))
    for k in range(1, m + 1):
        out[k, k:] = begin[k] / (m - k + 1)
    return out


def profile_path(model: Model, rng: np.random.Generator, length: int = 400, multihit: bool = True, local: bool = True) -> list[tuple[str, int, str]]:
    """(state, node, letter) of a path through a whole profile: flanks, one or more domains and what joins them."""
    p = configure(model, local, multihit)
    _, move = (float(np.exp(v)) for v in p.length_model(length))
    letters, f = ALPHABETS[model.alphabet], model.bg
    ins = model.ins if model.ins is not None else np.tile(f, (model.m + 1, 1))
    pick = lambda q: int(rng.choice(len(q), p=np.asarray(q) / np.sum(q)))
    spans = endpoints(model)
    out: list[tuple[str, int, str]] = []

    def flank(state: str) -> None:
        while rng.random() >= move:
            out.append((state, 0, letters[pick(f)]))

    flank("N")
    while True:
        first, last = divmod(pick(spans.ravel()), model.m + 1) if local else (0, model.m)
        k, state = first, "M"
        if not local:
            k, state = (1, "M") if rng.random() >= model.t[0, MD] else (1, "D")
        while True:
            if state == "M":
                out.append(("M", k, letters[pick(model.mat[k])]))
            elif state == "I":
                out.append(("I", k, letters[pick(ins[k])]))
            else:
                out.append(("D", k, "-"))
            if k == last and state != "I":
                break
            t = model.t[k]
            state = "MID"[pick(t[[MM, MI, MD]])] if state == "M" else "MI"[pick(t[[IM, II]])] if state == "I" else "MD"[pick(t[[DM, DD]])]
            k += state != "I"
        if not multihit or rng.random() < 0.5:
            break
        flank("J")
    flank("C")
    return out


def _sampled(spark: SparkSession, model: Model, n: int, seed: int, make, schema: str) -> DataFrame:
    """Rows make(i, path) of samples 0..n-1, in tasks."""
    columns = [c.split(" ")[0] for c in schema.replace("array<", "").replace(">", "").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([make(int(i), generator(seed, f"{model.name}/{i}")) for i in pdf.id], columns=columns)

    return spark.range(n).mapInPandas(run, schema)


def emit_profile(spark: SparkSession, model: Model, n: int, length: int = 400, seed: int = 42, multihit: bool = True, local: bool = True) -> DataFrame:
    """(i, name, seq, states) of n sequences that a whole profile emits with the length model of a target; states: N, M, I, D, J and C."""

    def make(i: int, rng: np.random.Generator) -> tuple:
        path = profile_path(model, rng, length, multihit, local)
        return i, f"{model.name}-sample{i + 1}", "".join(c.lower() if s == "I" else c for s, _, c in path if s != "D"), "".join(s for s, _, _ in path)

    return _sampled(spark, model, n, seed, make, "i bigint, name string, seq string, states string")


def emit_alignment(spark: SparkSession, model: Model, n: int, seed: int = 42) -> DataFrame:
    """(name, aseq, pp) of n sequences that a core model emits, from its first node to its last, as rows of one alignment."""

    def make(i: int, rng: np.random.Generator) -> tuple:
        m = model.m
        match, inserts = ["-"] * (m + 1), [""] * (m + 1)
        for state, k, c in profile_path(model, rng, 0, False, False):
            if state == "M":
                match[k] = c
            elif state == "I":
                inserts[k] += c.lower()
        return f"{model.name}-sample{i + 1}", match, ["."] * (m + 1), inserts, ["." * len(x) for x in inserts]

    return B.rows_of(_sampled(spark, model, n, seed, make, B.PARTS), model.m)
