"""Shuffles keep what they should, and samples of profiles follow the profile."""

from collections import Counter

import numpy as np
import pytest

from seqloom.operators import profile as P
from seqloom.operators import sampling as S


def pairs(s):
    return Counter(zip(s, s[1:], strict=False))


def test_pairs_are_kept_and_walks_are_drawn_alike():
    rng = np.random.default_rng(1)
    for _ in range(300):
        seq = "".join(rng.choice(list("abcd"), int(rng.integers(0, 40))))
        out = S.pair_shuffle(seq, rng)
        assert pairs(out) == pairs(seq) and Counter(out) == Counter(seq) and out[:1] == seq[:1] and out[-1:] == seq[-1:]
    counts = Counter(S.pair_shuffle("abcabdacbad", np.random.default_rng(k)) for k in range(6000))
    # all words with these pairs, each in as many ways as equal pairs can change places
    words = {w for w in _walks("abcabdacbad")}
    assert set(counts) == words and max(counts.values()) < 1.35 * 6000 / len(words) and min(counts.values()) > 0.65 * 6000 / len(words)


def _walks(seq):
    def go(at, left):
        if not left:
            yield at
            return
        for (a, b), n in left.items():
            if a == at[-1]:
                yield from go(at + b, +(left - Counter({(a, b): 1})) if n else left)
    return set(go(seq[0], pairs(seq)))


def test_kinds_of_random_sequences():
    bg = ("ACGT", np.array([0.7, 0.1, 0.1, 0.1]))
    seq = "AACCCGT" * 60
    out = {k: S.drawn(seq, k, np.random.default_rng(3), bg) for k in S.KINDS}
    assert all(len(v) == len(seq) for v in out.values()) and out["reverse"] == seq[::-1]
    assert Counter(out["mono"]) == Counter(seq) and out["mono"] != seq
    assert pairs(out["di"]) == pairs(seq)
    assert abs(out["markov0"].count("C") / 420 - 3 / 7) < 0.08 and abs(out["iid"].count("A") / 420 - 0.7) < 0.08
    assert set(pairs(out["markov1"])) <= set(pairs(seq + seq[0])) and abs(out["markov1"].count("C") / 420 - 3 / 7) < 0.1
    assert all(S.drawn("", k, np.random.default_rng(3), bg) == "" for k in S.KINDS)
    with pytest.raises(ValueError, match="none of"):
        S.drawn("AC", "x", np.random.default_rng(3), bg)


def test_rows_draw_for_themselves(spark):
    rows = [(k, "ACDEFGHIKL" * (k % 4)) for k in range(40)] + [(99, None)]
    df = spark.createDataFrame(rows, "key int, seq string")
    one, many = ({r.key: r.seq for r in S.shuffled_rows(df.repartition(n), "mono").collect()} for n in (1, 8))
    assert one == many and one[99] is None and one[2] != one[6] and all(Counter(one[k]) == Counter(s) for k, s in rows if s)
    with pytest.raises(ValueError, match="none of"):
        S.shuffled_rows(df, "x")


def test_domains_lie_where_they_were_put():
    rng = np.random.default_rng(4)
    for domains in (["AAAA"], ["AAAA", "CCC"], []):
        for length in (0, 20, 60):
            seq, places = S.embedded(domains, length, rng, lambda n: "." * n)
            assert len(seq) == max(length, sum(map(len, domains))) and [seq[i - 1 : j] for i, j in places] == domains


def model():
    m = P.single_sequence("w", "ACDEFGHIKL", popen=0.1, pextend=0.3)
    return m


def test_endpoints_are_a_distribution_over_spans():
    m = model()
    p = S.endpoints(m)
    assert np.isclose(p.sum(), 1) and not np.tril(p, -1).any() and not p[0].any()
    m.t[:, P.MM], m.t[:, P.MI], m.t[:, P.MD] = 1, 0, 0  # every node is used: all spans alike
    assert np.allclose(S.endpoints(m)[np.triu_indices(10, 0, 10)[0] + 1, np.triu_indices(10, 0, 10)[1] + 1], 2 / (10 * 11))


def test_samples_follow_the_profile():
    m = model()
    paths = [S.profile_path(m, S.generator(7, k), 30) for k in range(4000)]
    flanks = np.mean([sum(s in "NCJ" for s, *_ in p) for p in paths])
    doms = [sum(1 for a, b in zip([("N", 0, "")] + p, p, strict=False) if b[0] == "M" and (a[0] in "NJ" or (a[0] == "M" and b[1] <= a[1]))) for p in paths]
    assert abs(np.mean(doms) - 2) < 0.15  # half of all domains are followed by another
    assert abs(flanks / (30 / 3 * 3) - 1) < 0.15  # N, C and J: on average a target of that length together
    first = Counter(next(k for s, k, _ in p if s == "M") for p in paths)
    spans = S.endpoints(m).sum(1)
    assert all(abs(first[k] / 4000 - spans[k]) < 0.025 for k in range(1, 11))
    letters = Counter(c for p in paths for s, k, c in p if s == "M" and k == 3)
    share = letters["D"] / sum(letters.values())
    assert abs(share - m.mat[3]["ACDEFGHIKLMNPQRSTVWY".index("D")]) < 0.03


def test_unihit_and_glocal_paths_go_from_end_to_end():
    m = model()
    for k in range(200):
        path = [x for x in S.profile_path(m, S.generator(1, k), 10, multihit=False, local=False) if x[0] in "MD"]
        assert [x[1] for x in path] == list(range(1, 11))


def test_sampled_rows_do_not_depend_on_partitions(spark):
    m = model()
    a, b = (sorted(map(tuple, S.emit_profile(spark, m, 50, 20, seed).collect())) for seed in (3, 3))
    assert a == b and a == sorted(map(tuple, S.emit_profile(spark, m, 60, 20, 3).where("i < 50").collect())) and len({r[2] for r in a}) > 45
    assert a != sorted(map(tuple, S.emit_profile(spark, m, 50, 20, 4).collect()))
    assert all(len(seq) == len(states.replace("D", "")) for _, _, seq, states in a)
    rows = S.emit_alignment(spark, m, 30).collect()
    assert len({len(r.aseq) for r in rows}) == 1 and {sum(c.isupper() or c == "-" for c in r.aseq) for r in rows} == {10} and len(rows) == 30
