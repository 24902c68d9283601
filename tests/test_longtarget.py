"""Long targets: windows of the filters, composition, and hits against plain versions."""

import math
from dataclasses import replace

import numpy as np
import pytest

from seqloom.functions.alphabet import digitize
from seqloom.operators import kernels as K
from seqloom.operators import longtarget as L
from seqloom.operators import profile as P
from seqloom.operators import search as R
from seqloom.operators.profile import DD, DM, IM, II, MD, MI, MM

WORD = "ACGTTGCAAGGCTTACCGATGCATTGACCA"


def dna(rng, n, f=(0.25, 0.25, 0.25, 0.25)):
    return "".join(rng.choice(list("ACGT"), n, p=f))


@pytest.fixture(scope="module")
def model():
    m = P.single_sequence("w", WORD, popen=0.03125, pextend=0.75, alphabet="dna")
    m.max_length = 60
    return R.calibrated(m)


@pytest.fixture(scope="module")
def targets():
    rng = np.random.default_rng(3)
    out = ["", "A", "ACGT", "N" * 50, dna(rng, 200), WORD, WORD + WORD, dna(rng, 80) + WORD + dna(rng, 60) + WORD[:12] + "GT" + WORD[12:] + dna(rng, 30) + WORD[:14] + WORD[18:]]
    return out + [dna(rng, int(rng.integers(20, 300))) + WORD[: int(rng.integers(8, 30))] + dna(rng, 40) for _ in range(12)]


def test_stretches_of_many_are_those_of_each(model, targets):
    p, codes = P.configure(model), [digitize(s, "dna") for s in targets]
    for least in (8, 14, 25):
        found = K.ssv_windows_many(p, codes, least)
        assert found == [K.ssv_windows(p, c, least) for c in codes]
        assert any(found)


def plain_crossings(p, codes, target, least):
    """The recursion cell by cell."""
    scale = 500 / math.log(2)
    t, e, entry = (P.quantise_viterbi(v).tolist() for v in (p.tsc, p.msc, p.entry))
    move, half, low = math.floor(scale * math.log(3 / (target + 3)) + 0.5), math.floor(scale * math.log(0.5) + 0.5), -32768
    m, i, d = ([low] * (p.m + 1) for _ in range(3))
    b, j, out = 12000 + move, low, []
    for at, c in enumerate(codes.tolist(), 1):
        new = [low] * (p.m + 1)
        for k in range(1, p.m + 1):
            cells = [b + entry[k]] + ([m[k - 1] + t[k - 1][MM], i[k - 1] + t[k - 1][IM], d[k - 1] + t[k - 1][DM]] if k > 1 else [])
            new[k] = max(low, max(cells) + e[c][k])
        i = [low] + [max(m[k] + t[k][MI], i[k] + t[k][II]) for k in range(1, p.m)] + [low]
        m, d = new, [low] * (p.m + 1)
        for k in range(2, p.m + 1):
            d[k] = max(m[k - 1] + t[k - 1][MD], d[k - 1] + t[k - 1][DD])
        best = max(m[1:])
        if best >= least:
            out += [(at, k) for k in range(1, p.m + 1) if m[k] == best]
            m, i, d = ([low] * (p.m + 1) for _ in range(3))
        else:
            j = max(j, best + half)
            b = max(j, 12000) + move
    return out


def test_gapped_windows_begin_anew_at_every_crossing(model, targets):
    p, codes = P.configure(model), [digitize(s, "dna") for s in targets if s]
    x, lengths = K.batch(codes)
    for nats, own in ((0.0, 60), (4.0, 60), (9.0, 200)):
        target = np.minimum(lengths, own)
        least = K.viterbi_least(p, np.full(len(codes), nats), target)
        found = K.viterbi_crossings(p, x, lengths, target, least)
        assert found == [plain_crossings(p, c, int(n), int(s)) for c, n, s in zip(codes, target, least, strict=True)]
        assert max(map(len, found)) >= 2


def test_crossings_are_where_the_filter_passes(model, targets):
    """A target has a crossing of its own score, and none of a greater one."""
    p, codes = P.configure(model), [digitize(s, "dna") for s in targets if len(s) > 30]
    x, lengths = K.batch(codes)
    scores = K.viterbi_int(p, x, lengths)
    single = [i for i, s in enumerate(scores) if np.isfinite(s)]
    above = K.viterbi_crossings(p, x, lengths, lengths, K.viterbi_least(p, scores + 0.01, lengths))
    assert not any(above[i] for i in single if len(codes[i]) < 100)


def test_spans_are_united_and_cut():
    assert L.united([(5, 10), (1, 4), (9, 20), (30, 31)], 0.0) == [(1, 4), (5, 20), (30, 31)]
    assert L.united([(1, 10), (6, 15), (5, 14)], 0.5) == [(1, 15)] and L.united([(1, 10), (6, 15)], 0.5) == [(1, 10), (6, 15)]
    assert L.united([], 0.5) == []
    assert L.cut_up([(1, 25), (40, 45)], 10, 4) == [(1, 10), (7, 16), (13, 22), (19, 25), (40, 45)]
    assert L.covered([(0, 1, 10), (0, 5, 12), (1, 5, 6)]) == 14


def test_a_composition_is_mixed_in():
    f = np.array([0.25] * 4)
    assert np.allclose(L.mixed_background(f, digitize("AAAA", "dna"), 400), [0.8125, 0.0625, 0.0625, 0.0625])
    assert np.allclose(L.mixed_background(f, digitize("AANC", "dna"), 10), 0.5 * f + 0.5 * np.array([2 / 3, 1 / 3, 0, 0]))
    assert np.allclose(L.mixed_background(f, digitize("NN", "dna"), 10), f)


def plain_forward(model, f, codes, length):
    """Forward of one domain in probabilities, with emissions against f."""
    p = P.configure(replace(model, f=f), multihit=False)
    t, e, entry = np.exp(p.tsc), np.exp(p.msc), np.exp(p.entry)
    loop, move = length / (length + 2), 2 / (length + 2)
    m, i, d = (np.zeros(p.m + 1) for _ in range(3))
    n, c, b = 1.0, 0.0, move
    for x in codes:
        new, ins, de = (np.zeros(p.m + 1) for _ in range(3))
        for k in range(1, p.m + 1):
            new[k] = e[x, k] * (b * entry[k] + (m[k - 1] * t[k - 1, MM] + i[k - 1] * t[k - 1, IM] + d[k - 1] * t[k - 1, DM] if k > 1 else 0))
            if k < p.m:
                ins[k] = m[k] * t[k, MI] + i[k] * t[k, II]
        for k in range(2, p.m + 1):
            de[k] = new[k - 1] * t[k - 1, MD] + de[k - 1] * t[k - 1, DD]
        m, i, d = new, ins, de
        c = c * loop + m[1:].sum() + d[1:].sum()
        n *= loop
        b = n * move
    return math.log(c * move)


def test_a_domain_is_scored_by_its_own_composition_and_as_in_a_window(model):
    rng = np.random.default_rng(8)
    s = L.Scanner(model)
    for f in ((0.25,) * 4, (0.7, 0.1, 0.1, 0.1)):
        seq = dna(rng, 25, f) + WORD + dna(rng, 90, f)
        codes = digitize(seq, "dna")
        d = L.domain(s, seq, codes, 10, 130)
        i, j, env = d["ienv"], d["jenv"], d["jenv"] - d["ienv"] + 1
        assert d["iali"] <= 26 and d["jali"] >= 50 and 10 <= i <= d["iali"] and d["jali"] <= j < 130
        part = codes[i - 1 : j]
        plain = plain_forward(model, model.bg, part, env)
        own = min(plain, plain_forward(model, L.mixed_background(model.bg, part, len(codes)), part, env))
        ali, w = d["jali"] - d["iali"] + 1, max(60, env)
        nats = own - 2 * math.log(2 / (env + 2)) + 2 * math.log(2 / 62) - (env - ali) * math.log(env / (env + 2)) + (w - ali) * math.log(60 / 62)
        null = w * math.log(w / (w + 1)) + math.log(1 / (w + 1))
        assert math.isclose(d["bits"], (nats - null) / math.log(2), abs_tol=1e-6)
        assert math.isclose(d["dombias"], (plain - own) / math.log(2), abs_tol=1e-6)
        assert L.domain(s, seq, codes, 10, 130, use_null2=False)["dombias"] == 0
    assert L.domain(s, "ACGTA", digitize("ACGTA", "dna"), 1, 5) is None


def test_a_part_of_its_own_composition_loses_score():
    word = "AAATAACAAAAGAATAAACAAAATAAGAAAACAATAAAAG"
    m = P.single_sequence("a", word, popen=0.03125, pextend=0.75, alphabet="dna")
    m.max_length = 80
    s = L.Scanner(R.calibrated(m))
    seq = "CGTTGCGT" * 6 + word + "GCTGCGTC" * 6
    codes = digitize(seq, "dna")
    own, whole = L.domain(s, seq, codes, 49, 88), L.domain(s, seq, codes, 49, 88, use_null2=False)
    assert own["dombias"] > 5 and math.isclose(own["bits"] + own["dombias"], whole["bits"], abs_tol=0.2)  # alignments differ by an end residue
    assert L.domain(s, "A" * 120, digitize("A" * 120, "dna"), 40, 80) is None  # nothing is left of an unbroken run


def planted(rng):
    other = WORD[::-1].translate(str.maketrans("ACGT", "TGCA"))
    return dna(rng, 700) + WORD + dna(rng, 900) + other + dna(rng, 1300) + WORD[:15] + "G" + WORD[15:] + dna(rng, 200) + WORD + dna(rng, 333)


def test_hits_do_not_depend_on_chunks_or_partitions(spark, model):
    rng = np.random.default_rng(12)
    rows = [(1, "one", planted(rng)), (2, "two", planted(rng).lower()), (3, "none", None), (4, "empty", ""), (5, "short", "ACG"), (6, "odd", "N" * 500)]
    df = spark.createDataFrame(rows, "seq_id bigint, name string, seq string")
    second = P.single_sequence("v", rows[0][2][100:140], popen=0.03125, pextend=0.75, alphabet="dna")
    second.max_length = 70
    models = [model, R.calibrated(second)]

    def found(df, **more):
        return sorted((r.model, r.seq_id, r.strand, r.ali_from, r.ali_to, round(r.bits, 3)) for r in L.search(df, models, L.Config(e=1e-3), **more).collect())

    whole = found(df, chunk=50_000)
    assert {x[:5] for x in whole} >= {("w", 1, "+", 701, 730), ("w", 1, "-", 1660, 1631), ("w", 2, "+", 701, 730)}
    assert any(x[:3] == ("v", 1, "+") and abs(x[3] - 101) <= 3 and abs(x[4] - 140) <= 3 for x in whole)
    assert len([x for x in whole if x[:3] == ("w", 1, "+")]) == 3
    for size, parts in ((700, 1), (1111, 5)):
        assert [x[:5] for x in found(df.repartition(parts), chunk=size)] == [x[:5] for x in whole]
    assert {x[2] for x in found(df, which="top")} == {"+"}


def test_filters_lose_nothing_that_scores(spark, model):
    rng = np.random.default_rng(21)
    df = spark.createDataFrame([(k, str(k), planted(rng)) for k in range(3)], "seq_id bigint, name string, seq string")
    key = lambda rows: {(r.seq_id, r.strand, r.ali_from, r.ali_to) for r in rows}
    some, every = L.search(df, [model], L.Config(e=1e-3)).collect(), L.search(df, [model], L.Config(e=1e-3).maximal()).collect()
    assert key(some) == key(every) and len(some) == 12
    counts = L.counters(df, [model]).first()
    assert counts.n == 2 * sum(len(r.seq) for r in df.collect())
    assert counts.n > counts.past_msv >= counts.past_bias >= counts.past_vit >= counts.past_fwd > 0


def test_scan_ranks_within_a_target_and_counts_models(spark, model):
    rng = np.random.default_rng(12)
    df = spark.createDataFrame([(1, "one", planted(rng))], "seq_id bigint, name string, seq string")
    twin = replace(model, name="x")
    one, two = L.search(df, [model]).collect(), L.scan(df, [model, twin]).collect()
    assert [r["rank"] for r in sorted(two, key=lambda r: r["rank"])] == list(range(1, len(two) + 1)) and len(two) == 2 * len(one)
    assert math.isclose(min(r.evalue for r in two), 2 * min(r.evalue for r in one))
    with pytest.raises(ValueError, match="model"):
        L.search(df, [])
