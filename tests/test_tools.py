"""Tools around a search against plain versions: paths, model forms, the transform index, exchange formats, clusters."""

import random
import re

import numpy as np
import pytest

from seqloom.functions.alphabet import AMINO, digitize
from seqloom.operators import build as B
from seqloom.operators import clusters as C
from seqloom.operators import fmindex
from seqloom.operators import intervals as I
from seqloom.operators import kernels as K
from seqloom.operators import profile as P
from seqloom.operators import tracing as T
from seqloom.sources import modelforms, wire
from seqloom.sources.hmmfile import render

RNG = np.random.default_rng(5)


def profiles():
    for _ in range(40):
        m = P.single_sequence("w", "".join(RNG.choice(list(AMINO), RNG.integers(2, 9))))
        yield P.configure(m, multihit=bool(RNG.integers(2)), local=bool(RNG.integers(2))), RNG.integers(0, 20, RNG.integers(1, 25))


def test_the_best_path_scores_what_viterbi_says():
    for p, x in profiles():
        path = T.viterbi_path(p, x)
        assert [i for s, _, i in path if i and s != "D"] == list(range(1, len(x) + 1))
        score = K.viterbi(p, x[None, :], np.array([len(x)]))[0]
        assert score == -np.inf or np.isclose(T.path_score(p, x, path), score)


def test_a_band_of_all_nodes_is_forward_and_a_narrow_one_is_less():
    for p, x in profiles():
        n = len(x)
        whole = K.forward(p, x[None, :], np.array([n]))[0]
        assert whole == -np.inf or np.isclose(K.forward_banded(p, x, np.zeros(n), np.full(n, p.m)), whole)
        assert K.forward_banded(p, x, np.full(n, 1), np.full(n, p.m - 1)) <= whole + 1e-9


def test_composition_of_a_path_counts_its_states():
    p = P.configure(P.single_sequence("w", "WCHMK"))
    x = digitize("AAWCHMKAA")
    path = T.viterbi_path(p, x)
    assert T.path_domains(path) == [(3, 7, 1, 5)]
    inner = [s for s in path if s[0] == "M"]
    odds = np.exp(p.msc)
    assert np.allclose(T.null2_of_path(p, inner), odds[:, 1:].mean(1))
    assert np.allclose(T.null2_of_path(p, path), (odds[:, 1:].sum(1) + 4) / 9)


def test_columns_of_an_alignment_sum_to_what_its_steps_cost():
    p = P.configure(P.single_sequence("w", "WCHMKYF"))
    x = digitize("WCHAAMYF")
    scores = T.alignment_scores(p, "WCH..MKYF", "WCHaaM-YF", x, 1, 1)
    path = [("M", 1, 1), ("M", 2, 2), ("M", 3, 3), ("I", 3, 4), ("I", 3, 5), ("M", 4, 6), ("D", 5, 0), ("M", 6, 7), ("M", 7, 8)]
    steps = sum(T.transition(p, 8, a, b) for a, b in zip(path, path[1:], strict=False))
    emitted = sum(p.msc[x[i - 1], k] for s, k, i in path if s == "M")
    assert np.isclose(scores[np.isfinite(scores)].sum(), steps + emitted)
    assert np.isneginf(scores).tolist() == [c == 3 for c in range(9)]


def family():
    m = B.from_alignment("x", ["ACDE-F", "ACDEGF", "AC-EGF", "ACDWGF"])
    m.acc, m.descr, m.rf, m.cutoffs, m.stats, m.checksum, m.max_length = "A1", "some thing", "x" * m.m, {"ga": (1.5, 2.5)}, dict.fromkeys(modelforms.STATS, 1.5), 77, 55
    return m


def test_models_come_back_from_every_form():
    m = family()
    two = list(modelforms.models_of(modelforms.to_binary(m) * 2))
    same = lambda g: (g.name, g.acc, g.descr, g.rf, g.map, g.checksum, g.max_length, g.consensus, g.cutoffs, g.stats)
    assert len(two) == 2 and same(two[1]) == same(m)
    assert np.allclose(two[1].mat, m.mat, atol=1e-6) and np.allclose(two[1].t, m.t, atol=1e-6)
    old, _ = modelforms.models_of((modelforms.render_v2(m) * 2).encode())
    assert np.abs(old.mat - m.mat).max() < 1e-3 and np.abs(old.t[1:-1] - m.t[1:-1]).max() < 1e-3
    assert (old.name, old.acc, old.map, old.rf, old.cutoffs, old.stats) == (m.name, m.acc, m.map, m.rf, m.cutoffs, {})
    with pytest.raises(ValueError, match="cut short"):
        list(modelforms.models_of(modelforms.to_binary(m)[:-3]))
    with pytest.raises(ValueError, match="known kind"):
        list(modelforms.models_of(b"something else"))


def test_files_of_mixed_kinds_are_read_and_fetched(spark, tmp_path):
    m = family()
    (tmp_path / "a.bin").write_bytes(modelforms.to_binary(m))
    (tmp_path / "b.txt").write_text(render(m).replace("NAME  x", "NAME  y"))
    (tmp_path / "c.txt").write_text(modelforms.render_v2(m))
    models = modelforms.read_any(spark, str(tmp_path)).cache()
    assert sorted(r.name for r in models.collect()) == ["x", "x", "y"]
    assert [tuple(r) for r in modelforms.duplicate_names(models).collect()] == [("x", 2)]
    keys = spark.createDataFrame([("y",), (None,), ("absent",)], "key string")
    assert [r.name for r in modelforms.fetch_listed(models, keys).collect()] == ["y"]


def test_backgrounds_come_back():
    f = P.single_sequence("w", "AC").bg
    name, back = modelforms.parse_background("# a comment\n" + modelforms.render_background(f))
    assert name == "amino" and np.allclose(back, f, atol=1e-5)
    with pytest.raises(ValueError, match="sum to 1"):
        modelforms.parse_background("amino " + " ".join(f"{a} 0.5" for a in AMINO))


def test_the_transform_index_finds_what_a_plain_search_finds():
    rng = random.Random(1)
    for _ in range(120):
        text = "".join(rng.choice("ab\x01c") for _ in range(rng.randint(0, 300))).encode()
        index = fmindex.Index(text)
        assert index.text() == text
        some = ["".join(rng.choice("abcz") for _ in range(rng.randint(1, 5))).encode() for _ in range(6)]
        for q, low, high in zip(some, *index.intervals(some), strict=True):
            assert sorted(index.located(np.arange(low, high))) == [m.start() for m in re.finditer(b"(?=" + re.escape(q) + b")", text)]
        rows, letters = np.array([rng.randint(0, index.n) for _ in range(9)]), np.array([rng.randrange(len(index.letters)) for _ in range(9)])
        assert index.smaller(letters, rows).tolist() == [int((index.bwt[:r] < index.letters[c]).sum()) for r, c in zip(rows, letters, strict=True)]
        assert index.all_occurrences(rows)[np.arange(9), letters].tolist() == index.occurrences(letters, rows).tolist() == [int((index.bwt[:r] == index.letters[c]).sum()) for r, c in zip(rows, letters, strict=True)]


@pytest.mark.parametrize("limit", [1 << 24, 100])
def test_long_sequences_are_indexed_in_parts(spark, monkeypatch, limit):
    monkeypatch.setattr(fmindex, "PATTERN_BYTES", limit)  # beyond it, patterns go in groups
    rng = random.Random(2)
    seqs = [(i, "".join(rng.choice("acgt") for _ in range(n))) for i, n in enumerate((900, 40, 0, 333))] + [(9, None)]
    df = spark.createDataFrame(seqs, "target bigint, seq string")
    queries = spark.createDataFrame([(1, "acgt"), (2, "ttt"), (3, "g"), (4, None), (5, ""), (6, "acgt")], "query int, pattern string")
    index = fmindex.build_index(df, overlap=20, block=128)
    want = {(q, t, m.start() + 1) for q, p in ((1, "acgt"), (2, "ttt"), (3, "g"), (6, "acgt")) for t, s in seqs if s for m in re.finditer(f"(?={p})", s)}
    assert {tuple(r) for r in fmindex.find(index, queries).collect()} == want
    parts = {(r.target, r.start): r.part for r in fmindex.restored(index).collect()}
    assert all(dict(seqs)[t][s - 1 : s - 1 + len(p)] == p for (t, s), p in parts.items()) and len(parts) > 8


def test_streams_refuse_what_is_cut_short(spark):
    rows = spark.createDataFrame([(1, None, [1.5, None]), (2, "b", None)], "id bigint, name string, x array<double>").coalesce(1)
    sent = wire.packed(rows)
    assert sorted(map(str, wire.unpacked(sent, rows.schema).collect())) == sorted(map(str, rows.collect()))
    with pytest.raises(Exception, match="fewer rows"):
        wire.unpacked(sent.selectExpr("n + 1 AS n", "content"), rows.schema).collect()


def test_requests_say_what_is_wrong_with_them(spark):
    texts = ["@--seqdb 1 -E 5\n>a b\nAC\nDE\n//", "hello", "@\n>\nAC\n//", "@\n>a\n//", "@-E 1\n>a\nAC", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    c = wire.parsed_request(df.t)
    got = {r.i: r for r in df.select("i", *[v.alias(k) for k, v in c.items()]).collect()}
    assert (got[0].options, got[0].name, got[0].seq, got[0].problem) == ({"--seqdb": "1", "-E": "5"}, "a", "ACDE", None)
    assert [got[i].problem for i in (1, 2, 3, 4)] == ["no options", "no name", "no letters", "no end"]


def test_short_patterns_are_found_beyond_one_automaton(spark, monkeypatch):
    targets = spark.createDataFrame([(1, "abcabcabcabcabcabc"), (2, "xyz" * 9), (3, None)], "target bigint, seq string")
    patterns = ["abc", "zx", "abcabcabcabcab", "xyzxyzxyzxyzxyz", "q", "bcabcabcabcabc"]
    queries = spark.createDataFrame(list(enumerate(patterns)), "query bigint, pattern string")
    small = sorted(map(tuple, I.exact_matches(targets, queries).collect()))
    monkeypatch.setattr(I, "PATTERN_BYTES", 8)
    assert sorted(map(tuple, I.exact_matches(targets, queries).collect())) == small
    assert len(small) > 20


def test_clusters_follow_links_and_empty_alignments_have_none(spark):
    rows = [(1, 1, "AAAA"), (1, 2, "AAAC"), (1, 3, "AACC"), (1, 4, "WWWW"), (1, 5, "AAAA"), (2, 1, "----"), (2, 2, "----")]
    df = spark.createDataFrame(rows, "msa_id int, row_idx int, aseq string")
    got = {(r.msa_id, r.row_idx): r.cluster for r in C.single_linkage(df, 0.7).collect()}
    assert got == {(1, 1): 1, (1, 2): 1, (1, 3): 1, (1, 4): 4, (1, 5): 1, (2, 1): 1, (2, 2): 1}
    assert C.single_linkage(df.where("false"), 0.7).count() == 0
    assert C.independent_set(df.where("false"), 0.7).count() == 0


def test_matrices_become_probabilities():
    from seqloom.sources import matrix

    f = P.single_sequence("w", "AC").bg
    scores = matrix.parse_matrix(matrix.plain_matrix(5, -4))
    joint = matrix.joint_probabilities(scores, f)
    assert np.isclose(joint.sum(), 1) and np.allclose(joint, joint.T)
    odds = np.log(joint / np.outer(f, f))
    assert np.allclose(odds, matrix.scale_of(scores, f) * scores, atol=1e-6)
    with pytest.raises(ValueError, match="negative on average"):
        matrix.scale_of(np.ones((20, 20)), f)
    with pytest.raises(ValueError, match="no scores for"):
        matrix.parse_matrix("A C\nA 1 2\nC 2 1\n")


def test_ungapped_stretches_are_those_of_a_plain_walk():
    for _ in range(60):
        p = P.configure(P.single_sequence("w", "".join(RNG.choice(list(AMINO[:6]), RNG.integers(2, 12)))))
        x = RNG.integers(0, 6, RNG.integers(1, 60))
        cost, bias = P.quantise_msv(p)
        want = []
        for diagonal in range(-p.m, len(x)):
            run, begun, best = 0, 0, None
            for i in range(max(1, diagonal + 1), min(len(x), diagonal + p.m) + 1):
                gain = int(bias - cost[x[i - 1], i - diagonal])
                if run + gain <= 0:
                    want += [best] if best else []
                    run, best = 0, None
                    continue
                begun = i if run == 0 else begun
                run += gain
                if run >= 12 and (best is None or run > best[3]):
                    best = (begun, i, i - diagonal, run)
            want += [best] if best else []
        assert sorted(K.ssv_windows(p, x, 12)) == sorted(want)


def test_domains_are_laid_out_as_one_alignment(spark, tmp_path):
    from seqloom.operators import search as R
    from seqloom.sources.hmmfile import from_record

    rows = [(1, "a", "GGWCHMKYFHCGG"), (2, "b", "WCHAAAMKYFHC"), (3, "c", "WCHYFHC"), (4, "d", "GGGG")]
    df = spark.createDataFrame(rows, "seq_id bigint, name string, seq string")
    query = P.single_sequence("q", "WCHMKYFHC")
    config = R.Config(inc_e=1e6, inc_dom_e=1e6, e=1e6).maximal()
    hits, _ = R.iterate(df, query, B.rebuilder("WCHMKYFHC"), 2, config, str(tmp_path))
    made = {r.name.split("/")[0]: r.aseq for r in spark.read.parquet(str(tmp_path / "round1" / "alignment")).collect()}
    assert len({len(a) for a in made.values()}) == 1 and {"a", "b"} <= made.keys()
    assert made["a"].replace(".", "") == "WCHMKYFHC" and "aaa" in made["b"]
    back = from_record(spark.read.parquet(str(tmp_path / "round1" / "model")).first())
    assert np.allclose(back.mat, query.mat) and back.name == "q"
