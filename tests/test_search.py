"""The cascade, thresholds, tables, sources, building and intervals on small inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import scores as S
from seqloom.functions.alphabet import AMINO, letters
from seqloom.operators import build as B
from seqloom.operators import intervals as I
from seqloom.operators import longtarget as L
from seqloom.operators import profile as P
from seqloom.operators import search as R
from seqloom.sources import fasta, hmmfile, stockholm

QUERY = "WCHMKWYFHCDERTGPWW"


@pytest.fixture(scope="module")
def targets(spark):
    rng = np.random.default_rng(3)
    noise = lambda n: "".join(rng.choice(list(AMINO), n))
    rows = [(i, f"s{i}", noise(60)) for i in range(40)]
    rows += [(100, "one", noise(20) + QUERY + noise(30)), (101, "two", noise(10) + QUERY + noise(40) + QUERY + noise(5)), (102, "none", None), (103, "empty", "")]
    return spark.createDataFrame(rows, "seq_id bigint, name string, seq string").repartition(3)


@pytest.fixture(scope="module")
def found(targets):
    return R.search(targets, [P.single_sequence("q", QUERY)])


def test_planted_targets_are_reported(found):
    hits, counts = found
    rows = {r.name: r for r in hits.where("reported").collect()}
    assert {"one", "two"} <= rows.keys()
    assert max(rows.values(), key=lambda r: r.score).name == "two"
    assert len(rows["two"].domains) == 2
    c = counts.first()
    assert c.n == 44 and c.n >= c.past_msv >= c.past_bias >= c.past_vit >= c.past_fwd >= 2
    assert math.isclose(rows["one"].evalue, math.exp(rows["one"].lnp) * 44)


def test_tables(found):
    hits, _ = found
    t = R.tblout(hits).orderBy("rank").collect()
    assert [r.rank for r in t] == list(range(1, len(t) + 1))
    d = R.domtblout(hits).where("target_name = 'one'").collect()
    d = sorted(d, key=lambda r: -r.dom_score)
    assert (d[0].ali_from, d[0].ali_to, d[0].hmm_from, d[0].hmm_to) == (21, 38, 1, 18)
    assert d[0].ali_line == QUERY
    assert len(d[0].hmm_line) == len(d[0].pp_line) == 18


def test_results_do_not_depend_on_partitioning(targets, found):
    again, _ = R.search(targets.repartition(1), [P.single_sequence("q", QUERY)])
    key = lambda df: sorted((r.name, round(r.score, 9), r.reported) for r in df.collect())
    assert key(again) == key(found[0])


def test_thresholds_by_score_and_cutoffs(targets, found):
    model = P.single_sequence("q", QUERY)
    model.cutoffs["ga"] = (30.0, 30.0)
    hits, _ = R.search(targets, [model], R.Config().cutoffs(model, "ga"))
    assert {r.name for r in hits.where("reported").collect()} == {r.name for r in hits.where("score >= 30").collect()}
    with pytest.raises(ValueError, match="NC"):
        R.Config().cutoffs(model, "nc")


def test_scan_counts_models(targets):
    models = [P.single_sequence("q", QUERY), P.single_sequence("r", "ACDEFGHIKLMNPQRST")]
    rows = R.scan(targets.where("name = 'one'"), models).collect()
    assert [(r.model, r.rank, r.z) for r in rows] == [("q", 1, 2.0)]


def test_iteration_ends(targets):
    hits, rounds = R.iterate(targets, P.single_sequence("q", QUERY), lambda m, h: m, rounds=4)
    assert rounds == 2
    assert hits.where("included").count() >= 2


def test_domains_are_aligned_to_the_query():
    rows, reference = B.aligned_domains("ACDEF", [(2, "CD..E", "C-klE"), (1, "ACD.EF", "ACDwEY")])
    assert (rows, reference) == (["ACD..EF", "-C-klE-", "ACDw.EY"], "xxx..xx")


def test_iteration_finds_a_remote_target_in_round_2(spark):
    """The remote target has what the near ones have in place of the query's residues, and little of the query."""
    rng = np.random.default_rng(8)
    noise = lambda n: "".join(rng.choice(list(AMINO), n))
    query = QUERY + "HKNMDWYCRF" + "PEGVTHWCQK"
    near = "".join(AMINO[(AMINO.index(a) + 7) % 20] if i % 5 in (1, 3) else a for i, a in enumerate(query))
    remote = "".join(a if i % 5 in (1, 3) or i % 10 in (0, 4) else AMINO[(AMINO.index(a) + 11) % 20] for i, a in enumerate(near))
    rows = [(i, f"s{i}", noise(80)) for i in range(40)] + [(100 + i, f"near{i}", noise(20) + near + noise(20)) for i in range(12)] + [(200, "remote", noise(20) + remote + noise(20))]
    table = spark.createDataFrame(rows, "seq_id bigint, name string, seq string").repartition(4)
    first, _ = R.iterate(table, P.single_sequence("q", query), B.rebuilder(query), rounds=1)
    last, rounds = R.iterate(table, P.single_sequence("q", query), B.rebuilder(query), rounds=5)
    names = lambda hits: {r.name for r in hits.where("included").collect()}
    assert names(first) == {f"near{i}" for i in range(12)}
    assert names(last) == names(first) | {"remote"} and rounds == 3


def test_search_of_no_targets(targets):
    hits, counts = R.search(targets.where("false"), [P.single_sequence("q", QUERY)])
    assert hits.count() == 0 and counts.count() == 0


def test_score_functions(spark):
    S.register(spark)
    r = spark.sql("SELECT sl_null1(100D) a, sl_bits(3D, 1D) b, sl_gumbel_p(10D, 2D, 0.7D) c, sl_exponential_p(1D, 5D, 0.7D) d, sl_log_sum(0D, 0D) e").first()
    assert math.isclose(r.a, 100 * math.log(100 / 101) + math.log(1 / 101))
    assert math.isclose(r.b, 2 / math.log(2)) and r.d == 1 and math.isclose(r.e, math.log(2))
    assert math.isclose(r.c, 1 - math.exp(-math.exp(-0.7 * 8)))
    p = spark.range(1).select(S.gumbel_ln_p(F.lit(100.0), 2.0, 0.7).alias("x"), letters(F.lit("Straße 1bx")).alias("s")).first()
    assert math.isclose(p.x, -0.7 * 98)
    assert p.s == "STRAE"


def test_gumbel_fit_recovers_its_parameters():
    x = np.random.default_rng(1).gumbel(3.0, 1 / 0.7, 20_000)
    mu, lam = R.fit_gumbel(x)
    assert abs(mu - 3) < 0.05 and abs(lam - 0.7) < 0.02


def test_fasta_comes_back(spark, tmp_path, targets):
    rows = targets.where("seq is not null").select("name", F.lit("a b").alias("descr"), "seq")
    fasta.write_fasta(rows, str(tmp_path / "f"), 25)
    assert sorted(map(tuple, fasta.read_fasta(spark, str(tmp_path / "f")).drop("len").collect())) == sorted(map(tuple, rows.collect()))


def test_stockholm_blocks_are_joined(spark, tmp_path):
    text = "# STOCKHOLM 1.0\n#=GF ID fam\n#=GC RF xx\na AC\nb A-\n\n#=GC RF x.\na DE\nb -E\n//\n# STOCKHOLM 1.0\n\nc GG\n//\n"
    (tmp_path / "x.sto").write_text(text)
    rows, notes = stockholm.read_stockholm(spark, str(tmp_path / "x.sto"))
    assert sorted((r.msa_name or "", r.row_idx, r.name, r.aseq) for r in rows.collect()) == [("", 1, "c", "GG"), ("fam", 1, "a", "ACDE"), ("fam", 2, "b", "A--E")]
    assert {(r.kind, r.tag, r.value) for r in notes.collect()} == {("GF", "ID", "fam"), ("GC", "RF", "xxx.")}
    (tmp_path / "y.sto").write_text("\n".join(r.value for r in stockholm.render_stockholm(rows).collect()) + "\n")
    again, _ = stockholm.read_stockholm(spark, str(tmp_path / "y.sto"))
    key = lambda df: sorted((r.msa_name or "", r.name, r.aseq) for r in df.collect())
    assert key(again) == key(rows)


def test_models_come_back(spark, tmp_path):
    m = R.calibrated(B.from_alignment("fam", ["ACDEF", "ACDEF", "AC-EF", "GCDEF"]))
    m.cutoffs["ga"] = (25.0, 24.0)
    other = P.single_sequence("dna", "ACGTTGCA", alphabet="dna")
    (tmp_path / "m.txt").write_text(hmmfile.render(m) + hmmfile.render(other))
    df = hmmfile.read_models(spark, str(tmp_path / "m.txt"))
    got = {r["name"]: hmmfile.from_record(r) for r in df.collect()}
    assert got.keys() == {"fam", "dna"}
    back = got["fam"]
    assert np.allclose(back.mat[1:], m.mat[1:], atol=1e-5) and np.allclose(back.t, m.t, atol=1e-5)
    assert back.map == m.map and back.consensus == m.consensus and back.cutoffs == m.cutoffs
    assert math.isclose(back.stats["fwd_tau"], m.stats["fwd_tau"], abs_tol=1e-4)
    hmmfile.press(df, str(tmp_path / "pressed"))
    assert hmmfile.fetch(spark.read.parquet(str(tmp_path / "pressed")), "dna").count() == 1


def test_models_from_alignments():
    rows = ["ACDEFGH", "ACDEFGH", "AC--FGH", "ACDEFaGH".replace("a", "")]
    m = B.from_alignment("fam", rows)
    m.check()
    assert P.consensus(m).upper() == "ACDEFGH"
    assert m.t[2, P.MD] > m.t[1, P.MD]
    by_hand = B.from_alignment("fam", rows, reference="xx..xxx")
    assert by_hand.m == 5
    assert B.mark_fragments(["--A--", "AAAAA"], 0.5) == ["~~A~~", "AAAAA"]
    few, many = B.from_alignment("a", rows[:1] * 2), B.from_alignment("a", rows[:1] * 40)
    assert few.eff_nseq <= many.eff_nseq


def test_alignment_to_a_model_keeps_residues():
    m = P.single_sequence("q", QUERY)
    seqs = ["AA" + QUERY, QUERY[:5] + "GGG" + QUERY[5:], QUERY[:8] + QUERY[10:], ""]
    out = B.align(m, list("abcd"), seqs)
    assert len({len(r) for _, r, _ in out}) == 1
    for (_, row, pp), s in zip(out, seqs, strict=True):
        assert row.replace("-", "").replace(".", "").upper() == s
        assert len(pp) == len(row)


def test_emitted_sequences_resemble_the_model():
    m = P.single_sequence("q", QUERY, joint=np.eye(20) + 1e-9, popen=0.001)
    assert max(B.emit(m, 5), key=len)[:3] == "WCH"
    assert B.emit(m, 3) == B.emit(m, 3)


def test_weights_in_tables_equal_those_in_memory(spark):
    rows = ["ACDE", "ACDE", "AC-F", "G--F"]
    df = spark.createDataFrame([(1, i, r) for i, r in enumerate(rows)], "msa_id int, row_idx int, aseq string")
    got = [r.weight for r in B.position_weights(B.cells(df)).orderBy("row_idx").collect()]
    want = np.zeros(4)
    for col in range(4):
        on = [i for i, r in enumerate(rows) if r[col] != "-"]
        kinds = {rows[i][col] for i in on}
        for i in on:
            want[i] += 1 / (len(kinds) * sum(rows[j][col] == rows[i][col] for j in on))
    want /= [sum(c != "-" for c in r) for r in rows]
    assert np.allclose(got, want / want.sum() * 4)


def test_intervals(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 6, 9), ("a", 12, 15), ("a", 13, 14), ("b", 3, 3)], "t string, start int, end int")
    assert sorted(map(tuple, I.merged(df, ["t"]).collect())) == [("a", 1, 9, 2), ("a", 12, 15, 2), ("b", 3, 3, 1)]
    hits = df.withColumn("lnp", F.lit(-1.0) * F.col("end"))
    kept = sorted((r.t, r.start, r.end) for r in I.without_duplicates(hits, ["t"]).collect())
    assert kept == [("a", 1, 5), ("a", 6, 9), ("a", 12, 15), ("b", 3, 3)]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_exact_matches_by_automaton_and_by_seeds(spark, monkeypatch, limit):
    monkeypatch.setattr(I, "PATTERN_BYTES", limit)
    rng = np.random.default_rng(0)
    seqs = ["".join(rng.choice(list("ab"), 900)) for _ in range(6)] + [None, ""]
    patterns = [seqs[0][100:115], seqs[1][300:330], "c" * 20, seqs[0][100:115]]
    t = spark.createDataFrame(list(enumerate(seqs)), "target int, seq string")
    q = spark.createDataFrame(list(enumerate(patterns)), "query int, pattern string")
    got = sorted(map(tuple, I.exact_matches(t, q).collect()))
    want = sorted((i, j, k + 1) for i, s in enumerate(seqs) if s for j, p in enumerate(patterns) for k in range(len(s)) if s.startswith(p, k))
    assert got == want and want


def test_windows_cover_a_sequence(spark):
    df = spark.createDataFrame([("abcdefghij",), ("abc",), ("",)], "s string")
    rows = [(r.s, r.start, r.part) for r in I.windows(df, "s", 5, 2).collect()]
    assert rows == [("abcdefghij", 1, "abcde"), ("abcdefghij", 4, "defgh"), ("abcdefghij", 7, "ghij"), ("abc", 1, "abc")]


@pytest.mark.parametrize("filtered", [False, True])
def test_long_targets_are_searched_on_both_strands(spark, filtered):
    rng = np.random.default_rng(5)
    word = "ACGTTGCAAGGCTTACCGATGCATTGACCA"
    other = word[::-1].translate(str.maketrans("ACGT", "TGCA"))
    noise = lambda n: "".join(rng.choice(list("ACGT"), n))
    seq = noise(700) + word + noise(900) + other + noise(300)
    df = spark.createDataFrame([(1, "chr", seq), (2, "none", None)], "seq_id bigint, name string, seq string")
    model = P.single_sequence("w", word, popen=0.03125, pextend=0.75, alphabet="dna")
    model.max_length = 60
    config = L.Config() if filtered else L.Config().maximal()
    rows = L.search(df, [model], config, chunk=400).collect()
    found = {(r.strand, r.ali_from, r.ali_to) for r in rows if r.bits > 25}
    assert found == {("+", 701, 730), ("-", 1660, 1631)}


def test_paths_without_delete_next_to_insert():
    path = [("M", 1, 0), ("D", 2, 1), ("I", 2, 2), ("M", 3, 3), ("I", 3, 4), ("D", 4, 5)]
    assert B.without_delete_insert(path) == [("M", 1, 0), ("M", 2, 2), ("M", 3, 3), ("M", 4, 4)]


def test_simulated_scores_follow_their_fit(spark):
    model = R.calibrated(P.single_sequence("q", QUERY))
    rows = R.simulated(spark, model, 400, 100).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, R.simulated(spark, model, 400, 100).repartition(3).collect()))
    fwd = np.array([r.fwd for r in rows])
    tail = np.exp(np.minimum(0, -model.stats["fwd_lambda"] * (fwd - model.stats["fwd_tau"])))
    assert 0.01 < (tail <= 0.05).mean() < 0.15
    assert all(r.vit <= r.fwd + 1e-9 for r in rows)


def test_compact_tables(found):
    hits, _ = found
    seqs, doms = R.compact_sequences(hits), R.compact_domains(hits)
    assert {"one", "two"} <= {r.name for r in seqs.collect()}
    numbers = sorted(r.hit_no for r in doms.collect())
    assert numbers == list(range(1, len(numbers) + 1)) and len(numbers) >= 3
