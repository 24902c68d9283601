"""Alignments onto the model they came from, new sequences beside them, and statistics of aligned residues."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions.alphabet import digitize
from seqloom.operators import build as B
from seqloom.operators import kernels as K
from seqloom.operators import mapali as A
from seqloom.operators import profile as P

ROWS = ["--ACDE-FG-HI..", "mmACDE-FGkHI-w", "--AC-EyFG-HIpp", "a-.CDEyF--HI--", "--------------", "--ACDEyFGkHI-."]
COLUMNS = [3, 4, 5, 6, 8, 9, 11, 12]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(k, f"r{k}", r) for k, r in enumerate(rows)], "row_idx int, name string, aseq string")


def model(spark, rows=ROWS):
    m = B.from_alignment("fam", rows, reference="".join("x" if c in COLUMNS else "." for c in range(1, len(rows[0]) + 1)))
    m.checksum = B.checksum(table(spark, rows).select(F.lit(0).alias("msa_id"), "row_idx", "aseq")).first().checksum
    return m


def plain(parts):
    """Rows laid out one by one with the widest insert of each node."""
    m = len(parts[0][0]) - 1
    widths = [max(len(p[2][k]) for p in parts) for k in range(m + 1)]
    out = []
    for match, _, inserts, _ in parts:
        row = ""
        for k in range(m + 1):
            cut = 0 if k == 0 else len(inserts[k]) if k == m else (len(inserts[k]) + 1) // 2
            row += (match[k] if k else "") + inserts[k][:cut] + "." * (widths[k] - len(inserts[k])) + inserts[k][cut:]
        out.append(row)
    return out


def test_rows_are_laid_out_again(spark):
    found = {r.name: r.aseq for r in A.realigned(table(spark).repartition(3), COLUMNS).collect()}
    assert found == {"r0": "..ACDE.FG.HI..", "r1": "mmACDE.FGkHIw.", "r2": "..AC-EyFG.HIpp", "r3": ".a-CDEyF-.HI..", "r4": "..----.--.--..", "r5": "..ACDEyFGkHI.."}
    assert {r.name: r.aseq for r in A.realigned(table(spark, [*ROWS[:2], None]), COLUMNS).collect()}["r2"] == "..------.--."
    assert A.realigned(table(spark).limit(0), COLUMNS).collect() == []
    with pytest.raises(Exception, match="columns"):
        A.realigned(table(spark, ["AC"]), COLUMNS).collect()


def test_doctored_rows_have_no_insertion_beside_a_deletion(spark):
    rows = ["AC-kEF", "ACDkEF"]  # beside the deletion of D, k becomes its match
    assert {r.aseq for r in A.realigned(table(spark, rows), [1, 2, 3, 5, 6], doctored=True).collect()} == {"ACK.EF", "ACDkEF"}
    assert {r.aseq for r in A.realigned(table(spark, rows), [1, 2, 3, 5, 6]).collect()} == {"AC-kEF", "ACDkEF"}


def test_new_sequences_stand_beside_the_alignment_a_model_came_from(spark):
    m = model(spark)
    assert m.map == COLUMNS
    seqs = [("new1", "ACDEFGHI"), ("new2", "WWWACDEYYYYFGHIW"), ("new3", ""), ("new4", None), ("new5", "ACDEFGKKKHI")]
    new = spark.createDataFrame(seqs, "name string, seq string")
    rows = A.with_alignment(new, m, table(spark).repartition(2)).collect()
    found = {r.name: (r.aseq, r.pp) for r in rows}
    parts = [A.row_parts(r, COLUMNS) for r in ROWS] + [B.aligned_parts(m, s or "") for _, s in seqs]
    assert [found[n][0] for n in [*(f"r{k}" for k in range(6)), *(n for n, _ in seqs)]] == plain(parts)
    assert len({len(a) for a, _ in found.values()} | {len(p) for _, p in found.values()}) == 1
    for k, row in enumerate(ROWS):  # residues and their order stay, and those of nodes stay together
        assert found[f"r{k}"][0].replace(".", "").replace("-", "").upper() == row.replace(".", "").replace("-", "").upper() and set(found[f"r{k}"][1]) == {"."}
    at = [i for i, c in enumerate(found["new1"][0]) if c.isupper() or c == "-"]
    assert all("".join(found[f"r{k}"][0][i] for i in at) == "".join(row[c - 1] if row[c - 1].isalpha() else "-" for c in COLUMNS).upper() for k, row in enumerate(ROWS))


def test_another_alignment_is_refused(spark):
    m, new = model(spark), spark.createDataFrame([("a", "AC")], "name string, seq string")
    with pytest.raises(ValueError, match="not those"):
        A.with_alignment(new, m, table(spark, [*ROWS[:5], ROWS[0]]))
    with pytest.raises(ValueError, match="not those"):
        A.with_alignment(new, m, table(spark).limit(0))
    m.map = None
    with pytest.raises(ValueError, match="no map"):
        A.with_alignment(new, m, table(spark))


def test_posterior_codes(spark):
    df = spark.createDataFrame([(c,) for c in "0123456789*."], "c string").select("c", A.decoded_posterior(F.col("c")).alias("p"))
    found = {r.c: r.p for r in df.collect()}
    assert found == {"0": 0.01, "*": 1.0, ".": 0.0} | {str(k): k / 10 for k in range(1, 10)}
    aligned = spark.createDataFrame([("a", "AC-d", "9*.0"), ("b", "A-.d", "7..5"), ("c", "--..", "....")], "name string, aseq string, pp string")
    line = {r.apos: (r.posterior, r.code) for r in A.posterior_line(aligned).collect()}
    assert {k: (None if p is None else round(p, 6), c) for k, (p, c) in line.items()} == {1: (0.8, "8"), 2: (1.0, "*"), 3: (None, "."), 4: (0.255, "3")}


def test_residues_have_posterior_entropy_and_score(spark):
    m = P.single_sequence("w", "ACDEFGHIKL")
    seqs = [("a", "MMACDEFGWWHIKLMM"), ("b", "ACXEF"), ("c", ""), ("d", None)]
    rows = A.residue_statistics(spark.createDataFrame(seqs, "name string, seq string"), m).collect()
    p, f = P.configure(m, multihit=False), m.bg
    for name, seq in seqs[:2]:
        codes = digitize(seq)
        _, path = K.optimal_accuracy(p, K.decoded(p, [codes], full=True)[0])
        own = sorted((r for r in rows if r.name == name), key=lambda r: r.pos)
        assert [(r.pos, r.node, r.matched) for r in own] == [(i, k, s == "M") for s, k, i, _ in path if s in "MI"]
        for r in own:
            if r.matched:
                assert np.isclose(r.relent, sum(q * np.log2(q / b) for q, b in zip(m.mat[r.node], f, strict=True)))
                if codes[r.pos - 1] < 20:
                    assert np.isclose(r.bits, np.log2(m.mat[r.node, codes[r.pos - 1]] / f[codes[r.pos - 1]]))
            else:
                assert r.relent is None and r.bits is None
    assert {r.name for r in rows} == {"a", "b"} and all(0 <= r.posterior <= 1 + 1e-9 for r in rows)
