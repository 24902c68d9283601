"""Counters of a long-target search need its filters alone."""

import numpy as np
import pytest

from seqloom.functions.alphabet import digitize
from seqloom.operators import longtarget as L
from seqloom.operators import profile as P
from seqloom.operators import search as R


def test_counters_decode_no_window(spark, monkeypatch):
    rng = np.random.default_rng(8)
    dna = lambda n: "".join(rng.choice(list("ACGT"), n))
    m = P.single_sequence("w", dna(30), popen=0.03, pextend=0.75, alphabet="dna")
    m.max_length = 50
    m = R.calibrated(m)
    seqs = [dna(300) + m.consensus.upper() + dna(200), dna(400), "ACG"]
    codes = [digitize(s, "dna") for s in seqs]
    (want, hits), = L.found_in([L.Scanner(m)], seqs, codes, L.Config())
    assert hits and want[3]
    df = spark.createDataFrame([(k, f"s{k}", s) for k, s in enumerate(seqs)], "seq_id bigint, name string, seq string")
    raw = {r.kind for r in L.raw(df, [m], L.Config()).collect()}
    assert raw == {"count", "hit"} and {r.kind for r in L.raw(df, [m], L.Config(), hits=False).collect()} == {"count"}
    row = L.counters(df, [m]).first()
    both = L.raw(df, [m], L.Config()).where("kind = 'count'").groupBy("model").sum("n", "past_msv", "past_bias", "past_vit", "past_fwd").first()
    assert tuple(row) == tuple(both) and row.past_fwd
    monkeypatch.setattr(R, "spans_of", lambda *a: pytest.fail("decoded"))
    assert L.found_in([L.Scanner(m)], seqs, codes, L.Config(), hits=False) == [(want, [])]
