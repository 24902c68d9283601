"""Equal sequences are worked out once, and give each of their rows what it got alone."""

from collections import Counter

import pandas as pd

from seqloom.operators import build as B
from seqloom.operators import kernels as K
from seqloom.operators import profile as P
from seqloom.operators import search as R

SEQS = ["STEELRED", "STEELRED", "PLATED", "", "STEELRED", "STALLSTEEL"]


def test_a_batch_is_searched_once_for_equal_targets(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"t{i}", s) for i, s in enumerate([*SEQS, None])], "seq_id bigint, name string, seq string").coalesce(1)
    monkeypatch.setattr(R, "balanced", lambda df: df)
    config = R.Config(f1=1.0, f2=1.0, f3=1.0)
    models = [R.calibrated(P.single_sequence(w.lower(), w)) for w in ("STEEL", "PLATED")]
    got = R.raw_hits(df, models, config).toPandas()
    for m in models:
        found = R.cascade(m, config, list(range(7)), [f"t{i}" for i in range(7)], [*SEQS, ""])
        mine = got[got.model == m.name]
        whole = ["n", "residues", "past_msv", "past_bias", "past_vit", "past_fwd"]
        assert mine.loc[mine.kind == "count", whole].astype(int).values.tolist() == found.loc[found.kind == "count", whole].astype(int).values.tolist()
        rows = lambda x: sorted((int(r.seq_id), r["name"], int(r.len), round(r.score, 9), len(r.domains)) for _, r in x[x.kind == "hit"].iterrows())
        assert rows(mine) == rows(found) and len(rows(mine)) >= 4

    seen = []
    monkeypatch.setattr(R, "cascade", lambda m, c, ids, names, seqs, *rest: seen.append(seqs) or pd.DataFrame({"kind": [], "seq_id": []}))
    calls = []
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, f, schema: calls.append(f) or self)
    R.raw_hits(df, models[:1], config)
    list(calls[0](iter([df.toPandas()])))
    assert [Counter(s) for s in seen] == [Counter(set(SEQS))]


def test_equal_sequences_are_aligned_once(spark, monkeypatch):
    m = P.single_sequence("word", "STEEL")
    asked = []
    real = B.aligned_parts
    monkeypatch.setattr(B, "aligned_parts", lambda model, s: asked.append(s) or real(model, s))
    df = spark.createDataFrame([(f"t{i}", s) for i, s in enumerate(SEQS)], "name string, seq string")
    run = []
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, f, schema: run.append(f) or self)
    B.parts_of(df, m)
    (out,) = run[0](iter([pd.DataFrame({"name": [f"t{i}" for i in range(6)], "seq": SEQS})]))
    assert Counter(asked) == Counter(set(SEQS)) and out.match.tolist() == [real(m, s)[0] for s in SEQS]


def test_only_so_many_results_are_kept():
    asked = []
    f = K.once(lambda s: asked.append(s) or len(s))
    assert [f(s) for s in ("A", "BB", "A")] == [1, 2, 1] and asked == ["A", "BB"]
    assert f.cache_info().maxsize == K.KEPT
