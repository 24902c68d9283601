"""The pipeline's stages on a small table, each decision checked by itself."""

import corpus_pipeline as p
from helpers import lowered
from test_texts import KEY

from seqloom.llm import catalog

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra int"


def table(spark):
    base = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    texts = [base + f" tail{chr(97 + i)}" for i in range(4)] + [f"the thing {chr(97 + i)} only other " * 3 + chr(97 + i) * 5 for i in range(20)]
    rows = [(i, t, "en", f"s{i % 3}", len(t), 1) for i, t in enumerate(texts)]
    rows += [(100, None, "en", "s1", None, 1), (101, "12 34", None, None, 5, 1), (102, f"the only password={KEY} thing", "en", "s1", 0, None), (None, "the thing only", "en", "s2", 1, 1), rows[5]]
    return spark.createDataFrame(rows, SCHEMA)


def test_stages_do_what_they_say(spark):
    docs = table(spark)
    kept = p.identify(spark, docs, "")
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()}
    assert gone == {100, 101}
    one = p.dedup(spark, kept, "")
    ids = [r.doc_id for r in one.collect()]
    assert len(ids) == len(set(ids))
    assert {0} == {i for i in ids if i is not None and i < 4}
    assert None in ids and set(range(4, 24)) <= set(ids)
    clean = p.redact(spark, one, "")
    masked = {r.doc_id: r for r in clean.collect()}
    assert masked[102].text == "the only [SECRET] thing"
    assert masked[102].n_chars == len(masked[102].text)
    assert len(masked) == len(ids)
    mixed = p.blend(spark, clean, "")
    assert mixed.columns == docs.columns
    size = lambda rows: sum(len(lowered(r.text)) for r in rows)
    assert abs(size(mixed.collect()) - size(clean.collect())) < 0.2 * size(clean.collect())
    coded = p.encode(spark, mixed, "")
    assert coded.count() == mixed.count()
    assert coded.where("n_tokens = 0").count() == 0


def test_documents_that_share_an_id_stay_apart(spark):
    near = " ".join(f"w{i}" for i in range(50))
    rows = [(7, "one text of its own", 1), (7, "another text, not like it at all", 2), (7, near, 3), (3, near + " end", 4), (None, "a text without an id", 5), (None, near, 6), (8, "one text of its own", 7), (7, "one text of its own", 8)]
    out = p.dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string, key int"), "")
    got = sorted((str(r.doc_id), r.text) for r in out.collect())
    assert got == sorted([("7", rows[0][1]), ("7", rows[1][1]), ("3", near + " end"), ("None", rows[4][1])])


def test_dedup_keeps_what_brute_force_keeps(spark):
    """Near copies by brute force over sets of shingles, on what the first stage keeps."""
    docs = table(spark)
    kept = p.identify(spark, docs, "").collect()
    sets = []
    for r in kept:
        w = lowered(r.text)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    rank = lambda r: (r.doc_id is None, r.doc_id or 0)
    label = list(range(len(kept)))
    for _ in kept:
        for i in range(len(kept)):
            for j in range(len(kept)):
                if len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    first = {g: min((r for r, x in zip(kept, label, strict=True) if x == g), key=rank) for g in set(label)}
    got = p.dedup(spark, spark.createDataFrame(kept, docs.schema), "").collect()
    assert sorted(map(str, got)) == sorted(map(str, first.values()))


def test_names_and_order():
    assert [f.__name__ for _, f in p.STAGES] == ["identify", "dedup", "redact", "blend", "encode"]
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in catalog.queries() if k != "pipeline"}
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_an_empty_table_passes_through(spark):
    docs = table(spark).where("false")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
