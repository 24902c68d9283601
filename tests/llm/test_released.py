"""The disk of op7: the sieve's shuffle is let go before that of the words is written."""

from seqloom.llm import substrings


def test_the_sieves_shuffle_goes_before_the_words_are_sent(spark, monkeypatch):
    seen = []
    for name in ("checkpointed", "released"):
        real = getattr(substrings, name)
        monkeypatch.setattr(substrings, name, lambda *a, name=name, real=real: (seen.append(name), real(*a))[1])
    words = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, words), (2, words)], "doc_id bigint, text string")
    rows = {r.doc_id: len(r.repeats) for r in substrings.deduplicated(df).collect()}
    assert rows == {1: 0, 2: 1} and seen[:3] == ["checkpointed", "released", "checkpointed"]
