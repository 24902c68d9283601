"""Streams give what batches give, however targets and requests are cut."""

import random
import re

import pytest

from seqloom.operators import profile as P
from seqloom.operators import search as R
from seqloom.streaming import targets as T


def run(spark, tmp_path, batches, make, name):
    """The rows of make(stream) over batches of (target, number, part), one file and micro-batch each."""
    folder = tmp_path / f"in-{name}"
    schema = "target string, number bigint, part string"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = tmp_path / f"out-{name}"
    query = make(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / f"check-{name}")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.read.schema(make(stream).schema).parquet(str(out))


@pytest.mark.parametrize("size", [3, 40])
def test_matches_across_pieces_are_found_once(spark, tmp_path, size):
    rng = random.Random(size)
    seqs = {f"t{k}": "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 90))) for k in range(4)}
    patterns = ["ACG", "A", "GGTA", "TT"]
    rows = []
    for t, s in seqs.items():
        at, n = 0, 0
        while at < len(s):
            step = rng.randint(0, size)
            rows.append((t, n, s[at : at + step] or (None if n % 2 else "")))
            at, n = at + step, n + 1
    rng.shuffle(rows)
    rows += [rows[0], (None, 0, "ACG"), ("t1", None, "ACG")]
    batches = [rows[k::3] for k in range(3)]
    found = run(spark, tmp_path, batches, lambda s: T.matches(T.continued(s, 3), patterns), f"m{size}").collect()
    expected = sorted((t, p, m.start() + 1) for t, s in seqs.items() for p in patterns for m in re.finditer(f"(?={p})", s))
    assert sorted(map(tuple, found)) == expected and len(expected) > 20
    pieces = run(spark, tmp_path, batches, lambda s: T.continued(s, 3), f"p{size}")
    assert {r.target: r.n for r in T.residues(pieces).collect()} == {t: len(s) for t, s in seqs.items() if s}
    for r in pieces.collect():
        assert seqs[r.target][r.start - 1 : r.start - 1 + len(r.piece)] == r.piece and r.context <= 3


WORDS = ["ACDEFGHIKLMNPQRS", "MKVLAAGWWHHPPQRSTV", "TTTTTTSSSSGGGGPPPP"]


def test_requests_are_answered_as_a_batch_is(spark, tmp_path):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))
    rows = [(k, f"s{k}", noise(60) + (WORDS[k % 3] if k % 2 else "") + noise(50)) for k in range(12)]
    collection = spark.createDataFrame(rows, "seq_id bigint, name string, seq string").cache()
    asked = [("a", f"@-E 5\n>a x\n{WORDS[0]}\n//"), ("b", f"@-E 1e-30\n>b\n{WORDS[1].lower()}\n//"), ("c", "nothing"), ("d", None)]
    folder = tmp_path / "asked"
    for r in asked:
        spark.createDataFrame([r], "request string, text string").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema("request string, text string").option("maxFilesPerTrigger", 1).parquet(str(folder))
    T.served(stream, collection, str(tmp_path / "answers"), str(tmp_path / "check"), once=True).awaitTermination(300)
    found = spark.read.parquet(str(tmp_path / "answers")).collect()
    assert {r.request: r.problem for r in found if r.problem} == {"c": "no options", "d": "no text"}
    hits, _ = R.search(collection, [P.single_sequence("a", WORDS[0])], R.Config(e=5))
    expected = sorted((r.seq_id, round(r.evalue, 6), r["rank"]) for r in R.ranked(hits).collect())
    assert sorted((r.seq_id, round(r.evalue, 6), r["rank"]) for r in found if r.request == "a") == expected and expected
    assert not [r for r in found if r.request == "b"]
    assert {r.batch for r in found} <= set(range(4))
