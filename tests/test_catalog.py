"""Every query with SQL gives what DuckDB gives, on the smallest tables; the streaming front end agrees with batch."""

import os
from pathlib import Path

import pytest

from seqloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(catalog.SQL[name])
    names, rows = want.columns, want.fetchall()
    got = catalog.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, rows))


@pytest.mark.parametrize("name", sorted(catalog.queries().keys() - catalog.oracle_sql().keys()))
def test_query_without_sql_runs(spark, name):
    found = catalog.QUERIES[name](spark, DATA)
    assert len(found.columns) > 0 and found.count() >= 0


def test_every_query_has_a_plan(spark):
    assert catalog.flagship(spark, DATA).count() > 0
    assert set(catalog.SQL) <= set(catalog.QUERIES)


def test_long_targets_have_envelopes_in_order(spark):
    """Regions whose frequent starts and ends cross, or that have none, as pages at sf0.01 do."""
    if os.path.isdir("/root/testdata/sf0.01"):
        for r in catalog.queries()["long_target_search"](spark, "/root/testdata/sf0.01").collect():
            assert (r.ali_from <= r.ali_to) == (r.strand == "+")


def test_passages_of_every_item_are_found(spark):
    held = {(r.item_id, r.doc_id) for r in catalog.cross_search(spark, DATA).collect()}
    found = {(r.item_id, r.seq_id): r["rank"] for r in catalog.passage_search(spark, DATA).collect()}
    assert len({i for i, _ in held}) > 1 and held <= found.keys()
    assert {i for (i, _), rank in found.items() if rank == 1} == {i for i, _ in found}


def test_nothing_outside_llm_imports_it():
    root = Path(catalog.__file__).resolve().parent.parent
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text().replace("seqloom.llm", "llm") or path.name == "__spark_entry__.py", path


def test_stream_hits_equal_batch_hits(spark, tmp_path):
    from seqloom.operators import profile as P
    from seqloom.streaming import search as stream

    rows = [(1, "a", "MKVLWCHMKWYFHCDERTGPWWAAA"), (2, "b", "AAAAAAAAAA"), (3, "c", None)]
    schema = "seq_id bigint, name string, seq string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    model = P.single_sequence("q", "WCHMKWYFHCDERTGPWW")
    batch = stream.hits(spark.read.parquet(str(tmp_path / "in")), [model], 100.0)
    live = stream.hits(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), [model], 100.0)
    live.writeStream.format("memory").queryName("live_hits").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.seq_id, round(r.score, 6)) for r in spark.table("live_hits").collect())
    assert got == sorted((r.seq_id, round(r.score, 6)) for r in batch.collect()) and got


def test_windowed_counts_of_a_stream(spark):
    from seqloom.streaming import search as stream

    events = spark.readStream.schema(spark.read.parquet(f"{DATA}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(DATA)
    out = stream.windowed_counts(events, "ts", "event_type")
    out.writeStream.format("memory").outputMode("complete").queryName("live_counts").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("live_counts").selectExpr("sum(n) AS n").first().n == spark.read.parquet(f"{DATA}/events.parquet").count()
