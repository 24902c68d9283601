"""Tail P-values score each part name once, however many parts have it."""

from seqloom.plans import tools


def test_copies_of_a_name_are_scored_once(spark, tmp_path):
    names = [(k, n) for k, n in enumerate(["steel plated", "small linen", "antique tin"] * 5)]
    spark.createDataFrame(names, "p_partkey bigint, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    make = lambda p, x: [(float(len(x)),)]
    once = tools._paths(spark, str(tmp_path), make, "bits double", distinct=True)
    every = tools._paths(spark, str(tmp_path), make, "bits double")
    assert sorted(r.p_partkey for r in once.collect()) == [0, 1, 2]
    assert every.count() == 15
    assert {r.bits for r in once.collect()} == {r.bits for r in every.collect()}
