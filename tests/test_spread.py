"""Work is dealt over the cores, whatever the size or the files of its input."""

from pyspark.sql import functions as F

from seqloom.operators import fmseeds as S
from seqloom.operators import search as R


def test_blocks_of_a_small_index_are_searched_by_several_tasks(spark):
    rows = [(k, "ACGTTGCAAGGCTTACCGAT"[k % 17 :] * 40) for k in range(12)]
    index = S.build(spark.createDataFrame(rows, "target bigint, seq string"), overlap=20, block=512)
    found = index.select("block", F.spark_partition_id().alias("task")).collect()
    assert len({r.block for r in found}) == len(found) > 4
    assert len({r.task for r in found}) > 2


def test_rows_of_one_split_are_dealt_over_tasks(spark, tmp_path):
    """A file of many splits may have all its rows in one of them."""
    rows = [(k, f"s{k}", "ACDEFGHIKLMNPQRSTVWY"[k % 19 :] * (k % 7 + 1) + str(k * 7919)) for k in range(2000)]
    spark.createDataFrame(rows, "seq_id bigint, name string, seq string").coalesce(1).write.parquet(str(tmp_path / "t"))
    kept = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in kept:
            spark.conf.set(c, "1024")
        df = spark.read.parquet(str(tmp_path / "t"))
        tasks = lambda some: [r["count"] for r in some.groupBy(F.spark_partition_id()).count().collect()]
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and len(tasks(df)) == 1
        found = tasks(R.balanced(df))
    finally:
        for c, value in kept.items():
            spark.conf.set(c, value)
    assert sum(found) == 2000 and len(found) >= spark.sparkContext.defaultParallelism
