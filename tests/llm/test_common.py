"""Tables of steps: what stays, what goes, and where they may lie."""

import os

import pytest

from seqloom.llm import common


def there(df):
    return os.path.isdir(df.table_path.removeprefix("file:"))


def test_scratch_tables_go_and_kept_ones_stay(spark):
    rows = spark.range(10)
    with common.scratch(spark) as keep:
        gone = common.checkpointed(rows)
        kept = keep(common.stored(rows, "kept"))
        with common.scratch(spark) as inner:
            inside = common.checkpointed(rows)
            handed = inner(common.bucketed(rows, "handed", "id"))
        assert not there(inside) and there(handed) and there(gone)
        twice = keep(handed)
    assert not there(gone) and there(kept) and there(twice)
    assert kept.count() == twice.count() == 10
    with pytest.raises(RuntimeError, match="on purpose"), common.scratch(spark):
        lost = common.checkpointed(rows)
        raise RuntimeError("on purpose")
    assert not there(lost)


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="share"):
        common.shared_dir(Session())


def test_buckets_spare_the_stored_side_a_shuffle(spark):
    rows = spark.range(100).withColumnRenamed("id", "chunk")
    left = common.bucketed(rows, "left", "chunk")
    plan = left.groupBy("chunk").cogroup(rows.groupBy("chunk")).applyInPandas(lambda a, b: a, "chunk bigint")
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert plan.count() == 100
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("seqloom_left")]
