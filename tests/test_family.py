"""Models of alignments of any number of rows, and the query that lays new sequences out beside one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import build as B
from seqloom.operators import clusters as C
from seqloom.plans import tools

ROWS = ["--ACDE-FG-HI..", "mmACDE-FGkHI-w", "--AC-EyFG-HIpp", "a-.CDEyF--HI--", "--------------", "--ACDEyFGkHI-.", "-----EyF------"]
REFERENCE = "..xxxx.xx.xx.."


@pytest.mark.parametrize("rows", [ROWS, ["-" * 14] * 2])
def test_a_model_of_a_table_is_that_of_its_rows(spark, rows):
    copies = np.array([2, 1, 5, 3, 1, 1, 4][: len(rows)])
    want = B.from_alignment("fam", rows, reference=REFERENCE, copies=copies)
    table = spark.createDataFrame(list(zip(rows, copies.tolist(), strict=True)), "aseq string, n int").repartition(3)
    got = B.from_table("fam", table, REFERENCE)
    assert np.allclose(got.mat, want.mat) and np.allclose(got.t, want.t) and got.map == want.map
    assert (got.consensus, got.nseq, round(got.eff_nseq, 9)) == (want.consensus, want.nseq, round(want.eff_nseq, 9))


def test_the_checksum_of_rows_read_in_order(spark):
    rows = spark.createDataFrame([(k, r) for k, r in enumerate([*ROWS, None, "é"])], "row_idx int, aseq string").repartition(3)
    assert B.chained_checksum(rows) == B.checksum(rows.withColumn("msa_id", F.lit(0))).first().checksum
    assert B.chained_checksum(rows.limit(0)) is None


def test_rows_are_numbered_in_order(spark):
    found = C.numbered(spark.range(1000).select((-F.col("id")).alias("k")), ["k"], "at").collect()
    assert sorted((r["at"], r.k) for r in found) == [(i, i - 999) for i in range(1000)]


def test_every_part_name_is_a_row_of_the_family(spark, tmp_path):
    """Beyond 200 different names too."""
    names = [f"{a}{b}c deF {c}hik" for a in "acdefghi" for b in "klmnpqrs" for c in "tvwy"]
    spark.createDataFrame([(k, n) for k, n in enumerate([*names, *names[:9], None])], "p_partkey bigint, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1, "machinery"), (2, None)], "c_custkey bigint, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    found = {r.name: r.aseq for r in tools.mapped_alignment(spark, str(tmp_path)).collect()}
    letters = sorted("".join(c for c in v if c.isalpha()).upper() for k, v in found.items() if k.startswith("row"))
    assert letters == sorted(["", *(n.replace(" ", "").upper() for n in names)])
    assert {k for k in found if k.startswith("row")} == {f"row{k}" for k in range(len(names) + 1)} and len(found) == len(names) + 3
    assert len({len(v) for v in found.values()}) == 1
    assert {"".join(c for c in found[f"row{k}"] if c.isalpha()).upper() for k in range(9)} == {n.replace(" ", "").upper() for n in names[:9]}
