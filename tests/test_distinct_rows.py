"""Models of alignments whose equal rows are taken once, against all rows taken one by one."""

from seqloom.operators import build as B

ROWS = ["ACDE", "ACDE", "ACDE", "AC-F", "G--F", "G--F", "----"]


def test_equal_rows_of_an_alignment_are_taken_once(spark):
    msa = spark.createDataFrame([(m, i, r) for m in (1, 2) for i, r in enumerate(ROWS)], "msa_id int, row_idx int, aseq string")
    distinct = B.distinct_rows(msa)
    assert distinct.count() == 8

    def numbers(rows):
        cell = B.cells(rows)
        weights = B.position_weights(cell)
        columns = B.consensus_columns(cell, weights)
        out = [columns.drop("is_match"), B.emission_counts(cell, weights, columns), B.transition_counts(B.states(cell, columns), weights)]
        return [sorted((tuple(r)[:-1] if len(r) == 4 and not isinstance(r[2], float) else (r[0], r[1], r[3]), round(r["count" if "count" in r.asDict() else "occupied"], 9)) for r in df.collect()) for df in out]

    assert numbers(distinct) == numbers(msa)


def test_weights_are_not_sent_to_the_driver(spark):
    """Weights have a row per row of an alignment: joins with them broadcast nothing, however small they look."""
    msa = spark.createDataFrame([(1, i, r) for i, r in enumerate(ROWS)], "msa_id int, row_idx int, aseq string")
    cell = B.cells(msa)
    weights = spark.createDataFrame([(1, i, 1.0) for i in range(len(ROWS))], "msa_id int, row_idx int, weight double")
    for df in (B.consensus_columns(cell, weights), B.transition_counts(spark.createDataFrame([(1, 0, 1, 1, "M")], "msa_id int, row_idx int, apos int, k int, state string"), weights)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
