"""Numbers of reports against C's printf."""

from pyspark.sql import functions as F

from seqloom.sources import report


def test_numbers_are_printed_as_c_prints_them(spark):
    """A half goes to the even digit, and what is rounded is the value that the 64 bits have."""
    values = [125.0, 135.0, 1250.0, 0.125, 1.25, 0.15, 0.25, 0.35, 2.5e-6, 0.0, -125.0, 9.95, 99.5, 1e5, float("inf"), None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double")
    got = df.select("i", report.two_digits(F.col("x")).alias("two"), report.one_digit(F.col("x")).alias("one")).orderBy("i").collect()
    for x, r in zip(values, got, strict=True):
        assert (r.two, r.one) == ((None, None) if x is None else ("%.2g" % x, "%.1f" % x))
