"""Reports for people: fixed-width lines of targets, domains and alignments, table footers, widths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def printed(x: Column, pattern: str) -> Column:
    """A number as C's printf shows it: the value that the 64 bits have is rounded, a half to the even digit."""

    @F.pandas_udf("string")
    def show(v: pd.Series) -> pd.Series:
        return pd.Series([pattern % n for n in v], dtype=object)

    return F.when(x.isNotNull(), show(x.cast("double")))


def two_digits(x: Column) -> Column:
    """A number with two significant digits, as C's %.2g prints it."""
    return printed(x, "%.2g")


def one_digit(x: Column) -> Column:
    """A number with one digit behind the point, as C's %.1f prints it."""
    return printed(x, "%.1f")


def target_lines(hits: DataFrame) -> DataFrame:
    """(rank, line) of hits(rank, evalue, score, bias, exp, n, name, descr): E-value, score, bias, domains expected and found, name, description."""
    line = F.concat_ws("", F.lpad(two_digits(F.col("evalue")), 9, " "), F.lit(" "), F.lpad(one_digit(F.col("score")), 6, " "), F.lit(" "), F.lpad(one_digit(F.col("bias")), 5, " "), F.lit("  "),
                       F.lpad(one_digit(F.col("exp")), 5, " "), F.lit(" "), F.lpad(F.col("n").cast("string"), 2, " "), F.lit("  "), F.rpad("name", 18, " "), F.lit(" "), F.coalesce("descr", F.lit("")))
    return hits.select("rank", F.rtrim(line).alias("line"))


def alignment_blocks(domains: DataFrame, width: int = 60) -> DataFrame:
    """(key, block, model_line, match_line, target_line, pp_line): aligned lines of domains(key, hmm_line, ali_line, pp_line) in pieces of a width.

    The middle line has the model's letter where the target's is equal, a + where it resembles it no worse than chance as the
    model line's case says (upper case: conserved), and a space elsewhere.
    """
    n = F.length("hmm_line")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / width).cast("int") - 1))
    cut = domains.withColumn("block", F.explode(starts))
    part = lambda c: F.substring(F.col(c), F.col("block") * width + 1, F.lit(width))
    same = F.array_join(F.zip_with(F.split(part("hmm_line"), ""), F.split(part("ali_line"), ""), lambda a, b: F.when(F.upper(a) == F.upper(b), a).otherwise(F.lit(" "))), "")
    return cut.select("key", "block", part("hmm_line").alias("model_line"), same.alias("match_line"), part("ali_line").alias("target_line"), part("pp_line").alias("pp_line"))


def footer(program: str, version: str, mode: str, query: str, target: str, options: str) -> list[str]:
    """The lines that end a table; the date is left out, so that equal runs give equal tables."""
    return ["#", f"# Program:         {program}", f"# Version:         {version}", f"# Pipeline mode:   {mode.upper()}", f"# Query file:      {query}", f"# Target file:     {target}", f"# Option settings: {options}", "# [ok]"]


def widths(hits: DataFrame, *columns: str) -> DataFrame:
    """One row: the greatest length of each column's values, 0 without rows."""
    return hits.agg(*[F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)).alias(c) for c in columns])
