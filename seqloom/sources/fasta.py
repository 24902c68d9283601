"""FASTA in and out, through Spark's text source: any store, and large files are split between records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, descr, seq, len) of every record; letters keep their case, white space goes."""
    record = spark.read.option("lineSep", "\n>").text(path)
    record = record.select(F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "").alias("r")).where("trim(r) <> ''")
    head = F.substring_index("r", "\n", 1)
    body = F.when(F.instr("r", "\n") > 0, F.expr("substring(r, instr(r, '\n') + 1)")).otherwise("")
    seq = F.regexp_replace(body, r"\s", "")
    name = F.regexp_extract(head, r"^(\S*)", 1)
    descr = F.nullif(F.trim(F.regexp_replace(head, r"^\S*\s*", "")), F.lit(""))
    return record.select(name.alias("name"), descr.alias("descr"), seq.alias("seq"), F.length(seq).alias("len"))


def render_fasta(df: DataFrame, width: int = 60) -> DataFrame:
    """(value): each record as text, sequence lines of a fixed width."""
    head = F.concat(F.lit(">"), F.col("name"), F.coalesce(F.concat(F.lit(" "), F.col("descr")), F.lit("")))
    body = F.regexp_replace("seq", f"(.{{{width}}})(?!$)", "$1\n")
    return df.select(F.concat_ws("\n", head, body).alias("value"))


def write_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    render_fasta(df, width).write.text(path)
