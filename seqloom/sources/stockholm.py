"""Stockholm and aligned-FASTA alignments as rows, in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_stockholm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, annotation) of all alignments: rows(msa_id, msa_name, row_idx, name, aseq), blocks joined;
    annotation(msa_id, kind, tag, name, value) with kind GF, GC, GR or GS, repeated lines joined."""
    text = spark.read.option("lineSep", "//\n").text(path).where("trim(value) <> ''")
    text = text.withColumn("msa_id", F.xxhash64("value"))
    line = text.select("msa_id", F.posexplode(F.split("value", "\r?\n")).alias("at", "line")).where("line <> '' and line not like '# STOCKHOLM%'")
    seq = line.where("line not like '#%'").select("msa_id", "at", F.regexp_extract("line", r"^(\S+)", 1).alias("name"), F.regexp_extract("line", r"^\S+\s+(\S+)", 1).alias("part"))
    whole = lambda col: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", col))), lambda s: s[col]), "")
    rows = seq.groupBy("msa_id", "name").agg(F.min("at").alias("first"), whole("part").alias("aseq"))
    rows = rows.withColumn("row_idx", F.row_number().over(Window.partitionBy("msa_id").orderBy("first")))
    mark = line.where(r"line rlike '^#=G[FCRS] '").select(
        "msa_id", "at", F.substring("line", 3, 2).alias("kind"),
        F.when(F.substring("line", 3, 2).isin("GF", "GC"), F.regexp_extract("line", r"^#=G.\s+(\S+)", 1)).otherwise(F.regexp_extract("line", r"^#=G.\s+\S+\s+(\S+)", 1)).alias("tag"),
        F.when(F.substring("line", 3, 2).isin("GR", "GS"), F.regexp_extract("line", r"^#=G.\s+(\S+)", 1)).alias("name"),
        F.when(F.substring("line", 3, 2).isin("GF", "GC"), F.regexp_extract("line", r"^#=G.\s+\S+\s+(.*)$", 1)).otherwise(F.regexp_extract("line", r"^#=G.\s+\S+\s+\S+\s+(.*)$", 1)).alias("part"),
    )
    notes = mark.groupBy("msa_id", "kind", "tag", "name").agg(whole("part").alias("value"))
    names = notes.where("kind = 'GF' and tag = 'ID'").select("msa_id", F.col("value").alias("msa_name"))
    return rows.join(names, "msa_id", "left").select("msa_id", "msa_name", "row_idx", "name", "aseq"), notes


def render_stockholm(rows: DataFrame) -> DataFrame:
    """(msa_id, value): each alignment as Stockholm text; an alignment is bounded by its family."""
    line = F.concat_ws(" ", "name", "aseq")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", line.alias("line")))), lambda s: s["line"]), "\n")
    head = F.concat(F.lit("# STOCKHOLM 1.0\n"), F.coalesce(F.concat(F.lit("#=GF ID "), F.first("msa_name"), F.lit("\n")), F.lit("")))
    return rows.groupBy("msa_id").agg(F.concat(head, body, F.lit("\n//")).alias("value"))


def degapped(rows: DataFrame) -> DataFrame:
    """The sequences of an alignment's rows."""
    return rows.withColumn("seq", F.upper(F.regexp_replace("aseq", r"[-.~_]", "")))
