"""A training-data pipeline over `documents`: language ID, near-dedup, secrets, mixing, token ids.

Each stage works on all that its predecessor kept. Null texts have no language and go in the first stage; rows
with a null id are documents like others. Extra columns of documents pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import langid, mixing, neardup, pieces, secrets
from seqloom.llm.common import prepare, stored
from seqloom.session import importable_on_workers


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that speak for one of the languages learned from the labelled ones; others go."""
    importable_on_workers(spark)
    prepare(spark)
    return langid.keep_identified(docs, langid.fit(docs, F.lit(True)))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8: the one of the smallest id.

    Rows are told apart by a hash of id and text, as ids may repeat: rows that repeat both are one document, rows of
    one id and other texts are compared like any others. A null id comes after all others. Of documents of a
    group with equal ids, the one of the smallest hash stays.
    """
    importable_on_workers(spark)
    prepare(spark)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.lit("document"), "doc_id", "text").alias("key"))
    groups = neardup.classes(row.select("key", F.col("row.text").alias("text")), width=5, percent=80, id_col="key").select("key", F.col("component_id").alias("group")).distinct()
    ids = row.select("key", F.col("row.doc_id").alias("id")).distinct().join(groups, "key")
    first = ids.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("x")).select("x.key")
    return row.join(first, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts masked and n_chars counted anew."""
    importable_on_workers(spark)
    prepare(spark)
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def blend(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those it takes zero times go."""
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token ids of every document that is left."""
    importable_on_workers(spark)
    prepare(spark)
    return pieces.tokenized(docs).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("language_id", identify),
    ("minhash_near_dedup", dedup),
    ("secret_scan", redact),
    ("source_mixing", blend),
    ("sentencepiece", encode),
]

#: The stages learn a model, follow links and solve for rates: SQL can't say that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name, "snappy")
    return docs
