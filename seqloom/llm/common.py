"""What the training-data operators share: tokens, shared-folder tables and Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Entries that a worker's cache of words may hold before it is emptied.
CACHE_LIMIT = 200_000
#: Rows and bytes of a batch between the JVM and Python, whichever comes first: texts and sets are long, and both sides hold batches at once.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Tables of the innermost scratch() block.
_SCRATCH: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    spark.checkpoint.dir where the cluster names one, or the checkpoint folder that was set before. A
    master that runs in this process alone (tests) gets a temporary folder; any other is refused, as
    executors would write to folders that nobody else sees.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    have = spark.sparkContext.getCheckpointDir()
    if have is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        own = tempfile.mkdtemp(prefix="seqloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
        have = spark.sparkContext.getCheckpointDir()
    return have.rstrip("/")


def prepare(spark: SparkSession) -> None:
    """Small batches to Python workers, for plans made from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once, with its lineage cut, for steps whose rows are narrow.

    A written table rather than checkpoint(): that keeps the constraints of the plan it replaces, which
    grow beyond all bounds over the rounds of a loop.
    """
    return stored(df, "step", "snappy")


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written as Parquet to the shared folder and read back; columns can then be read alone.

    Within scratch(), the table lasts until the end of that block.
    """
    spark = df.sparkSession
    prepare(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    if (tables := _SCRATCH.get()) is not None:
        tables.append(path)
    return out


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """df written to the shared folder in as many buckets of key as shuffles have partitions, and read back.

    What is grouped or joined by key later stays where it is; only the other side is shuffled to it. The name that
    the catalog has for it is given up at once: the files are the table, and scratch() deletes them.
    """
    spark = df.sparkSession
    prepare(spark)
    table = f"seqloom_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "none").option("path", path).bucketBy(count, key).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    out.table_path = path
    if (tables := _SCRATCH.get()) is not None:
        tables.append(path)
    return out


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def released(spark: SparkSession) -> None:
    """Both sides of the driver collect their garbage: shuffle files, broadcasts and generated classes that nothing refers to go now."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that stored() and checkpointed() write within the block are deleted at its end.

    What the block yields is a function that keeps a table, and hands it to the block around, if any. At the end of an
    outermost block both sides of the driver collect their garbage, so that shuffle files, broadcasts and generated
    classes of the steps go now and not at some later time.
    """
    mine: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.table_path)
        return df

    token = _SCRATCH.set(mine)
    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        outer = _SCRATCH.get()
        if outer is not None:
            outer.extend(x for x in mine if x in kept)
        for path in mine:
            if path not in kept:
                removed(spark, path)
        if outer is None:
            released(spark)


def as_bytes(column: pa.Array) -> list:
    """The UTF-8 bytes of a string column, None where null."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def lowered_words(data: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; bytes methods know ASCII only, as is wanted."""
    return data.lower().split()
