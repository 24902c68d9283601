"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def importable_on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started from."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":") if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = ":".join([ROOT, *parts])


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, where driver and executors leave files for one another.

    Where none is named, a master that runs in this process alone gets a temporary one, any other is refused.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        named, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if named is None:
            if master != "local" and not master.startswith("local["):
                raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
            named = tempfile.mkdtemp(prefix="seqloom-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; a lost executor costs its own tasks alone."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def local_session(cpus: int = 8, app: str = "seqloom", memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
