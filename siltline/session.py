"""Session set-up and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", memory: str = "8g", name: str = "siltline") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; only where that is unset (tests), a local one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = folder or os.path.join(tempfile.gettempdir(), "siltline-checkpoints")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise df once in the shared folder, so that several consumers don't recompute it and lost executors don't lose it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hash_below(order: Column, share: float) -> Column:
    """Whether a 64-bit hash lies in the lowest part of its range: any share, however small, keeps its part of the rows."""
    return order <= F.lit(min(2**63 - 1, int(-(2**63) + max(0.0, share) * 2**64)))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
