"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("costbook")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a temporary one only on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def settle(df: DataFrame) -> DataFrame:
    """The frame written once to the shared folder, for frames that several branches of a plan read."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shuffled(df: DataFrame) -> DataFrame:
    """The frame as a side of a join that is never broadcast, for tables that grow with the data.

    Spark guesses a side's size from its packed files and counts an exploded row once, so a table of millions of rows can pass for a small one.
    """
    return df.hint("merge")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table written between two jobs."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{os.urandom(6).hex()}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written once as Parquet below the shared folder, for wide rows that several branches filter: packed, and no filter works its columns out again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
