"""Spark sessions of this library."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one ``spark.checkpoint.dir`` names.

    Only where that is unset and all runs on one machine, as in tests, a folder of
    our own is taken; on a cluster an unset folder is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + os.path.join(tempfile.gettempdir(), "glosswright-checkpoints")
    spark.sparkContext.setCheckpointDir(own)
    return own


def workers_find_package(spark: SparkSession) -> None:
    """Lets Python workers import this package where it isn't installed."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    parts = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, parts)])


def local_session(cpus: int = 8, memory: str = "8g", partitions: int = 16) -> SparkSession:
    """A session on one machine, for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("glosswright")
        .config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
