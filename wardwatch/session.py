"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording the Python line of every column expression costs more than planning itself.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: int | str = "*", memory: str = "8g", shared: str | None = None) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own session and settings."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("wardwatch")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
    )
    if shared is not None:
        builder = builder.config("spark.checkpoint.dir", shared)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _temporary_folder(spark.sparkContext.applicationId)


@lru_cache(maxsize=None)
def _temporary_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"wardwatch-{application}-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return os.path.join(shared_folder(spark), "wardwatch", f"{label}-{uuid.uuid4().hex}")


def settle(df: DataFrame) -> DataFrame:
    """Write a frame that several later steps read to the shared folder and go on from there.

    A written table cuts the lineage and tells Spark its real size. (A checkpoint may carry constraints on columns it no longer has, on
    which a later union fails in Spark 4.1.)
    """
    path = scratch_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(*tasks: Callable[[], T]) -> list[T]:
    """Results of tasks that do not depend on each other, in order; their Spark jobs share the cluster.

    Fits are chains of many small jobs, and most of a chain's time is planning and waiting.
    """
    if len(tasks) < 2:
        return [task() for task in tasks]
    inherit = inheritable_thread_target(SparkSession.getActiveSession())
    with ThreadPoolExecutor(len(tasks)) as pool:
        return list(pool.map(lambda run: run(), [inherit(task) for task in tasks]))
