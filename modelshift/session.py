"""Session settings and the shared folder used for lineage cuts and sinks."""

from __future__ import annotations

import os
import tempfile
import uuid

from collections.abc import Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrameWriter, SparkSession


def local_session(cpus: str = "*", app: str = "modelshift") -> SparkSession:
    """A session for tests and the bench, with a folder of its own for stored tables.

    On a cluster use the session you are given, whose ``spark.checkpoint.dir`` is shared.
    """
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="modelshift-"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where it is unset, a session whose executors are threads of the driver gets one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="modelshift-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh, unused path below the shared folder."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`new_folder` that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """SQL settings for the jobs that run within, put back afterwards.

    They hold for the whole session, so other jobs that run meanwhile may be cut alike.
    """
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def write_all(
    spark: SparkSession, writers: Mapping[str, DataFrameWriter], folder: str, at_once: int = 4
) -> None:
    """Save several frames below ``folder``, a few jobs at a time.

    Independent jobs share the cluster, so a small one does not wait for a large one's tail.
    """
    with ThreadPoolExecutor(at_once) as pool:
        jobs = [
            pool.submit(inheritable_thread_target(spark)(w.save), f"{folder}/{name}")
            for name, w in writers.items()
        ]
        for job in jobs:
            job.result()
