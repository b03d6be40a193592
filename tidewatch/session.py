"""Session defaults for local runs; a cluster brings its own session."""

from __future__ import annotations

import os
import tempfile

import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def local_session(cores: str | int | None = None, **extra: str) -> SparkSession:
    """A local session with the settings that the queries are written for."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.showConsoleProgress": "false",
        **extra,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tidewatch")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir; local runs that set none get one of their own.

    A cluster without the setting is an error, as a folder of the driver's machine would be read by no executor.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    known = sc._jsc.sc().getCheckpointDir()
    if not at and known.isDefined():
        at = known.get()
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="shared-")
    if known.isEmpty():
        sc.setCheckpointDir(at)
    return at


def qualified(spark: SparkSession, path: str) -> str:
    """A path as an address that workers open."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def opened(address: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a qualified address, and the path on it."""
    if address.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + address.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(address)
