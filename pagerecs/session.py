"""Local session for tests and benchmarks. Library code never creates a
session; it takes the caller's."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "pagerecs") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PAGERECS_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_PREPARED: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Readies a session for the registered queries, once per application.

    Ships this package to the executors. A session in one process that names
    no ``spark.checkpoint.dir`` (local runs and tests) gets a temporary folder
    as its checkpoint folder; a cluster must name a shared one, else the first
    intermediate table is an error.
    """
    context = spark.sparkContext
    if context.applicationId not in _PREPARED:
        home = tempfile.mkdtemp(prefix="pagerecs-")
        package = os.path.dirname(os.path.abspath(__file__))
        context.addPyFile(shutil.make_archive(f"{home}/pagerecs", "zip", os.path.dirname(package), "pagerecs"))
        one_process = context.master == "local" or context.master.startswith("local[")
        if one_process and not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
            context.setCheckpointDir(f"file://{home}/checkpoints")
        _PREPARED[context.applicationId] = home
    return spark
