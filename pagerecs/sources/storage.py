"""Shared scratch space for materialized intermediate tables.

Intermediate tables are written as Parquet under the folder the cluster
names in ``spark.checkpoint.dir`` (shared storage, survives executor loss,
cuts lineage). An unset folder is an error; local runs and tests set their own.
"""

from __future__ import annotations

import hashlib
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCK = threading.Lock()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names; an error if it names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        raise RuntimeError(
            "spark.checkpoint.dir is not set: point it at a shared folder (HDFS, object store) for intermediate tables"
        )
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused folder under the scratch root."""
    return f"{scratch_root(spark)}/pagerecs/{name}-{uuid.uuid4().hex[:12]}"


_MATERIALIZED: dict[tuple[str, str], str] = {}


def _read_marker(spark: SparkSession, marker: str) -> str | None:
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(marker).collect()
    except AnalysisException:
        return None
    return rows[0].value if rows else None


def _write_marker(spark: SparkSession, marker: str, path: str) -> None:
    from pyspark.errors import AnalysisException
    from pyspark.sql import functions as F

    try:
        spark.range(0, 1, 1, 1).select(F.lit(path).alias("value")).write.mode("errorifexists").text(marker)
    except AnalysisException as error:
        if error.getCondition() != "PATH_ALREADY_EXISTS":  # else another process wrote it; its build is as good
            raise


def materialize_once(spark: SparkSession, key: str, build, fingerprint: str = "") -> str:
    """Path of a table built by ``build(path)``, reused while ``key`` and
    ``fingerprint`` are unchanged.

    Every build goes to a fresh folder; only after it completes is a small
    marker written next to it naming that folder. Later calls -- in this
    process or another one sharing the scratch root -- read the marker and
    reuse the table. A crashed or concurrent build never leaves a marker to a
    half-written folder. ``fingerprint`` should change whenever the built
    content would (code version, input files).
    """
    root = scratch_root(spark)
    cache_key = (root, key + "|" + fingerprint)
    with _LOCK:
        path = _MATERIALIZED.get(cache_key)
    if path is not None:
        return path
    digest = hashlib.sha1(cache_key[1].encode()).hexdigest()
    marker = f"{root}/pagerecs/ready-{digest}"
    path = _read_marker(spark, marker)
    if path is None:
        path = fresh_path(spark, f"derived-{digest[:10]}")
        build(path)
        _write_marker(spark, marker, path)
    with _LOCK:
        _MATERIALIZED.setdefault(cache_key, path)
        return _MATERIALIZED[cache_key]


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (never a local checkpoint)."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)
