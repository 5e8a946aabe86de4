"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagerecs.sources.storage import fresh_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Most rows that are sent to every executor; a larger side is joined by a shuffle.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Most texts that a worker gets at once where its executor's memory is short.
BATCH_ROWS = 256


def _at_most(spark: SparkSession, rows: int) -> str:
    given = int(spark.conf.get(_BATCH_ROWS))  # no limit from 0 down
    return str(min(given, rows) if given > 0 else rows)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Python workers of this session get ``rows`` rows at once at most, from
    now on: executor and worker each hold a whole batch, on its way in and out,
    and a plan reads the setting when it runs."""
    spark.conf.set(_BATCH_ROWS, _at_most(spark, rows))


def keep(df: DataFrame, name: str, drop_shuffles: bool = False, batch_rows: int = 0) -> DataFrame:
    """Written to the shared folder and read again: lineage ends there, and
    a lost executor costs no more than the tasks it was running.

    With ``drop_shuffles`` Spark removes the write's shuffle files as it ends,
    not when the driver happens to collect what refers to them. ``batch_rows``:
    as ``small_batches``, for this write alone (0: as the session says).
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    settings = {}
    if drop_shuffles:
        settings[_DROP_SHUFFLES] = "true"
    if batch_rows:
        settings[_BATCH_ROWS] = _at_most(spark, batch_rows)
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def keep_dropping(df: DataFrame, name: str) -> DataFrame:
    """``keep`` for the many small tables of one operator, whose shuffle files would add up."""
    return keep(df, name, drop_shuffles=True)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def set_apart(df: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with all columns but the ``needed`` under names that no operator
    uses, and what gives a frame of these columns its names back."""
    names = df.columns
    apart = [n if n in needed else f"given_{i}_column" for i, n in enumerate(names)]
    return df.toDF(*apart), lambda out: out.select(*apart).toDF(*names)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column, remainder: int) -> Column:
    """crc32 of the id's decimal text modulo 5 is ``remainder``; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == remainder, F.lit(False))


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are few, else as it is."""
    return F.broadcast(df) if rows <= most else df


_DROPPED: list[Callable[[], object]] = []


def on_give_back(drop: Callable[[], object]) -> None:
    """``drop`` empties a cache that a worker keeps between tasks."""
    _DROPPED.append(drop)


def give_back(keep_caches: bool = False) -> None:
    """Returns what this worker has freed to the system, as workers are kept
    for later stages; first it drops the caches that earlier stages left.
    Tasks that follow others in a pipeline begin with it, all end with it."""
    if not keep_caches:
        for drop in _DROPPED:
            drop()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def byte_runs(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string or large binary column into runs of whole rows of about ``most`` bytes.

    Yields (first row, end row, bytes, offsets): the run's UTF-8 bytes and
    the place of each of its rows in them. Null texts are empty.
    """
    if not pa.types.is_large_binary(column.type):
        column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end
