"""Crash-safe publishing into partitioned catalog tables.

A run writes its partitions to a folder of its own below the table's location
(``_runs/<run>``, which path readers and partition discovery pass over) and
only then points the catalog's partitions at it: one catalog call for those
that are new, one for each that is replaced. A reader plans against either the
old folder of a partition or the new one, both whole; a write that fails leaves
the table as it was. Nothing but the run's own partitions is listed or
registered, however many the table has. Repeating ``point_partitions`` for the
same folder finishes a run that stopped between two partitions.

Folders that are no longer pointed at stay for readers that still use them,
until ``drop_unused_runs``. ``repair_partitions(sync=True)`` would drop the
partitions again, as their folders are not where the table's layout puts them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from pagerecs.schemas import PROD_PARTITION_COLUMNS, SEARCH_PARTITION_COLUMNS
from pagerecs.sources.catalog import _quote_ident, _quote_string

RUNS_FOLDER = "_runs"
# Fixed value: the folder name of a NULL partition value.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def table_location(spark: SparkSession, table: str) -> str:
    """The folder that a catalog table was created over."""
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'")
    return described.first()["data_type"].rstrip("/")


def _spec(partition_by: Sequence[str], values: Sequence) -> str:
    def literal(value) -> str:
        if value is None:
            return "NULL"
        return str(value) if isinstance(value, int) else _quote_string(str(value))

    return f"PARTITION ({', '.join(f'{_quote_ident(c)} = {literal(v)}' for c, v in zip(partition_by, values))})"


def _folders(written: DataFrame, partition_by: Sequence[str]) -> list[Row]:
    """Partition values of a written folder and where each one's files are (as
    a URI). A row per partition of one run; only partition values and file
    names are read."""
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    return written.groupBy(*partition_by).agg(F.min(folder).alias("folder")).collect()


def partition_locations(spark: SparkSession, table: str, partition_by: Sequence[str]) -> dict[tuple[str, ...], str]:
    """Where the catalog's partitions are, by their values as text."""
    found = {}
    kinds = dict(spark.table(table).dtypes)
    for row in spark.sql(f"SHOW PARTITIONS {table}").collect():
        texts = [unquote(part.split("=", 1)[1]) for part in row["partition"].split("/")]
        values = tuple(None if t == NULL_PARTITION else t for t in texts)
        typed = [int(v) if v and kinds[c] == "int" else v for v, c in zip(values, partition_by)]
        described = spark.sql(f"DESCRIBE TABLE EXTENDED {table} {_spec(partition_by, typed)}")
        found[values] = described.where("col_name = 'Location'").first()["data_type"]
    return found


def point_partitions(spark: SparkSession, table: str, folder: str, partition_by: Sequence[str]) -> list[tuple]:
    """Points the table's partitions at those that ``folder`` holds. Returns their values."""
    written = spark.read.schema(spark.table(table).schema).parquet(folder)
    found = _folders(written, partition_by)
    known = {r["partition"] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()}
    added, moved = [], []
    for row in found:
        place = unquote(row["folder"])
        name = "/".join(place.split("/")[-len(partition_by) :])  # escaped as the catalog's names are
        spec = _spec(partition_by, [row[c] for c in partition_by])
        (moved if name in known else added).append((spec, _quote_string(place)))
    if added:
        places = " ".join(f"{spec} LOCATION {place}" for spec, place in added)
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {places}")
    for spec, place in moved:
        spark.sql(f"ALTER TABLE {table} {spec} SET LOCATION {place}")
    spark.catalog.refreshTable(table)
    return [tuple(row[c] for c in partition_by) for row in found]


def publish_partitions(
    spark: SparkSession,
    table: str,
    write: Callable[[str], object],
    partition_by: Sequence[str] = PROD_PARTITION_COLUMNS,
) -> list[tuple]:
    """``write(folder)`` writes partitioned Parquet to a fresh folder; then the
    table's partitions of the same values are replaced by it, all others stay.
    Returns the published partition values."""
    folder = f"{table_location(spark, table)}/{RUNS_FOLDER}/{uuid.uuid4().hex}"
    write(folder)
    return point_partitions(spark, table, folder, partition_by)


def publish_search_partitions(spark: SparkSession, table: str, write: Callable[[str], object]) -> list[tuple]:
    return publish_partitions(spark, table, write, SEARCH_PARTITION_COLUMNS)


def drop_unused_runs(spark: SparkSession, table: str, partition_by: Sequence[str] = PROD_PARTITION_COLUMNS) -> list[str]:
    """Deletes run folders that no partition points into; call it when no
    reader uses an older plan and no run is being written. Returns their names."""
    root = f"{table_location(spark, table)}/{RUNS_FOLDER}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    places = partition_locations(spark, table, partition_by).values()
    used = {p.split(f"/{RUNS_FOLDER}/", 1)[1].split("/", 1)[0] for p in places if f"/{RUNS_FOLDER}/" in p}
    unused = sorted(s.getPath().getName() for s in files.listStatus(path) if s.getPath().getName() not in used)
    for name in unused:
        files.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/{name}"), True)
    return unused
