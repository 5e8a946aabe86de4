"""Parquet scans of the three tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from pagerecs.schemas import PROD_SCHEMA, RAW_SCHEMA, SEARCH_SCHEMA, require_schema


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw table with the enforced schema (no inference, no footer merge);
    partition directories wiki_db=/snapshot= become the last two columns."""
    return require_schema(spark.read.schema(RAW_SCHEMA).parquet(path), RAW_SCHEMA)


def read_prod(spark: SparkSession, path: str, schema: StructType | None = PROD_SCHEMA) -> DataFrame:
    """Production table. With the declared schema (default) the partition
    values stay strings whatever they look like (a daily ``snapshot=2024-02-01``
    would otherwise be inferred as a date); pass ``schema=None`` for plain
    partition discovery. Filters on wiki/snapshot prune directories."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_search_feed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEARCH_SCHEMA).parquet(path)


def is_table_name(source: str) -> bool:
    """``db.table`` / ``table`` rather than a path (paths contain ``/`` or a
    scheme such as ``hdfs:``)."""
    return "/" not in source and ":" not in source


def open_raw(spark: SparkSession, source: str) -> DataFrame:
    """Raw input from a path or a catalog table. A partitioned catalog table
    keeps its partitions in the catalog, so filters on wiki_db/snapshot are
    pruned before any folder is listed -- at scale this replaces listing
    every partition folder of the table on each read."""
    if is_table_name(source):
        return require_schema(spark.table(source), RAW_SCHEMA)
    return read_raw(spark, source)


def open_prod(spark: SparkSession, source: str) -> DataFrame:
    """Production table from a path or a catalog table (see ``open_raw``)."""
    return spark.table(source) if is_table_name(source) else read_prod(spark, source)
