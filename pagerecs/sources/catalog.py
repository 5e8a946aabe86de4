"""Catalog tables over the Parquet folders.

Datasource tables (``USING PARQUET ... LOCATION``): they behave as the
external Hive tables of the original jobs -- dropping one leaves its files --
and need no Hive metastore.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from pagerecs.schemas import (
    PROD_PARTITION_COLUMNS,
    PROD_SCHEMA,
    RAW_PARTITION_COLUMNS,
    RAW_SCHEMA,
    SEARCH_PARTITION_COLUMNS,
    SEARCH_SCHEMA,
)

# Table names of the published datasets.
TABLES = {
    "raw": ("imagerec", RAW_SCHEMA, RAW_PARTITION_COLUMNS),
    "prod": ("imagerec_prod", PROD_SCHEMA, PROD_PARTITION_COLUMNS),
    "search": ("search_imagerec", SEARCH_SCHEMA, SEARCH_PARTITION_COLUMNS),
}


def _quote_ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _quote_string(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def qualified(name: str, database: str | None = None) -> str:
    return f"{_quote_ident(database)}.{_quote_ident(name)}" if database else _quote_ident(name)


def table_ddl(name: str, schema: StructType, partition_by, location: str, database: str | None = None) -> str:
    columns = ",\n  ".join(f"{_quote_ident(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    parts = ", ".join(_quote_ident(p) for p in partition_by)
    return (
        f"CREATE TABLE IF NOT EXISTS {qualified(name, database)} (\n  {columns})\n"
        f"USING PARQUET\nPARTITIONED BY ({parts})\nLOCATION {_quote_string(location)}"
    )


def create_external_table(
    spark: SparkSession,
    kind: str,
    location: str,
    database: str | None = None,
    name: str | None = None,
    repair: bool = True,
) -> str:
    """Create (if missing) the ``raw`` / ``prod`` / ``search`` table over
    ``location`` and register the partitions found there. Returns the
    qualified table name."""
    default_name, schema, partition_by = TABLES[kind]
    table = name or default_name
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quote_ident(database)}")
    spark.sql(table_ddl(table, schema, partition_by, location, database))
    full = qualified(table, database)
    if repair:
        repair_partitions(spark, full)
    return full


def repair_partitions(spark: SparkSession, table: str, sync: bool = False) -> None:
    """Register partitions present on storage but missing from the catalog.
    ``sync=True`` also drops catalog partitions whose folders are gone."""
    spark.sql(f"MSCK REPAIR TABLE {table}" + (" SYNC PARTITIONS" if sync else ""))


def use_database(spark: SparkSession, database: str) -> None:
    spark.catalog.setCurrentDatabase(database)


def read_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
