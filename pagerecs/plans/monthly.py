"""The monthly run: raw -> prod -> {export, search feed, profile}.

Each published table is written, then read back from storage before the
next step uses it. That cuts lineage at every hand-off, so a lost executor
recomputes at most one step, and downstream steps read pruned, pushed-down
Parquet instead of re-running the transform.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagerecs.operators.profile import pages_without_image, value_frequencies
from pagerecs.plans.jobs import publish_exports, publish_prod, publish_search_feed
from pagerecs.plans.params import Snapshot
from pagerecs.sources.catalog import create_external_table, repair_partitions
from pagerecs.sources.parquet import is_table_name, open_raw, read_prod
from pagerecs.sources.snapshots import publish_partitions, publish_search_partitions


@dataclass
class MonthlyResult:
    snapshot: Snapshot
    dataset_id: str | None
    prod_path: str
    search_path: str | None = None
    export_path: str | None = None
    prod_table: str | None = None
    search_table: str | None = None
    profile: dict[str, DataFrame] = field(default_factory=dict)


def run_monthly(
    spark: SparkSession,
    raw_source: str,
    prod_path: str,
    snapshot: str | Snapshot,
    *,
    wikis: Sequence[str] = (),
    search_path: str | None = None,
    export_path: str | None = None,
    dataset_id: str | None = None,
    insertion_ts: float | None = None,
    source_snapshot: str | None = None,
    android: bool = False,
    search_this_month_only: bool = False,
    database: str | None = None,
) -> MonthlyResult:
    """Publish one monthly snapshot.

    ``raw_source`` is a path or a catalog table name. ``snapshot`` is the
    daily run date (validated first, before any Spark work); production
    partitions are named by its month. ``source_snapshot``
    restricts the raw input to one raw partition (pruned at the scan); by
    default every raw row is published under this run's snapshot.

    With ``database`` the run goes through the catalog: the raw table is created
    over its path if need be and its partitions repaired before the transform;
    production and search tables are created over their paths and get the run's
    partitions only once they are whole (``sources.snapshots``); every later
    step reads the production table through its catalog partitions, so no other
    month's folders are listed.

    The count reports of ``profile`` are collected by the write itself;
    ``pages_without_image`` and ``value_frequencies`` read the table when shown.
    """
    snap = snapshot if isinstance(snapshot, Snapshot) else Snapshot.parse(snapshot)
    if export_path is not None and not wikis:
        raise ValueError("an export path needs the wikis to export")
    if database is not None:
        if not is_table_name(raw_source):
            raw_source = create_external_table(spark, "raw", raw_source, database, repair=False)
        repair_partitions(spark, raw_source)
    raw = open_raw(spark, raw_source)
    if source_snapshot is not None:
        raw = raw.where(F.col("snapshot") == F.lit(source_snapshot))
    result = MonthlyResult(snap, dataset_id, prod_path)

    def write(path: str) -> None:
        result.profile = publish_prod(raw, path, snap, dataset_id, insertion_ts, profile=True).reports(spark)

    if database is None:
        write(prod_path)
        table = read_prod(spark, prod_path)
    else:
        result.prod_table = create_external_table(spark, "prod", prod_path, database, repair=False)
        publish_partitions(spark, result.prod_table, write)
        table = spark.table(result.prod_table)
    published = table.where(F.col("snapshot") == F.lit(snap.month))
    if export_path is not None:
        publish_exports(published, export_path, snap, wikis, android)
        result.export_path = export_path
    if search_path is not None:

        def write_feed(path: str) -> None:
            publish_search_feed(table, path, snap, this_month_only=search_this_month_only)

        if database is None:
            write_feed(search_path)
        else:
            result.search_table = create_external_table(spark, "search", search_path, database, repair=False)
            publish_search_partitions(spark, result.search_table, write_feed)
        result.search_path = search_path
    result.profile["pages_without_image"] = pages_without_image(published)
    result.profile["value_frequencies"] = value_frequencies(published)
    return result
