"""The three publishing jobs, each one Spark job from input to files.

J1 ``publish_prod``   raw table -> production table
J2 ``publish_search_feed``  production table -> search-index feed
J3 ``publish_exports``      production table -> one TSV set per wiki
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagerecs.operators.candidates import candidate_pages, explode_pages, stamp_run
from pagerecs.operators.export import export_tsv
from pagerecs.operators.profile import ProfileWrite
from pagerecs.operators.search import search_feed
from pagerecs.plans.params import Snapshot, month_of
from pagerecs.schemas import PROD_SCHEMA
from pagerecs.sources.sinks import prod_order, write_prod, write_search_feed


def _snapshot(s: str | Snapshot) -> Snapshot:
    return s if isinstance(s, Snapshot) else Snapshot.parse(s)


def publish_prod(
    raw: DataFrame,
    path: str,
    snapshot: str | Snapshot,
    dataset_id: str | None = None,
    insertion_ts: float | None = None,
    *,
    sort: bool = True,
    global_order: bool = False,
    max_records_per_file: int | None = None,
    profile: bool = False,
) -> ProfileWrite | None:
    """Transform, stamp and write one monthly snapshot of the production
    table (partitions wiki / month of ``snapshot``, given as ``YYYY-MM-DD``
    or ``YYYY-MM``).

    With ``sort`` (the default) each file is ordered by page_title descending.
    The raw rows are read once: *pages*, before the explode, are rebalanced on
    the wiki, so page-level columns travel once per page instead of once per
    candidate, and each task explodes and sorts its own share. With
    ``global_order`` a range shuffle makes a partition's files in name order
    give the order of the whole; its sampling reads the input a second time.

    Skew: the rebalance splits a hot wiki over tasks (as the range bounds on
    title and page do). A single page cannot be split, but it is one input
    row already read whole by one scan task, so the per-task work stays
    bounded by the largest input row, not by the data.

    With ``profile`` the write's own tasks count its rows; the result gives the
    count reports (``ProfileWrite.reports``) without reading the table.
    """
    counts = None
    if profile:  # the wikis are partition values of a production raw table
        wikis = [r.wiki_db for r in raw.select("wiki_db").distinct().collect()]
        counts = ProfileWrite(month_of(snapshot), wikis)
    rows = prod_rows_for_write(
        raw, snapshot, dataset_id, insertion_ts, sort=sort, global_order=global_order, counts=counts
    )
    write_prod(rows, path, sort=False, max_records_per_file=max_records_per_file)
    return counts


def prod_rows_for_write(
    raw: DataFrame,
    snapshot: str | Snapshot,
    dataset_id: str | None = None,
    insertion_ts: float | None = None,
    *,
    sort: bool = True,
    global_order: bool = False,
    counts: ProfileWrite | None = None,
) -> DataFrame:
    """The rows ``publish_prod`` writes, in table column order; with ``sort``
    clustered by wiki and ordered by ``prod_order()`` within each partition
    (see ``publish_prod``). ``counts`` observes them below the sort: above it
    the writer would not see their order and would sort them a second time."""
    month = month_of(snapshot)
    pages = candidate_pages(raw)
    if sort and not global_order:
        pages = pages.hint("rebalance", "wiki_db")
    elif sort:
        pages = pages.repartitionByRange(F.col("wiki_db"), F.desc_nulls_last("page_title"), F.asc("page_id"))
    rows = stamp_run(explode_pages(pages), dataset_id, insertion_ts, month)
    rows = rows.select(*[f.name for f in PROD_SCHEMA.fields])
    if counts is not None:
        rows = counts.observe(rows)
    return rows.sortWithinPartitions(*prod_order()) if sort else rows


def publish_search_feed(
    prod: DataFrame,
    path: str,
    snapshot: str | Snapshot,
    *,
    this_month_only: bool = False,
    **write_options,
) -> None:
    """Search feed for the daily ``snapshot``, from every row of ``prod``.
    ``this_month_only`` takes the production rows of its month alone (pruned
    at the scan)."""
    snap = _snapshot(snapshot)
    current = prod.where(F.col("snapshot") == F.lit(snap.month)) if this_month_only else prod
    write_search_feed(search_feed(current, snap), path, **write_options)


def publish_exports(
    prod: DataFrame,
    path: str,
    snapshot: str | Snapshot,
    wikis: Sequence[str],
    android: bool = False,
) -> None:
    """One header + rows TSV set per wiki for ``snapshot``'s month."""
    export_tsv(prod, list(wikis), month_of(snapshot), path, require_image=android)
