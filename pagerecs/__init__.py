"""pagerecs: image-recommendation publishing as PySpark DataFrame jobs.

Subpackages
-----------
``functions``  Column expressions (classification, parsing, flags).
``operators``  DataFrame -> DataFrame steps (flatten, feed, export, profile,
               compare, daily counts).
``sources``    Scans, sinks, catalog tables, and the raw table derived from
               the driver's TPC-H-style tables.
``plans``      Run parameters, the publishing jobs, the monthly run and the
               query registry used by ``__spark_entry__``.


The most used entry points are re-exported here.
"""

from pagerecs import schemas
from pagerecs.operators.candidates import flatten_candidates, stamp_run, transform_candidates
from pagerecs.operators.compare import frame_diff
from pagerecs.operators.daily import daily_new_pages
from pagerecs.operators.export import export_rows, export_tsv
from pagerecs.operators.profile import profile_reports, value_frequencies
from pagerecs.operators.search import search_feed
from pagerecs.plans.jobs import publish_exports, publish_prod, publish_search_feed
from pagerecs.plans.monthly import run_monthly
from pagerecs.plans.params import Snapshot, running_date
from pagerecs.sources.parquet import open_prod, open_raw, read_prod, read_raw
from pagerecs.sources.sinks import write_prod, write_search_feed, write_tsv

__all__ = [
    "Snapshot",
    "daily_new_pages",
    "export_rows",
    "export_tsv",
    "flatten_candidates",
    "frame_diff",
    "open_prod",
    "open_raw",
    "profile_reports",
    "publish_exports",
    "publish_prod",
    "publish_search_feed",
    "read_prod",
    "read_raw",
    "run_monthly",
    "running_date",
    "schemas",
    "search_feed",
    "stamp_run",
    "transform_candidates",
    "value_frequencies",
    "write_prod",
    "write_search_feed",
    "write_tsv",
]
