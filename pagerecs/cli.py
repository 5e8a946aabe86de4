"""Command-line entry points, one per job, for ``spark-submit`` or
``python -m pagerecs``. The session comes from ``getOrCreate()``, so cluster
settings come from the submit command, not from here.

  publish-prod   --snapshot --source --destination [--dataset-id]
  search-feed    --snapshot --source --destination [--this-month-only]
  export         --snapshot --source --destination --wiki ... [--android]
  monthly        --snapshot --source --prod --search --export --wiki ... [--reports]
  create-tables  [--database] [--raw] [--prod] [--search]
  repair         --table
  daily-count    [--date] [--database] --table [--database-col] [--ts-col] [--destination]
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagerecs", description="Image-recommendation publishing jobs")
    sub = p.add_subparsers(dest="command", required=True)

    j1 = sub.add_parser("publish-prod", help="raw table -> production table")
    j1.add_argument("--snapshot", required=True, help="monthly (YYYY-MM) or daily (YYYY-MM-DD) snapshot")
    j1.add_argument("--source", required=True, help="raw table path or catalog table name")
    j1.add_argument("--destination", required=True, help="production table path")
    j1.add_argument("--dataset-id", dest="dataset_id", default=None, help="default: a fresh uuid")
    j1.add_argument("--no-sort", dest="sort", action="store_false")

    j2 = sub.add_parser("search-feed", help="production table -> search feed")
    j2.add_argument("--snapshot", required=True, help="daily snapshot YYYY-MM-DD")
    j2.add_argument("--source", required=True, help="production table path or catalog table name")
    j2.add_argument("--destination", required=True, help="search feed path")
    j2.add_argument("--this-month-only", action="store_true", help="only the snapshot's month of the source")

    j3 = sub.add_parser("export", help="production table -> TSV per wiki")
    j3.add_argument("--snapshot", required=True, help="monthly or daily snapshot")
    j3.add_argument("--source", required=True, help="production table path or catalog table name")
    j3.add_argument("--destination", required=True, help="export folder")
    j3.add_argument("--wiki", nargs="+", required=True)
    j3.add_argument("--android", action="store_true", help="rows with an image only")

    m = sub.add_parser("monthly", help="raw -> prod -> export + search feed")
    m.add_argument("--snapshot", required=True, help="daily snapshot YYYY-MM-DD")
    m.add_argument("--source", required=True)
    m.add_argument("--prod", required=True)
    m.add_argument("--search", default=None)
    m.add_argument("--export", default=None)
    m.add_argument("--wiki", nargs="*", default=[])
    m.add_argument("--dataset-id", dest="dataset_id", default=None)
    m.add_argument("--android", action="store_true", help="export rows with an image only")
    m.add_argument("--source-snapshot", default=None, help="one raw snapshot (default: all)")
    m.add_argument("--insertion-ts", type=float, default=None)
    m.add_argument("--reports", default=None, help="folder for the profile reports, one Parquet table each")

    c = sub.add_parser("create-tables", help="external tables over the data folders")
    c.add_argument("--database", default=None)
    c.add_argument("--raw", default=None, help="raw table location")
    c.add_argument("--prod", default=None, help="production table location")
    c.add_argument("--search", default=None, help="search feed location")

    r = sub.add_parser("repair", help="register new partitions of a table")
    r.add_argument("--table", required=True)

    d = sub.add_parser("daily-count", help="new pages per database for one day")
    d.add_argument("--date", default=None, help="YYYY-MM-DD, default yesterday")
    d.add_argument("--database", default=None, help="one database (default: all)")
    d.add_argument("--table", required=True, help="event table name")
    d.add_argument("--database-col", default="database")
    d.add_argument("--ts-col", default=None, help="timestamp column (default: year/month/day columns)")
    d.add_argument("--destination", default=None, help="Parquet folder for the counts (default: print them all)")
    return p


def _print_all(df: DataFrame) -> None:
    """Every row, tab-separated, a partition at a time."""
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    # validate run parameters before starting any Spark work
    from pagerecs.plans.params import Snapshot, month_of, running_date

    if args.command in ("search-feed", "monthly"):
        Snapshot.parse(args.snapshot)
    elif args.command in ("publish-prod", "export"):
        month_of(args.snapshot)
    day = dt.date.fromisoformat(args.date) if getattr(args, "date", None) else None

    spark = spark or SparkSession.builder.getOrCreate()
    from pagerecs.plans import jobs
    from pagerecs.sources import catalog
    from pagerecs.sources.parquet import open_prod, open_raw

    if args.command == "publish-prod":
        dataset_id = args.dataset_id or str(uuid.uuid4())
        jobs.publish_prod(open_raw(spark, args.source), args.destination, args.snapshot, dataset_id,
                          sort=args.sort)
        print(f"dataset_id={dataset_id}")
    elif args.command == "search-feed":
        jobs.publish_search_feed(open_prod(spark, args.source), args.destination, args.snapshot,
                                 this_month_only=args.this_month_only)
    elif args.command == "export":
        jobs.publish_exports(open_prod(spark, args.source), args.destination, args.snapshot, args.wiki,
                             android=args.android)
    elif args.command == "monthly":
        from pagerecs.plans.monthly import run_monthly

        res = run_monthly(spark, args.source, args.prod, args.snapshot, wikis=args.wiki,
                          search_path=args.search, export_path=args.export,
                          dataset_id=args.dataset_id or str(uuid.uuid4()), android=args.android,
                          source_snapshot=args.source_snapshot, insertion_ts=args.insertion_ts)
        if args.reports:
            for name, report in res.profile.items():
                report.write.mode("overwrite").parquet(f"{args.reports.rstrip('/')}/{name}")
        for name in ("partition_counts", "confidence_violations"):
            print(name)
            _print_all(res.profile[name])
    elif args.command == "create-tables":
        for kind in ("raw", "prod", "search"):
            location = getattr(args, kind)
            if location:
                print(catalog.create_external_table(spark, kind, location, database=args.database))
    elif args.command == "repair":
        catalog.repair_partitions(spark, args.table)
    elif args.command == "daily-count":
        from pagerecs.operators.daily import daily_new_pages

        the_day = day or running_date()
        counts = daily_new_pages(spark.table(args.table), the_day, args.database,
                                 database_col=args.database_col, ts_col=args.ts_col)
        if args.destination:
            counts.write.mode("overwrite").parquet(args.destination)
        else:
            _print_all(counts)
    return 0


if __name__ == "__main__":
    sys.exit(main())
