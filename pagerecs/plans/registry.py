"""Registered queries over the driver's tables, and their DuckDB oracles.

Inputs follow the production data flow. The raw candidate table is derived
from ``orders`` + ``lineitem`` by Spark and written once (per code version
and input) as a partitioned Parquet table in the shared scratch folder; the
production table is then published from it by the J1 job (``publish_prod``)
under fixed run parameters. Every query reads those tables (whole, no
sampling) the way the published jobs read theirs.

Each oracle restates the same result in DuckDB from the *flat* tables (a
left join of orders and line items, no arrays), so it is independent of the
nesting. Array columns are compared as their JSON text.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagerecs.functions.candidates import (
    candidate_source,
    confidence_rating,
    found_on,
    instance_of_id,
    is_article_page,
)
from pagerecs.operators.candidates import (
    explode_candidates,
    flatten_candidates,
    pages_without_candidates,
    stamp_run,
    transform_candidates,
    transform_candidates_two_pass,
    with_candidates,
)
from pagerecs.operators.compare import bucketed_frame_diff, frame_diff
from pagerecs.operators.daily import daily_new_pages, daily_new_pages_sql
from pagerecs.operators.export import EXPORT_COLUMNS, export_rows, export_rows_sql, export_tsv
from pagerecs.operators.profile import (
    confidence_by_source,
    confidence_violations,
    pages_without_image,
    partition_counts,
    profile_counts,
    row_count,
    value_frequencies,
)
from pagerecs.operators.search import search_feed
from pagerecs.plans.jobs import prod_rows_for_write, publish_prod
from pagerecs.plans.monthly import run_monthly
from pagerecs.plans.params import Snapshot
from pagerecs.sources.catalog import create_external_table
from pagerecs.sources.derived import (
    ENTITIES,
    IMAGE_MODULUS,
    LISTED_WIKIS,
    NOTES,
    RATINGS,
    WIKIS_BY_CUSTKEY,
    derive_raw,
    load_tables,
)
from pagerecs.sources.parquet import read_prod, read_raw, read_search_feed
from pagerecs.sources.sinks import TSV_SEPARATOR, file_order, read_tsv, read_tsv_rows, tsv_headers, write_search_feed
from pagerecs.sources.snapshots import publish_partitions
from pagerecs.sources.storage import fresh_path, materialize_once
from pagerecs.schemas import NON_ARTICLE_INSTANCES, RAW_PARTITION_COLUMNS

# Parameters of the registered run (shared with the oracles).
RUN = Snapshot.parse("2024-02-01")
RUN_MONTH = RUN.month
RUN_DATASET_ID = "run-2024-02-01"
RUN_INSERTION_TS = 1706745600.0
RUN_INSERTION_TS_TEXT = "1.7067456E9"  # Spark's (and Hive's) text form of it
EXPORT_WIKI = "kowiki"
ALL_WIKIS = WIKIS_BY_CUSTKEY
EARLIER_MONTH = "2024-01"
EARLIER_DATASET_ID = "run-2024-01-late"
DAILY_DAY = "2024-01-15"
DAILY_DATABASE = "signup"


# --------------------------------------------------------------------------
# Derived inputs, written once per scratch folder, sf directory, code
# version and input files (see ``materialize_once``).


def _code_version() -> str:
    """Hash of the package source: any code change gives new fixtures."""
    global _CODE_VERSION
    if _CODE_VERSION is None:
        h = hashlib.sha1()
        base = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        for folder, _, files in sorted(os.walk(base)):
            if os.path.relpath(folder, base).split(os.sep)[0] == "llm":
                continue  # makes none of these tables
            for name in sorted(files):
                if name.endswith(".py"):
                    with open(os.path.join(folder, name), "rb") as fh:
                        h.update(name.encode() + fh.read())
        _CODE_VERSION = h.hexdigest()[:16]
    return _CODE_VERSION


_CODE_VERSION: str | None = None


def _inputs_version(spark: SparkSession, sf_dir: str) -> str:
    """Name, length and modification time of the input tables' files, as
    Spark lists them (their contents are not read)."""
    paths = [f"{sf_dir.rstrip('/')}/{name}.parquet" for name in ("orders", "lineitem")]
    files = spark.read.format("binaryFile").load(paths).select("path", "length", "modificationTime")
    found = files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
    return f"{found[0]}:{found[1]}"


def _key(spark: SparkSession, kind: str, sf_dir: str) -> str:
    return f"{kind}|{sf_dir.rstrip('/')}|{_code_version()}|{_inputs_version(spark, sf_dir)}"


def write_derived_raw(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Derive the raw table from the sf tables and write it partitioned by
    (wiki_db, snapshot)."""
    orders, lineitem = load_tables(spark, sf_dir, "orders", "lineitem")
    derive_raw(orders, lineitem).write.partitionBy(*RAW_PARTITION_COLUMNS).parquet(path)


def raw_path(spark: SparkSession, sf_dir: str) -> str:
    return materialize_once(spark, _key(spark, "raw", sf_dir), lambda path: write_derived_raw(spark, sf_dir, path))


def raw_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_raw(spark, raw_path(spark, sf_dir))


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stamp_run(
        transform_candidates(raw_table(spark, sf_dir)), RUN_DATASET_ID, RUN_INSERTION_TS, snapshot=RUN_MONTH
    )


def prod_path(spark: SparkSession, sf_dir: str) -> str:
    """The production table, published by the J1 job from the raw table."""

    def build(path: str) -> None:
        publish_prod(raw_table(spark, sf_dir), path, RUN, RUN_DATASET_ID, RUN_INSERTION_TS)

    return materialize_once(spark, _key(spark, "prod", sf_dir), build)


def prod_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_prod(spark, prod_path(spark, sf_dir))


def _json_found_on(df: DataFrame) -> DataFrame:
    return df.withColumn("found_on", F.to_json("found_on"))


# --------------------------------------------------------------------------
# Queries.


def q_scan_raw(spark, sf_dir):
    raw = raw_table(spark, sf_dir)
    arr = F.col("top_candidates")
    n = F.when(arr.isNull(), F.lit(None)).otherwise(F.size(arr))
    return raw.select("item_id", "page_id", "page_title", "instance_of", "wiki_db", "snapshot", n.alias("n_candidates"))


def q_with_candidates(spark, sf_dir):
    arr = F.col("top_candidates")
    n = F.when(arr.isNull(), F.lit(None)).otherwise(F.size(arr))
    return with_candidates(raw_table(spark, sf_dir)).select(
        "page_id", "page_title", "wiki_db", "snapshot", n.alias("n_candidates")
    )


def q_explode_candidates(spark, sf_dir):
    return explode_candidates(raw_table(spark, sf_dir))


def q_flatten_candidates(spark, sf_dir):
    return flatten_candidates(raw_table(spark, sf_dir))


def q_confidence_rating(spark, sf_dir):
    return explode_candidates(raw_table(spark, sf_dir)).select(
        "page_id", "image_id", "rating", confidence_rating("rating").alias("confidence_rating")
    )


def q_candidate_source(spark, sf_dir):
    return explode_candidates(raw_table(spark, sf_dir)).select(
        "page_id", "image_id", "note", candidate_source("note").alias("source")
    )


def q_found_on(spark, sf_dir):
    return explode_candidates(raw_table(spark, sf_dir)).select(
        "page_id", "image_id", "note", F.to_json(found_on("note")).alias("found_on")
    )


def q_instance_of_id(spark, sf_dir):
    return raw_table(spark, sf_dir).select(
        "page_id", "instance_of", instance_of_id("instance_of").alias("instance_of_id")
    )


def q_is_article_page(spark, sf_dir):
    entity = instance_of_id("instance_of")
    return raw_table(spark, sf_dir).select(
        "page_id", entity.alias("instance_of_id"), is_article_page(entity).alias("is_article_page")
    )


def q_pages_without_candidates(spark, sf_dir):
    return _json_found_on(pages_without_candidates(raw_table(spark, sf_dir)))


def q_candidate_transform(spark, sf_dir):
    return _json_found_on(transform_candidates(raw_table(spark, sf_dir)))


def q_candidate_transform_two_pass(spark, sf_dir):
    return _json_found_on(transform_candidates_two_pass(raw_table(spark, sf_dir)))


def q_stamped_prod(spark, sf_dir):
    return _json_found_on(stamped(spark, sf_dir))


def q_sorted_prod(spark, sf_dir):
    """The frame the J1 job hands to the writer (pages rebalanced on their
    wiki, then exploded and sorted per task)."""
    rows = prod_rows_for_write(raw_table(spark, sf_dir), RUN, RUN_DATASET_ID, RUN_INSERTION_TS)
    return _json_found_on(rows)


def q_prod_roundtrip(spark, sf_dir):
    return _json_found_on(prod_table(spark, sf_dir))


def q_search_feed(spark, sf_dir):
    return search_feed(prod_table(spark, sf_dir), RUN)


def q_search_roundtrip(spark, sf_dir):
    def build(path):
        write_search_feed(search_feed(prod_table(spark, sf_dir), RUN), path)

    return read_search_feed(spark, materialize_once(spark, _key(spark, "search", sf_dir), build))


def q_export_rows(spark, sf_dir):
    return export_rows(prod_table(spark, sf_dir), EXPORT_WIKI, RUN_MONTH)


def q_export_rows_android(spark, sf_dir):
    return export_rows(prod_table(spark, sf_dir), EXPORT_WIKI, RUN_MONTH, require_image=True)


def q_export_all_wikis(spark, sf_dir):
    return export_rows(prod_table(spark, sf_dir), ALL_WIKIS, RUN_MONTH)


def prod_catalog_table(spark: SparkSession, sf_dir: str) -> str:
    """The published production folder as an external catalog table (created
    if missing, partitions repaired); one table name per folder."""
    path = prod_path(spark, sf_dir)
    name = "imagerec_prod_" + os.path.basename(path).replace("-", "_")
    return create_external_table(spark, "prod", path, name=name)


def q_export_rows_sql(spark, sf_dir):
    return export_rows_sql(spark, prod_catalog_table(spark, sf_dir), EXPORT_WIKI, RUN_MONTH)


def q_export_rows_sql_android(spark, sf_dir):
    return export_rows_sql(spark, prod_catalog_table(spark, sf_dir), EXPORT_WIKI, RUN_MONTH, require_image=True)


def monthly_run_paths(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Run the whole monthly plan once (raw -> prod -> export, search feed)
    into fresh folders; return where each output went."""

    def build(root: str) -> None:
        run_monthly(
            spark,
            raw_path(spark, sf_dir),
            f"{root}/prod",
            RUN,
            wikis=ALL_WIKIS,
            search_path=f"{root}/search",
            export_path=f"{root}/export",
            dataset_id=RUN_DATASET_ID,
            insertion_ts=RUN_INSERTION_TS,
        )

    root = materialize_once(spark, _key(spark, "monthly", sf_dir), build)
    return {"prod": f"{root}/prod", "search": f"{root}/search", "export": f"{root}/export"}


def q_monthly_search_feed(spark, sf_dir):
    return read_search_feed(spark, monthly_run_paths(spark, sf_dir)["search"])


def q_monthly_tsv_export(spark, sf_dir):
    return one_header(read_tsv(spark, monthly_run_paths(spark, sf_dir)["export"]))


def q_tsv_export(spark, sf_dir):
    return one_header(read_tsv(spark, tsv_path(spark, sf_dir)))


def tsv_path(spark, sf_dir):
    def build(path):
        export_tsv(prod_table(spark, sf_dir), ALL_WIKIS, RUN_MONTH, path)

    return materialize_once(spark, _key(spark, "tsv", sf_dir), build)


def one_header(lines: DataFrame) -> DataFrame:
    """An export's lines with one header per partition, however many files it has."""
    is_header = F.col("value") == F.lit(TSV_SEPARATOR.join(EXPORT_COLUMNS))
    return lines.where(~is_header).unionByName(lines.where(is_header).distinct())


def q_tsv_rows(spark, sf_dir):
    """Every file of the export parsed by itself, back into fields."""
    return read_tsv_rows(spark, tsv_path(spark, sf_dir), EXPORT_COLUMNS)


def q_tsv_headers(spark, sf_dir):
    return tsv_headers(spark, tsv_path(spark, sf_dir), EXPORT_COLUMNS).drop("files")


def q_prod_file_order(spark, sf_dir):
    return file_order(prod_table(spark, sf_dir))


def q_partition_counts(spark, sf_dir):
    return partition_counts(prod_table(spark, sf_dir))


def q_value_frequencies(spark, sf_dir):
    return value_frequencies(prod_table(spark, sf_dir), top=20).withColumnRenamed("column", "column_name")


def q_value_frequencies_all(spark, sf_dir):
    return value_frequencies(prod_table(spark, sf_dir)).withColumnRenamed("column", "column_name")


def q_scan_prod(spark, sf_dir):
    """The production table by plain partition discovery, no declared schema."""
    return _json_found_on(read_prod(spark, prod_path(spark, sf_dir), schema=None))


def q_row_count(spark, sf_dir):
    return row_count(prod_table(spark, sf_dir))


def q_confidence_by_source(spark, sf_dir):
    return confidence_by_source(prod_table(spark, sf_dir))


def q_confidence_violations(spark, sf_dir):
    return confidence_violations(prod_table(spark, sf_dir))


def q_pages_without_image(spark, sf_dir):
    return pages_without_image(prod_table(spark, sf_dir))


def q_profile_counts(spark, sf_dir):
    return profile_counts(prod_table(spark, sf_dir))


def q_frame_diff(spark, sf_dir):
    prod = prod_table(spark, sf_dir)
    return frame_diff(
        export_rows(prod, ALL_WIKIS, RUN_MONTH),
        export_rows(prod, ALL_WIKIS, RUN_MONTH, require_image=True),
    )


def q_frame_diff_multiset(spark, sf_dir):
    """Copies count: every tenth page is twice on the left, the wiki's other
    pages have a changed title on the right."""
    rows = export_rows(prod_table(spark, sf_dir), ALL_WIKIS, RUN_MONTH)
    left = rows.unionByName(rows.where("page_id % 10 = 0"))
    retitled = rows.where("page_id % 7 = 0").withColumn("page_title", F.concat("page_title", F.lit(" (new)")))
    right = rows.where("page_id % 7 <> 0").unionByName(retitled).unionByName(retitled.where("page_id % 2 = 0"))
    return bucketed_frame_diff(left, right, multiset=True)


def q_frame_diff_bucketed(spark, sf_dir):
    prod = prod_table(spark, sf_dir)
    rows = export_rows(prod, ALL_WIKIS, RUN_MONTH)
    return bucketed_frame_diff(rows, export_rows(prod, ALL_WIKIS, RUN_MONTH, require_image=True))


def monthly_catalog(spark: SparkSession, sf_dir: str):
    """The monthly run through catalog tables, once per application (the
    default catalog lives no longer than that)."""
    key = _key(spark, f"monthly-catalog-{spark.sparkContext.applicationId}", sf_dir)
    database = "pagerecs_" + hashlib.sha1(key.encode()).hexdigest()[:12]

    def build(root: str) -> None:
        run_monthly(
            spark,
            raw_path(spark, sf_dir),
            f"{root}/prod",
            RUN,
            search_path=f"{root}/search",
            dataset_id=RUN_DATASET_ID,
            insertion_ts=RUN_INSERTION_TS,
            database=database,
        )

    materialize_once(spark, key, build)
    return database


def q_monthly_catalog_scan(spark, sf_dir):
    return _json_found_on(spark.table(f"{monthly_catalog(spark, sf_dir)}.imagerec_prod"))


def q_monthly_catalog_search(spark, sf_dir):
    return spark.table(f"{monthly_catalog(spark, sf_dir)}.search_imagerec")


def two_snapshots(spark: SparkSession, sf_dir: str) -> str:
    """A catalog table of two months, the earlier one published, then the
    later one, then the earlier one again from other rows."""
    key = _key(spark, f"two-snapshots-{spark.sparkContext.applicationId}", sf_dir)
    name = "prod_" + hashlib.sha1(key.encode()).hexdigest()[:12]

    def build(root: str) -> None:
        raw = raw_table(spark, sf_dir)
        table = create_external_table(spark, "prod", root, name=name, repair=False)
        for month, rows, dataset in (
            (EARLIER_MONTH, raw.where("page_id % 2 = 0"), "first"),
            (RUN_MONTH, raw.where("page_id % 5 <> 0"), RUN_DATASET_ID),
            (EARLIER_MONTH, raw.where("page_id % 3 = 0"), EARLIER_DATASET_ID),
        ):
            publish_partitions(
                spark, table, lambda path: publish_prod(rows, path, month, dataset, RUN_INSERTION_TS)
            )

    materialize_once(spark, key, build)
    return name


def q_republished_snapshot(spark, sf_dir):
    return _json_found_on(spark.table(two_snapshots(spark, sf_dir)))


def q_search_feed_all_snapshots(spark, sf_dir):
    return search_feed(spark.table(two_snapshots(spark, sf_dir)), RUN)


def q_partition_counts_all_snapshots(spark, sf_dir):
    return partition_counts(spark.table(two_snapshots(spark, sf_dir)))


def written_reports(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The count reports that a publishing write collects about its own rows."""
    path = fresh_path(spark, "profiled-prod")
    counts = publish_prod(raw_table(spark, sf_dir), path, RUN, RUN_DATASET_ID, RUN_INSERTION_TS, profile=True)
    return counts.reports(spark)


def q_written_partition_counts(spark, sf_dir):
    return written_reports(spark, sf_dir)["partition_counts"]


def q_written_confidence(spark, sf_dir):
    return written_reports(spark, sf_dir)["confidence_by_source"]


def q_daily_new_pages(spark, sf_dir):
    (events,) = load_tables(spark, sf_dir, "events")
    return daily_new_pages(events, DAILY_DAY, database_col="event_type", ts_col="ts")


def q_daily_new_pages_one_database(spark, sf_dir):
    (events,) = load_tables(spark, sf_dir, "events")
    return daily_new_pages(events, DAILY_DAY, DAILY_DATABASE, database_col="event_type", ts_col="ts")


def q_daily_new_pages_sql(spark, sf_dir):
    (events,) = load_tables(spark, sf_dir, "events")
    view = "pagerecs_events_" + hashlib.sha1(os.path.abspath(sf_dir).encode()).hexdigest()[:8]
    events.createOrReplaceTempView(view)
    return daily_new_pages_sql(spark, view, DAILY_DAY, database_col="event_type", ts_col="ts")


def q_daily_new_pages_partitioned(spark, sf_dir):
    """The count over events written by year/month/day: only the day's folder is read."""

    def build(path):
        (events,) = load_tables(spark, sf_dir, "events")
        parts = [f(F.col("ts")).alias(n) for n, f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth))]
        days = events.select("event_type", *parts).repartition("year", "month", "day", F.pmod(F.xxhash64("event_type"), F.lit(8)))
        days.write.partitionBy("year", "month", "day").parquet(path)

    path = materialize_once(spark, _key(spark, "events", sf_dir), build)
    events = spark.read.schema("event_type string, year int, month int, day int").parquet(path)
    return daily_new_pages(events, DAILY_DAY, database_col="event_type")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_raw": q_scan_raw,
    "with_candidates": q_with_candidates,
    "explode_candidates": q_explode_candidates,
    "flatten_candidates": q_flatten_candidates,
    "confidence_rating": q_confidence_rating,
    "candidate_source": q_candidate_source,
    "found_on": q_found_on,
    "instance_of_id": q_instance_of_id,
    "is_article_page": q_is_article_page,
    "pages_without_candidates": q_pages_without_candidates,
    "candidate_transform": q_candidate_transform,
    "candidate_transform_two_pass": q_candidate_transform_two_pass,
    "stamped_prod": q_stamped_prod,
    "sorted_prod": q_sorted_prod,
    "prod_roundtrip": q_prod_roundtrip,
    "search_feed": q_search_feed,
    "search_roundtrip": q_search_roundtrip,
    "export_rows": q_export_rows,
    "export_rows_android": q_export_rows_android,
    "export_all_wikis": q_export_all_wikis,
    "export_rows_sql": q_export_rows_sql,
    "export_rows_sql_android": q_export_rows_sql_android,
    "tsv_export": q_tsv_export,
    "monthly_search_feed": q_monthly_search_feed,
    "monthly_tsv_export": q_monthly_tsv_export,
    "partition_counts": q_partition_counts,
    "value_frequencies": q_value_frequencies,
    "value_frequencies_all": q_value_frequencies_all,
    "scan_prod": q_scan_prod,
    "daily_new_pages_partitioned": q_daily_new_pages_partitioned,
    "row_count": q_row_count,
    "confidence_by_source": q_confidence_by_source,
    "confidence_violations": q_confidence_violations,
    "pages_without_image": q_pages_without_image,
    "profile_counts": q_profile_counts,
    "frame_diff": q_frame_diff,
    "frame_diff_bucketed": q_frame_diff_bucketed,
    "frame_diff_multiset": q_frame_diff_multiset,
    "prod_file_order": q_prod_file_order,
    "tsv_rows": q_tsv_rows,
    "tsv_headers": q_tsv_headers,
    "monthly_catalog_scan": q_monthly_catalog_scan,
    "monthly_catalog_search": q_monthly_catalog_search,
    "republished_snapshot": q_republished_snapshot,
    "search_feed_all_snapshots": q_search_feed_all_snapshots,
    "partition_counts_all_snapshots": q_partition_counts_all_snapshots,
    "written_partition_counts": q_written_partition_counts,
    "written_confidence": q_written_confidence,
    "daily_new_pages": q_daily_new_pages,
    "daily_new_pages_one_database": q_daily_new_pages_one_database,
    "daily_new_pages_sql": q_daily_new_pages_sql,
}


# --------------------------------------------------------------------------
# DuckDB oracles.

_NON_ARTICLE_SQL = ", ".join(f"'{q}'" for q in NON_ARTICLE_INSTANCES)

_PRELUDE = r"""
WITH page_rows AS (
  SELECT concat('Q', CAST(o_orderkey AS VARCHAR)) AS item_id,
         o_orderkey AS page_id,
         concat('Page ', CAST(o_orderkey AS VARCHAR)) AS page_title,
         list_extract([__ENTITIES__], CAST(o_orderkey % __N_ENTITIES__ AS INTEGER) + 1) AS instance_of,
         CASE o_custkey % 4 WHEN 0 THEN 'kowiki' WHEN 1 THEN 'plwiki'
           WHEN 2 THEN 'enwiki' ELSE 'arwiki' END AS wiki_db,
         strftime(o_orderdate, '%Y-%m') AS snapshot,
         o_orderkey % 97 = 0 AS null_array
  FROM orders
), cands AS (
  SELECT l_orderkey AS page_id,
         CASE WHEN l_partkey % __IMAGE_MODULUS__ <> 0 THEN concat('img_', CAST(l_partkey AS VARCHAR), '.jpg') END AS image,
         list_extract([__RATINGS__],
           CAST((l_linenumber + CASE WHEN l_partkey % 5 = 4 THEN 1 ELSE 0 END) % __N_RATINGS__ AS INTEGER) + 1) AS rating,
         list_extract([__NOTES__], CAST(l_linenumber % 5 AS INTEGER) + 1)
           || CASE WHEN l_linenumber % 5 = 2
              THEN list_extract([__LISTED_WIKIS__], CAST(l_partkey % 3 AS INTEGER) + 1) ELSE '' END AS note
  FROM lineitem
), ncand AS (
  SELECT page_id, count(*) AS n FROM cands GROUP BY page_id
), raw_pages AS (
  SELECT p.item_id, p.page_id, p.page_title, p.instance_of, p.wiki_db, p.snapshot,
         CASE WHEN p.null_array THEN NULL ELSE coalesce(n.n, 0) END AS n_candidates
  FROM page_rows p LEFT JOIN ncand n ON n.page_id = p.page_id
), exploded AS (
  SELECT p.wiki_db AS wiki, p.page_id, p.page_title, c.image AS image_id, c.rating, c.note, p.instance_of
  FROM raw_pages p JOIN cands c ON c.page_id = p.page_id
  WHERE p.n_candidates IS NOT NULL
), flat AS (
  SELECT *, true AS is_candidate FROM exploded
  UNION ALL
  SELECT wiki_db AS wiki, page_id, page_title, NULL AS image_id, NULL AS rating, NULL AS note, instance_of,
         false AS is_candidate
  FROM raw_pages WHERE n_candidates = 0
), parsed AS (
  SELECT *,
    CASE try_cast(regexp_extract(rating, '^\s*([+-]?[0-9]+)(\.[0-9]*)?\s*$', 1) AS INTEGER)
      WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' END AS confidence_rating,
    CASE WHEN starts_with(note, 'image was in the Wikidata item') THEN 'wikidata'
         WHEN starts_with(note, 'image was found in the following Wikis:') THEN 'wikipedia'
         WHEN starts_with(note, 'image was found in the Commons category') THEN 'commons' END AS source,
    string_split(regexp_replace(regexp_extract(note, 'Wikis:\s+(.*)$', 1), '\s+', '', 'g'), ',') AS found_on_list,
    CASE WHEN json_valid(instance_of) THEN json_extract_string(instance_of, '$.id') END AS instance_of_id
  FROM flat
), transformed AS (
  SELECT wiki, page_id, page_title, image_id, confidence_rating, source,
         instance_of_id AS instance_of, found_on_list AS found_on,
         coalesce(NOT (instance_of_id IN (__NON_ARTICLE__)), true) AS is_article_page
  FROM parsed
), prod AS (
  SELECT *, '__DATASET_ID__' AS dataset_id, CAST(__INSERTION_TS__ AS DOUBLE) AS insertion_ts,
         '__RUN_MONTH__' AS snapshot
  FROM transformed
), export_all AS (
  SELECT page_id, page_title,
         coalesce(image_id, '') AS image_id,
         coalesce(confidence_rating, '') AS confidence_rating,
         coalesce(source, '') AS source,
         dataset_id, insertion_ts, wiki,
         coalesce(array_to_string(found_on, ','), '') AS found_on
  FROM prod WHERE snapshot = '__RUN_MONTH__' AND is_article_page
), export_android AS (
  SELECT * FROM export_all WHERE image_id <> ''
)
"""


def _sql_list(values) -> str:
    return ", ".join("NULL" if v is None else f"'{v}'" for v in values)


_PRELUDE = (
    _PRELUDE.replace("__NON_ARTICLE__", _NON_ARTICLE_SQL)
    .replace("__ENTITIES__", _sql_list(ENTITIES))
    .replace("__N_ENTITIES__", str(len(ENTITIES)))
    .replace("__RATINGS__", _sql_list(RATINGS))
    .replace("__N_RATINGS__", str(len(RATINGS)))
    .replace("__NOTES__", _sql_list(NOTES))
    .replace("__LISTED_WIKIS__", _sql_list(LISTED_WIKIS))
    .replace("__IMAGE_MODULUS__", str(IMAGE_MODULUS))
    .replace("__DATASET_ID__", RUN_DATASET_ID)
    .replace("__INSERTION_TS__", repr(RUN_INSERTION_TS))
    .replace("__RUN_MONTH__", RUN_MONTH)
)

_ALL_WIKIS_SQL = ", ".join(f"'{w}'" for w in ALL_WIKIS)

_PROD_COLUMNS = (
    "page_id, page_title, image_id, confidence_rating, source, instance_of, is_article_page, "
    "dataset_id, insertion_ts, CAST(to_json(found_on) AS VARCHAR) AS found_on, wiki, snapshot"
)
_TRANSFORM_COLUMNS = (
    "wiki, page_id, page_title, image_id, confidence_rating, source, instance_of, "
    "CAST(to_json(found_on) AS VARCHAR) AS found_on, is_article_page"
)


def _tsv_field(expr: str) -> str:
    return f"coalesce(regexp_replace(CAST({expr} AS VARCHAR), '[\\t\\n\\r]', ' ', 'g'), '\\N')"


def _tsv_oracle() -> str:
    fields = []
    for c in EXPORT_COLUMNS:
        # insertion_ts is a run constant; its text is Spark's double format.
        fields.append(f"'{RUN_INSERTION_TS_TEXT}'" if c == "insertion_ts" else _tsv_field(c))
    line = "concat_ws(chr(9), " + ", ".join(fields) + ")"
    header = "\t".join(EXPORT_COLUMNS).replace("\t", "' || chr(9) || '")
    return (
        f"SELECT {line} AS value, wiki, '{RUN_MONTH}' AS snapshot FROM export_all "
        f"WHERE wiki IN ({_ALL_WIKIS_SQL}) "
        f"UNION ALL SELECT '{header}' AS value, w AS wiki, '{RUN_MONTH}' AS snapshot "
        f"FROM (VALUES {', '.join(f'({chr(39)}{w}{chr(39)})' for w in ALL_WIKIS)}) AS t(w)"
    )


def _value_frequencies_oracle(top: int | None = 20) -> str:
    renders = {
        "page_id": "CAST(page_id AS VARCHAR)",
        "page_title": "page_title",
        "image_id": "image_id",
        "confidence_rating": "confidence_rating",
        "source": "source",
        "instance_of": "instance_of",
        "is_article_page": "CAST(is_article_page AS VARCHAR)",
        "dataset_id": "dataset_id",
        # a run constant; its text is Spark's double format
        "insertion_ts": f"'{RUN_INSERTION_TS_TEXT}'",
        "found_on": "CAST(to_json(found_on) AS VARCHAR)",
        "wiki": "wiki",
        "snapshot": "snapshot",
    }
    parts = [
        f"SELECT '{name}' AS column_name, {expr} AS value, count(*) AS \"count\" FROM prod GROUP BY 2"
        for name, expr in renders.items()
    ]
    if top is None:
        return " UNION ALL ".join(parts)
    return (
        "SELECT column_name, value, \"count\", CAST(\"rank\" AS INTEGER) AS \"rank\" FROM ("
        "SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY \"count\" DESC, value ASC NULLS FIRST) AS \"rank\" "
        f"FROM ({' UNION ALL '.join(parts)})) WHERE \"rank\" <= {top}"
    )


_ORACLE_BODIES = {
    "scan_raw": "SELECT item_id, page_id, page_title, instance_of, wiki_db, snapshot, "
    "CAST(n_candidates AS INTEGER) AS n_candidates FROM raw_pages",
    "with_candidates": "SELECT page_id, page_title, wiki_db, snapshot, CAST(n_candidates AS INTEGER) AS n_candidates "
    "FROM raw_pages WHERE n_candidates IS NULL OR n_candidates > 0",
    "explode_candidates": "SELECT wiki, page_id, page_title, image_id, rating, note, instance_of FROM exploded",
    "flatten_candidates": "SELECT wiki, page_id, page_title, image_id, rating, note, instance_of FROM flat",
    "confidence_rating": "SELECT page_id, image_id, rating, confidence_rating FROM parsed WHERE is_candidate",
    "candidate_source": "SELECT page_id, image_id, note, source FROM parsed WHERE is_candidate",
    "found_on": "SELECT page_id, image_id, note, CAST(to_json(found_on_list) AS VARCHAR) AS found_on FROM parsed WHERE is_candidate",
    "instance_of_id": "SELECT page_id, instance_of, CASE WHEN json_valid(instance_of) "
    "THEN json_extract_string(instance_of, '$.id') END AS instance_of_id FROM raw_pages",
    "is_article_page": "SELECT page_id, instance_of_id, coalesce(NOT (instance_of_id IN (__NON_ARTICLE__)), true) "
    "AS is_article_page FROM (SELECT page_id, CASE WHEN json_valid(instance_of) "
    "THEN json_extract_string(instance_of, '$.id') END AS instance_of_id FROM raw_pages)".replace(
        "__NON_ARTICLE__", _NON_ARTICLE_SQL
    ),
    "pages_without_candidates": f"SELECT {_TRANSFORM_COLUMNS} FROM transformed WHERE page_id IN "
    "(SELECT page_id FROM raw_pages WHERE n_candidates = 0)",
    "candidate_transform": f"SELECT {_TRANSFORM_COLUMNS} FROM transformed",
    "candidate_transform_two_pass": f"SELECT {_TRANSFORM_COLUMNS} FROM transformed",
    "stamped_prod": f"SELECT {_TRANSFORM_COLUMNS}, dataset_id, insertion_ts, snapshot FROM prod",
    "sorted_prod": f"SELECT {_TRANSFORM_COLUMNS}, dataset_id, insertion_ts, snapshot FROM prod",
    "prod_roundtrip": f"SELECT {_PROD_COLUMNS} FROM prod",
    "search_feed": "SELECT DISTINCT wiki AS wikiid, CAST(page_id AS INTEGER) AS page_id, 0 AS page_namespace, "
    f"'image' AS recommendation_type, {RUN.year} AS year, {RUN.month_number} AS month, {RUN.day} AS day "
    "FROM prod WHERE image_id IS NOT NULL AND is_article_page",
    "search_roundtrip": "SELECT DISTINCT wiki AS wikiid, CAST(page_id AS INTEGER) AS page_id, 0 AS page_namespace, "
    f"'image' AS recommendation_type, {RUN.year} AS year, {RUN.month_number} AS month, {RUN.day} AS day "
    "FROM prod WHERE image_id IS NOT NULL AND is_article_page",
    "export_rows": f"SELECT * FROM export_all WHERE wiki = '{EXPORT_WIKI}'",
    "export_rows_android": f"SELECT * FROM export_android WHERE wiki = '{EXPORT_WIKI}'",
    "export_all_wikis": f"SELECT * FROM export_all WHERE wiki IN ({_ALL_WIKIS_SQL})",
    "export_rows_sql": f"SELECT * FROM export_all WHERE wiki = '{EXPORT_WIKI}'",
    "export_rows_sql_android": f"SELECT * FROM export_android WHERE wiki = '{EXPORT_WIKI}'",
    "tsv_export": _tsv_oracle(),
    "monthly_tsv_export": _tsv_oracle(),
    "partition_counts": "SELECT snapshot, wiki, count(*) AS \"count\" FROM prod GROUP BY snapshot, wiki",
    "value_frequencies": _value_frequencies_oracle(),
    "value_frequencies_all": _value_frequencies_oracle(None),
    "scan_prod": f"SELECT {_PROD_COLUMNS} FROM prod",
    "row_count": "SELECT count(*) AS \"rows\" FROM prod",
    "confidence_by_source": "SELECT confidence_rating, source, count(*) AS \"count\" FROM prod "
    "GROUP BY confidence_rating, source",
    "confidence_violations": "SELECT confidence_rating, source, count(*) AS \"count\" FROM prod "
    "GROUP BY confidence_rating, source HAVING source IS DISTINCT FROM (CASE confidence_rating "
    "WHEN 'high' THEN 'wikidata' WHEN 'medium' THEN 'wikipedia' WHEN 'low' THEN 'commons' END)",
    "pages_without_image": "SELECT wiki, snapshot, count(*) AS pages FROM (SELECT wiki, snapshot, page_id FROM prod "
    "GROUP BY ALL HAVING count(image_id) = 0) GROUP BY wiki, snapshot",
    "profile_counts": "SELECT snapshot, wiki, confidence_rating, source, image_id IS NULL AS without_image, "
    "count(*) AS \"count\" FROM prod GROUP BY ALL",
    "frame_diff": f"SELECT *, 'left_only' AS side FROM (SELECT * FROM export_all WHERE wiki IN ({_ALL_WIKIS_SQL}) "
    f"EXCEPT SELECT * FROM export_android WHERE wiki IN ({_ALL_WIKIS_SQL})) "
    f"UNION ALL SELECT *, 'right_only' AS side FROM (SELECT * FROM export_android WHERE wiki IN ({_ALL_WIKIS_SQL}) "
    f"EXCEPT SELECT * FROM export_all WHERE wiki IN ({_ALL_WIKIS_SQL}))",
}

_TWO_SNAPSHOTS = (
    f"(SELECT * FROM prod WHERE page_id % 5 <> 0 UNION ALL SELECT * REPLACE ('{EARLIER_DATASET_ID}' AS dataset_id, '{EARLIER_MONTH}' AS snapshot) "
    "FROM prod WHERE page_id % 3 = 0)"
)
_BAG_COLUMNS = ", ".join(EXPORT_COLUMNS)


def _bag_difference_oracle() -> str:
    """Copies of each row on both sides, counted apart and compared."""
    new = "SELECT * REPLACE (page_title || ' (new)' AS page_title) FROM export_all WHERE page_id % 7 = 0"
    left = "SELECT * FROM export_all UNION ALL SELECT * FROM export_all WHERE page_id % 10 = 0"
    right = f"SELECT * FROM export_all WHERE page_id % 7 <> 0 UNION ALL {new} UNION ALL {new} AND page_id % 2 = 0"
    return (
        f"SELECT {_BAG_COLUMNS}, CASE WHEN sum(n) > 0 THEN 'left_only' ELSE 'right_only' END AS side, "
        f"CAST(abs(sum(n)) AS BIGINT) AS copies FROM (SELECT *, 1 AS n FROM ({left}) UNION ALL "
        f"SELECT *, -1 AS n FROM ({right})) GROUP BY {_BAG_COLUMNS} HAVING sum(n) <> 0"
    )


_ORACLE_BODIES |= {
    "frame_diff_bucketed": _ORACLE_BODIES["frame_diff"],
    "frame_diff_multiset": _bag_difference_oracle(),
    "prod_file_order": "SELECT wiki, snapshot, count(*) AS \"rows\", CAST(0 AS BIGINT) AS inversions FROM prod "
    "GROUP BY wiki, snapshot",
    "tsv_rows": "SELECT "
    + ", ".join(
        f"'{RUN_INSERTION_TS_TEXT}' AS insertion_ts" if c == "insertion_ts" else f"CAST({c} AS VARCHAR) AS {c}"
        for c in EXPORT_COLUMNS
    )
    + f", '{RUN_MONTH}' AS snapshot FROM export_all",
    "tsv_headers": f"SELECT wiki, '{RUN_MONTH}' AS snapshot, count(*) AS \"rows\", "
    "CAST(0 AS BIGINT) AS files_without_header FROM export_all GROUP BY wiki",
    "monthly_catalog_scan": f"SELECT {_PROD_COLUMNS} FROM prod",
    "monthly_catalog_search": _ORACLE_BODIES["search_feed"],
    "republished_snapshot": f"SELECT {_PROD_COLUMNS} FROM {_TWO_SNAPSHOTS}",
    "search_feed_all_snapshots": _ORACLE_BODIES["search_feed"].replace("FROM prod", f"FROM {_TWO_SNAPSHOTS}"),
    "partition_counts_all_snapshots": _ORACLE_BODIES["partition_counts"].replace("FROM prod", f"FROM {_TWO_SNAPSHOTS}"),
    "written_partition_counts": _ORACLE_BODIES["partition_counts"],
    "written_confidence": _ORACLE_BODIES["confidence_by_source"],
}
_ORACLE_BODIES["monthly_search_feed"] = _ORACLE_BODIES["search_feed"]

_EVENT_ORACLES = {
    "daily_new_pages_partitioned": "SELECT event_type AS database, count(*) AS count_of_new_pages FROM events "
    "WHERE year(ts) = 2024 AND month(ts) = 1 AND day(ts) = 15 GROUP BY event_type",
    "daily_new_pages_sql": "SELECT event_type AS database, count(*) AS count_of_new_pages FROM events "
    f"WHERE ts >= TIMESTAMP '{DAILY_DAY}' AND ts < TIMESTAMP '{DAILY_DAY}' + INTERVAL 1 DAY GROUP BY event_type",
    "daily_new_pages": "SELECT event_type AS database, count(*) AS count_of_new_pages FROM events "
    f"WHERE ts >= TIMESTAMP '{DAILY_DAY}' AND ts < TIMESTAMP '{DAILY_DAY}' + INTERVAL 1 DAY GROUP BY event_type",
    "daily_new_pages_one_database": "SELECT event_type AS database, count(*) AS count_of_new_pages FROM events "
    f"WHERE ts >= TIMESTAMP '{DAILY_DAY}' AND ts < TIMESTAMP '{DAILY_DAY}' + INTERVAL 1 DAY "
    f"AND event_type = '{DAILY_DATABASE}' GROUP BY event_type",
}


def oracle_sql() -> dict[str, str]:
    out = {name: _PRELUDE + body for name, body in _ORACLE_BODIES.items()}
    out.update(_EVENT_ORACLES)
    return out
