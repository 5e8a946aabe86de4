"""Publishing through the catalog, reports of the write itself, order and digests."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from pagerecs.operators.candidates import stamp_run, transform_candidates
from pagerecs.operators.compare import (
    assert_frames_equal,
    bucket_digests,
    bucketed_frame_diff,
    differing_buckets,
    frame_diff,
)
from pagerecs.operators.profile import (
    ProfileWrite,
    confidence_by_source,
    confidence_violations,
    partition_counts,
    value_frequencies,
)
from pagerecs.plans.jobs import publish_prod
from pagerecs.plans.monthly import run_monthly
from pagerecs.sources.catalog import create_external_table
from pagerecs.sources.sinks import file_order, write_prod
from pagerecs.sources.snapshots import (
    drop_unused_runs,
    partition_locations,
    point_partitions,
    publish_partitions,
    table_location,
)
from pagerecs.schemas import PROD_PARTITION_COLUMNS
from tests.conftest import DAY, MONTH, plan_text


@pytest.fixture
def table(spark, tmp_path):
    return create_external_table(spark, "prod", str(tmp_path / "prod"), name="t" + uuid.uuid4().hex, repair=False)


def month_rows(raw_data, month, dataset="d", where="true"):
    return stamp_run(transform_candidates(raw_data).where(where), dataset, 1.0, month)


def publish(spark, table, rows):
    return publish_partitions(spark, table, lambda path: write_prod(rows, path))


def seen(spark, table):
    return sorted((r.wiki, r.snapshot, r.dataset_id, r.page_id) for r in spark.table(table).distinct().collect())


def test_a_run_replaces_its_partitions_and_no_other(spark, raw_data, table):
    assert sorted(publish(spark, table, month_rows(raw_data, "2023-08", "old"))) == [("cswiki", "2023-08"), ("svwiki", "2023-08")]
    publish(spark, table, month_rows(raw_data, MONTH, "first"))
    publish(spark, table, month_rows(raw_data, MONTH, "second", "wiki = 'svwiki'"))
    found = {(r.wiki, r.snapshot): r.dataset_id for r in spark.table(table).collect()}
    assert found == {
        ("cswiki", "2023-08"): "old", ("svwiki", "2023-08"): "old", ("cswiki", MONTH): "first", ("svwiki", MONTH): "second"}
    # what a filter reads is the partition's own folder, nothing else of the table
    one = spark.table(table).where(f"wiki = 'svwiki' and snapshot = '{MONTH}'")
    place = partition_locations(spark, table, PROD_PARTITION_COLUMNS)["svwiki", MONTH]
    assert one.count() == 3 and all(f.split("/part-")[0].endswith(place.split(":")[-1].lstrip("/")) for f in one.inputFiles())
    assert "PartitionFilters: [isnotnull(wiki" in plan_text(one)


def test_a_failed_run_leaves_the_table_as_it_was(spark, raw_data, table):
    publish(spark, table, month_rows(raw_data, MONTH, "whole"))
    before = seen(spark, table)
    broken = month_rows(raw_data, MONTH, "half").withColumn(
        "image_id", F.when(F.col("page_id") == 37, F.raise_error(F.lit("lost"))).otherwise(F.col("image_id"))
    )
    with pytest.raises(Exception, match="lost"):
        publish(spark, table, broken.repartition(4, "page_id"))
    assert seen(spark, table) == before
    publish(spark, table, month_rows(raw_data, MONTH, "again"))
    assert {d for _, _, d, _ in seen(spark, table)} == {"again"}


def test_a_stopped_run_is_finished_by_repeating_it(spark, raw_data, table, tmp_path):
    publish(spark, table, month_rows(raw_data, MONTH, "old"))
    folder = f"{table_location(spark, table)}/_runs/resumed"
    write_prod(month_rows(raw_data, MONTH, "new"), folder)
    place = f"{folder}/wiki=cswiki/snapshot={MONTH}"
    spark.sql(f"ALTER TABLE {table} PARTITION (wiki = 'cswiki', snapshot = '{MONTH}') SET LOCATION '{place}'")
    assert {d for _, _, d, _ in seen(spark, table)} == {"old", "new"}
    for _ in range(2):
        point_partitions(spark, table, folder, PROD_PARTITION_COLUMNS)
        assert {d for _, _, d, _ in seen(spark, table)} == {"new"}


def test_runs_that_nothing_points_into_can_be_dropped(spark, raw_data, table):
    assert drop_unused_runs(spark, table) == []
    publish(spark, table, month_rows(raw_data, MONTH, "a"))
    publish(spark, table, month_rows(raw_data, MONTH, "b", "wiki = 'svwiki'"))
    assert drop_unused_runs(spark, table) == []  # cswiki is still that of the first run
    publish(spark, table, month_rows(raw_data, MONTH, "c"))
    assert len(drop_unused_runs(spark, table)) == 2
    assert {d for _, _, d, _ in seen(spark, table)} == {"c"} and spark.table(table).count() == 6


def test_values_with_marks_are_partitions_too(spark, raw_data, table):
    odd = [month_rows(raw_data, MONTH).withColumn("wiki", F.lit(w).cast("string")) for w in ("o'wi ki=%+", "x/y", None)]
    for rows in odd:
        publish(spark, table, rows)
        publish(spark, table, rows.limit(1))
    assert sorted(r.wiki or "" for r in spark.table(table).collect()) == ["", "o'wi ki=%+", "x/y"]
    assert set(partition_locations(spark, table, PROD_PARTITION_COLUMNS)) == {
        ("o'wi ki=%+", MONTH), ("x/y", MONTH), (None, MONTH)}


def test_monthly_run_through_the_catalog(spark, raw_data, tmp_path):
    raw = str(tmp_path / "raw")
    raw_data.write.partitionBy("wiki_db", "snapshot").parquet(raw)
    database = "monthly_" + uuid.uuid4().hex[:8]
    paths = {"search_path": str(tmp_path / "search"), "export_path": str(tmp_path / "export"), "wikis": ["svwiki"]}
    res = run_monthly(spark, raw, str(tmp_path / "prod"), DAY, dataset_id="one", database=database, **paths)
    assert spark.table(res.prod_table).count() == 6
    assert {r.page_id for r in spark.table(res.search_table).collect()} == {21, 37}
    # a raw partition that arrives later is registered by the next run
    raw_data.where("page_id = 37").withColumn("snapshot", F.lit("2023-10")).write.mode("append").partitionBy(
        "wiki_db", "snapshot").parquet(raw)
    res = run_monthly(spark, raw, str(tmp_path / "prod"), "2023-10-01", source_snapshot="2023-10", dataset_id="two",
                      database=database, **paths)
    table = spark.table(res.prod_table)
    assert {(r.snapshot, r.dataset_id): r["count"] for r in table.groupBy("snapshot", "dataset_id").count().collect()} == {
        (MONTH, "one"): 6, ("2023-10", "two"): 2}
    assert [(r.snapshot, r.wiki, r["count"]) for r in res.profile["partition_counts"].collect()] == [("2023-10", "cswiki", 2)]
    days = {(r.year, r.month, r.day) for r in spark.table(res.search_table).collect()}
    assert days == {(2023, 9, 12), (2023, 10, 1)}
    shown = spark.table(res.prod_table).where("snapshot = '2023-10'")
    assert len({f.rsplit("/", 1)[0] for f in shown.inputFiles()}) == 1


def test_reports_come_from_the_write(spark, raw_data, tmp_path):
    path = str(tmp_path / "prod")
    reports = publish_prod(raw_data, path, MONTH, "d", 1.0, profile=True).reports(spark)
    assert all("FileScan" not in plan_text(r, "simple") for r in reports.values())
    prod = spark.read.parquet(path)
    assert_frames_equal(reports["partition_counts"], partition_counts(prod), multiset=True)
    assert_frames_equal(reports["confidence_by_source"], confidence_by_source(prod), multiset=True)
    assert_frames_equal(reports["confidence_violations"], confidence_violations(prod), multiset=True)
    assert [r.rows for r in reports["row_count"].collect()] == [6]
    assert file_order(prod.select("*", "_metadata")).count() == 2


def test_reports_do_not_miss_a_wiki(spark, raw_data):
    counts = ProfileWrite(MONTH, ["svwiki"])
    counts.observe(month_rows(raw_data, MONTH)).collect()
    with pytest.raises(ValueError):
        counts.reports(spark)


def test_file_order_finds_rising_titles(spark, raw_data, tmp_path):
    rows = month_rows(raw_data, MONTH)
    sorted_path, risen_path = str(tmp_path / "sorted"), str(tmp_path / "risen")
    write_prod(rows, sorted_path)
    rows = rows.coalesce(1).withColumn("page_title", F.when(F.col("page_id") != 22, F.col("page_title")))
    write_prod(rows.sortWithinPartitions("wiki", "snapshot", F.asc_nulls_first("page_title"), "image_id"), risen_path, sort=False)
    fine = file_order(spark.read.parquet(sorted_path)).collect()
    assert {(r.wiki, r.rows, r.inversions) for r in fine} == {("cswiki", 3, 0), ("svwiki", 3, 0)}
    bad = file_order(spark.read.parquet(risen_path)).collect()
    # cswiki: Alder before two mills; svwiki: no title before two quarries
    assert {(r.wiki, r.rows, r.inversions) for r in bad} == {("cswiki", 3, 1), ("svwiki", 3, 1)}


def test_frequencies_are_ranked_in_two_levels(spark):
    df = spark.range(0, 5000, 1, 16).selectExpr("id % 4999 AS near_unique", "id % 3 AS few")
    top = value_frequencies(df, top=5)
    got = [(r.column, r["rank"], r.value, r["count"]) for r in top.orderBy("column", "rank").collect()]
    assert got == [
        ("few", 1, "0", 1667), ("few", 2, "1", 1667), ("few", 3, "2", 1666), ("near_unique", 1, "0", 2),
        *[("near_unique", 2 + k, v, 1) for k, v in enumerate(sorted(map(str, range(1, 4999)))[:4])]]
    plan = plan_text(top, "simple")
    assert plan.count("WindowGroupLimit") == 4 and "hashpartitioning(column#" in plan and "salt#" in plan


def test_bucketed_difference_equals_the_whole_one(spark):
    rng = random.Random(4)
    schema = "k int, v string, a array<string>, bucket double"
    for _ in range(4):
        def bag(n):
            return [(rng.choice([None, 1, 2]), rng.choice([None, "", "x"]), rng.choice([None, [], ["x", None]]),
                     rng.choice([None, 0.5])) for _ in range(n)]
        common = bag(30)
        left = spark.createDataFrame(common + bag(6), schema).repartition(3)
        right = spark.createDataFrame(common[::-1] + bag(4), schema).withColumn("extra", F.lit(1))
        for multiset in (False, True):
            want = frame_diff(left, right, multiset).collect()
            got = bucketed_frame_diff(left, right, multiset, buckets=7).collect()
            assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_equal_tables_have_equal_digests_whatever_their_order(spark):
    df = spark.range(2000).selectExpr("id % 700 AS a", "cast(id AS string) AS b")
    other = df.orderBy(F.desc("b")).repartition(7)
    assert differing_buckets(df, other, 64).isEmpty()
    assert differing_buckets(df, other.where("b <> '5'"), 64).count() == 1
    assert differing_buckets(df, other.unionByName(other.where("b = '5'")), 64).count() == 1
    assert bucket_digests(df, 64).agg(F.sum("rows")).first()[0] == 2000
    with pytest.raises(ValueError):
        bucketed_frame_diff(df, df.drop("b"))
