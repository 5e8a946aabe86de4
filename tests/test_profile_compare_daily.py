import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagerecs.operators.candidates import stamp_run, transform_candidates
from pagerecs.operators.compare import LEFT_ONLY, RIGHT_ONLY, assert_frames_equal, frame_diff, frames_equal
from pagerecs.operators.daily import daily_new_pages
from pagerecs.operators.profile import (
    confidence_by_source,
    confidence_violations,
    pages_without_image,
    partition_counts,
    row_count,
    value_frequencies,
)
from pagerecs.plans.params import Snapshot, running_date
from tests.conftest import MONTH, SF_SMALL, plan_text


@pytest.fixture(scope="module")
def prod(raw_data):
    return stamp_run(transform_candidates(raw_data), "ds-1", 5.0, MONTH)


def test_partition_counts_and_row_count(prod):
    older = prod.where("wiki = 'cswiki'").withColumn("snapshot", F.lit("2023-08"))
    counts = partition_counts(prod.unionByName(older)).collect()
    assert [tuple(r) for r in counts] == [(MONTH, "cswiki", 3), (MONTH, "svwiki", 3), ("2023-08", "cswiki", 3)]
    assert row_count(prod).collect()[0].rows == 6


def test_confidence_checks(prod, spark):
    got = {(r.confidence_rating, r.source): r["count"] for r in confidence_by_source(prod).collect()}
    assert got == {("medium", "wikipedia"): 2, ("high", "wikidata"): 1, ("low", "commons"): 1, (None, None): 2}
    assert confidence_violations(prod).count() == 0
    bad = prod.withColumn("source", F.when(F.col("image_id") == "slab.png", "commons").otherwise(F.col("source")))
    assert [tuple(r) for r in confidence_violations(bad).collect()] == [("high", "commons", 1)]
    # a rated candidate without a known source is a violation too
    orphan = prod.withColumn("source", F.when(F.col("image_id") == "pit.png", None).otherwise(F.col("source")))
    assert [tuple(r) for r in confidence_violations(orphan).collect()] == [("low", None, 1)]


def test_pages_without_image(prod):
    assert [tuple(r) for r in pages_without_image(prod).collect()] == [("svwiki", MONTH, 1)]


def test_value_frequencies(prod, spark):
    vf = value_frequencies(prod, top=2)
    rows = {(r.column, r.rank): (r.value, r["count"]) for r in vf.collect()}
    assert rows[("wiki", 1)] == ("cswiki", 3) and rows[("wiki", 2)] == ("svwiki", 3)  # ties broken by value
    assert rows[("instance_of", 1)] == (None, 3) and rows[("instance_of", 2)] == ("Q820477", 2)
    assert rows[("found_on", 1)] == (None, 2) and rows[("found_on", 2)] == ('[""]', 2)  # NULL first
    assert rows[("is_article_page", 1)] == ("true", 5)
    assert {c for c, _ in rows} == set(prod.columns)
    assert vf.where("rank > 2").count() == 0
    only = value_frequencies(prod, 20, ["source"])
    assert only.count() == 4 and {r.column for r in only.collect()} == {"source"}


def test_value_frequencies_limits_before_shuffle(prod):
    plan = plan_text(value_frequencies(prod, top=20))
    assert "WindowGroupLimit" in plan and "Partial" in plan and "Final" in plan
    # one pass for all columns: a single generator, one aggregation shuffle
    # and two ranking shuffles, by groups of tasks and then by column
    simple = plan_text(value_frequencies(prod, top=20), "simple")
    assert simple.count("Generate inline") == 1
    assert simple.count("Exchange hashpartitioning") == 3


def test_frame_diff_of_bags(lakes, spark):
    same = lakes.orderBy("depth")
    assert frames_equal(lakes, same, multiset=True)
    assert_frames_equal(lakes, same.select("depth", "name"), multiset=True)  # by name, not position
    other = spark.createDataFrame([("Tarn", None), ("Mere", 3.5), ("Loch", 8.0), ("Loch", 8.0)], lakes.schema)
    got = sorted((tuple(r) for r in frame_diff(lakes, other).collect()), key=repr)
    assert got == [("Loch", 8.0, RIGHT_ONLY), ("Loch", 9.0, LEFT_ONLY)]
    multi = {tuple(r) for r in frame_diff(lakes, other, multiset=True).collect()}
    assert multi == {("Loch", 8.0, RIGHT_ONLY, 2), ("Loch", 9.0, LEFT_ONLY, 1), ("Tarn", None, LEFT_ONLY, 1)}
    assert frames_equal(lakes, lakes.distinct()) and not frames_equal(lakes, lakes.distinct(), multiset=True)
    with pytest.raises(ValueError):
        frame_diff(lakes.withColumn("extra", F.lit(1)), lakes)
    assert frames_equal(lakes, same.withColumn("extra", F.lit(1)))  # extra right-hand columns are ignored


def test_frame_diff_takes_columns_of_any_name(spark):
    a = spark.createDataFrame([(1, 2, 3)], ["_l", "_copies_left", "_copies_right"])
    b = spark.createDataFrame([(1, 2, 4)], ["_l", "_copies_left", "_copies_right"])
    assert frame_diff(a, b).count() == 2 and frames_equal(a, a)


def test_pages_without_image_counts_pages(spark):
    rows = [("w", "s", 1, None), ("w", "s", 1, None), ("w", "s", 2, None), ("w", "s", 2, "a.jpg"), ("w", "s", 3, "b.jpg")]
    prod = spark.createDataFrame(rows, "wiki string, snapshot string, page_id int, image_id string")
    assert [r.pages for r in pages_without_image(prod).collect()] == [1]


def test_frame_diff_nulls_and_arrays(spark):
    a = spark.createDataFrame([(None, ["x"]), ("k", None)], "k string, v array<string>")
    b = spark.createDataFrame([(None, ["x"]), ("k", [])], "k string, v array<string>")
    got = sorted(((r.k, r.v, r.side) for r in frame_diff(a, b).collect()), key=repr)
    assert got == sorted([("k", None, LEFT_ONLY), ("k", [], RIGHT_ONLY)], key=repr)


def test_frame_diff_is_one_aggregation(lakes):
    plan = plan_text(frame_diff(lakes, lakes), "simple")
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan


def test_daily_new_pages_on_events(spark):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    got = daily_new_pages(events, "2024-01-15", database_col="event_type", ts_col="ts")
    day = events.where((F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"))
                       & (F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")))
    expected = {r.event_type: r["count"] for r in day.groupBy("event_type").count().collect()}
    assert {r.database: r.count_of_new_pages for r in got.collect()} == expected
    one = daily_new_pages(events, dt.date(2024, 1, 15), "signup", database_col="event_type", ts_col="ts").collect()
    assert [(r.database, r.count_of_new_pages) for r in one] == [("signup", expected["signup"])]
    assert daily_new_pages(events, "2023-06-01", database_col="event_type", ts_col="ts").count() == 0
    plan = plan_text(got)
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed


def test_daily_new_pages_partitioned_events(spark):
    events = spark.createDataFrame(
        [("enwiki", 2024, 1, 14), ("enwiki", 2024, 1, 15), ("enwiki", 2024, 1, 15), ("dewiki", 2024, 1, 15)],
        "database string, year int, month int, day int",
    )
    got = {r.database: r.count_of_new_pages for r in daily_new_pages(events, "2024-01-15").collect()}
    assert got == {"enwiki": 2, "dewiki": 1}
    one = daily_new_pages(events, running_date(dt.date(2024, 1, 16)), "enwiki").collect()
    assert [tuple(r) for r in one] == [("enwiki", 2)]


def test_run_parameters():
    assert running_date(dt.date(2024, 3, 1)) == dt.date(2024, 2, 29)
    assert running_date(dt.date(2024, 3, 1), num_days=0) == dt.date(2024, 3, 1)
    assert running_date(dt.datetime(2024, 1, 1, 5)) == dt.date(2023, 12, 31)
    assert running_date() == dt.date.today() - dt.timedelta(days=1)
    s = Snapshot.parse("2021-11-22")
    assert (s.month, s.year, s.month_number, s.day, str(s)) == ("2021-11", 2021, 11, 22, "2021-11-22")
    for bad in ("2021-11", "2021-13-01", "22-11-2021", "", None, "2021-02-30"):
        with pytest.raises(ValueError):
            Snapshot.parse(bad)


def test_schema_text(prod):
    from pagerecs.operators.profile import schema_text

    text = schema_text(prod)
    assert text.startswith("root\n") and " |-- found_on: array (nullable = true)" in text


def test_profile_reports_match_single_reports(prod, spark):
    from pagerecs.operators.profile import profile_reports

    reports = profile_reports(prod)
    assert_frames_equal(reports["partition_counts"], partition_counts(prod), multiset=True)
    assert_frames_equal(reports["confidence_by_source"], confidence_by_source(prod), multiset=True)
    assert_frames_equal(reports["confidence_violations"], confidence_violations(prod), multiset=True)
    assert_frames_equal(reports["pages_without_image"], pages_without_image(prod), multiset=True)
    assert reports["row_count"].collect()[0].rows == 6
    assert dict(reports["row_count"].dtypes)["rows"] == "bigint"
    # reports read the checkpointed summary, not the data
    assert "ExistingRDD" in plan_text(reports["confidence_by_source"], "simple")
    empty = profile_reports(prod.where("false"), materialize=False)
    assert empty["row_count"].collect()[0].rows == 0


def test_daily_new_pages_sql_matches_dataframe(spark):
    from pagerecs.operators.daily import daily_new_pages_sql

    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    events.createOrReplaceTempView("events_sql_test")
    for db in (None, "signup"):
        assert_frames_equal(
            daily_new_pages_sql(spark, "events_sql_test", "2024-01-15", db, database_col="event_type", ts_col="ts"),
            daily_new_pages(events, "2024-01-15", db, database_col="event_type", ts_col="ts"),
            multiset=True,
        )
    spark.createDataFrame(
        [("enwiki", 2024, 1, 15), ("enwiki", 2024, 1, 15), ("de'wiki", 2024, 1, 15), ("enwiki", 2024, 1, 14)],
        "database string, year int, month int, day int",
    ).createOrReplaceTempView("page_create_sql_test")
    got = {tuple(r) for r in daily_new_pages_sql(spark, "page_create_sql_test", "2024-01-15").collect()}
    assert got == {("enwiki", 2), ("de'wiki", 1)}
    assert daily_new_pages_sql(spark, "page_create_sql_test", "2024-01-15", "x' OR '1'='1").count() == 0
