import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from pagerecs.operators.candidates import stamp_run, transform_candidates
from pagerecs.operators.compare import assert_frames_equal
from pagerecs.operators.search import search_feed
from pagerecs.plans.jobs import publish_exports, publish_prod, publish_search_feed
from pagerecs.plans.registry import raw_table
from pagerecs.sources.parquet import read_prod, read_search_feed
from pagerecs.sources.sinks import read_tsv
from tests.conftest import SF_SMALL, plan_text


def test_publish_prod_equals_transform_and_is_ordered(spark, tmp_path):
    raw = raw_table(spark, SF_SMALL)
    out = str(tmp_path / "prod")
    publish_prod(raw, out, "2024-02-01", "ds", 2.0)
    expected = stamp_run(transform_candidates(raw), "ds", 2.0, "2024-02")
    assert_frames_equal(read_prod(spark, out), expected, multiset=True)
    for folder in glob.glob(out + "/wiki=*/snapshot=2024-02"):
        titles = []
        for f in sorted(glob.glob(folder + "/*.parquet")):
            titles += pq.read_table(f, columns=["page_title"]).column("page_title").to_pylist()
        assert titles == sorted(titles, reverse=True)


def test_publish_prod_shuffles_pages_not_candidates(spark):
    import pagerecs.plans.jobs as jobs

    raw = raw_table(spark, SF_SMALL)
    captured = {}
    original = jobs.write_prod

    def capture(df, path, **kw):
        captured["df"] = df

    jobs.write_prod = capture
    try:
        publish_prod(raw, "/nonexistent", "2024-02-01", "ds", 2.0)
    finally:
        jobs.write_prod = original
    simple = plan_text(captured["df"], "simple")
    lines = simple.splitlines()
    exchange = next(i for i, line in enumerate(lines) if "REBALANCE_PARTITIONS" in line)
    generate = next(i for i, line in enumerate(lines) if "Generate explode" in line)
    assert generate < exchange  # explode runs above (after) the shuffle
    assert "Exchange" not in "".join(lines[:exchange])  # exactly one shuffle
    assert simple.count("Exchange") == 1


def test_publish_search_feed_and_exports(spark, tmp_path):
    raw = raw_table(spark, SF_SMALL)
    prod_dir = str(tmp_path / "prod")
    publish_prod(raw, prod_dir, "2024-02-01", "ds", 2.0)
    publish_prod(raw.where(F.col("wiki_db") == "kowiki"), prod_dir, "2024-03-01", "ds", 3.0)
    prod = read_prod(spark, prod_dir)
    search_dir = str(tmp_path / "search")
    publish_search_feed(prod, search_dir, "2024-03-01", this_month_only=True)
    got = read_search_feed(spark, search_dir)
    march = prod.where("snapshot = '2024-03'")
    assert_frames_equal(got, search_feed(march, "2024-03-01"))
    assert {r.wikiid for r in got.select("wikiid").distinct().collect()} == {"kowiki"}
    every_dir = str(tmp_path / "search-all")
    publish_search_feed(prod, every_dir, "2024-03-01")
    assert_frames_equal(read_search_feed(spark, every_dir), search_feed(prod, "2024-03-01"))
    export_dir = str(tmp_path / "export")
    publish_exports(prod, export_dir, "2024-03-01", ["kowiki", "plwiki"], android=True)
    lines = read_tsv(spark, export_dir)
    assert lines.where("wiki = 'plwiki'").count() == 1  # header only: no March rows
    n = march.where("is_article_page AND image_id IS NOT NULL").count()
    assert lines.where("wiki = 'kowiki'").count() == n + 1


def test_publish_prod_splits_a_hot_wiki(spark, tmp_path):
    raw = raw_table(spark, SF_SMALL).withColumn(
        "wiki_db", F.when(F.col("page_id") % 10 == 0, F.col("wiki_db")).otherwise(F.lit("hotwiki"))
    )
    out = str(tmp_path / "prod")
    conf = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(conf)
    spark.conf.set(conf, "4k")
    try:
        publish_prod(raw, out, "2024-02-01", "ds", 2.0)
    finally:
        spark.conf.set(conf, old)
    hot = out + "/wiki=hotwiki/snapshot=2024-02"
    files = sorted(glob.glob(hot + "/*.parquet"))
    assert len(files) > 1  # the hot wiki is spread over several tasks
    for f in files:
        titles = pq.read_table(f, columns=["page_title"]).column("page_title").to_pylist()
        assert titles == sorted(titles, reverse=True)
