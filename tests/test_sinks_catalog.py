import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from pagerecs.operators.candidates import stamp_run, transform_candidates
from pagerecs.operators.search import search_feed
from pagerecs.plans.registry import raw_table
from pagerecs.schemas import PROD_SCHEMA, RAW_SCHEMA
from pagerecs.sources.catalog import create_external_table, repair_partitions, use_database
from pagerecs.sources.parquet import read_prod, read_raw, read_search_feed
from pagerecs.sources.sinks import write_prod, write_search_feed
from tests.conftest import SF_SMALL


def _prod(spark, snapshot="2024-02"):
    return stamp_run(transform_candidates(raw_table(spark, SF_SMALL)), "ds", 1.0, snapshot)


def _titles_in_name_order(folder):
    titles = []
    for f in sorted(glob.glob(folder + "/*.parquet")):
        titles += pq.read_table(f, columns=["page_title"]).column("page_title").to_pylist()
    return titles


def _desc_nulls_last(values):
    present = [v for v in values if v is not None]
    return present == sorted(present, reverse=True) and values[len(present):] == [None] * (len(values) - len(present))


def test_prod_files_sorted_by_title_desc(spark, tmp_path):
    out = str(tmp_path / "prod")
    write_prod(_prod(spark), out)
    folders = glob.glob(out + "/wiki=*/snapshot=2024-02")
    assert len(folders) == 4
    for folder in folders:
        titles = _titles_in_name_order(folder)
        assert titles and _desc_nulls_last(titles), folder
    # data files carry the table's data columns in DDL order
    f = glob.glob(out + "/wiki=kowiki/snapshot=2024-02/*.parquet")[0]
    assert pq.read_schema(f).names == [c.name for c in PROD_SCHEMA.fields][:-2]
    assert read_prod(spark, out).count() == _prod(spark).count()


def test_prod_one_file_per_partition_option(spark, tmp_path):
    out = str(tmp_path / "prod1")
    write_prod(_prod(spark), out)
    for folder in glob.glob(out + "/wiki=*/snapshot=*"):
        files = glob.glob(folder + "/*.parquet")
        assert len(files) == 1
        assert _desc_nulls_last(_titles_in_name_order(folder))


def test_dynamic_overwrite_touches_only_written_partitions(spark, tmp_path):
    out = str(tmp_path / "prod")
    write_prod(_prod(spark, "2024-01"), out)
    write_prod(_prod(spark, "2024-02"), out)
    before = read_prod(spark, out).groupBy("snapshot").count().collect()
    assert {r.snapshot for r in before} == {"2024-01", "2024-02"}
    # rewrite only kowiki / 2024-02 with one row: every other partition stays
    one = _prod(spark, "2024-02").where(F.col("wiki") == "kowiki").limit(1)
    write_prod(one, out)
    after = read_prod(spark, out)
    assert after.where("wiki = 'kowiki' AND snapshot = '2024-02'").count() == 1
    n_other = _prod(spark).where(F.col("wiki") != "kowiki").count()
    assert after.where("snapshot = '2024-02' AND wiki <> 'kowiki'").count() == n_other
    assert after.where("snapshot = '2024-01'").count() == _prod(spark).count()


def test_search_feed_int_partitions(spark, tmp_path):
    prod = _prod(spark)
    out = str(tmp_path / "search")
    write_search_feed(search_feed(prod, "2024-02-01"), out)
    assert glob.glob(out + "/year=2024/month=2/day=1/*.parquet")
    back = read_search_feed(spark, out)
    assert back.count() == search_feed(prod, "2024-02-01").count()
    assert dict(back.dtypes)["month"] == "int"
    write_search_feed(search_feed(prod, "2024-02-02"), out)  # new day, old one kept
    assert read_search_feed(spark, out).select("day").distinct().count() == 2


def test_external_tables_and_repair(spark, tmp_path):
    raw_dir = str(tmp_path / "raw")
    prod_dir = str(tmp_path / "prod")
    search_dir = str(tmp_path / "search")
    raw = raw_table(spark, SF_SMALL).where("snapshot IN ('1995-01', '1995-02')")
    raw.write.partitionBy("wiki_db", "snapshot").parquet(raw_dir)
    prod = _prod(spark)
    write_prod(prod, prod_dir)
    write_search_feed(search_feed(prod, "2024-02-01"), search_dir)

    t_raw = create_external_table(spark, "raw", raw_dir, database="pagerecs_test")
    t_prod = create_external_table(spark, "prod", prod_dir, database="pagerecs_test")
    t_search = create_external_table(spark, "search", search_dir, database="pagerecs_test")
    assert spark.table(t_raw).schema == RAW_SCHEMA
    assert spark.table(t_raw).count() == raw.count()
    assert len(spark.sql(f"SHOW PARTITIONS {t_raw}").collect()) == 8
    assert len(spark.sql(f"SHOW PARTITIONS {t_prod}").collect()) == 4
    assert spark.table(t_search).count() == search_feed(prod, "2024-02-01").count()
    # idempotent
    create_external_table(spark, "prod", prod_dir, database="pagerecs_test")
    # a new load shows up after repair
    write_prod(_prod(spark, "2024-03"), prod_dir)
    repair_partitions(spark, t_prod)
    assert len(spark.sql(f"SHOW PARTITIONS {t_prod}").collect()) == 8
    use_database(spark, "pagerecs_test")
    try:
        assert spark.table("imagerec_prod").where("snapshot = '2024-03'").count() == prod.count()
    finally:
        use_database(spark, "default")


def test_read_raw_enforces_schema(spark, tmp_path):
    raw_dir = str(tmp_path / "raw")
    raw_table(spark, SF_SMALL).write.partitionBy("wiki_db", "snapshot").parquet(raw_dir)
    assert read_raw(spark, raw_dir).schema == RAW_SCHEMA


def test_prod_order_puts_null_titles_last(spark, tmp_path):
    prod = _prod(spark).withColumn(
        "page_title", F.when(F.col("page_id") % 5 == 0, F.lit(None)).otherwise(F.col("page_title"))
    )
    out = str(tmp_path / "prod")
    write_prod(prod, out)
    for folder in glob.glob(out + "/wiki=*/snapshot=*"):
        titles = _titles_in_name_order(folder)
        assert None in titles and _desc_nulls_last(titles)


def test_hot_partition_is_split_across_tasks(spark, tmp_path):
    # one wiki holds ~90% of the rows: the rebalance spreads it
    # over several tasks (files) instead of funnelling it into one
    prod = _prod(spark).withColumn(
        "wiki", F.when(F.col("page_id") % 10 == 0, F.col("wiki")).otherwise(F.lit("hotwiki"))
    )
    out = str(tmp_path / "prod")
    conf = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(conf)
    spark.conf.set(conf, "4k")
    try:
        write_prod(prod, out)
    finally:
        spark.conf.set(conf, old)
    hot = out + "/wiki=hotwiki/snapshot=2024-02"
    assert len(glob.glob(hot + "/*.parquet")) > 1
    assert read_prod(spark, out).count() == prod.count()


def test_catalog_table_prunes_partitions_before_listing(spark, tmp_path):
    from pagerecs.sources.parquet import is_table_name, open_raw

    raw_dir = str(tmp_path / "raw")
    raw = raw_table(spark, SF_SMALL).where("snapshot IN ('1995-01', '1995-02', '1995-03')")
    raw.write.partitionBy("wiki_db", "snapshot").parquet(raw_dir)
    table = create_external_table(spark, "raw", raw_dir, database="pagerecs_prune", name="raw_prune")
    assert is_table_name(table) and not is_table_name(raw_dir) and not is_table_name("hdfs:x")
    one = open_raw(spark, table).where("snapshot = '1995-02'")
    from tests.conftest import plan_text

    location = next(line for line in plan_text(one).splitlines() if line.startswith("Location:"))
    # catalog-tracked partitions: the file index holds only the matching folders
    assert "snapshot=1995-02" in location and "1995-01" not in location and "1995-03" not in location
    assert one.count() == raw.where("snapshot = '1995-02'").count()
    by_path = plan_text(open_raw(spark, raw_dir).where("snapshot = '1995-02'"))
    path_location = next(line for line in by_path.splitlines() if line.startswith("Location:"))
    assert "snapshot=" not in path_location  # a path read indexes the whole table root


def test_repair_adds_by_default_and_syncs_on_request(spark, tmp_path):
    prod_dir = str(tmp_path / "prod")
    write_prod(_prod(spark, "2024-01"), prod_dir)
    table = create_external_table(spark, "prod", prod_dir, database="pagerecs_repair")
    assert len(spark.sql(f"SHOW PARTITIONS {table}").collect()) == 4
    # a catalog partition outside the table folder (the catalog creates it)
    other = str(tmp_path / "elsewhere")
    spark.sql(f"ALTER TABLE {table} ADD PARTITION (wiki='xxwiki', snapshot='2024-01') LOCATION '{other}'")
    write_prod(_prod(spark, "2024-02"), prod_dir)
    repair_partitions(spark, table)
    assert len(spark.sql(f"SHOW PARTITIONS {table}").collect()) == 9  # new folders added, nothing dropped
    repair_partitions(spark, table, sync=True)  # drops only partitions whose folder is gone
    assert len(spark.sql(f"SHOW PARTITIONS {table}").collect()) == 9


def test_materialize_once_reuses_complete_builds_only(spark, tmp_path):
    import uuid

    from pagerecs.sources import storage

    calls = []

    def build(path):
        calls.append(path)
        spark.range(3).write.parquet(path)

    key = f"test-{uuid.uuid4().hex}"
    p1 = storage.materialize_once(spark, key, build, "v1")
    assert storage.materialize_once(spark, key, build, "v1") == p1 and len(calls) == 1
    storage._MATERIALIZED.clear()  # as a new process would start
    assert storage.materialize_once(spark, key, build, "v1") == p1 and len(calls) == 1
    p2 = storage.materialize_once(spark, key, build, "v2")  # new fingerprint -> new build
    assert p2 != p1 and len(calls) == 2

    def failing(path):
        raise RuntimeError("build failed")

    import pytest

    key2 = f"test-{uuid.uuid4().hex}"
    with pytest.raises(RuntimeError):
        storage.materialize_once(spark, key2, failing, "v1")
    storage._MATERIALIZED.clear()
    assert storage.materialize_once(spark, key2, build, "v1") not in (p1, p2)  # no marker was left
    assert spark.read.parquet(p1).count() == 3


def test_scratch_root_refuses_local_folder_on_a_cluster(monkeypatch):
    import pytest

    from pagerecs.sources import storage

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

        @property
        def sparkContext(self):
            class Context:
                def getCheckpointDir(self):
                    return None

            return Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.scratch_root(Session())
