"""The derived raw table on rows of our own, and what its shuffles and the publishing write carry."""

import datetime

import pagerecs.sources.derived as derived
from pagerecs.operators.profile import ProfileWrite
from pagerecs.operators.candidates import transform_candidates
from pagerecs.plans.jobs import prod_rows_for_write, publish_prod
from pagerecs.schemas import NON_ARTICLE_INSTANCES, RAW_SCHEMA
from tests.conftest import plan_text

DAY = datetime.datetime(2023, 9, 12)
#: order 4 twice, one order without a key, 97 with a NULL array, 5 without line items
ORDERS = [(4, 2, DAY), (4, 3, DAY), (None, 0, DAY), (97, 1, DAY), (5, 0, DAY), (6, None, None)]
#: a line item twice, one without an order, one without a key, ones with NULLs
LINES = [(4, 1, 7), (4, 1, 7), (4, 2, 23), (6, 3, None), (6, None, 9), (97, 1, 1), (1000, 1, 1), (None, 1, 1)]


def tables(spark):
    orders = spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long, o_orderdate timestamp")
    return orders, spark.createDataFrame(LINES, "l_orderkey long, l_linenumber int, l_partkey long")


def expected_raw():
    item = "image was in the Wikidata item of this page"
    listed = "image was found in the following Wikis: "
    seven = (("image", "img_7.jpg"), ("note", item), ("rating", "1"))
    nine = (("image", "img_9.jpg"),)
    three = (("note", "image was found in the Commons category that bears its name"),)
    of_four = sorted([seven, seven, (("note", listed), ("rating", "2.0"))])
    entity = {k: f'{{"id":"{NON_ARTICLE_INSTANCES[k]}","entity-type":"item"}}' for k in (4, 5, 6, 7)}
    month = "2023-09"
    return [
        ("Q4", 4, "Page 4", of_four, entity[4], "arwiki", month),
        ("Q4", 4, "Page 4", of_four, entity[4], "enwiki", month),
        (None, None, None, [], None, "kowiki", month),
        ("Q97", 97, "Page 97", None, entity[7], "plwiki", month),
        ("Q5", 5, "Page 5", [], entity[5], "kowiki", month),
        ("Q6", 6, "Page 6", sorted([nine, three]), entity[6], "arwiki", None),  # as the SQL's ELSE gives
    ]


def found_raw(raw):
    def maps(top):
        return None if top is None else sorted(tuple(sorted(m.items())) for m in top)

    return [tuple(maps(v) if name == "top_candidates" else v for name, v in r.asDict().items()) for r in raw.collect()]


def test_derived_raw_rows(spark, monkeypatch):
    for rows_per_task in (derived.ROWS_PER_TASK, 1):
        monkeypatch.setattr(derived, "ROWS_PER_TASK", rows_per_task)
        raw = derived.derive_raw(*tables(spark))
        assert [(f.name, f.dataType) for f in raw.schema] == [(f.name, f.dataType) for f in RAW_SCHEMA]
        assert sorted(found_raw(raw), key=repr) == sorted(expected_raw(), key=repr)


def test_derived_raw_shuffles_numbers_not_maps(spark):
    plan = plan_text(derived.derive_raw(*tables(spark)), "simple")
    lines = plan.splitlines()
    gather = next(i for i, line in enumerate(lines) if "REBALANCE_PARTITIONS" in line)
    assert any("map_filter" in line for line in lines[:gather])  # the maps are made after the last shuffle
    assert not any("map_filter" in line or "img_" in line for line in lines[gather:])
    assert "rangepartitioning" not in plan  # whose sampling would run the join twice


def test_derived_raw_deals_large_inputs_over_more_tasks(spark, monkeypatch):
    shuffle_partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders, lineitem = tables(spark)
    many = lineitem.unionByName(lineitem)
    monkeypatch.setattr(derived, "ROWS_PER_TASK", 1)
    tasks = many.count()
    assert tasks > shuffle_partitions
    plan = plan_text(derived.gather_pages(orders, many), "simple")
    assert plan.count(f", {tasks}), REPARTITION_BY_NUM") == 2
    assert plan.count("Exchange") == 2


def test_profiled_write_sorts_once(spark, raw_data, tmp_path):
    counts = ProfileWrite("2023-09", ["svwiki", "cswiki"])
    rows = prod_rows_for_write(raw_data, "2023-09-12", "ds", 1.0, counts=counts)
    lines = plan_text(rows, "simple").splitlines()
    sort = next(i for i, line in enumerate(lines) if "Sort [" in line)
    observe = next(i for i, line in enumerate(lines) if "CollectMetrics" in line)
    assert sort < observe  # the sort is the writer's input, and the rows are counted below it
    reports = publish_prod(raw_data, str(tmp_path / "prod"), "2023-09-12", "ds", 1.0, profile=True).reports(spark)
    found = {tuple(r) for r in reports["partition_counts"].collect()}
    assert found == {("2023-09", "svwiki", 3), ("2023-09", "cswiki", 3)}


def test_transform_parses_a_rating_once(spark, raw_data):
    plan = next(p for p in plan_text(transform_candidates(raw_data), "simple").splitlines() if "[0-9]+" in p)
    assert plan.count("[0-9]+") == 1
