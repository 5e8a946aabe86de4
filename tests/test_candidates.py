from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagerecs.operators.candidates import (
    TRANSFORM_COLUMNS,
    explode_candidates,
    flatten_candidates,
    pages_without_candidates,
    stamp_run,
    transform_candidates,
    transform_candidates_two_pass,
    with_candidates,
)
from pagerecs.operators.compare import assert_frames_equal
from pagerecs.schemas import RAW_SCHEMA, SchemaMismatchError, require_schema
from pagerecs.sources.parquet import read_raw
from tests.conftest import MONTH, WIKIDATA_NOTE, WIKIS_NOTE, plan_text


def test_golden_transform(raw_data):
    out = transform_candidates(raw_data)
    assert tuple(out.columns) == TRANSFORM_COLUMNS
    got = Counter((*r[:7], tuple(r.found_on) if r.found_on is not None else None, r.is_article_page) for r in out.collect())
    assert got == Counter(
        [
            ("svwiki", 21, "Granite quarry", "slab.png", "high", "wikidata", "Q820477", ("",), True),
            ("svwiki", 21, "Granite quarry", "pit.png", "low", "commons", "Q820477", ("",), True),
            ("svwiki", 22, "Ferry timetable", None, None, None, None, None, True),
            ("cswiki", 35, "Alder (surname)", "alder.svg", "medium", "wikipedia", "Q101352", ("nowiki", "dawiki"), False),
            ("cswiki", 37, "Salt mill", "mill.tif", None, None, None, None, True),
            ("cswiki", 37, "Salt mill", "wheel.tif", "medium", "wikipedia", None, ("plwiki",), True),
        ]
    )


def test_null_array_page_vanishes_and_edge_candidates(spark):
    raw = spark.createDataFrame(
        [
            ("Q1", 1, "null array", None, None, "kowiki", "2024-01"),
            ("Q2", 2, "partial maps", [{"image": "a.jpg"}, {"rating": "2", "note": WIKIDATA_NOTE}, None],
             "{bad", "kowiki", "2024-01"),
            ("Q3", 3, "odd ratings", [{"image": "b.jpg", "rating": "1.9", "note": "unknown"},
                                      {"image": "c.jpg", "rating": "abc", "note": WIKIS_NOTE}],
             '{"id":"Q13406463"}', "kowiki", "2024-01"),
        ],
        RAW_SCHEMA,
    )
    out = transform_candidates(raw)
    rows = {(r.page_id, r.image_id): r for r in out.collect()}
    assert 1 not in {p for p, _ in rows}
    assert out.count() == 5
    r = rows[(2, "a.jpg")]
    assert (r.confidence_rating, r.source, r.found_on, r.instance_of, r.is_article_page) == (
        None, None, None, None, True)
    r = [v for v in out.collect() if v.page_id == 2 and v.image_id is None]
    assert len(r) == 2  # the map without image and the NULL element
    assert {(x.confidence_rating, x.source) for x in r} == {("medium", "wikidata"), (None, None)}
    r = rows[(3, "b.jpg")]
    assert (r.confidence_rating, r.source, r.found_on, r.is_article_page) == ("high", None, [""], False)
    r = rows[(3, "c.jpg")]
    assert (r.confidence_rating, r.source, r.found_on) == (None, "wikipedia", [""])


def test_single_scan_equals_two_branch_union(raw_data, spark):
    assert_frames_equal(transform_candidates(raw_data), transform_candidates_two_pass(raw_data), multiset=True)


def test_steps(raw_data):
    assert {r.page_id for r in with_candidates(raw_data).collect()} == {21, 35, 36, 37}
    assert explode_candidates(raw_data).count() == 5
    assert flatten_candidates(raw_data).count() == 6
    empty = pages_without_candidates(raw_data).collect()
    assert [(r.page_id, r.image_id, r.found_on, r.is_article_page) for r in empty] == [(22, None, None, True)]


def test_schema_contract(raw_data):
    require_schema(raw_data, RAW_SCHEMA)
    with pytest.raises(SchemaMismatchError):
        transform_candidates(raw_data.withColumnRenamed("wiki_db", "wiki"))
    with pytest.raises(AttributeError):  # same exception family as the original job
        require_schema(raw_data.select(*reversed(raw_data.columns)), RAW_SCHEMA)
    with pytest.raises(SchemaMismatchError):
        require_schema(raw_data.withColumn("page_id", F.col("page_id").cast("int")), RAW_SCHEMA)


def test_stamp_run(raw_data):
    out = stamp_run(transform_candidates(raw_data), "ds-1", 1234.5, MONTH)
    vals = {(r.dataset_id, r.insertion_ts, r.snapshot) for r in out.collect()}
    assert vals == {("ds-1", 1234.5, MONTH)}
    auto = stamp_run(transform_candidates(raw_data), snapshot=MONTH)
    vals = {(r.dataset_id, r.insertion_ts) for r in auto.collect()}
    assert len(vals) == 1  # one value per run
    assert dict(auto.dtypes)["insertion_ts"] == "double"


def test_plan_single_scan_no_shuffle_pushdown(raw_data, spark, tmp_path):
    path = str(tmp_path / "raw")
    raw_data.write.partitionBy("wiki_db", "snapshot").parquet(path)
    raw = read_raw(spark, path)
    out = transform_candidates(raw).where(F.col("wiki") == "cswiki")
    plan = plan_text(out)
    assert plan_text(out, "simple").count("FileScan parquet") == 1
    assert "Exchange" not in plan
    assert "PartitionFilters: [isnotnull(wiki_db" in plan and "(wiki_db" in plan and "= cswiki)" in plan
    assert "explode(top_candidates" in plan  # outer explode, printed with outer=true
    assert out.count() == 3
    two = plan_text(transform_candidates_two_pass(raw), "simple")
    assert two.count("FileScan parquet") == 2
    # column pruning: a two-column projection does not read candidates
    pruned = plan_text(raw.select("page_id", "wiki_db"))
    assert "ReadSchema: struct<page_id:bigint>" in pruned
    assert transform_candidates(raw).count() == 6


def test_json_parse_runs_once_per_page_before_explode(raw_data, spark, tmp_path):
    path = str(tmp_path / "raw")
    raw_data.write.partitionBy("wiki_db", "snapshot").parquet(path)
    simple = plan_text(transform_candidates(read_raw(spark, path)), "simple")
    lines = simple.splitlines()
    gen = next(i for i, line in enumerate(lines) if "Generate explode" in line)
    parse = next(i for i, line in enumerate(lines) if "from_json" in line)
    assert parse > gen  # printed below the Generate: evaluated on pages
    assert lines[gen].lstrip(" +-").startswith("*(")  # explode stage is code-generated


def test_stamp_run_needs_snapshot(raw_data):
    with pytest.raises(ValueError):
        stamp_run(transform_candidates(raw_data), "ds", 1.0)


def test_survey_signatures(raw_data, spark):
    from pagerecs.functions import candidate_source, source_of
    from pagerecs.operators.profile import value_frequencies

    assert source_of is candidate_source
    prod = stamp_run(transform_candidates(raw_data), "ds-1", 1.0, MONTH)
    assert {r.rank for r in value_frequencies(prod, top=1).collect()} == {1}
