import glob

import pytest
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from pagerecs.operators.candidates import stamp_run, transform_candidates
from pagerecs.operators.export import EXPORT_COLUMNS, export_rows, export_rows_sql, export_tsv
from pagerecs.operators.compare import assert_frames_equal
from pagerecs.operators.search import search_feed
from pagerecs.sources.catalog import create_external_table
from pagerecs.sources.parquet import read_prod
from pagerecs.sources.sinks import read_tsv, read_tsv_rows, tsv_headers, write_prod
from tests.conftest import DAY, MONTH, plan_text


@pytest.fixture(scope="module")
def prod_path(raw_data, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("prod") / "imagerec_prod")
    write_prod(stamp_run(transform_candidates(raw_data), "ds-1", 1700000000.0, MONTH), path)
    return path


@pytest.fixture(scope="module")
def prod(spark, prod_path):
    return read_prod(spark, prod_path)


def test_search_feed_golden(prod):
    rows = search_feed(prod, DAY).collect()
    assert {tuple(r) for r in rows} == {("svwiki", 21, 0, "image", 2023, 9, 12), ("cswiki", 37, 0, "image", 2023, 9, 12)}
    assert len(rows) == 2  # 35 is a surname, 22 has no image
    assert search_feed(prod, DAY).dtypes == [
        ("wikiid", "string"), ("page_id", "int"), ("page_namespace", "int"),
        ("recommendation_type", "string"), ("year", "int"), ("month", "int"), ("day", "int")]


def test_search_feed_is_distinct_and_pushes_filters(spark, prod):
    doubled = prod.unionByName(prod)
    assert search_feed(doubled, DAY).count() == 2
    plan = plan_text(search_feed(prod, DAY))
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    for f in ("IsNotNull(image_id)", "EqualTo(is_article_page,true)"):
        assert f in pushed
    assert "ReadSchema: struct<page_id:bigint,image_id:string,is_article_page:boolean>" in plan
    # the distinct shuffles only the two key columns
    assert "hashpartitioning(wikiid" in plan and "page_id" in plan


def test_search_feed_rejects_bad_date(prod):
    with pytest.raises(ValueError):
        search_feed(prod, MONTH)


def test_search_feed_page_id_overflow_raises(spark, prod):
    big = prod.withColumn("page_id", F.lit(2**31).cast("bigint"))
    with pytest.raises(ArithmeticException):
        search_feed(big, DAY).collect()


def test_export_golden(prod):
    rows = export_rows(prod, "svwiki", MONTH)
    assert tuple(rows.columns) == EXPORT_COLUMNS
    got = {(r.page_id, r.image_id, r.confidence_rating, r.source, r.found_on) for r in rows.collect()}
    assert got == {(21, "pit.png", "low", "commons", ""), (21, "slab.png", "high", "wikidata", ""), (22, "", "", "", "")}
    android = export_rows(prod, "svwiki", MONTH, require_image=True).collect()
    assert sorted(r.image_id for r in android) == ["pit.png", "slab.png"]
    assert {(r.page_id, r.found_on) for r in export_rows(prod, "cswiki", MONTH).collect()} == {(37, ""), (37, "plwiki")}
    assert export_rows(prod, ["svwiki", "cswiki"], MONTH).count() == 5
    assert export_rows(prod, "svwiki", "2023-08").count() == 0


def test_export_prunes_partitions(prod):
    plan = plan_text(export_rows(prod, ["svwiki"], MONTH))
    parts = next(line for line in plan.splitlines() if line.startswith("PartitionFilters"))
    assert "= svwiki)" in parts and f"= {MONTH})" in parts
    assert "EqualTo(is_article_page,true)" in plan


def test_export_sql_matches_dataframe(spark, prod, prod_path):
    table = create_external_table(spark, "prod", prod_path, name="imagerec_prod_export_test")
    for android in (False, True):
        assert_frames_equal(
            export_rows_sql(spark, table, "svwiki", MONTH, android),
            export_rows(prod, "svwiki", MONTH, android),
            multiset=True,
        )
    # a value with a quote cannot inject SQL: it is a bound parameter
    assert export_rows_sql(spark, table, "svwiki' OR '1'='1", MONTH).count() == 0


def lines_by_file(folder):
    return [open(f, encoding="utf-8").read().splitlines() for f in sorted(glob.glob(f"{folder}/part-*"))]


def test_every_tsv_file_has_its_header_and_nothing_is_quoted(spark, raw_data, tmp_path):
    odd_title = 'Tab\there "quoted" \x01\nline \\x # '
    tricky = raw_data.withColumn(
        "page_title", F.when(F.col("page_id") == 21, F.lit(odd_title)).otherwise(F.col("page_title"))
    )
    prod_dir, out = str(tmp_path / "prod"), str(tmp_path / "tsv")
    rows = stamp_run(transform_candidates(tricky), "ds-1", 1700000000.0, MONTH)
    write_prod(rows.repartition(3, "image_id"), prod_dir, sort=False)
    prod = read_prod(spark, prod_dir)
    export_tsv(prod, ["svwiki", "cswiki", "kowiki"], MONTH, out)
    for wiki, n_rows in (("svwiki", 3), ("cswiki", 2), ("kowiki", 0)):
        files = lines_by_file(f"{out}/wiki={wiki}/snapshot={MONTH}")
        assert files and all(lines[0] == "\t".join(EXPORT_COLUMNS) for lines in files)
        found = [line.split("\t") for lines in files for line in lines[1:]]
        assert len(found) == n_rows and all(len(f) == len(EXPORT_COLUMNS) and f[6] == "1.7E9" for f in found)
    text = {r.value for r in read_tsv(spark, out).collect()}
    shown = 'Tab here "quoted"   line \\x # '
    assert f"21\t{shown}\tslab.png\thigh\twikidata\tds-1\t1.7E9\tsvwiki\t" in text
    assert "22\tFerry timetable\t\t\t\tds-1\t1.7E9\tsvwiki\t" in text
    headers = {r.wiki: r for r in tsv_headers(spark, out, EXPORT_COLUMNS).collect()}
    assert {w: (r.rows, r.files_without_header) for w, r in headers.items()} == {
        "svwiki": (3, 0), "cswiki": (2, 0), "kowiki": (0, 0)}
    parsed = read_tsv_rows(spark, out, EXPORT_COLUMNS)
    assert {(r.page_id, r.page_title, r.wiki, r.snapshot) for r in parsed.collect()} == {
        ("21", shown, "svwiki", MONTH), ("22", "Ferry timetable", "svwiki", MONTH), ("37", "Salt mill", "cswiki", MONTH)}


def test_a_tsv_file_without_header_is_found(spark, tmp_path):
    path = tmp_path / "wiki=w" / "snapshot=s"
    path.mkdir(parents=True)
    (path / "part-0").write_text("a\tb\n1\t2\n")
    (path / "part-1").write_text("3\t4\n")
    (path / "part-2").write_text("a\tb\na\tb\n")
    found = tsv_headers(spark, str(tmp_path), ["a", "b"]).collect()
    assert [tuple(r) for r in found] == [("w", "s", 3, 2, 2)]
    with pytest.raises(Exception, match="other fields"):
        read_tsv_rows(spark, str(tmp_path), ["a"]).collect()


def test_tsv_null_is_backslash_n(spark, tmp_path):
    from pagerecs.sources.sinks import write_tsv

    df = spark.createDataFrame([("a", None, "w", "s")], "x string, y string, wiki string, snapshot string")
    out = str(tmp_path / "t")
    write_tsv(df, out, ("x", "y"))
    assert [r.value for r in read_tsv(spark, out).collect()] == ["x\ty", "a\t\\N"]
    assert [(r.x, r.y) for r in read_tsv_rows(spark, out, ("x", "y")).collect()] == [("a", None)]





def test_tsv_write_has_no_shuffle(spark, prod, tmp_path):
    from pagerecs.sources import sinks

    captured = {}
    original = sinks._writer

    def capture(df, partition_by, max_records_per_file):
        captured["df"] = df
        return original(df, partition_by, max_records_per_file)

    sinks._writer = capture
    try:
        export_tsv(prod, ["svwiki"], MONTH, str(tmp_path / "t"))
    finally:
        sinks._writer = original
    assert "Exchange" not in plan_text(captured["df"], "simple")
