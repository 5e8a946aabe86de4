import pytest

from pagerecs.cli import main
from pagerecs.plans.params import month_of
from pagerecs.sources.parquet import read_prod, read_search_feed
from pagerecs.sources.sinks import read_tsv
from tests.conftest import DAY, MONTH


def test_month_of():
    assert month_of("2024-02") == "2024-02" and month_of("2024-02-29") == "2024-02"
    for bad in ("2024-13", "2024-2", "24-02-01", "x"):
        with pytest.raises(ValueError):
            month_of(bad)


def test_cli_jobs_end_to_end(spark, raw_data, tmp_path, capsys):
    raw = str(tmp_path / "raw")
    raw_data.write.partitionBy("wiki_db", "snapshot").parquet(raw)
    prod, search, export = (str(tmp_path / n) for n in ("prod", "search", "export"))
    assert main(["publish-prod", "--snapshot", MONTH, "--source", raw, "--destination", prod,
                 "--dataset-id", "cli-run"], spark) == 0
    rows = read_prod(spark, prod).collect()
    assert len(rows) == 6 and {(r.dataset_id, r.snapshot) for r in rows} == {("cli-run", MONTH)}
    main(["search-feed", "--snapshot", DAY, "--source", prod, "--destination", search], spark)
    assert {r.page_id for r in read_search_feed(spark, search).collect()} == {21, 37}
    main(["export", "--snapshot", MONTH, "--source", prod, "--destination", export,
          "--wiki", "svwiki", "cswiki"], spark)
    lines = [r.value for r in read_tsv(spark, export).collect()]
    assert sum(not v.startswith("page_id") for v in lines) == 5
    main(["create-tables", "--database", "pagerecs_cli", "--prod", prod], spark)
    assert spark.table("pagerecs_cli.imagerec_prod").count() == 6
    main(["repair", "--table", "pagerecs_cli.imagerec_prod"], spark)


def test_cli_daily_count(spark, capsys):
    spark.createDataFrame(
        [("enwiki", 2024, 1, 15), ("enwiki", 2024, 1, 15), ("dewiki", 2024, 1, 14)],
        "database string, year int, month int, day int",
    ).createOrReplaceTempView("page_create_events")
    main(["daily-count", "--date", "2024-01-15", "--table", "page_create_events", "--database", "enwiki"], spark)
    out = capsys.readouterr().out
    lines = [line for line in out.splitlines() if "enwiki" in line]
    assert len(lines) == 1 and lines[0].split("\t")[1] == "2"
    assert "dewiki" not in out


def test_cli_daily_count_shows_and_writes_every_database(spark, tmp_path, capsys):
    rows = [(f"db{i:02}", 2024, 1, 15) for i in range(30)]
    spark.createDataFrame(rows, "database string, year int, month int, day int").createOrReplaceTempView("many_databases")
    call = ["daily-count", "--date", "2024-01-15", "--table", "many_databases"]
    main(call, spark)
    assert sum(line.startswith("db") for line in capsys.readouterr().out.splitlines()) == 30
    main([*call, "--destination", str(tmp_path / "counts")], spark)
    assert spark.read.parquet(str(tmp_path / "counts")).count() == 30


def test_cli_validates_before_spark():
    with pytest.raises(ValueError):
        main(["search-feed", "--snapshot", MONTH, "--source", "x", "--destination", "y"], spark=object())
    with pytest.raises(SystemExit):
        main(["publish-prod", "--snapshot", MONTH], spark=object())


def test_cli_monthly_from_catalog_table(spark, raw_data, tmp_path, capsys):
    from pagerecs.sources.catalog import create_external_table

    raw = str(tmp_path / "raw")
    raw_data.write.partitionBy("wiki_db", "snapshot").parquet(raw)
    table = create_external_table(spark, "raw", raw, database="pagerecs_cli_monthly")
    prod, search, export = (str(tmp_path / n) for n in ("prod", "search", "export"))
    main(["monthly", "--snapshot", DAY, "--source", table, "--prod", prod, "--search", search,
          "--export", export, "--wiki", "svwiki", "--dataset-id", "m1"], spark)
    assert read_prod(spark, prod).count() == 6
    assert {r.page_id for r in read_search_feed(spark, search).collect()} == {21, 37}
    assert sum(not r.value.startswith("page_id") for r in read_tsv(spark, export).collect()) == 3
    out = capsys.readouterr().out
    assert MONTH in out and "svwiki" in out  # partition counts shown
