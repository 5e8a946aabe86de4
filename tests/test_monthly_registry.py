import glob

import duckdb
import pytest

import __spark_entry__ as entry_mod
from pagerecs.operators.export import EXPORT_COLUMNS
from pagerecs.plans import registry
from pagerecs.plans.monthly import run_monthly
from pagerecs.plans.params import Snapshot
from pagerecs.sources.parquet import read_prod, read_search_feed
from pagerecs.sources.sinks import read_tsv
from tests.conftest import DAY, MONTH, SF_SMALL


def test_run_monthly_golden(spark, raw_data, tmp_path):
    raw_dir = str(tmp_path / "raw")
    raw_data.write.partitionBy("wiki_db", "snapshot").parquet(raw_dir)
    res = run_monthly(
        spark,
        raw_dir,
        str(tmp_path / "prod"),
        DAY,
        wikis=["svwiki", "kowiki"],
        search_path=str(tmp_path / "search"),
        export_path=str(tmp_path / "export"),
        dataset_id="ds-9",
        insertion_ts=10.0,
    )
    assert res.snapshot == Snapshot.parse(DAY)
    prod = read_prod(spark, res.prod_path)
    assert prod.count() == 6 and {r.snapshot for r in prod.collect()} == {MONTH}
    assert {tuple(r) for r in read_search_feed(spark, res.search_path).collect()} == {
        ("svwiki", 21, 0, "image", 2023, 9, 12), ("cswiki", 37, 0, "image", 2023, 9, 12)}
    lines = [r.value for r in read_tsv(spark, res.export_path).collect()]
    assert sum(v != "\t".join(EXPORT_COLUMNS) for v in lines) == 3
    assert glob.glob(res.export_path + f"/wiki=kowiki/snapshot={MONTH}/part-*")  # a header, though no rows
    assert res.profile["confidence_violations"].count() == 0
    assert [tuple(r) for r in res.profile["pages_without_image"].collect()] == [("svwiki", MONTH, 1)]
    top_wiki = res.profile["value_frequencies"].where("column = 'wiki'").collect()
    assert {(r.value, r["count"]) for r in top_wiki} == {("cswiki", 3), ("svwiki", 3)}


def test_run_monthly_validates_first(spark, tmp_path):
    with pytest.raises(ValueError):
        run_monthly(spark, str(tmp_path / "missing"), str(tmp_path / "prod"), MONTH)


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["wiki", "page_id", "page_title", "image_id", "confidence_rating", "source",
                          "instance_of", "found_on", "is_article_page"]
    assert df.count() > 0


TABLES = ("orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def norm(v):
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = entry_mod.queries()[name](spark, SF_SMALL)
    sql = entry_mod.oracle_sql().get(name)
    assert sql is not None, f"{name} has no oracle"
    res = duck.execute(sql)
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    rel = duck.sql(sql)
    duck_types = dict(zip(rel.columns, (str(t) for t in rel.types)))
    names = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    assert {c: names.get(t, t) for c, t in df.dtypes} == duck_types
    assert _bag(df.columns, [tuple(r) for r in df.collect()]) == _bag(ocols, res.fetchall())
