from pagerecs.functions import (
    candidate_source,
    confidence_rating,
    found_on,
    instance_of_id,
    is_article_page,
    rating_value,
)
from tests.conftest import COMMONS_NOTE, WIKIDATA_NOTE, WIKIS_NOTE, entity, plan_text


def _one_col(spark, values, ddl="v string"):
    return spark.createDataFrame([(v,) for v in values], ddl)


def test_rating_parse_is_ansi_safe(spark):
    values = ["1", "2.0", "3.0", "4", "1.9", "1.9999999", " 3 ", "+1", "-2", "1.", "abc", "", "1e0",
              "NaN", "99999999999", None]
    df = _one_col(spark, values)
    got = dict(df.select("v", rating_value("v").alias("r")).collect())
    assert got["1"] == 1 and got["2.0"] == 2 and got["3.0"] == 3 and got["4"] == 4
    assert got["1.9"] == 1 and got["1.9999999"] == 1 and got[" 3 "] == 3
    assert got["+1"] == 1 and got["-2"] == -2 and got["1."] == 1
    for bad in ("abc", "", "1e0", "NaN", "99999999999"):
        assert got[bad] is None, bad
    assert got[None] is None


def test_confidence_rating(spark):
    df = _one_col(spark, ["1", "2.0", "3.0", "4", "1.9", " 3 ", "abc", "0", None])
    got = dict(df.select("v", confidence_rating("v").alias("c")).collect())
    assert got == {"1": "high", "2.0": "medium", "3.0": "low", "4": None, "1.9": "high",
                   " 3 ": "low", "abc": None, "0": None, None: None}


def test_candidate_source(spark):
    notes = [WIKIDATA_NOTE, WIKIS_NOTE + "x", COMMONS_NOTE, "image came from elsewhere",
             "IMAGE WAS IN THE WIKIDATA ITEM", " " + WIKIDATA_NOTE, None]
    got = [r.s for r in _one_col(spark, notes).select(candidate_source("v").alias("s")).collect()]
    assert got == ["wikidata", "wikipedia", "commons", None, None, None, None]


def test_found_on_takes_what_follows_the_marker(spark):
    notes = [WIKIS_NOTE + " nowiki ,dawiki,  sk wiki", WIKIS_NOTE + "cswiki", WIKIS_NOTE, WIKIS_NOTE + " ,", None]
    got = [r.f for r in _one_col(spark, notes).select(found_on("v").alias("f")).collect()]
    # the marker needs whitespace after it; a lone comma lists two empty names
    assert got == [["nowiki", "dawiki", "skwiki"], [""], [""], ["", ""], None]


def test_found_on_without_marker_is_single_empty_string(spark):
    got = [r.f for r in _one_col(spark, [WIKIDATA_NOTE, COMMONS_NOTE]).select(found_on("v").alias("f")).collect()]
    assert got == [[""], [""]]


def test_instance_of_id(spark):
    values = [entity("Q82799"), "{bad", "", "null", "[]", '{"id":5}', '{"id":"Q1","numeric-id":"x"}', None,
              '{"id":"A","id":"B"}', '{"x":{"id":"Q2"}}', '{"id":"Q1"']
    got = [r.i for r in _one_col(spark, values).select(instance_of_id("v").alias("i")).collect()]
    # duplicate keys: the last one wins, as with the original's from_json
    assert got == ["Q82799", None, None, None, None, "5", "Q1", None, "B", None, None]


def test_is_article_page(spark):
    df = _one_col(spark, ["Q82799", "Q4167410", "Q28920052", "Q5", None])
    got = [r.a for r in df.select(is_article_page("v").alias("a")).collect()]
    assert got == [False, False, False, True, True]


def test_expressions_need_no_python_udf(spark):
    # per-candidate expressions run inside whole-stage codegen
    df = _one_col(spark, ["1"]).select(
        confidence_rating("v"), candidate_source("v"), found_on("v"), is_article_page("v")
    )
    plan = plan_text(df)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "*(1) Project" in plan_text(df, "simple")
    # the JSON parse is a codegen fallback in Spark 4: still no Python
    parsed = _one_col(spark, ["1"]).select(instance_of_id("v"))
    assert "Python" not in plan_text(parsed).replace("applySchemaToPythonRDD", "")
