"""Property tests: many generated cases per Spark job, checked against a
plain-Python model of the intended semantics."""

import datetime as dt
import re
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagerecs.functions import candidate_source, found_on, rating_value
from pagerecs.functions.candidates import SOURCE_PREFIXES
from pagerecs.operators.compare import LEFT_ONLY, RIGHT_ONLY, frame_diff
from pagerecs.operators.profile import value_frequencies

SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))

INT_MIN, INT_MAX = -(2**31), 2**31 - 1


def model_rating(text):
    """Truncating string -> int cast of non-ANSI Spark 3+: trim, optional
    sign, digits, optional '.' followed by digits only; NULL otherwise or out
    of int range."""
    if text is None:
        return None
    m = re.fullmatch(r"[ \t\n\r\f\v]*([+-]?[0-9]+)(\.[0-9]*)?[ \t\n\r\f\v]*", text)
    if not m:
        return None
    v = int(m.group(1))
    return v if INT_MIN <= v <= INT_MAX else None


rating_text = st.one_of(
    st.none(),
    st.text(alphabet="0123456789+-. eE\tx", max_size=8),
    st.integers(min_value=-(2**33), max_value=2**33).map(str),
    st.builds(lambda a, b: f"{a}.{b}", st.integers(-50, 50), st.integers(0, 999)),
)


@SETTINGS
@given(st.lists(rating_text, min_size=1, max_size=40))
def test_rating_parse_matches_model(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r.i: r.r for r in df.select("i", rating_value("v").alias("r")).collect()}
    assert got == {i: model_rating(v) for i, v in enumerate(values)}


def model_found_on(note):
    if note is None:
        return None
    m = re.search(r"Wikis:\s+(.*)$", note)
    listed = m.group(1) if m else ""
    return re.sub(r"\s+", "", listed).split(",")


def model_source(note):
    if note is None:
        return None
    for prefix, label in SOURCE_PREFIXES:
        if note.startswith(prefix):
            return label
    return None


note_text = st.one_of(
    st.none(),
    st.builds(
        lambda prefix, body: prefix + body,
        st.sampled_from([p for p, _ in SOURCE_PREFIXES] + ["", "image was", "Wikis:", "Wikis: "]),
        st.text(alphabet="abc ,\t", max_size=12),
    ),
)


@SETTINGS
@given(st.lists(note_text, min_size=1, max_size=40))
def test_note_parsing_matches_model(spark, notes):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(notes)], "i int, n string")
    rows = df.select("i", found_on("n").alias("f"), candidate_source("n").alias("s")).collect()
    assert {r.i: r.f for r in rows} == {i: model_found_on(n) for i, n in enumerate(notes)}
    assert {r.i: r.s for r in rows} == {i: model_source(n) for i, n in enumerate(notes)}


small_rows = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.sampled_from(["a", "b", None])),
                      max_size=12)


@SETTINGS
@given(small_rows, small_rows)
def test_frame_diff_matches_set_and_multiset_models(spark, left, right):
    schema = "k int, v string"
    a = spark.createDataFrame(left, schema)
    b = spark.createDataFrame(right, schema)
    got = Counter((r.k, r.v, r.side) for r in frame_diff(a, b).collect())
    want = Counter({(k, v, LEFT_ONLY): 1 for k, v in set(left) - set(right)})
    want.update({(k, v, RIGHT_ONLY): 1 for k, v in set(right) - set(left)})
    assert got == want
    got_multi = {(r.k, r.v, r.side): r.copies for r in frame_diff(a, b, multiset=True).collect()}
    cl, cr = Counter(left), Counter(right)
    want_multi = {(*row, LEFT_ONLY): n for row, n in (cl - cr).items()}
    want_multi.update({(*row, RIGHT_ONLY): n for row, n in (cr - cl).items()})
    assert got_multi == want_multi


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["x", "y", "z", None]), st.integers(0, 6)), min_size=1, max_size=60),
       st.integers(1, 4))
def test_value_frequencies_matches_brute_force(spark, rows, top):
    df = spark.createDataFrame(rows, "c string, n int")
    got = sorted((r.column, r.rank, r.value, r["count"]) for r in value_frequencies(df, top).collect())
    want = []
    for idx, name in enumerate(("c", "n")):
        counts = Counter(None if r[idx] is None else str(r[idx]) for r in rows)
        ordered = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0] is not None, kv[0] or ""))
        want += [(name, rank, value, n) for rank, (value, n) in enumerate(ordered[:top], start=1)]
    assert got == sorted(want)




def model_instance_id(text):
    import json

    if text is None:
        return None
    try:
        obj = json.loads(text)
    except ValueError:
        return None
    if not isinstance(obj, dict) or obj.get("id") is None:
        return None
    v = obj["id"]
    return v if isinstance(v, str) else json.dumps(v)


def model_transform(pages):
    """The original's semantics: pages with a non-empty (or NULL) array are
    exploded (NULL arrays then vanish), pages with an empty array give one
    NULL row; instance_of is parsed afterwards and drives the article flag."""
    from pagerecs.schemas import NON_ARTICLE_INSTANCES

    out = []
    for page_id, cands, inst in pages:
        entity = model_instance_id(inst)
        article = entity not in NON_ARTICLE_INSTANCES
        if cands is None:
            continue
        if not cands:
            out.append((page_id, None, None, None, entity, None, article))
            continue
        for c in cands:
            c = c or {}
            rating = model_rating(c.get("rating"))
            conf = {1: "high", 2: "medium", 3: "low"}.get(rating)
            note = c.get("note")
            found = model_found_on(note)
            out.append((page_id, c.get("image"), conf, model_source(note), entity,
                        None if found is None else tuple(found), article))
    return out


candidate = st.one_of(
    st.none(),
    st.fixed_dictionaries(
        {},
        optional={
            "image": st.sampled_from(["a.jpg", "b.jpg", None]),
            "rating": st.sampled_from(["1", "2.0", "3.0", "4", " 2 ", "x", None]),
            "note": note_text,
        },
    ),
)
page = st.tuples(
    st.one_of(st.none(), st.lists(candidate, max_size=4)),
    st.sampled_from([None, '{"id":"Q577"}', '{"id":"Q5"}', "{bad", '{"id":"Q4167410","numeric-id":1}', "[]"]),
)


@SETTINGS
@given(st.lists(page, min_size=1, max_size=25))
def test_transform_matches_model(spark, generated):
    from pagerecs.operators.candidates import transform_candidates
    from pagerecs.schemas import RAW_SCHEMA

    pages = [(i, cands, inst) for i, (cands, inst) in enumerate(generated)]
    raw = spark.createDataFrame(
        [(f"Q{i}", i, f"t{i}", cands, inst, "kowiki", "2024-01") for i, cands, inst in pages], RAW_SCHEMA
    )
    got = Counter(
        (r.page_id, r.image_id, r.confidence_rating, r.source, r.instance_of,
         None if r.found_on is None else tuple(r.found_on), r.is_article_page)
        for r in transform_candidates(raw).collect()
    )
    assert got == Counter(model_transform(pages))


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["kowiki", "plwiki"]), st.integers(1, 6),
                          st.sampled_from(["a.jpg", None]), st.sampled_from([True, False, None])),
                min_size=1, max_size=40))
def test_search_feed_matches_model(spark, rows):
    from pagerecs.operators.search import search_feed

    prod = spark.createDataFrame(rows, "wiki string, page_id bigint, image_id string, is_article_page boolean")
    got = sorted(tuple(r) for r in search_feed(prod, "2024-02-03").collect())
    want = sorted({(w, p, 0, "image", 2024, 2, 3) for w, p, img, art in rows if img is not None and art is True})
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["kowiki", "plwiki", "enwiki"]), st.sampled_from(["2024-01", "2024-02"]),
                          st.integers(1, 5), st.sampled_from(["a.jpg", None]), st.sampled_from(["high", None]),
                          st.sampled_from([["x", "y"], [""], None]), st.sampled_from([True, False, None])),
                min_size=1, max_size=30),
       st.booleans())
def test_export_rows_matches_model(spark, rows, android):
    from pagerecs.operators.export import export_rows

    schema = ("wiki string, snapshot string, page_id bigint, image_id string, confidence_rating string, "
              "found_on array<string>, is_article_page boolean")
    prod = (spark.createDataFrame(rows, schema)
            .withColumn("page_title", F.concat(F.lit("t"), F.col("page_id").cast("string")))
            .withColumn("source", F.col("confidence_rating"))
            .withColumn("dataset_id", F.lit("d"))
            .withColumn("insertion_ts", F.lit(1.0)))
    got = Counter(tuple(r) for r in export_rows(prod, ["kowiki", "enwiki"], "2024-02", android).collect())
    want = Counter(
        (p, f"t{p}", img or "", conf or "", conf or "", "d", 1.0, w, ",".join(found or []))
        for w, snap, p, img, conf, found, art in rows
        if w in ("kowiki", "enwiki") and snap == "2024-02" and art is True and (img is not None or not android)
    )
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]),
                          st.datetimes(min_value=dt.datetime(2024, 1, 14), max_value=dt.datetime(2024, 1, 17))),
                min_size=1, max_size=40),
       st.sampled_from([None, "a"]))
def test_daily_count_matches_model(spark, events, database):
    from pagerecs.operators.daily import daily_new_pages

    df = spark.createDataFrame(events, "db string, ts timestamp_ntz")
    got = {r.database: r.count_of_new_pages
           for r in daily_new_pages(df, "2024-01-15", database, database_col="db", ts_col="ts").collect()}
    start, end = dt.datetime(2024, 1, 15), dt.datetime(2024, 1, 16)
    want = Counter(db for db, ts in events if start <= ts < end and (database is None or db == database))
    assert got == dict(want)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["kowiki", "plwiki"]), st.sampled_from(["2024-01", "2024-02"]),
                          st.sampled_from(["high", "low", None]), st.sampled_from(["wikidata", "commons", None]),
                          st.sampled_from(["a.jpg", None]), st.integers(1, 4)),
                max_size=40))
def test_profile_reports_match_model(spark, rows):
    from pagerecs.operators.profile import profile_reports

    prod = spark.createDataFrame(rows, "wiki string, snapshot string, confidence_rating string, source string, "
                                       "image_id string, page_id int")
    reports = profile_reports(prod, materialize=False)
    assert {(r.snapshot, r.wiki): r["count"] for r in reports["partition_counts"].collect()} == dict(
        Counter((s, w) for w, s, *_ in rows))
    assert {(r.confidence_rating, r.source): r["count"] for r in reports["confidence_by_source"].collect()} == dict(
        Counter((c, src) for _, _, c, src, *_ in rows))
    expected = {"high": "wikidata", "low": "commons"}
    assert {(r.confidence_rating, r.source): r["count"] for r in reports["confidence_violations"].collect()} == {
        k: v for k, v in Counter((c, src) for _, _, c, src, *_ in rows).items() if expected.get(k[0]) != k[1]}
    assert {(r.wiki, r.snapshot): r.pages for r in reports["pages_without_image"].collect()} == dict(
        Counter((w, s) for w, s, page in {(w, s, p) for w, s, _, _, _, p in rows}
                if all(r[4] is None for r in rows if (r[0], r[1], r[5]) == (w, s, page))))
    assert reports["row_count"].collect()[0].rows == len(rows)


@SETTINGS
@given(st.lists(st.tuples(st.one_of(st.none(), st.text(alphabet='ab\t\n\r"\\, ', max_size=6)),
                          st.one_of(st.none(), st.integers(-5, 5)),
                          st.one_of(st.none(), st.booleans())),
                min_size=1, max_size=30))
def test_tsv_line_matches_model(spark, rows):
    from pagerecs.sources.sinks import tsv_line

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, n int, b boolean")
    got = {r.i: r.line for r in df.select("i", tsv_line(["s", "n", "b"], df).alias("line")).collect()}

    def field(v):
        if v is None:
            return "\\N"
        if isinstance(v, bool):
            return "true" if v else "false"
        return str(v).replace("\t", " ").replace("\n", " ").replace("\r", " ")

    want = {i: "\t".join(field(v) for v in r) for i, r in enumerate(rows)}
    assert got == want
    assert all(line.count("\t") == 2 and "\n" not in line for line in got.values())
