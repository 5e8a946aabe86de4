"""Nested candidates per page -> one typed row per (page, image).

The whole transform is narrow (scan -> filter -> per-page parse ->
generate -> per-candidate project): no shuffle, so it scales linearly with
executors and needs no skew handling. Pages without candidates are produced by the same
``explode_outer`` pass instead of a second scan plus a union.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagerecs.functions.candidates import (
    candidate_source,
    confidence_rating,
    found_on,
    instance_of_id,
    is_article_page,
)
from pagerecs.schemas import RAW_SCHEMA, require_schema

TRANSFORM_COLUMNS = (
    "wiki",
    "page_id",
    "page_title",
    "image_id",
    "confidence_rating",
    "source",
    "instance_of",
    "found_on",
    "is_article_page",
)

_CANDIDATE = "candidate"


def with_candidates(raw: DataFrame) -> DataFrame:
    """Pages whose candidate array is non-empty or NULL (NULL ones are kept
    here and only disappear when exploded)."""
    arr = F.col("top_candidates")
    return raw.where(arr.isNull() | (F.size(arr) > 0))


def _candidate_fields(exploded: DataFrame) -> DataFrame:
    c = F.col(_CANDIDATE)
    return exploded.select(
        F.col("wiki_db").alias("wiki"),
        "page_id",
        "page_title",
        c.getItem("image").alias("image_id"),
        c.getItem("rating").alias("rating"),
        c.getItem("note").alias("note"),
        "instance_of",
    )


def explode_candidates(raw: DataFrame) -> DataFrame:
    """One row per candidate of pages that have candidates: wiki, page_id,
    page_title, image_id, rating, note, instance_of (raw JSON). Missing map
    keys give NULL; NULL and empty arrays give no row."""
    exploded = with_candidates(raw).select("*", F.explode("top_candidates").alias(_CANDIDATE))
    return _candidate_fields(exploded)


def flatten_candidates(raw: DataFrame) -> DataFrame:
    """As ``explode_candidates``, plus one all-NULL candidate row for each
    page with an *empty* array. Pages whose array is NULL produce no row.
    One scan: ``explode_outer`` emits the NULL row for empty arrays."""
    exploded = raw.where(F.col("top_candidates").isNotNull()).select(
        "*", F.explode_outer("top_candidates").alias(_CANDIDATE)
    )
    return _candidate_fields(exploded)


def classify(flat: DataFrame) -> DataFrame:
    """Derive confidence_rating, source, found_on, then replace instance_of by
    its parsed id and flag article pages from that id."""
    entity = instance_of_id("instance_of")
    return flat.select(
        "wiki",
        "page_id",
        "page_title",
        "image_id",
        confidence_rating("rating").alias("confidence_rating"),
        candidate_source("note").alias("source"),
        entity.alias("instance_of"),
        found_on("note").alias("found_on"),
        is_article_page(entity).alias("is_article_page"),
    )


def parse_pages(raw: DataFrame) -> DataFrame:
    """Page-level columns, computed once per page rather than once per
    candidate: instance_of replaced by its parsed id, and the article flag
    derived from that id. (The JSON parse is not code-generated in Spark 4,
    so running it before the explode keeps the per-candidate stage in
    whole-stage codegen and parses each page once.) Two projections so the
    parse is not duplicated into the flag expression."""
    parsed = raw.withColumn("instance_of", instance_of_id("instance_of"))
    return parsed.withColumn("is_article_page", is_article_page("instance_of"))


def explode_pages(pages: DataFrame) -> DataFrame:
    """Parsed pages (``parse_pages`` output, NULL arrays already removed) ->
    one classified row per candidate; an empty array yields the page's single
    NULL-candidate row (``explode_outer``)."""
    exploded = pages.select(
        F.col("wiki_db").alias("wiki"),
        "page_id",
        "page_title",
        "instance_of",
        "is_article_page",
        F.explode_outer("top_candidates").alias(_CANDIDATE),
    )
    c = F.col(_CANDIDATE)
    return exploded.select(
        "wiki",
        "page_id",
        "page_title",
        c.getItem("image").alias("image_id"),
        confidence_rating(c.getItem("rating")).alias("confidence_rating"),
        candidate_source(c.getItem("note")).alias("source"),
        "instance_of",
        found_on(c.getItem("note")).alias("found_on"),
        "is_article_page",
    )


def candidate_pages(raw: DataFrame, check_schema: bool = True) -> DataFrame:
    """Pages that produce production rows (non-NULL candidate array), with
    page-level columns parsed. Still one row per page: the natural unit to
    shuffle, since nothing is duplicated per candidate yet."""
    if check_schema:
        require_schema(raw, RAW_SCHEMA)
    return parse_pages(raw.where(F.col("top_candidates").isNotNull()))


def transform_candidates(raw: DataFrame, check_schema: bool = True) -> DataFrame:
    """Raw pages -> the nine production columns (``TRANSFORM_COLUMNS``).

    Same rows as classifying ``flatten_candidates``: pages with a non-NULL
    array are parsed, then exploded with ``explode_outer`` (an empty array
    yields the page's single NULL-candidate row), then each candidate is
    classified.
    """
    return explode_pages(candidate_pages(raw, check_schema))


def pages_without_candidates(raw: DataFrame) -> DataFrame:
    """Pages with an empty candidate array, as production rows with NULL
    image_id, confidence_rating, source and found_on."""
    empty = parse_pages(raw.where(F.size("top_candidates") == 0))
    return empty.select(
        F.col("wiki_db").alias("wiki"),
        "page_id",
        "page_title",
        F.lit(None).cast("string").alias("image_id"),
        F.lit(None).cast("string").alias("confidence_rating"),
        F.lit(None).cast("string").alias("source"),
        "instance_of",
        F.lit(None).cast("array<string>").alias("found_on"),
        "is_article_page",
    )


def transform_candidates_two_pass(raw: DataFrame) -> DataFrame:
    """Same rows as ``transform_candidates`` built as a union of two scans
    (candidates, empty pages). Kept only to measure and test the single-scan
    plan against it."""
    return classify(explode_candidates(raw)).unionByName(pages_without_candidates(raw))


def stamp_run(
    df: DataFrame,
    dataset_id: str | None = None,
    insertion_ts: float | None = None,
    snapshot: str | None = None,
) -> DataFrame:
    """Add the run columns: dataset_id (default: a fresh uuid), insertion_ts
    (epoch seconds, default: now) and snapshot (the monthly ``YYYY-MM``,
    required). Defaults are evaluated once, on the driver, so every row of a
    run carries the same values."""
    if snapshot is None:
        raise ValueError("stamp_run needs the run's snapshot")
    if dataset_id is None:
        dataset_id = str(uuid.uuid4())
    if insertion_ts is None:
        insertion_ts = time.time()
    return df.withColumns(
        {
            "dataset_id": F.lit(dataset_id),
            "insertion_ts": F.lit(float(insertion_ts)).cast("double"),
            "snapshot": F.lit(snapshot),
        }
    )
