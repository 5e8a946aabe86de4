"""Search-index feed -- distinct article pages that have a suggestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagerecs.plans.params import Snapshot

# Constants of the feed.
PAGE_NAMESPACE = 0
RECOMMENDATION_TYPE = "image"


def search_feed(prod: DataFrame, snapshot_date: str | Snapshot) -> DataFrame:
    """(wikiid, page_id int, page_namespace, recommendation_type, year,
    month, day): one row per (wiki, page) with an image on an article page.

    The two predicates reach the Parquet scan. The DISTINCT runs on the two
    key columns only, before the constants are attached, so the shuffle
    carries (wiki, page_id) and partial aggregation removes a page's
    duplicate rows on the map side. ``page_id`` above int range raises
    (ANSI cast) rather than wrapping around.
    """
    snap = snapshot_date if isinstance(snapshot_date, Snapshot) else Snapshot.parse(snapshot_date)
    pages = (
        prod.where(F.col("image_id").isNotNull() & (F.col("is_article_page") == F.lit(True)))
        .select(F.col("wiki").alias("wikiid"), F.col("page_id").cast("int").alias("page_id"))
        .distinct()
    )
    return pages.select(
        "wikiid",
        "page_id",
        F.lit(PAGE_NAMESPACE).alias("page_namespace"),
        F.lit(RECOMMENDATION_TYPE).alias("recommendation_type"),
        F.lit(snap.year).alias("year"),
        F.lit(snap.month_number).alias("month"),
        F.lit(snap.day).alias("day"),
    )
