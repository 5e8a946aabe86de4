"""Dataset profile and regression checks.

All of them are aggregations with partial (map-side) combine. The top-k of
``value_frequencies`` is exact and ranked in two levels, so no task receives a
whole column: tasks keep k values of a column, groups of tasks (about the
square root of their number) rank those, and the last task of a column gets k
values per group. ``ProfileWrite`` collects the count reports while the
production table is written, without reading it again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

# The expected source of each confidence rating.
EXPECTED_SOURCE = (("high", "wikidata"), ("medium", "wikipedia"), ("low", "commons"))

#: Stands for a rating or source that the table does not know.
OTHER = "other"


def partition_counts(prod: DataFrame) -> DataFrame:
    """Rows per (snapshot, wiki), newest snapshot first."""
    return (
        prod.groupBy("snapshot", "wiki")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("snapshot"), F.asc("wiki"))
    )


def schema_text(df: DataFrame) -> str:
    """The schema tree ``printSchema`` prints, as a string (no job runs)."""
    return df.schema.treeString()


def row_count(df: DataFrame) -> DataFrame:
    """One row, one column ``rows``."""
    return df.select(F.count(F.lit(1)).alias("rows"))


def render_value(df: DataFrame, column: str) -> Column:
    """A column's values as text: nested values as JSON, others as a cast."""
    dtype = df.schema[column].dataType
    c = F.col(column)
    if isinstance(dtype, (ArrayType, MapType, StructType)):
        return F.to_json(c)
    return c.cast("string")


def value_frequencies(df: DataFrame, top: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """For each column: every value (NULL is a value) and its ``count``,
    most frequent first, as (column, value, count).

    With ``top``, only that many values per column, with their ``rank``;
    ties ordered by value. One pass over the data for all columns: each row
    becomes one (column, value) pair per column, counted by a single
    aggregation.
    """
    names = list(columns) if columns is not None else list(df.columns)
    pairs = F.array(
        *[F.struct(F.lit(n).alias("column"), render_value(df, n).alias("value")) for n in names]
    )
    counts = df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    if top is None:
        return counts.orderBy("column", F.desc("count"), F.asc_nulls_first("value"))
    order = (F.desc("count"), F.asc_nulls_first("value"))
    salts = math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    salted = counts.withColumn("salt", F.spark_partition_id() % salts)  # any dealing gives the same result
    first = F.row_number().over(Window.partitionBy("column", "salt").orderBy(*order))
    last = F.row_number().over(Window.partitionBy("column").orderBy(*order))
    ranked = salted.withColumn("rank", first).where(F.col("rank") <= top).drop("salt")
    return ranked.withColumn("rank", last).where(F.col("rank") <= top)


def confidence_by_source(prod: DataFrame) -> DataFrame:
    """Row counts per (confidence_rating, source)."""
    return prod.groupBy("confidence_rating", "source").agg(F.count(F.lit(1)).alias("count"))


def expected_source(confidence: Column | str = "confidence_rating") -> Column:
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    expr = None
    for rating, source in EXPECTED_SOURCE:
        expr = F.when(c == rating, F.lit(source)) if expr is None else expr.when(c == rating, F.lit(source))
    return expr


def confidence_violations(prod: DataFrame) -> DataFrame:
    """(confidence_rating, source, count) pairs that break high=wikidata,
    medium=wikipedia, low=commons (NULL with NULL is fine). Empty when the
    dataset is consistent."""
    ok = F.col("source").eqNullSafe(expected_source("confidence_rating"))
    return confidence_by_source(prod).where(~ok)


def pages_without_image(prod: DataFrame) -> DataFrame:
    """Pages published without any recommended image, per (wiki, snapshot):
    pages (not rows) none of whose rows has one."""
    pages = prod.groupBy("wiki", "snapshot", "page_id").agg(F.count("image_id").alias("images"))
    return pages.where("images = 0").groupBy("wiki", "snapshot").agg(F.count(F.lit(1)).alias("pages"))


def profile_counts(prod: DataFrame) -> DataFrame:
    """One pass: rows per (snapshot, wiki, confidence_rating, source,
    without_image). Every count report below is a sum over this frame, whose
    size is bounded by partitions x ratings x sources x 2, not by the data."""
    return prod.groupBy(
        "snapshot",
        "wiki",
        "confidence_rating",
        "source",
        F.col("image_id").isNull().alias("without_image"),
    ).agg(F.count(F.lit(1)).alias("count"))


class ProfileWrite:
    """Counts the rows that a write passes on: in all, per wiki, and per
    confidence rating and source, as metrics of the write's own tasks.

    ``wikis`` are those that the rows can have (the input's partitions); rows
    of others make ``reports`` fail rather than miss them.
    """

    def __init__(self, snapshot: str, wikis: Sequence[str | None]):
        self.snapshot, self.wikis = snapshot, sorted(set(wikis), key=lambda w: (w is not None, w or ""))
        self.observation = Observation()
        ratings, sources = zip(*EXPECTED_SOURCE)
        self.pairs = list(product((*ratings, None, OTHER), (*sources, None, OTHER)))

    def observe(self, prod: DataFrame) -> DataFrame:
        def kind(column: str, known: Sequence[str]) -> Column:
            c = F.col(column)
            return F.when(c.isNull() | c.isin(*known), c).otherwise(F.lit(OTHER))

        ratings, sources = zip(*EXPECTED_SOURCE)
        rating, source = kind("confidence_rating", ratings), kind("source", sources)
        pair = [
            F.count_if(rating.eqNullSafe(F.lit(r)) & source.eqNullSafe(F.lit(s))).alias(f"pair{i}")
            for i, (r, s) in enumerate(self.pairs)
        ]
        wiki = [F.count_if(F.col("wiki").eqNullSafe(F.lit(w))).alias(f"wiki{i}") for i, w in enumerate(self.wikis)]
        return prod.observe(self.observation, F.count(F.lit(1)).alias("rows"), *pair, *wiki)

    def reports(self, spark: SparkSession) -> dict[str, DataFrame]:
        """partition_counts, confidence_by_source, confidence_violations and
        row_count of what was written; waits for the write."""
        found = self.observation.get
        per_wiki = [(self.snapshot, w, n) for i, w in enumerate(self.wikis) if (n := found[f"wiki{i}"])]
        per_pair = [(r, s, n) for i, (r, s) in enumerate(self.pairs) if (n := found[f"pair{i}"])]
        if sum(n for *_, n in per_wiki) != found["rows"]:
            raise ValueError("rows of wikis that were not named")
        by_source = spark.createDataFrame(per_pair, "confidence_rating string, source string, count long")
        counts = spark.createDataFrame(per_wiki, "snapshot string, wiki string, count long")
        ok = F.col("source").eqNullSafe(expected_source("confidence_rating"))
        return {
            "partition_counts": counts.orderBy(F.desc("snapshot"), F.asc("wiki")),
            "confidence_by_source": by_source,
            "confidence_violations": by_source.where(~ok),
            "row_count": spark.createDataFrame([(found["rows"],)], "rows long"),
        }


def profile_reports(prod: DataFrame, materialize: bool = True) -> dict[str, DataFrame]:
    """partition_counts, confidence_by_source, confidence_violations and
    row_count from ONE scan of ``prod``; pages_without_image, which counts
    pages, aggregates ``prod`` itself.

    With ``materialize`` the small ``profile_counts`` frame is checkpointed
    (reliably, in the session's checkpoint folder) so the other reports read
    it instead of re-scanning the data.
    """
    counts = profile_counts(prod)
    if materialize:
        from pagerecs.sources.storage import checkpoint

        counts = checkpoint(counts)
    total = F.sum("count")
    by_source = counts.groupBy("confidence_rating", "source").agg(total.alias("count"))
    ok = F.col("source").eqNullSafe(expected_source("confidence_rating"))
    return {
        "partition_counts": counts.groupBy("snapshot", "wiki")
        .agg(total.alias("count"))
        .orderBy(F.desc("snapshot"), F.asc("wiki")),
        "confidence_by_source": by_source,
        "confidence_violations": by_source.where(~ok),
        "pages_without_image": pages_without_image(prod),
        "row_count": counts.select(F.coalesce(total, F.lit(0)).alias("rows")),
    }
