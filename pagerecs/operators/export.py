"""Per-wiki exports of one production snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagerecs.sources.sinks import write_tsv

# Exported columns, in file order, and the text that replaces
# a missing recommendation field.
EXPORT_COLUMNS = (
    "page_id",
    "page_title",
    "image_id",
    "confidence_rating",
    "source",
    "dataset_id",
    "insertion_ts",
    "wiki",
    "found_on",
)
RECOMMENDATION_COLUMNS = ("image_id", "confidence_rating", "source")
MISSING_VALUE = ""
FOUND_ON_SEPARATOR = ","


def _wiki_list(wikis: str | Sequence[str]) -> list[str]:
    return [wikis] if isinstance(wikis, str) else list(wikis)


def export_rows(
    prod: DataFrame,
    wikis: str | Sequence[str],
    snapshot: str,
    require_image: bool = False,
) -> DataFrame:
    """Article-page rows of ``snapshot`` for ``wikis`` in export form.

    wiki/snapshot are partition columns, so the predicate prunes folders;
    is_article_page (and image_id) are pushed into the Parquet reader. All
    wikis go through one scan -- no per-wiki job.
    """
    cond = (
        F.col("wiki").isin(*_wiki_list(wikis))
        & (F.col("snapshot") == F.lit(snapshot))
        & (F.col("is_article_page") == F.lit(True))
    )
    if require_image:
        cond = cond & F.col("image_id").isNotNull()
    missing = F.lit(MISSING_VALUE)
    return prod.where(cond).select(
        *[
            F.concat_ws(FOUND_ON_SEPARATOR, c).alias(c)
            if c == "found_on"
            else F.coalesce(c, missing).alias(c)
            if c in RECOMMENDATION_COLUMNS
            else c
            for c in EXPORT_COLUMNS
        ]
    )


def _export_field(column: str) -> str:
    """One exported field as SQL over a catalog table."""
    if column == "found_on":
        return "concat_ws(:separator, found_on) AS found_on"
    return f"coalesce({column}, :missing) AS {column}" if column in RECOMMENDATION_COLUMNS else column


#: The same export as SQL text, run parameters bound as named markers (never formatted into the text).
EXPORT_SQL = (
    f"SELECT {', '.join(map(_export_field, EXPORT_COLUMNS))} FROM IDENTIFIER(:table) "
    "WHERE snapshot = :snapshot AND wiki = :wiki AND is_article_page "
    "AND (image_id IS NOT NULL OR NOT :require_image)"
)


def export_rows_sql(
    spark: SparkSession, table: str, wiki: str, snapshot: str, require_image: bool = False
) -> DataFrame:
    return spark.sql(
        EXPORT_SQL,
        args={
            "table": table,
            "wiki": wiki,
            "snapshot": snapshot,
            "require_image": bool(require_image),
            "missing": MISSING_VALUE,
            "separator": FOUND_ON_SEPARATOR,
        },
    )


def export_tsv(
    prod: DataFrame,
    wikis: str | Sequence[str],
    snapshot: str,
    path: str,
    require_image: bool = False,
) -> None:
    """Write a text set per requested wiki under
    ``path/wiki=<wiki>/snapshot=<snapshot>/``, as one Spark job. Every file has
    its header; a listed wiki without rows gets a file with nothing else."""
    wiki_list = _wiki_list(wikis)
    rows = export_rows(prod, wiki_list, snapshot, require_image).withColumn("snapshot", F.lit(snapshot))
    write_tsv(
        rows,
        path,
        EXPORT_COLUMNS,
        partition_by=("wiki", "snapshot"),
        header_partitions=[(w, snapshot) for w in wiki_list],
    )
