"""Table schemas, the instance_of JSON contract and the schema check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
)

# The three schemas (names, types and order of the published tables).
#
# Raw algorithm output, one row per page, candidates nested.
# Partition columns (wiki_db, snapshot) come last, as partition discovery
# appends them there.
RAW_SCHEMA = StructType(
    [
        StructField("item_id", StringType(), True),
        StructField("page_id", LongType(), True),
        StructField("page_title", StringType(), True),
        StructField(
            "top_candidates",
            ArrayType(MapType(StringType(), StringType(), True), True),
            True,
        ),
        StructField("instance_of", StringType(), True),
        StructField("wiki_db", StringType(), True),
        StructField("snapshot", StringType(), True),
    ]
)
RAW_PARTITION_COLUMNS = ("wiki_db", "snapshot")

# Production table, one row per (page, image); pages without candidates keep
# one row with a NULL image.
PROD_SCHEMA = StructType(
    [
        StructField("page_id", LongType(), True),
        StructField("page_title", StringType(), True),
        StructField("image_id", StringType(), True),
        StructField("confidence_rating", StringType(), True),
        StructField("source", StringType(), True),
        StructField("instance_of", StringType(), True),
        StructField("is_article_page", BooleanType(), True),
        StructField("dataset_id", StringType(), True),
        StructField("insertion_ts", DoubleType(), True),
        StructField("found_on", ArrayType(StringType(), True), True),
        StructField("wiki", StringType(), True),
        StructField("snapshot", StringType(), True),
    ]
)
PROD_PARTITION_COLUMNS = ("wiki", "snapshot")

# Search-index feed: one row per (wiki, page) that has a suggestion.
SEARCH_SCHEMA = StructType(
    [
        StructField("wikiid", StringType(), True),
        StructField("page_id", IntegerType(), True),
        StructField("page_namespace", IntegerType(), True),
        StructField("recommendation_type", StringType(), True),
        StructField("year", IntegerType(), True),
        StructField("month", IntegerType(), True),
        StructField("day", IntegerType(), True),
    ]
)
SEARCH_PARTITION_COLUMNS = ("year", "month", "day")

# The JSON shape of the instance_of column (a knowledge-base entity
# reference); only `id` is used downstream.
INSTANCE_OF_DDL = "struct<`entity-type`:string,`numeric-id`:bigint,id:string>"

# Entity classes whose instances are not article pages
# (year, year BC, calendar year, recurrent timeframe, century leap year,
# family name, name, disambiguation page, list, natural number, positive
# integer, non-negative integer).
NON_ARTICLE_INSTANCES = (
    "Q577",
    "Q29964144",
    "Q3186692",
    "Q14795564",
    "Q3311614",
    "Q101352",
    "Q82799",
    "Q4167410",
    "Q13406463",
    "Q21199",
    "Q28920044",
    "Q28920052",
)


class SchemaMismatchError(AttributeError):
    """Raised when a frame does not carry exactly the expected schema."""


def require_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """Return ``df`` unchanged if its schema equals ``schema`` exactly
    (names, order, types, nullability); raise otherwise.

    Analysis-time only: ``df.schema`` resolves the plan, it runs no job.
    """
    if df.schema != schema:
        raise SchemaMismatchError(
            f"Invalid schema. Expected '{schema.simpleString()}'. "
            f"Got '{df.schema.simpleString()}'"
        )
    return df
