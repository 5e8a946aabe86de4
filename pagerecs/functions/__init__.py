"""Column expressions. Every function takes column names or Columns and
returns a Column built from ``pyspark.sql.functions`` only (JVM-side,
whole-stage-codegen friendly; no Python UDFs)."""

from pagerecs.functions.candidates import (
    candidate_source,
    confidence_rating,
    found_on,
    instance_of_id,
    is_article_page,
    rating_value,
    source_of,
)

__all__ = [
    "candidate_source",
    "confidence_rating",
    "found_on",
    "instance_of_id",
    "is_article_page",
    "rating_value",
    "source_of",
]
