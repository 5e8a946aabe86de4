"""Per-candidate and per-page classification expressions.

All of them are null-preserving, ANSI-safe Column expressions: none can
raise on malformed input, so a single bad row never fails a job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagerecs.schemas import INSTANCE_OF_DDL, NON_ARTICLE_INSTANCES

# Numeric rating -> confidence label.
CONFIDENCE_LABELS = ((1, "high"), (2, "medium"), (3, "low"))

# Note prefix (case-sensitive) -> source label, tested in order.
SOURCE_PREFIXES = (
    ("image was in the Wikidata item", "wikidata"),
    ("image was found in the following Wikis:", "wikipedia"),
    ("image was found in the Commons category", "commons"),
)

# The list of wikis follows this marker in a note.
FOUND_ON_MARKER = "Wikis:"
FOUND_ON_PATTERN = FOUND_ON_MARKER + r"\s+(.*)$"

# Integral part of a plain decimal numeral ("2", "2.0", " 3 ", "+1.", "-4.75").
# Anything else ("1e0", "abc", "", "NaN") yields no match. This reproduces the
# truncating string->int cast of non-ANSI Spark without its exceptions.
_INTEGRAL_NUMERAL = r"^\s*([+-]?[0-9]+)(\.[0-9]*)?\s*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rating_value(rating: Column | str = "rating") -> Column:
    """Rating text -> int, truncating any fraction; NULL when unparsable or
    out of int range (``try_cast``)."""
    return F.regexp_extract(_col(rating), _INTEGRAL_NUMERAL, 1).try_cast("int")


def confidence_rating(rating: Column | str = "rating") -> Column:
    """1/2/3 -> high/medium/low; any other value or NULL -> NULL."""
    labels = F.create_map(*[F.lit(x) for pair in CONFIDENCE_LABELS for x in pair])
    return labels[rating_value(rating)]  # a lookup, so that the text is parsed once


def candidate_source(note: Column | str = "note") -> Column:
    """Where a candidate image was found, from the prefix of its note:
    wikidata / wikipedia / commons; unknown prefix or NULL -> NULL."""
    note = _col(note)
    expr = None
    for prefix, label in SOURCE_PREFIXES:
        cond = note.startswith(prefix)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


source_of = candidate_source


def found_on(note: Column | str = "note") -> Column:
    """Wikis listed after ``Wikis:`` in the note, whitespace removed, split
    on commas. A note without the marker gives ``[""]``; NULL gives NULL
    (every step below propagates NULL). Most notes have no marker and meet no
    regular expression."""
    note = _col(note)
    listed = F.regexp_extract(note, FOUND_ON_PATTERN, 1)
    split = F.split(F.regexp_replace(listed, r"\s+", ""), ",")
    return F.when(note.contains(FOUND_ON_MARKER), split).when(note.isNotNull(), F.array(F.lit("")))


def instance_of_id(instance_of: Column | str = "instance_of") -> Column:
    """Entity id (e.g. ``Q577``) from the instance_of JSON text; NULL or
    malformed JSON -> NULL (``from_json`` is PERMISSIVE)."""
    return F.from_json(_col(instance_of), INSTANCE_OF_DDL).getField("id")


def is_article_page(entity_id: Column | str = "instance_of") -> Column:
    """False iff the entity id is one of the non-article classes; a NULL id
    counts as an article page."""
    listed = _col(entity_id).isin(*NON_ARTICLE_INSTANCES)
    return ~F.coalesce(listed, F.lit(False))
