"""Raw-shaped candidate table derived from the driver's TPC-H-style tables.

Pages come from ``orders`` and candidates from ``lineitem`` (one candidate per
line item), by rules of modular arithmetic that the DuckDB oracles restate over
the flat tables. Ratings, notes and images follow different columns, so a
candidate can miss a key, carry a rating that is no number or contradict its
note. Deterministic: no clocks, no order-dependent output (array order is
irrelevant, every consumer treats the output as a bag).

Plan: ``lineitem`` is dealt by order key and aggregated into one array per
order, then sort-merge-joined (left) to ``orders``, dealt alike, so there is one
shuffle per side; a second one gathers the pages of a partition of the table.
What is shuffled and sorted are the few numbers that the rules give; the texts
and maps made from them, several times as large, are written where they are made. Large inputs are dealt over a number of tasks that grows with the rows
(``ROWS_PER_TASK``). An array holds an order's line items (17 at most at sf0.1);
a production raw table arrives already nested.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagerecs.functions.candidates import SOURCE_PREFIXES
from pagerecs.schemas import NON_ARTICLE_INSTANCES, RAW_PARTITION_COLUMNS, RAW_SCHEMA

NULL_ARRAY_MODULUS = 97  # o_orderkey % 97 = 0 -> NULL candidate array
WIKIS_BY_CUSTKEY = ("kowiki", "plwiki", "enwiki", "arwiki")  # o_custkey % 4
#: (l_linenumber + l_partkey % 5 / 4) % 8; None leaves the key out
RATINGS = ("abc", "1", "2.0", "3", "1.9", "2", " 3 ", None)
#: l_linenumber % 5, then text of our own behind the fixed prefixes; None leaves the key out
(_WIKIDATA, _), (_WIKIS, _), (_COMMONS, _) = SOURCE_PREFIXES
NOTES = (None, f"{_WIKIDATA} of this page", f"{_WIKIS} ", f"{_COMMONS} that bears its name", "seen on a postcard")
LISTED_WIKIS = ("svwiki", "huwiki,nowiki,  cswiki", "")  # l_partkey % 3, behind the note of wikis
IMAGE_MODULUS = 23  # l_partkey % 23 = 0 -> no image key
#: o_orderkey % 18: the twelve classes, then other texts
ENTITIES = (
    *(f'{{"id":"{entity}","entity-type":"item"}}' for entity in NON_ARTICLE_INSTANCES),
    None,
    '{"id":"Q42", "numeric-id":42}',
    '{"id":7}',
    "{broken",
    "",
    "[1]",
)


def _pick(key: Column, values: Sequence[str | None]) -> Column:
    """The value at place ``key``, as a string."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), key.cast("int") + 1)


#: Line items that a task of the join holds, about, where the session's shuffle
#: partitions would hold more.
ROWS_PER_TASK = 2_000_000


def line_places(line: Column, part: Column) -> Column:
    """What a line item's candidate is made of: its places in the lists of ratings,
    notes and listed wikis, and its part."""
    return F.struct(
        ((line + F.floor(part % 5 / 4)) % len(RATINGS)).cast("int").alias("rating"),
        (line % len(NOTES)).cast("int").alias("note"),
        (part % 3).cast("int").alias("listed"),
        part.alias("part"),
    )


def candidate_of(places: Column) -> Column:
    """The candidate map of a line item; keys without a value are left out."""
    note = _pick(places["note"], NOTES)
    note = F.when(places["note"] == 2, F.concat(note, _pick(places["listed"], LISTED_WIKIS))).otherwise(note)
    part = places["part"]
    image = F.when(part % IMAGE_MODULUS != 0, F.concat(F.lit("img_"), part.cast("string"), F.lit(".jpg")))
    rating = _pick(places["rating"], RATINGS)
    every = F.create_map(F.lit("image"), image, F.lit("rating"), rating, F.lit("note"), note)
    return F.map_filter(every, lambda _, value: value.isNotNull())


def _dealt(df: DataFrame, tasks: int) -> DataFrame:
    """By page: over the session's shuffle partitions, or over more if ``tasks`` is."""
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(tasks, "page_id")
    return df.repartition("page_id")


def gather_pages(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """(page_id, wiki_db, snapshot, lines) per order: ``lines`` holds the
    ``line_places`` of its line items, NULL if there are none."""
    tasks = math.ceil(lineitem.count() / ROWS_PER_TASK)
    line = line_places(F.col("l_linenumber"), F.col("l_partkey"))
    lines = lineitem.select(F.col("l_orderkey").alias("page_id"), line.alias("line"))
    arrays = _dealt(lines, tasks).groupBy("page_id").agg(F.collect_list("line").alias("lines"))
    keys = orders.select(F.col("o_orderkey").alias("page_id"), "o_custkey", "o_orderdate")
    # Both sides grow with the data: a merge join, never a broadcast decided
    # on an estimate.
    joined = _dealt(keys, tasks).join(arrays.hint("merge"), "page_id", "left")
    return joined.select(
        "page_id",
        _pick(F.col("o_custkey") % 4, WIKIS_BY_CUSTKEY).alias("wiki_db"),
        F.date_format("o_orderdate", "yyyy-MM").alias("snapshot"),
        "lines",
    )


def raw_of(pages: DataFrame) -> DataFrame:
    """Raw table (``RAW_SCHEMA``) of gathered pages, with NULL, empty and
    non-empty arrays."""
    key = F.col("page_id")
    array_type = RAW_SCHEMA["top_candidates"].dataType
    candidates = F.transform("lines", candidate_of)
    top = F.when(key % NULL_ARRAY_MODULUS == 0, F.lit(None).cast(array_type)).otherwise(
        F.coalesce(candidates, F.array().cast(array_type))
    )
    return pages.select(
        F.concat(F.lit("Q"), key.cast("string")).alias("item_id"),
        "page_id",
        F.concat(F.lit("Page "), key.cast("string")).alias("page_title"),
        top.alias("top_candidates"),
        _pick(key % len(ENTITIES), ENTITIES).alias("instance_of"),
        "wiki_db",
        "snapshot",
    )


def derive_raw(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """The raw table's rows, clustered and ordered by its partitions as a write
    needs them. The join is read once and only gathered pages are sorted."""
    pages = gather_pages(orders, lineitem).hint("rebalance", *RAW_PARTITION_COLUMNS)
    return raw_of(pages.sortWithinPartitions(*RAW_PARTITION_COLUMNS))


def load_tables(spark, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet") for n in names]
