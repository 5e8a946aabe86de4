"""Benchmark decontamination with SimHash windows and multi-index Hamming blocks.

DataFrame and SQL functions only. A text's words are runs of characters other
than space and \\t \\n \\v \\f \\r, with A-Z lower-cased; five in a row make a
shingle (an item with fewer words is one shingle). A document is looked at
through windows of each item's size. A window without any shingle of the
benchmark has similarity 0 to all of it, so only the windows of an item's
size around such a shingle are fingerprinted: every start that takes it in.

A fingerprint has 60 bits: bit j is the majority of bit j of the window's
features, a feature being a shingle and its running number among equal ones
in the window, so that a repeated shingle counts as so many different ones.
It is cut into ten blocks of six bits, and the index lists an item under
every block value within two bits of its own. Two fingerprints that differ in
at most ``RADIUS`` = 29 bits differ in at most two bits in some block, so
their meeting there is certain. Of the pairs met, those within the radius are
verified exactly: the weighted Jaccard similarity of the two shingle
multisets, a shingle's weight being how often it occurs, must be at least
0.75. At 0.75 two windows of one size share 6/7 of their features, a bit
differs with chance arccos(6/7) / pi = 0.172 for many features, and more than
29 of 60 do with a chance of some 6e-9 (binomial); such a pair is lost.

Results for odd input: null or empty texts and items match nothing; a text
shorter than an item is one window; repeated rows give one result per
(doc_id, text, item); null doc_ids are kept; an empty table or benchmark gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagerecs.llm.common import LOWER, UPPER, keep, set_apart, small

WIDTH, SIMILARITY, RADIUS = 5, 0.75, 29
#: Lanes of a long that count bits, their bits, and the fingerprint's blocks.
LANES, LANE_BITS, BLOCKS, BLOCK_BITS = 4, 15, 10, 6
#: What a block may differ by.
NEAR = [x for x in range(1 << BLOCK_BITS) if x.bit_count() <= 2]
#: Most start places that go to every executor with the documents they are in.
BROADCAST_PLACES = 4_000_000


def _words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _shingles(words: Column, width: Column) -> Column:
    """Hashes of all runs of ``width`` words; none if there are fewer."""
    at = F.sequence(F.lit(1), F.size(words) - width + 1)
    found = F.transform(at, lambda i: F.xxhash64(F.slice(words, i, width)))
    return F.when(F.size(words) >= width, found).otherwise(F.array().cast("array<bigint>"))


def _features(shingles: Column) -> Column:
    """The shingles, each but the first of equal ones hashed with its running number."""
    ordered = F.array_sort(shingles)

    def feature(x: Column, i: Column) -> Column:
        number = i + 1 - F.array_position(ordered, x)
        return F.when(number == 0, x).otherwise(F.xxhash64(x, number.cast("bigint")))

    distinct = F.size(F.array_distinct(shingles)) == F.size(shingles)
    return F.when(distinct, shingles).otherwise(F.transform(ordered, feature))


def fingerprint(hashes: Column, n: Column) -> Column:
    """SimHash of an array of ``n`` (at most 16,383) hashes. Four counters of
    15 bits share a long; adding the complement of the majority lifts a
    counter's top bit if it has one."""
    ones = sum(1 << LANE_BITS * k for k in range(LANES))
    lift = (F.lit((1 << LANE_BITS - 1) - 1) - F.floor(n / 2)).cast("bigint") * F.lit(ones)

    def bits(j: int) -> Column:
        lanes = F.transform(hashes, lambda h: F.shiftrightunsigned(h, j).bitwiseAND(F.lit(ones)))
        counts = F.aggregate(lanes, F.lit(0).cast("bigint"), lambda a, h: a + h)
        return F.shiftleft(F.shiftrightunsigned(counts + lift, LANE_BITS - 1).bitwiseAND(F.lit(ones)), j)

    return reduce(Column.bitwiseOR, map(bits, range(LANE_BITS)))


def _block(print_: Column, k: int) -> Column:
    return F.shiftrightunsigned(print_, BLOCK_BITS * k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, width, n, item_shingles, item_print) of every item with words."""
    items = benchmark.select("item_id", _words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("width", F.least(F.size("words"), F.lit(WIDTH)))
    items = items.withColumn("item_shingles", _shingles(F.col("words"), F.col("width"))).drop("words")
    items = items.withColumn("n", F.size("item_shingles"))
    return items.withColumn("item_print", fingerprint(_features(F.col("item_shingles")), F.col("n")))


def _overlap(one: Column, two: Column) -> Column:
    """Size of the intersection of two multisets."""
    distinct = (F.size(F.array_distinct(one)) == F.size(one)) & (F.size(F.array_distinct(two)) == F.size(two))
    least = F.aggregate(
        F.array_distinct(one),
        F.lit(0),
        lambda a, x: a + F.least(F.size(F.filter(one, lambda y: y == x)), F.size(F.filter(two, lambda y: y == x))),
    )
    return F.when(distinct, F.size(F.array_intersect(one, two))).otherwise(least)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, similarity, start_word, n_words): the best
    window for every document and item that are near duplicates there."""
    items = keep(_items(benchmark), "items")
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # 1 to WIDTH
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _words(F.col("text")).alias("words"))
    if not widths:
        return docs.limit(0).select(
            "doc_id", "text_hash", F.lit(0).cast(items.schema["item_id"].dataType).alias("item_id"),
            F.lit(0.0).alias("similarity"), F.lit(0).alias("start_word"), F.lit(0).alias("n_words"),
        )

    # where documents have shingles of the benchmark
    listed = keep(items.select("width", "n", F.explode("item_shingles").alias("shingle")).distinct(), "item-shingles")
    all_widths = F.array(*(F.struct(F.lit(w).alias("width"), _shingles(F.col("words"), F.lit(w)).alias("shingles")) for w in widths))
    docs = docs.select("doc_id", "text_hash", F.inline(all_widths))
    places = docs.select("doc_id", "text_hash", "width", F.posexplode("shingles").alias("at", "shingle"))
    found = places.join(small(listed, listed.count()), ["width", "shingle"])
    found = found.groupBy("doc_id", "text_hash", "width", "n").agg(F.collect_set("at").alias("places"))
    found = keep(found.withColumnsRenamed({"doc_id": "d", "text_hash": "h", "width": "w"}), "places")
    much = found.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]

    # windows of an item's size around them, and their fingerprints
    few = small(found, much, BROADCAST_PLACES)
    here = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_hash").eqNullSafe(F.col("h")) & (F.col("width") == F.col("w"))
    last = F.greatest(F.size("shingles") - F.col("n"), F.lit(0))
    starts = F.transform("places", lambda p: F.sequence(F.least(F.greatest(p - F.col("n") + 1, F.lit(0)), last), F.least(p, last)))
    windows = (
        docs.join(few, here)
        .dropDuplicates(["doc_id", "text_hash", "width", "n"])
        .select("doc_id", "text_hash", "width", "n", "shingles", F.explode(F.array_distinct(F.flatten(starts))).alias("start"))
        .select("doc_id", "text_hash", "width", "n", "start", F.slice("shingles", F.col("start") + 1, F.col("n")).alias("window"))
        .withColumn("features", _features(F.col("window")))
        .withColumn("print", fingerprint(F.col("features"), F.size("window")))
        .drop("features")
    )
    windows = keep(windows, "windows")

    # meetings in a block, within the radius, verified
    near = F.array(*map(F.lit, NEAR))
    of_item = F.array(*(F.struct(F.lit(k).alias("block"), _block(F.col("item_print"), k).alias("value")) for k in range(BLOCKS)))
    index = items.select("item_id", "width", "n", "item_shingles", "item_print", F.inline(of_item))
    index = index.select("*", F.explode(near).alias("off")).withColumn("value", F.col("value").bitwiseXOR(F.col("off"))).drop("off")
    of_window = F.array(*(F.struct(F.lit(k).alias("block"), _block(F.col("print"), k).alias("value")) for k in range(BLOCKS)))
    met = windows.select("*", F.inline(of_window)).join(small(index, items.count() * BLOCKS * len(NEAR)), ["width", "n", "block", "value"])
    apart = F.col("print").bitwiseXOR(F.col("item_print"))
    first = F.coalesce(*(F.when(F.bit_count(_block(apart, k)) <= 2, F.lit(k)) for k in range(BLOCKS)))
    met = met.where((F.bit_count(apart) <= RADIUS) & (F.col("block") == first))  # each pair once
    shared = _overlap(F.col("window"), F.col("item_shingles"))
    met = met.withColumn("shared", shared)
    similarity = F.col("shared") / (F.size("window") + F.size("item_shingles") - F.col("shared"))
    met = met.withColumn("similarity", similarity).where(F.col("similarity") >= SIMILARITY)
    best = F.max_by(F.struct("similarity", "start", (F.size("window") + F.col("width") - 1).alias("words")), F.struct("similarity", -F.col("start")))
    return (
        met.groupBy("doc_id", "text_hash", "item_id")
        .agg(best.alias("best"))
        .select(
            "doc_id", "text_hash", "item_id", "best.similarity",
            F.col("best.start").alias("start_word"), F.col("best.words").alias("n_words"),
        )
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a near duplicate of an item."""
    docs, named = set_apart(docs, "doc_id", "text")
    found = keep(leaks(docs, benchmark).select(F.col("doc_id").alias("d"), "text_hash").distinct(), "leaks")
    found = small(found.withColumnRenamed("text_hash", "h"), found.count())
    same = docs["doc_id"].eqNullSafe(found["d"]) & F.xxhash64(docs["text"]).eqNullSafe(found["h"])
    return named(docs.join(found, same, "left_anti"))
