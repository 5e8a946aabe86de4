"""Exact set-similarity self-join of texts' five-word shingle sets, as components.

Two sets link when 100 * intersection >= 75 * union. A shingle is a 63-bit
hash; a set is listed by its smallest hashes, which are a random sample of
it, so the first shingles of a pair's union hold a shared one but for odds
far below those of a hash collision. The index lists, for each shingle, the
sets that have it among their smallest, with position and size:

* Equal sets are one entry (their class's representative).
* Lists of a shingle of one set are skipped whole. A short list's entries
  meet one another, except where sizes or positions rule a link out.
* Long lists hold shared passages or groups of near copies. Only sets that
  consist of such shingles to a good part can link by them alone; each of
  those meets first the list's leading set.
* Set-relation skipping: each set's most alike candidate is verified first,
  and a set joins the family of that candidate; in long lists, the sets
  outside the largest component do so again with other sets of it. Entries
  of one component
  then skip one another, and in long lists only the entries outside the
  list's largest component go on to meet the others, a pair in the first
  of its common lists alone. What is left is
  resolved between families: from the overlap of the two leading sets and
  the members' known differences to them follows a bound on every pair's
  overlap, and only pairs that it leaves open are verified themselves.

The odds: of a pair at the threshold, whose sets list at least 32 of their
shingles, the first 32 shingles of the union hold none of the shared ones
with a chance of 4 ** -32; where a part p of both sets lies in long lists,
1 / 2 ** 32 at most. Sets of fewer shingles are listed whole.

Results for odd input: a null or empty text or one without words has the
empty set and links with nothing; repeated rows each give their row; a null
doc_id counts only where its whole component has no other; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagerecs.llm.common import byte_runs, give_back, set_apart, small
from pagerecs.llm.common import keep_dropping as keep
from pagerecs.llm.graph import components
from pagerecs.llm.words import shingles, words

#: Smallest hashes kept of a set; how many of those outside long lists, and
#: in them, are indexed; entries that make a list long; words (64 bits) of
#: the parity sketch.
LISTED, SHORT_DEPTH, LONG_DEPTH, LONG, PARITY = 64, 32, 24, 16, 8
#: Times that sets outside a long list's largest component are compared to one more set of it.
LEADERS = 3
#: A set meets others in long lists if less than this part of it lies outside them.
OUTSIDE = 0.65
#: Least share of the sampled shingles that linked sets have in common.
LEAST_SAMPLE = 0.3


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of every text with words, in order."""
    for first, _, data, offsets in byte_runs(column, 1 << 20):
        rows, values = shingles(*words(data, offsets))
        if not len(rows):
            continue
        values = (values >> np.uint64(1)).view(np.int64)
        heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]][: len(rows)])
        for a, b in zip(heads, np.r_[heads[1:], len(rows)], strict=True):
            yield first + int(rows[a]), np.unique(values[a:b])


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, key1, key2, low, parity) per row: set size, two
    64-bit sums that name the set, its smallest shingles, and the parity of
    its shingles in each of 64 * PARITY cells."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            rows = len(batch)
            n, key1, key2 = (np.zeros(rows, np.int64) for _ in range(3))
            low, parity = [[]] * rows, np.zeros((rows, PARITY), np.int64)
            for row, s in _sets(batch.column(1)):
                n[row], key1[row], key2[row] = len(s), s.sum(), np.bitwise_xor.reduce(s * s + s)
                low[row] = s[:LISTED]
                odd = np.bincount(s & (64 * PARITY - 1), minlength=64 * PARITY).astype(np.uint8) & 1
                parity[row] = np.packbits(odd).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(n),
                    pa.array(key1),
                    pa.array(key2),
                    pa.array(low, pa.list_(pa.int64())),
                    pa.array(list(parity), pa.list_(pa.int64())),
                ],
                ["doc_id", "text_hash", "n", "key1", "key2", "low", "parity"],
            )
        give_back()

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        sketch,
        f"doc_id {kind}, text_hash bigint, n bigint, key1 bigint, key2 bigint, low array<bigint>, parity array<bigint>",
    )


def needed(a: Column, b: Column, percent: int) -> Column:
    """The least overlap, times (100 + percent), with which sets of a and b shingles link."""
    return F.lit(percent) * (a + b)


def _possible(percent: int) -> Column:
    """A pair (n, m, parity, other_parity) may link: by its sizes and by its
    parities, which differ in no more cells than the sets do in shingles."""
    apart = sum(
        (F.bit_count(F.get("parity", F.lit(k)).bitwiseXOR(F.get("other_parity", F.lit(k)))) for k in range(1, PARITY)),
        F.bit_count(F.get("parity", F.lit(0)).bitwiseXOR(F.get("other_parity", F.lit(0)))),
    )
    sizes = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    return sizes & ((F.col("n") + F.col("m") - apart) * (100 + percent) >= 2 * needed(F.col("n"), F.col("m"), percent))


def _alike(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may link, with ``alike``, their sampled similarity."""
    one = reps.select(F.col("node").alias("a"), "n", "low", "parity")
    two = reps.select(
        F.col("node").alias("b"), F.col("n").alias("m"), F.col("low").alias("other_low"), F.col("parity").alias("other_parity")
    )
    both = pairs.join(one, "a").join(two, "b").where(_possible(percent))
    whole = F.lit((1 << 63) - 1)  # a set with fewer than LISTED shingles is listed whole
    edge = F.least(
        F.when(F.size("low") == LISTED, F.element_at("low", -1)).otherwise(whole),
        F.when(F.size("other_low") == LISTED, F.element_at("other_low", -1)).otherwise(whole),
    )
    both = both.withColumn("edge", edge).withColumn("shared", F.size(F.array_intersect("low", "other_low")))
    within = [F.size(F.filter(c, lambda h: h <= F.col("edge"))) for c in ("low", "other_low")]
    both = both.withColumn("alike", F.col("shared") / (within[0] + within[1] - F.col("shared")))
    return both.where(F.col("alike") >= LEAST_SAMPLE).select("a", "b", "n", "m", "alike")


def _full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles): whole sets of the given nodes (node, doc_id, text_hash), from their texts."""
    nodes = keep(nodes, "nodes")
    wanted = small(nodes.withColumnsRenamed({"doc_id": "d", "text_hash": "h"}), nodes.count())
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).select("node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_sets(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([row for row, _ in found], pa.int64())),
                    pa.array([s for _, s in found], pa.list_(pa.int64())),
                ],
                ["node", "shingles"],
            )
        give_back()

    found = texts.mapInArrow(sets, "node bigint, shingles array<bigint>")
    return keep(found.dropDuplicates(["node"]), "sets")


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` with ``overlap``, the exact size of their intersection."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("one"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("two"))
    overlap = F.size(F.array_intersect("one", "two")).cast("bigint")
    return pairs.join(one, "a").join(two, "b").withColumn("overlap", overlap).drop("one", "two")


def _links(pairs: DataFrame, percent: int) -> Column:
    return F.col("overlap") * (100 + percent) >= needed(pairs["n"], pairs["m"], percent)


def crossed(long: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may link, of sets with different labels in long lists
    (shingle, node, n, pos, la, parity); each pair once, from the first list of both."""
    of_set = long.groupBy("node").agg(F.sort_array(F.collect_list("shingle")).alias("lists"))  # LONG_DEPTH at most
    long = long.join(of_set, "node").withColumn("before", F.filter("lists", lambda s: s < F.col("shingle"))).drop("lists")
    count = long.groupBy("shingle", "la").agg(F.count("*").alias("c")).groupBy("shingle")
    largest = count.agg(F.max_by("la", F.struct("c", -F.col("la"))).alias("largest"), F.count("*").alias("labels")).where("labels > 1")
    mixed = long.join(largest.drop("labels"), "shingle")
    minor = mixed.where("la != largest").drop("largest")
    others = mixed.select(
        "shingle", F.col("node").alias("b"), F.col("n").alias("m"), F.col("pos").alias("other_pos"),
        F.col("la").alias("lb"), F.col("parity").alias("other_parity"), F.col("before").alias("other_before"),
        F.col("la").eqNullSafe(F.col("largest")).alias("major"),
    )
    meets = (F.col("la") != F.col("lb")) & (F.col("major") | (F.col("node") < F.col("b")))
    near = F.col("pos") + F.col("other_pos") < LONG_DEPTH  # their first shared shingle lies among so many of the union
    first = ~F.arrays_overlap("before", "other_before")
    found = minor.join(others, "shingle").where(meets & near & _possible(percent) & first)
    return found.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))


def join(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash, stays) for every row; see
    the module. One row of each component ``stays``, and every empty set."""
    rows = sketches(docs).withColumn("row_id", F.monotonically_increasing_id())
    rows = keep(rows, "sketches")
    classes = rows.where("n > 0").groupBy("n", "key1", "key2").agg(
        F.min_by(F.struct("row_id", "doc_id", "text_hash", "low", "parity"), F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")).alias("r")
    )
    reps = keep(classes.select("n", "key1", "key2", "r.*").withColumnRenamed("row_id", "node"), "representatives")

    # the index: shingles of at least two sets, short lists and long ones
    entries = reps.select("node", "n", F.size("low").alias("listed"), F.posexplode("low").alias("pos", "shingle"))
    length = entries.groupBy("shingle").agg(F.count("*").alias("length")).where("length > 1")
    shared = keep(entries.join(length, "shingle"), "shared-shingles")
    is_long = F.col("length") >= LONG
    long_at = F.sort_array(F.collect_list(F.when(is_long, F.col("pos"))))  # LISTED at most
    of_set = shared.groupBy("node").agg(long_at.alias("long_at"))
    shared = shared.join(of_set, "node")
    before = F.size(F.filter("long_at", lambda p: p < F.col("pos")))
    short = shared.where(~is_long & (F.col("pos") - before < SHORT_DEPTH)).select("shingle", "node", "n")
    outside = 1 - F.size("long_at") / F.col("listed")
    long = shared.where(is_long & (outside < OUTSIDE) & (F.col("pos") < LONG_DEPTH)).select("shingle", "node", "n", "pos")
    long = keep(long, "long-lists")
    other = short.select("shingle", F.col("node").alias("b"), F.col("n").alias("m"))
    met = short.join(other, "shingle").where("node < b").where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)
    leaders = long.groupBy("shingle").agg(F.min("node").alias("b"))
    led = long.join(leaders, "shingle").where("node != b")
    pairs = met.select(F.col("node").alias("a"), "b").unionByName(led.select(F.col("b").alias("a"), F.col("node").alias("b"))).distinct()
    pairs = keep(_alike(pairs, reps, percent), "candidates")

    names = reps.select("node", "doc_id", "text_hash")

    def sets_of(found: DataFrame) -> DataFrame:
        ends = found.select(F.col("a").alias("node")).union(found.select("b")).distinct()
        return _full_sets(docs, names.join(ends, "node"))

    def best_links(found: DataFrame) -> DataFrame:
        """The links among each set's most alike candidates."""
        other = [F.col("b").alias("a"), F.col("a").alias("b"), F.col("m").alias("n"), F.col("n").alias("m"), "alike"]
        best = F.max_by(F.struct("b", "n", "m"), F.struct("alike", -F.col("b"))).alias("x")
        best = found.unionByName(found.select(*other)).groupBy("a").agg(best).select("a", "x.*")
        ordered = F.col("a") < F.col("b")
        sizes = [F.when(ordered, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("n", "m", "n"), ("m", "n", "m"))]
        best = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *sizes).distinct()
        best = _overlaps(best, sets_of(best))
        return best.where(_links(best, percent))

    def labelled(found: DataFrame, node: str, label: str) -> DataFrame:
        named = labels.select(F.col("node").alias(node), F.col("label").alias(label))
        return found.join(named, node, "left").withColumn(label, F.coalesce(label, node))

    # each set's most alike candidate first: families and components
    links = keep(best_links(pairs), "links")
    labels = components(links.select("a", "b"))
    for turn in range(LEADERS):
        # in long lists, sets outside the largest component meet one more set of that component
        lists = labelled(long, "node", "la")
        count = lists.groupBy("shingle", "la").agg(F.count("*").alias("c")).groupBy("shingle")
        largest = count.agg(F.max_by("la", F.struct("c", -F.col("la"))).alias("largest"), F.count("*").alias("labels"))
        mixed = keep(lists.join(largest.where("labels > 1"), "shingle"), "mixed-lists")
        if mixed.isEmpty():
            break
        lead = mixed.where("la = largest").groupBy("shingle").agg(F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("b"))
        outer = mixed.where("la != largest").join(lead, "shingle")
        outer = outer.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        more = best_links(keep(_alike(outer, reps, percent), "candidates-outside"))
        links = keep(links.unionByName(more), "links")
        labels = components(links.select("a", "b"))

    # what is left between components: short lists' pairs, and in long lists all but the largest component against the rest
    rest = labelled(labelled(pairs.select("a", "b"), "a", "la"), "b", "lb").where("la != lb").select("a", "b")
    long = keep(labelled(long, "node", "la").join(reps.select("node", "parity"), "node"), "long-lists-labelled")
    rest = rest.unionByName(crossed(long, percent)).distinct()
    rest = keep(_alike(rest, reps, percent), "candidates-between")

    # families: a linked set's differences to its leading set bound its overlaps with others
    family = links.select(F.col("b").alias("node"), F.col("a").alias("lead"), (F.col("m") - F.col("overlap")).alias("apart"))
    family = family.groupBy("node").agg(F.min_by(F.struct("lead", "apart"), F.struct("apart", "lead")).alias("f")).select("node", "f.*")
    sizes = reps.select(F.col("node").alias("lead"), F.col("n").alias("lead_n"))
    family = keep(family.join(sizes, "lead"), "families")

    def with_family(found: DataFrame, node: str, size: str, tag: str) -> DataFrame:
        named = family.select(F.col("node").alias(node), *(F.col(c).alias(f"{tag}_{c}") for c in ("lead", "apart", "lead_n")))
        found = found.join(named, node, "left")
        own = {"lead": F.col(node), "apart": F.lit(0), "lead_n": F.col(size)}
        return found.withColumns({f"{tag}_{c}": F.coalesce(F.col(f"{tag}_{c}"), v) for c, v in own.items()})

    rest = keep(with_family(with_family(rest, "a", "n", "one"), "b", "m", "two"), "pairs-of-families")
    leads = rest.where("one_lead != two_lead").select(
        F.col("one_lead").alias("a"), F.col("two_lead").alias("b"), F.col("one_lead_n").alias("n"), F.col("two_lead_n").alias("m")
    ).distinct()
    sets = sets_of(rest.select("a", "b").unionByName(leads.select("a", "b")))
    leads = keep(_overlaps(leads, sets), "overlaps-of-families")
    known = leads.select(F.col("a").alias("one_lead"), F.col("b").alias("two_lead"), "overlap", _links(leads, percent).alias("linked"))
    bound = (F.col("overlap") + F.col("one_apart") + F.col("two_apart")) * (100 + percent) >= needed(F.col("n"), F.col("m"), percent)
    open_ = rest.join(known, ["one_lead", "two_lead"], "left").where(F.col("overlap").isNull() | (~F.col("linked") & bound))
    open_ = _overlaps(open_.select("a", "b", "n", "m"), sets)
    more = leads.where(_links(leads, percent)).select("a", "b").unionByName(open_.where(_links(open_, percent)).select("a", "b"))
    labels = components(links.select("a", "b").unionByName(more))

    named = labelled(reps.select("node", "doc_id", "n", "key1", "key2"), "node", "label")
    first_of = F.min_by("node", F.struct(F.col("doc_id").isNull(), "doc_id", "node"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"), first_of.alias("first"))
    named = keep(named.join(least, "label").select("n", "key1", "key2", "component_id", "first"), "classes")
    found = rows.select("doc_id", "text_hash", "row_id", "n", "key1", "key2").join(named, ["n", "key1", "key2"], "left")
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "text_hash",
        ((F.col("n") == 0) | (F.col("row_id") == F.col("first"))).alias("stays"),
    )


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` with the first document of each component (least doc_id, null
    last), and every text without words."""
    docs, named = set_apart(docs, "doc_id", "text")
    found = keep(join(docs, percent), "components").withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    rows = found.groupBy("d", "h").agg(F.max("stays").alias("stays"), F.count("*").alias("rows"), F.max("n_shingles").alias("n"))
    rows = keep(rows, "rows-that-stay")
    same = docs["doc_id"].eqNullSafe(F.col("d")) & F.xxhash64(docs["text"]).eqNullSafe(F.col("h"))
    gone = rows.where(~F.col("stays")).select("d", "h")
    left = docs.join(small(gone, gone.count()), same, "left_anti")
    repeated = rows.where("stays and rows > 1 and n > 0").select("d", "h")
    if not (n := repeated.count()):
        return named(left)
    once = left.join(small(repeated, n), same, "left_semi").withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"])
    return named(left.join(small(repeated, n), same, "left_anti").unionByName(once.select(*docs.columns)))
