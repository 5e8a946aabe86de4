"""How the sources of a language differ in their terms, by iceberg prefix refinement.

A term is a run of letters (every character beyond ASCII counts as one), A-Z
lower-cased. A language keeps the terms found in ``LEAST_DOCUMENTS`` of its
documents. They are found by refinement: terms are cut to byte prefixes of a
first length, the documents that hold each prefix are counted, and prefixes
with too few are discarded, as no term below them can be kept; what is left is
extended to twice the length, until no prefix is left that is not a complete
term. Only then are the terms themselves counted, so the long tail of rare ones
never crosses the network. Survivors reach the next level as a bitmap of fixed
size (``BITS``), whatever their number: two prefixes on one bit let a term pass
a level that it should not, and the last count, by the terms' text, drops it.

Counts are summed in each task before any shuffle and keyed by (language,
prefix) or (language, source, term), so no key has more than a row per batch.
For the comparison, a language's kept terms are dealt to blocks of a bounded
number of (term, source) cells; a block gives its part of the value of every
two sources and each source's greatest terms, which are summed and ranked.

All arithmetic is in integers and exact while a count stays below 9e15. A term
is known by 64 bits of its bytes while a batch is counted (4 MB of text): two
terms of one batch meet with odds of about 1e-8.

Results for odd input: null text, language or source count as ''; a group
without terms has its rows of part ``pair``; a language without kept terms has
pairs of value 0; a language with a single source has no pairs; repeated rows
and null ids each count as documents; an empty table gives no rows; columns
beside text, lang and source are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagerecs.llm.common import byte_runs, give_back, keep
from pagerecs.llm.words import Terms, mixed

#: A kept term's documents at least; terms ranked per source.
LEAST_DOCUMENTS, TOP = 10, 10
#: Bytes of the first level's prefixes; each later level has twice as many.
FIRST_LEVEL = 6
#: Bits of the map of surviving prefixes, and (term, source) cells of a block.
BITS, BLOCK_CELLS = 1 << 24, 1 << 18
#: Share by which shares of counts are multiplied before they are cut to integers.
SCALE_STEPS, SCALE_STEP = 3, 1000

RESULT = "lang string, source string, part string, item string, value long"


def _of_names(names: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of a string column, a hash of each code's text, and the texts."""
    coded = names.dictionary_encode()
    texts = coded.dictionary
    hashes = [int.from_bytes(blake2b(t.encode(), digest_size=8).digest(), "little") for t in texts.to_pylist()]
    return coded.indices.to_numpy(), np.array(hashes, np.uint64), texts


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BITS)).astype(np.int64)


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = _slot(hashes)
    return (bitmap[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) > 0


def _level(docs: DataFrame, width: int, bitmap: np.ndarray | None) -> DataFrame:
    """(prefix, open, documents) of every prefix of ``width`` bytes whose prefix
    of half as many is in ``bitmap``; a term that is no longer than ``width`` is
    its own prefix, complete and not open."""
    before = width // 2

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, seeds, _ = _of_names(batch.column(0))
            for first, end, data, offsets in byte_runs(batch.column(1)):
                found, seed = Terms(data, offsets), seeds[codes[first:end]]
                size = found.ends - found.starts
                some = np.arange(len(size))
                if bitmap is not None:
                    some = np.flatnonzero(size > before)
                    upper = found.hashes(some, found.starts[some] + before, seed[found.rows[some]])
                    some = some[_has(bitmap, upper)]
                is_open = size[some] > width
                hashes = found.hashes(some, found.starts[some] + np.minimum(size[some], width), seed[found.rows[some]])
                hashes = np.where(is_open, hashes, mixed(hashes))  # a complete term is not a prefix
                # each once a document
                key = mixed(hashes + found.rows[some].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                _, once = np.unique(key, return_index=True)
                value, at, count = np.unique(hashes[once], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), pa.array(is_open[once[at]]), pa.array(count)],
                    ["prefix", "open", "documents"],
                )
        give_back()

    rows = docs.select("lang", "text").mapInArrow(prefixes, "prefix long, open boolean, documents long")
    return rows.groupBy("prefix", "open").agg(F.sum("documents").alias("documents"))


def _map_of(survivors: DataFrame) -> tuple[np.ndarray, bool]:
    """The bitmap of surviving prefixes and whether any of them is open."""
    slot = F.col("prefix").bitwiseAND(F.lit(BITS - 1))
    bit = F.expr(f"shiftleft(1L, cast(prefix & 63 as int))")
    words = survivors.groupBy(F.shiftright(slot, 6).alias("word")).agg(
        F.bit_or(bit).alias("bits"), F.max("open").alias("open")
    )
    table = words.toArrow()  # BITS / 64 rows at most
    bitmap = np.zeros(BITS // 64, np.uint64)
    bitmap[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return bitmap, bool(table["open"].to_numpy().any()) if table.num_rows else False


def surviving_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS, first: int = FIRST_LEVEL) -> np.ndarray:
    """The bitmap that holds every complete term of ``least`` documents of its language."""
    width, bitmap, complete = first, None, np.zeros(BITS // 64, np.uint64)
    while True:
        bitmap, is_open = _map_of(_level(docs, width, bitmap).where(F.col("documents") >= least))
        complete |= bitmap
        if not is_open:
            return complete
        width *= 2


def term_counts(docs: DataFrame, complete: np.ndarray) -> DataFrame:
    """(lang, source, term, documents, n) of the terms in the bitmap."""
    golden = np.uint64(0x9E3779B97F4A7C15)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, seeds, langs = _of_names(batch.column(0))
            source, _, sources = _of_names(batch.column(1))
            group = lang.astype(np.int64) * len(sources) + source
            for first, end, data, offsets in byte_runs(batch.column(2)):
                found = Terms(data, offsets)
                some = np.arange(len(found.starts))
                seed = seeds[lang[first:end]]
                hashes = found.hashes(some, found.ends, seed[found.rows])
                kept = np.flatnonzero(_has(complete, mixed(hashes)))
                hashes, rows = hashes[kept], found.rows[kept]
                _, once, n = np.unique(
                    mixed(hashes + rows.astype(np.uint64) * golden), return_index=True, return_counts=True
                )
                of = group[first:end][rows[once]]
                _, at, which = np.unique(
                    mixed(hashes[once] + of.astype(np.uint64) * golden), return_index=True, return_inverse=True
                )
                of = of[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        langs.take(pa.array(of // max(len(sources), 1))),
                        sources.take(pa.array(of % max(len(sources), 1))),
                        found.texts(kept[once[at]]),
                        pa.array(np.bincount(which, minlength=len(at)).astype(np.int64)),
                        pa.array(np.bincount(which, n, len(at)).astype(np.int64)),
                    ],
                    ["lang", "source", "term", "documents", "n"],
                )
        give_back()

    schema = "lang string, source string, term string, documents long, n long"
    rows = docs.select("lang", "source", "text").mapInArrow(counts, schema)
    return rows.groupBy("lang", "source", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("n"))


def scaled_share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * count / total), by long division."""
    whole, rest = count // total, count % total
    for _ in range(SCALE_STEPS):
        rest = rest * SCALE_STEP
        whole = whole * SCALE_STEP + rest // total
        rest = rest % total
    return 1 + whole


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _compare(key: tuple, cells: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """One block's part of every pair's value, and the greatest terms of each source."""
    groups = groups.sort_values("source", ignore_index=True)
    sources, total = groups["source"].to_numpy(), groups["group_n"].to_numpy()
    n_terms = int(groups["kept"].iloc[0])
    out = []
    of_term, terms = pd.factorize(cells["term"].to_numpy(object), sort=True)
    of_source = pd.Categorical(cells["source"].to_numpy(object), categories=sources).codes
    count = np.zeros((len(terms), len(sources)), np.int64)
    count[of_term, of_source] = cells["n"].to_numpy()
    share = scaled_share(count + 2, np.maximum(total + 2 * n_terms, 1)[None, :])
    for s, source in enumerate(sources):
        others = np.flatnonzero(np.arange(len(sources)) != s)
        value = divergence(share[:, [s]], share[:, others]).sum(axis=0)
        out.append(pd.DataFrame({"source": source, "part": "pair", "item": sources[others], "value": value}))
    if len(terms):
        in_lang = np.zeros(len(terms), np.int64)
        in_lang[of_term] = cells["lang_term_n"].to_numpy()
        q = scaled_share(in_lang + 2, np.full(len(terms), groups["lang_n"].iloc[0] + 2 * n_terms))
        for s, source in enumerate(sources):
            some = np.flatnonzero((count[:, s] > 0) & (share[:, s] > q))
            value = divergence(share[some, s], q[some])
            best = np.argsort(-value, kind="stable")[:TOP]  # terms ascend, so ties do
            out.append(pd.DataFrame({"source": source, "part": "term", "item": terms[some[best]], "value": value[best]}))
    found = pd.concat(out)
    found.insert(0, "lang", groups["lang"].iloc[0])
    give_back()
    return found


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): see the registered query's contract."""
    blank = F.lit("")
    docs = docs.select(
        F.coalesce("lang", blank).alias("lang"),
        F.coalesce("source", blank).alias("source"),
        F.coalesce(F.col(text), blank).alias("text"),
    )
    counted = keep(term_counts(docs, surviving_terms(docs, least)), "term-counts")
    in_lang = counted.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("lang_term_n"))
    kept = counted.drop("documents").join(in_lang.where(F.col("documents") >= least), ["lang", "term"]).drop("documents")
    kept = keep(kept, "kept-terms")
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.countDistinct("term").alias("kept"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = docs.select("lang", "source").distinct()
    n_sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"))
    groups = groups.join(of_group, ["lang", "source"], "left").join(n_sources, "lang").join(of_lang, "lang", "left")
    groups = keep(groups.na.fill(0, ["group_n", "lang_n", "kept"]), "groups")
    blocks = F.ceil(F.col("kept") * F.col("n_sources") / BLOCK_CELLS)
    blocks = F.greatest(blocks.cast("long"), F.lit(1)).alias("blocks")
    of_lang = groups.select("lang", blocks).distinct()
    cells = kept.join(of_lang, "lang").withColumn("block", F.pmod(F.xxhash64("term"), "blocks"))
    dealt = groups.select("*", blocks).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = (
        cells.groupBy("lang", "block").cogroup(dealt.groupBy("lang", "block")).applyInPandas(_compare, RESULT)
    )
    found = keep(found, "compared")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = [rows.withColumn("rank", F.row_number().over(order)) for rows in (pairs, found.where("part = 'term'"))]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= TOP))
