"""Language-model scoring with a probabilistic suffix tree over words.

The tree's symbols are an end mark, the ``COMMON_WORDS`` most frequent words of
the training texts and one escape for all others (an escaped word is then drawn
by its frequency among them). Its root is the unigram base itself. A context of
up to ``DEPTH`` symbols is retained if it occurs ``LEAST`` times in the training
texts, however small its share, and its next-symbol distribution diverges from
its parent's (the context without its oldest symbol) by ``LEAST_GAIN`` nats over
its occurrences. A distribution is smoothed towards the parent's with a weight
of ``SMOOTHING`` for every distinct next symbol (Witten and Bell). Each symbol
is scored in the longest retained suffix of what precedes it; nothing precedes a
text but end marks. So a text's score is its base plus what contexts add.

The tree grows with the corpus and is never in one place. Every text's runs of
DEPTH + 1 symbols, each once with its number, are dealt out by their latest
context word, so all contexts ending in a word meet in one task. They travel as
bytes, one row of a shuffle for each task and part it deals to: a row for every
run would cost more than all that is done with it. A task sorts, counts, tests
and smooths its contexts, and gives each row its sum. The contexts of one word
with ``HOT`` or more of all symbols (so 1 / HOT words at most) are counted
before and sent to the executors, so their runs are dealt out by two words; so
are pairs and triples of words with that share, whose runs are dealt out by three
words and by row. A task holds the runs of its part: of about ``PART`` symbols,
or of the largest such group, of less than that share of the training texts. Runs
are dealt out in ``PASSES`` shares, by the latest word (and the one before, where
that is frequent), and a share's shuffle files go before the next, so the disk
holds one share. What comes back is one sum for each row and part, as bytes for
``ROWS`` row numbers: with a corpus so large that a part has most rows once only,
as many as the runs, and no more than that however it grows.

Word counts grow with the corpus and stay distributed: only the most frequent
go to the executors, all other words of a text meet their counts in a join.

Results for odd input: a null or empty text is its end alone; repeated rows
and repeated or null ids each give their row (a null id is never held out);
without training texts the tree is its root; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagerecs.llm.common import byte_runs, give_back, keep, shuffle_partitions
from pagerecs.llm.words import mixed, words

#: A symbol has 16 bits, so a run of DEPTH + 1 symbols is one number.
BITS, DEPTH = 16, 3
SYMBOLS = 1 << BITS
END, OTHER = 0, SYMBOLS - 1
COMMON_WORDS = SYMBOLS - 2
LEAST, LEAST_GAIN, SMOOTHING = 2, 2.0, 1.0
HOT = 1 / 512
#: Runs that a task works on at once, if its groups are smaller.
CHUNK = 1 << 18
#: Shares of the runs that are dealt out one after another.
PASSES = 4
#: Symbols for each part of the shuffle, all of which a task holds.
PART = 1 << 20
#: Runs that a task deals out at once, and row numbers whose sums go together.
PACK, ROWS = 1 << 20, 1 << 12
_RUN = 1 << 20
#: Symbols of whole rows that are looked at together, if no row has more.
_TOGETHER = 1 << 18


@dataclass
class Root:
    """Words in order of their hash with their symbols and log10(count + 0.5),
    and the chance of every symbol."""

    keys: np.ndarray
    symbol: np.ndarray
    log: np.ndarray
    chance: np.ndarray


def count_words(training: DataFrame) -> DataFrame:
    """(key, n): how often each word, by its hash, occurs in the training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in byte_runs(batch.column(0), 4 * _RUN):
                keys, n = np.unique(words(data, offsets)[1].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n, pa.int64())], ["key", "n"])
        give_back()

    found = training.select("text").mapInArrow(count, "key bigint, n bigint")
    return keep(found.groupBy("key").agg(F.sum("n").alias("n")), "word-counts", drop_shuffles=True)


def root(keys: np.ndarray, n: np.ndarray, ends: int, total: int, distinct: int) -> Root:
    """From the most frequent words, and the number of ends, tokens and
    distinct tokens of the training texts."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    chance = np.full(SYMBOLS, 0.5)  # symbols without a word are never drawn
    chance[END] = ends + 0.5
    chance[1 : len(keys) + 1] = n + 0.5
    known = distinct - (ends > 0)
    chance[OTHER] = total - ends - n.sum() + 0.5 * (known - len(keys)) + 0.5
    return Root(keys, np.arange(1, len(keys) + 1, dtype=np.uint16), np.log10(n + 0.5), chance / (total + 0.5 * (distinct + 1)))


def _heads(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])


def _symbols(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of a batch of (symbols, ...), run of rows by run of rows: the symbols; of
    each but the end marks before a row, its place there, and its row of the batch."""
    column = batch.column(0).cast(pa.large_binary())
    for first, end, data, offsets in byte_runs(column, 2 * _TOGETHER):
        size = np.diff(offsets) // 2
        stream = np.frombuffer(data.tobytes(), np.uint16)
        live = np.ones(len(stream), bool)
        live[((np.cumsum(size) - size)[:, None] + np.arange(DEPTH)).ravel()] = False
        yield stream, np.flatnonzero(live), np.repeat(np.arange(first, end), size - DEPTH)


def _runs(stream: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The DEPTH symbols before each place, the latest in the highest digit, then its own."""
    code = np.zeros(len(at), np.uint64)
    for k in [*range(1, DEPTH + 1), 0]:
        code = code << np.uint64(BITS) | stream[at - k]
    return code


def _refined(whole: np.ndarray, count: np.ndarray, parent: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Chances of seen and unseen next symbols, whose contexts begin at
    ``head`` and occur ``whole`` times: smoothed, or the parent's where the
    context isn't retained."""
    size = np.diff(np.r_[head, len(count)])
    seen = count > 0
    weight = SMOOTHING * np.add.reduceat(seen.astype(float), head)
    each, total = np.repeat(np.c_[weight, whole], size, axis=0).T
    own = (count + each * parent) / np.maximum(total + each, 1)
    gain = np.add.reduceat(np.where(seen, total * own * np.log(np.where(seen, own / parent, 1)), 0), head)
    # all symbols that never follow have the same ratio to the parent's chance
    ratio = np.where(weight > 0, weight / np.maximum(whole + weight, 1), 1)
    gain += whole * ratio * np.log(ratio) * (1 - np.add.reduceat(np.where(seen, parent, 0), head))
    retained = (gain >= LEAST_GAIN) & (whole >= LEAST)
    return np.where(np.repeat(retained, size), own, parent)


def _order(key: np.ndarray) -> np.ndarray:
    """The order of numbers from 0 up: key and place sorted as one number where both have room."""
    bits = len(key).bit_length()
    if not len(key) or int(key.max()).bit_length() + bits > 64:
        return np.argsort(key)
    both = np.sort(key.astype(np.uint64) << np.uint64(bits) | np.arange(len(key), dtype=np.uint64))
    return (both & np.uint64((1 << bits) - 1)).view(np.int64)


def _found(among: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the ``wanted`` are ``among`` (in order), and where."""
    if not len(among):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), int)
    at = np.minimum(np.searchsorted(among, wanted), len(among) - 1)
    return among[at] == wanted, at


def _next_counts(texts: DataFrame, hot: np.ndarray, depth: int) -> np.ndarray:
    """How often each symbol follows each of the ``hot`` contexts in the training texts, one row each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(hot) * SYMBOLS, np.int32)  # of a task
        for batch in batches:
            for stream, at, _ in _symbols(batch):
                context = np.zeros(len(at), np.uint64)
                for k in range(1, depth + 1):
                    context = context << np.uint64(BITS) | stream[at - k]
                is_hot, of = _found(hot, context)
                cells = np.sort(of[is_hot] * SYMBOLS + stream[at[is_hot]])
                head = _heads(cells)
                total[cells[head]] += np.diff(np.r_[head, len(cells)]).astype(np.int32)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells], pa.int64())], ["cell", "n"])
        give_back()

    counts = np.zeros((len(hot), SYMBOLS))
    if len(hot):
        found = texts.where("not held_out").select("symbols").mapInArrow(count, "cell bigint, n bigint")
        found = found.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most SYMBOLS / HOT
        counts.reshape(-1)[found["cell"].to_numpy()] = found["n"].to_numpy()
    return counts


def hot_contexts(texts: DataFrame, hot: np.ndarray, chance: np.ndarray, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1 to DEPTH symbols: the contexts that occur ``least`` times, in order,
    and the distribution after each; ``hot`` are those of one symbol. A context
    of one symbol more is a shorter one with a symbol that follows it often."""
    hot, levels = hot.astype(np.uint64), []
    for depth in range(1, DEPTH + 1):
        counts = _next_counts(texts, hot, depth)
        after = np.empty((len(hot), SYMBOLS), np.float32)
        for i, c in enumerate(counts):
            parent = levels[-1][1][_found(levels[-1][0], hot[i : i + 1] >> np.uint64(BITS))[1][0]] if levels else chance
            after[i] = _refined(c.sum(keepdims=True), c, parent, np.zeros(1, int))
        levels.append((hot, after))
        of, then = np.nonzero(counts >= least)
        longer = (then.astype(np.uint64) << np.uint64(BITS * depth) | hot[of])[then != END]
        # an end follows nothing but the end marks before a text
        hot = np.sort(np.r_[hot[hot == END], longer])
    return levels


def _share(stream: np.ndarray, at: np.ndarray, is_hot: np.ndarray, passes: int) -> np.ndarray:
    """The pass of each place's run, of so many; runs of one group are in one pass."""
    latest = stream[at - 1].astype(np.int64)
    return (latest + np.where(is_hot[latest], stream[at - 2], 0)) % passes


def _dealt(
    code: np.ndarray, row: np.ndarray, ids: np.ndarray, held_out: np.ndarray, hot: list[np.ndarray], parts: int
) -> Iterator[pa.RecordBatch]:
    """(part, runs): the runs of some rows, each the ``row``'s in ``ids``, in bytes
    for each of the ``parts`` that has any. Runs of one group go to one part, but
    those of a ``hot`` group of DEPTH symbols are dealt out by row. A row's equal
    runs become one with its number (but for a few, if hashes agree)."""
    group = code >> np.uint64(BITS * DEPTH)
    rest = np.arange(len(code))
    for d in range(1, DEPTH + 1):
        context = code[rest] >> np.uint64(BITS * (DEPTH + 1 - d))
        group[rest] = context
        rest = rest[_found(hot[d - 1], context)[0]]
    group[rest] = ids[row[rest]]  # what follows hot contexts of DEPTH symbols is known
    part = mixed(group) % np.uint64(parts)
    # by part, latest word, what little of a hash of the run has room, and place
    bits, wide = len(code).bit_length(), parts.bit_length()
    key = part << np.uint64(BITS) | code >> np.uint64(BITS * DEPTH)
    key = key << np.uint64(64 - BITS - wide) | mixed(code) >> np.uint64(BITS + wide)
    key = np.sort(key >> np.uint64(bits) << np.uint64(bits) | np.arange(len(code), dtype=np.uint64))
    place = (key & np.uint64((1 << bits) - 1)).view(np.int64)
    part, code, row = (key >> np.uint64(64 - wide)).astype(np.int32), code[place], row[place]
    other = np.r_[True, (code[1:] != code[:-1]) | (part[1:] != part[:-1])]
    head = np.flatnonzero(other | np.r_[True, row[1:] != row[:-1]])
    times = np.diff(np.r_[head, len(code)]).astype(np.int32)
    part, code, row = part[head], code[head], row[head]
    entry = np.flatnonzero(other[head])
    size = np.diff(np.r_[entry, len(code)]).astype(np.uint32)
    # digits and halves apart: those that change little take little room once compressed
    digits = code[entry].view(np.uint16).reshape(-1, DEPTH + 1).T.copy()
    halves = ids[row].view(np.uint32).reshape(-1, 2).T.copy()
    times = np.where(held_out[row], -times, times)
    cut = _heads(part)
    of, ends = part[cut], np.r_[cut, len(part)]
    entry_ends = np.searchsorted(entry, ends)
    blobs, numbers, held = [], [], 0
    for i, (a, b, c, d) in enumerate(zip(ends[:-1], ends[1:], entry_ends[:-1], entry_ends[1:], strict=True)):
        given = [np.array([d - c, b - a], np.uint32), size[c:d], *halves[:, a:b], times[a:b], *digits[:, c:d]]
        blobs.append(b"".join([x.tobytes() for x in given]))
        numbers.append(of[i])
        held += len(blobs[-1])
        if held >= _RUN or b == len(part):
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], ["part", "runs"])
            blobs, numbers, held = [], [], 0


def _read(blob: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of bytes that ``_dealt`` made: runs, how many rows have each, and these
    rows and how often they have it (less than none: held out)."""
    n, m = (int(x) for x in np.frombuffer(blob, np.uint32, 2))
    size = np.frombuffer(blob, np.uint32, n, 8)
    low, high = np.frombuffer(blob, np.uint32, 2 * m, 8 + 4 * n).reshape(2, m)
    times = np.frombuffer(blob, np.int32, m, 8 + 4 * n + 8 * m)
    digits = np.frombuffer(blob, np.uint16, (DEPTH + 1) * n, 8 + 4 * n + 12 * m).reshape(DEPTH + 1, n)
    code = np.ascontiguousarray(digits.T).view(np.uint64).reshape(n)
    return code, size, (high.astype(np.int64) << 32) | low, times


def _group_end(code: np.ndarray, end: int, hot: list[np.ndarray]) -> int:
    """Where the group of the run before ``end`` ends, of runs in order."""
    last = code[end - 1]
    for d in range(1, DEPTH + 1):
        rest = np.uint64(BITS * (DEPTH + 1 - d))
        if not _found(hot[d - 1], np.array([last >> rest]))[0][0]:
            last |= (np.uint64(1) << rest) - np.uint64(1)
            break
    return int(np.searchsorted(code, last, side="right"))


def _gains(code: np.ndarray, n: np.ndarray, chance: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """What the contexts add to log10 of the chance of each run, of whole groups of
    runs in order that occur ``n`` times in the training texts, together if equal."""
    first = _heads(code)
    size = np.diff(np.r_[first, len(code)])
    n = np.add.reduceat(n, first).astype(float)
    code = code[first]
    symbol = (code & np.uint64(SYMBOLS - 1)).astype(np.int64)
    start = value = chance[symbol]
    for d in range(1, DEPTH + 1):
        context = code >> np.uint64(BITS * (DEPTH + 1 - d))
        # by context and symbol within what is already in order of context
        new = np.r_[False, context[1:] != context[:-1]]
        order = _order(np.cumsum(new) << BITS | symbol) if d < DEPTH else np.arange(len(code))
        c, s = context[order], symbol[order]
        cell = np.flatnonzero(new | np.r_[True, s[1:] != s[:-1]])
        cells = np.diff(np.r_[cell, len(order)])
        head = _heads(c[cell])
        count = np.add.reduceat(n[order], cell)
        own = _refined(np.add.reduceat(count, head), count, value[order[cell]], head)
        hot, after = levels[d - 1]
        is_hot, place = _found(hot, c[cell])
        own[is_hot] = after[place[is_hot], s[cell[is_hot]]]
        refined = np.empty(len(code))
        refined[order] = np.repeat(own, cells)
        value = refined
    return np.repeat(np.log10(value / start), size)


def _summed(rows: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows, in order and each once, with their sums."""
    order = _order(rows)
    rows = rows[order]
    head = _heads(rows)
    return rows[head], np.add.reduceat(gain[order], head)


def context_gains(texts: DataFrame, chance: np.ndarray, hot: np.ndarray, least: float, tokens: int) -> DataFrame:
    """(row_id, gain): what the contexts add to each row's log10 chance by the
    root; of (row_id, held_out, symbols) rows with so many ``tokens``; ``hot``
    symbols occur ``least`` times."""
    spark = texts.sparkSession
    levels = hot_contexts(texts, hot, chance, least)
    sent = spark.sparkContext.broadcast((chance, levels))
    parts = max(shuffle_partitions(spark), -(-tokens // (PART * PASSES)))

    def runs(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
        among = [hot for hot, _ in sent.value[1]]
        is_hot = np.zeros(SYMBOLS, bool)
        is_hot[hot] = True
        found, given, many, base = [], [], 0, 0

        def dealt() -> Iterator[pa.RecordBatch]:
            code, row = (np.concatenate(c) for c in zip(*found, strict=True))
            yield from _dealt(code, row, *(np.concatenate(c) for c in zip(*given, strict=True)), among, parts)

        for batch in batches:
            rows = batch.column(2).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            given.append(rows)
            for stream, at, row in _symbols(batch):
                mine = _share(stream, at, is_hot, PASSES) == share
                at, row = at[mine], row[mine]
                if not len(at):
                    continue
                found.append((_runs(stream, at), row + base))
                many += len(at)
                if many >= PACK:
                    yield from dealt()
                    found, given, many, base = [], [rows], 0, 0
            base += len(batch)
        if many:
            yield from dealt()
        give_back()

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance, levels = sent.value
        among = [hot for hot, _ in levels]
        read = [_read(blob.as_buffer()) for batch in batches for blob in batch.column(1)]
        if read:
            code, size, rows, times = (np.concatenate(c) for c in zip(*read, strict=True))
            del read
            n = np.add.reduceat(np.maximum(times, 0), np.r_[0, np.cumsum(size[:-1], dtype=np.int64)], dtype=np.int64)
            order = np.argsort(code)
            code, gain, start = code[order], np.empty(len(code)), 0
            while start < len(code):
                end = _group_end(code, min(start + CHUNK, len(code)), among)
                of = order[start:end]
                gain[of] = _gains(code[start:end], n[of], chance, levels)
                start = end
            del code, order, n
            rows, gain = _summed(rows, np.repeat(gain, size) * np.abs(times))
            of = rows // ROWS
            cut = _heads(of)
            low = (rows % ROWS).astype(np.uint16)
            blobs = [low[a:b].tobytes() + gain[a:b].tobytes() for a, b in zip(cut, np.r_[cut[1:], len(of)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(of[cut]), pa.array(blobs, pa.binary())], ["rows", "sums"])
        give_back()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, many, most = [], 0, PACK
        for batch in batches:
            for of, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n = len(blob.as_buffer()) // 10
                low = np.frombuffer(blob.as_buffer(), np.uint16, n)
                found.append((low.astype(np.int64) + of * ROWS, np.frombuffer(blob.as_buffer(), np.float64, n, 2 * n)))
                many += n
                if many >= most:
                    found = [_summed(*(np.concatenate(c) for c in zip(*found, strict=True)))]
                    many = len(found[0][0])
                    most = 2 * many + PACK
        if found:
            rows, gain = _summed(*(np.concatenate(c) for c in zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(gain)], ["row_id", "gain"])
        give_back()

    given, sums = texts.select("symbols", "held_out", "row_id"), []
    for share in range(PASSES):
        dealt = given.mapInArrow(lambda batches, share=share: runs(batches, share), "part int, runs binary")
        found = dealt.repartitionById(parts, F.col("part")).mapInArrow(gains, "rows bigint, sums binary")
        found = found.repartition("rows").mapInArrow(added, "row_id bigint, gain double")
        sums.append(keep(found, "context-gains", drop_shuffles=True))
    return reduce(DataFrame.unionByName, sums).groupBy("row_id").agg(F.sum("gain").alias("gain"))


def score(docs: DataFrame, held_out: str = "held_out") -> DataFrame:
    """``doc_id``, ``held_out``, n_tokens, n_known, train_tokens, base_score and
    score of every text, learned from the rows that aren't held out."""
    docs = docs.select("doc_id", "text", F.col(held_out).alias("held_out"))
    training = docs.where("not held_out")
    counts = count_words(training)
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("distinct")).first()
    ends = training.count()
    n, distinct = totals.n + ends, totals.distinct + (ends > 0)
    common = counts.orderBy(F.col("n").desc(), "key").limit(COMMON_WORDS).toArrow()
    tree = root(common["key"].to_numpy(), common["n"].to_numpy(), ends, n, distinct)
    sent = docs.sparkSession.sparkContext.broadcast(tree)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent.value
        keys = tree.keys
        for batch in batches:
            for first, end, data, offsets in byte_runs(batch.column(1), _RUN):
                rows = end - first
                of, hashes = words(data, offsets)
                hashes = hashes.view(np.int64)
                k = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
                is_common = keys[k] == hashes if len(keys) else np.zeros(len(hashes), bool)
                # DEPTH end marks, the words' symbols and an end mark, text by text
                many = np.bincount(of, minlength=rows)
                starts = np.r_[0, np.cumsum(many + DEPTH + 1)]
                symbols = np.full(starts[-1], END, np.uint16)
                place = np.arange(len(of)) + of * (DEPTH + 1) + DEPTH
                symbols[place] = np.where(is_common, tree.symbol[k], OTHER) if len(keys) else OTHER
                rest, rest_of = hashes[~is_common], of[~is_common]
                # (row, word) pairs of the rest, each once with its number
                pair = np.lexsort((rest, rest_of))
                rest, rest_of = rest[pair], rest_of[pair]
                head = np.flatnonzero(np.r_[True, (rest[1:] != rest[:-1]) | (rest_of[1:] != rest_of[:-1])][: len(rest)])
                times = np.diff(np.r_[head, len(rest)])
                cuts = pa.array(np.searchsorted(rest_of[head], np.arange(rows + 1)), pa.int32())
                known = tree.log[k[is_common]] if len(keys) else None
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, rows),
                        batch.column(2).slice(first, rows),
                        pa.array(many + 1, pa.int64()),
                        pa.array(np.bincount(of[is_common], minlength=rows), pa.int64()),
                        pa.array(np.bincount(of[is_common], known, rows), pa.float64()),
                        pa.Array.from_buffers(
                            pa.binary(), rows, [None, pa.py_buffer((starts * 2).astype(np.int32)), pa.py_buffer(symbols)]
                        ),
                        pa.ListArray.from_arrays(cuts, pa.array(rest[head], pa.int64())),
                        pa.ListArray.from_arrays(cuts, pa.array(times, pa.int64())),
                    ],
                    ["doc_id", "held_out", "n_tokens", "common_known", "common_log", "symbols", "rest", "times"],
                )
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, held_out boolean, n_tokens bigint, common_known bigint, common_log double, "
        "symbols binary, rest array<bigint>, times array<bigint>"
    )
    rows = keep(docs.mapInArrow(read, schema).withColumn("row_id", F.monotonically_increasing_id()), "read-texts")
    share = n + ends * DEPTH  # end marks before a text are contexts too
    often = tree.chance * (n + 0.5 * (distinct + 1))
    often[END] = ends * (DEPTH + 1)
    least = max(HOT * share, 1)
    hot = np.flatnonzero(often >= least)
    tokens = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first().n
    gains = context_gains(rows.select("row_id", "held_out", "symbols"), tree.chance, hot, least, tokens)
    pairs = rows.select("row_id", F.explode(F.arrays_zip("rest", "times")).alias("w"))
    pairs = pairs.select("row_id", F.col("w.rest").alias("key"), F.col("w.times").alias("times"))
    seen = F.coalesce("n", F.lit(0))
    rest = (
        pairs.join(counts, "key", "left")
        .groupBy("row_id")
        .agg(
            F.sum(F.col("times") * F.log10(seen + F.lit(0.5))).alias("rest_log"),
            F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("rest_known"),
        )
    )
    end_log = F.log10(F.lit(ends + 0.5))
    scale = F.log10(F.lit(n + 0.5 * (distinct + 1)))
    whole = F.col("common_log") + F.coalesce("rest_log", F.lit(0.0)) + end_log
    base = whole - F.col("n_tokens") * scale
    return rows.drop("symbols", "rest", "times").join(rest, "row_id", "left").join(gains, "row_id", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("common_known") + F.coalesce("rest_known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        base.alias("base_score"),
        (base + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )
