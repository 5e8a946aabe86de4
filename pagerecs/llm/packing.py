"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

The number of sequences is a cutting-stock problem over the histogram of
piece lengths, which has at most ``capacity`` entries whatever the corpus.
Its configuration linear program (one variable per way to fill a sequence)
is solved by multiplicative weights: every length has a price, a knapsack
dynamic program finds the fillings that the prices make worth most, and
prices rise where a length lags behind its share and fall where it is ahead.
The solution is rounded down; best fit places what rounding left over. The
histogram is all that the driver sees: the plan is a table of rank intervals
per length, and every piece finds its place by its rank among its equals.

Results for odd input: a null or empty text is its end token alone; an empty
table gives no rows; repeated rows and repeated or null ids are packed as
rows of their own; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagerecs.llm.common import BATCH_ROWS, give_back, keep, shuffle_partitions, small
from pagerecs.llm.tokens import CACHE_CHUNKS, encoder, vocabulary

#: Rounds of multiplicative weights, how fast prices follow, and how far below
#: the best filling's worth a filling may be and still be used.
ROUNDS, RATE, SLACK = 40, 2.0, 0.02


def cut_pieces(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0, cache: int = CACHE_CHUNKS
) -> DataFrame:
    """Documents (doc_id, text) as pieces of at most ``capacity`` tokens.

    Every document ends in ``end_id``. Only longer ones are cut: the first
    piece takes the remainder, all others are full. ``ids`` holds the piece's
    ids as little-endian unsigned 32-bit integers.
    """
    width = 4 * capacity
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer or vocabulary("byte_bpe_50k.json"), most=cache).encode
        for batch in batches:
            for at in range(0, len(batch), BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                row, piece, start, ids = [], [], [], []
                for i, doc in enumerate(encode(part.column(1).to_pylist())):
                    doc += end
                    edges = [0, *range(len(doc) % width or width, len(doc) + 1, width)] if len(doc) > width else [0, len(doc)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        row.append(i)
                        piece.append(k)
                        start.append(a // 4)
                        ids.append(doc[a:b])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(row, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )
        give_back(keep_caches=True)

    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
    )


def _price(worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the most that each room can be worth, and the
    length to take first there (0: leave one place empty)."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        with_last = best[room - 1 :: -1][:room] + worth[1 : room + 1]
        k = int(with_last.argmax())
        best[room], take[room] = (with_last[k], k + 1) if with_last[k] > best[room - 1] else (best[room - 1], 0)
    return best, take


def _filling(first: int, take: list[int], capacity: int) -> tuple[int, ...]:
    lengths, room = [first], capacity - first
    while room:
        if take[room]:
            lengths.append(take[room])
            room -= take[room]
        else:
            room -= 1
    return tuple(sorted(lengths, reverse=True))


def solve(histogram: dict[int, int], capacity: int) -> Counter:
    """Fillings (lengths, longest first) and how often each is used, covering
    every length exactly as often as the histogram says."""
    left = Counter({n: c for n, c in histogram.items() if c > 0})
    used: Counter = Counter()
    if left[capacity]:
        used[(capacity,)] = left.pop(capacity)
    lengths = sorted(left, reverse=True)
    if not lengths:
        return used
    worth = np.full(capacity + 1, -np.inf)
    for n in lengths:
        worth[n] = n / capacity
    amount: dict[tuple[int, ...], float] = {}
    covered = dict.fromkeys(lengths, 0.0)
    for t in range(1, ROUNDS + 1):
        best, take = _price(worth, capacity)
        steps = take.tolist()
        for n in lengths:
            lag = left[n] * t / ROUNDS - covered[n]
            if lag > 0 and (t == ROUNDS or worth[n] + best[capacity - n] >= (1 - SLACK) * best[capacity]):
                filling = _filling(n, steps, capacity)
                lag /= filling.count(n)
                amount[filling] = amount.get(filling, 0.0) + lag
                for m in filling:
                    covered[m] += lag
        for n in lengths:
            worth[n] *= np.exp(RATE * np.clip(t / ROUNDS - covered[n] / left[n], -1, 1))
    for filling, x in sorted(amount.items(), key=lambda a: (-sum(a[0]), -a[0][0], -a[1], a[0])):
        need = Counter(filling)
        times = min(int(x), *(left[n] // k for n, k in need.items()))
        if times > 0:
            used[filling] += times
            for n, k in need.items():
                left[n] -= times * k
    return used + _best_fit(left, capacity)


def _best_fit(left: Counter, capacity: int) -> Counter:
    """Best fit, longest first, of the few pieces that rounding left."""
    rooms: list[int] = []  # of the open sequences, ascending
    held: dict[int, list[list[int]]] = {}
    for n in sorted(left, reverse=True):
        for _ in range(left[n]):
            k = bisect_left(rooms, n)
            if k < len(rooms):
                room = rooms.pop(k)
                lengths = held[room].pop()
            else:
                room, lengths = capacity, []
            lengths.append(n)
            held.setdefault(room - n, []).append(lengths)
            insort(rooms, room - n)
    return Counter(tuple(x) for group in held.values() for x in group)


def slots(used: Counter) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset): where
    pieces of each length go, by their rank among the pieces of that length."""
    rank: Counter = Counter()
    out, sequence = [], 0
    for filling, times in used.items():
        offset = 0
        for n in filling:
            out.append((n, rank[n], rank[n] + times, sequence, offset))
            rank[n] += times
            offset += n
        sequence += times
    return out


@dataclass
class Packing:
    """``pieces``: the written pieces with their ids; ``placement``: a row for
    each piece with its sequence and offset, without the ids."""

    pieces: DataFrame
    placement: DataFrame

    def sequences(self) -> DataFrame:
        """(sequence_id, length, ids): the packed sequences themselves."""
        placed = self.pieces.select("row_id", "ids").join(self.placement.select("row_id", "sequence_id", "offset", "length"), "row_id")
        parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most capacity pieces
        joined = F.aggregate(parts, F.lit(b""), lambda all_, x: F.concat(all_, x["ids"]))
        return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def pack(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0, cache: int = CACHE_CHUNKS
) -> Packing:
    """Packs all documents into as few sequences as it can; see the module.
    ``cache``: chunks of text whose ids a worker remembers."""
    spark = docs.sparkSession
    pieces = cut_pieces(docs, tokenizer, capacity, end_id, cache).withColumn("row_id", F.monotonically_increasing_id())
    pieces = keep(pieces, "pieces", batch_rows=BATCH_ROWS)
    narrow = pieces.drop("ids").withColumn("part", F.pmod(F.xxhash64("row_id"), F.lit(shuffle_partitions(spark))))
    counts = narrow.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram: Counter = Counter()
    for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most capacity rows
        histogram[row.length] = row.n
    plan = slots(solve(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    local = Window.partitionBy("length", "part").orderBy("row_id")
    ranked = (
        narrow.withColumn("local", F.row_number().over(local) - 1)
        .join(counts, ["length", "part"])
        .withColumn("rank", F.col("local") + F.col("before"))
    )
    at = spark.createDataFrame(
        plan, "slot_length bigint, first bigint, end bigint, first_sequence bigint, offset bigint"
    )
    placed = ranked.join(
        small(at, len(plan)),
        (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")),
    )
    return Packing(
        pieces,
        placed.select(
            "doc_id",
            "piece",
            "start",
            "length",
            "ids_crc32",
            (F.col("first_sequence") + F.col("rank") - F.col("first")).alias("sequence_id"),
            "offset",
            "row_id",
        ),
    )
