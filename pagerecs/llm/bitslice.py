"""Exact top-k search by inner product over a bit-sliced index.

Vectors are integers per attribute. The index deals them into blocks and
stores each attribute of a block as bitmaps, one per bit of its value. A
query's scores are sums of such bitmaps, shifted by the bits of its weights:
full adders over bitmaps (three of one weight make one of that weight and
one of the next) leave the score of every row of the block as slices. The
top rows are chosen from the most significant slice downward; rows that tie
at the boundary are resolved by their vec_id. Every step is exact.

Batches of queries go to every block by its number, and the pairs of a block
and a batch are dealt out again, so no task holds more than a block at a time
and a query keeps k rows per block until the last ranking.

Results for odd input: a vector that is null or has a null, NaN or infinite
component takes no part; rows with the same vec_id are rows of their own: each
is a candidate of the other, and each one's answers are ranked by themselves; a
null vec_id is never a query, and as a candidate comes last among ties; vectors
of different lengths never meet; a component or a score that no long holds (of
components from about 1e8 on) is an error that says so; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagerecs.llm.common import keep

#: Rows of a block, about; queries of a batch.
BLOCK_ROWS, BATCH_QUERIES = 32_768, 128


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(row_id, vec_id, v): floor(scale * component) of every usable vector."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    usable = F.col("embedding").isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    )
    # one that exceeds a long is the greatest long here, which no score holds either
    v = F.transform(x, lambda c: F.greatest(F.least(F.floor(c * scale), F.lit(2.0**62)), F.lit(-(2.0**62))).cast("bigint"))
    rows = vectors.where(usable).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
    return rows.withColumn("row_id", F.monotonically_increasing_id())


def build(rows: DataFrame) -> DataFrame:
    """The index: a row per block with its ids, its attributes' least values
    and their slices (attribute by attribute, low bit first)."""
    n = rows.count()
    blocks = max(1, -(-n // BLOCK_ROWS))
    dealt = rows.select("vec_id", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("row_id"), F.lit(blocks)).alias("block"), "row_id")

    def slices(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row_id")
        values = np.array(group["v"].tolist(), np.int64).reshape(len(group), -1)
        if np.abs(values).max(initial=0) >> 60:
            raise OverflowError("a component's score exceeds a long")
        low = values.min(axis=0)
        above = values - low
        bits = [int(a).bit_length() for a in above.max(axis=0)] if values.size else []
        planes = [np.packbits((above[:, d] >> b) & 1, bitorder="little") for d, width in enumerate(bits) for b in range(width)]
        out = {
            "dims": group["dims"].iloc[0],
            "block": group["block"].iloc[0],
            "ids": [[None if pd.isna(i) else int(i) for i in group["vec_id"]]],
            "row_ids": [group["row_id"].tolist()],
            "low": [low.tolist()],
            "bits": [bits],
            "planes": [np.array(planes, np.uint8).tobytes()],
        }
        return pd.DataFrame(out)

    return dealt.groupBy("dims", "block").applyInPandas(
        slices, "dims int, block bigint, ids array<bigint>, row_ids array<bigint>, low array<bigint>, bits array<int>, planes binary"
    )


def score_slices(query: np.ndarray, planes: np.ndarray, bits: list[int]) -> tuple[list[np.ndarray], int]:
    """Slices (low first) of query . value + shift, which is never negative,
    over all rows of a block, and the shift."""
    level: dict[int, list[np.ndarray]] = {}
    shift, at = 0, 0
    for weight, width in zip(query.tolist(), bits, strict=True):
        own = planes[at : at + width]
        at += width
        if weight < 0:  # -w * u = w * (all ones - u) - w * all ones
            shift += -weight * ((1 << width) - 1)
            own = ~own
        for j in range(abs(weight).bit_length()):
            if abs(weight) >> j & 1:
                for b in range(width):
                    level.setdefault(j + b, []).append(own[b])
    out, j = [], 0
    while level:
        maps = level.pop(j, [])
        carries = []
        while len(maps) >= 3:  # a full adder
            a, b, c = maps.pop(), maps.pop(), maps.pop()
            ab = a ^ b
            maps.insert(0, ab ^ c)
            ab &= c
            ab |= a & b
            carries.append(ab)
        if len(maps) == 2:
            a, b = maps
            maps = [a ^ b]
            carries.append(a & b)
        out.append(maps[0] if maps else None)
        if carries:
            level.setdefault(j + 1, []).extend(carries)
        j += 1
    return out, shift


def _ones(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def top_rows(slices: list[np.ndarray | None], among: np.ndarray, k: int) -> np.ndarray:
    """Rows of ``among`` (a bitmap) with the k highest scores, and all that tie at the boundary."""
    sure, open_ = np.zeros_like(among), among
    for bitmap in reversed(slices):
        if bitmap is None:
            continue
        higher = open_ & bitmap
        if _ones(sure) + _ones(higher) >= k:
            open_ = higher
        else:
            sure = sure | higher
            open_ = open_ & ~bitmap
    return np.flatnonzero(np.unpackbits((sure | open_).view(np.uint8), bitorder="little"))


def _values(slices: list[np.ndarray | None], rows: np.ndarray) -> list[int]:
    """Scores of the given rows, read from the slices."""
    out = [0] * len(rows)
    word, bit = rows // 64, (rows % 64).astype(np.uint64)
    for j, bitmap in enumerate(slices):
        if bitmap is not None:
            for i, one in enumerate(((bitmap[word] >> bit) & np.uint64(1)).tolist()):
                out[i] += one << j
    return out


def search(rows: DataFrame, index: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row (row_id, vec_id, v) that
    ``is_query``, the k other indexed rows with the highest inner product."""
    queries = rows.where(is_query).select(
        F.col("row_id").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("query"), F.size("v").alias("dims")
    )
    batches = max(1, -(-queries.count() // BATCH_QUERIES))
    queries = queries.withColumn("batch", F.pmod(F.xxhash64("query_row"), F.lit(batches)))
    queries = queries.groupBy("dims", "batch").agg(F.collect_list(F.struct("query_row", "query_id", "query")).alias("queries"))
    blocks = index.agg(F.max("block")).first()[0] or 0
    sent = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks)).cast("array<bigint>")))
    met = index.join(sent, ["dims", "block"]).repartition("block", "batch")
    met = met.select("ids", "row_ids", "low", "bits", "planes", "queries")

    def best(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(len(part)):
                ids, row_ids, low, bits, planes, queries = (part.column(c)[i].as_py() for c in range(6))
                row_ids = np.array(row_ids, np.int64)
                words_ = -(-len(ids) // 64)
                packed = np.zeros((sum(bits), 8 * words_), np.uint8)
                if planes:
                    packed[:, : -(-len(ids) // 8)] = np.frombuffer(planes, np.uint8).reshape(sum(bits), -1)
                packed = packed.view(np.uint64)
                every = np.zeros(8 * words_, np.uint8)
                every[: -(-len(ids) // 8)] = np.packbits(np.ones(len(ids), np.uint8), bitorder="little")
                every = every.view(np.uint64)
                out = []
                for q in queries:
                    query = np.array(q["query"], np.int64)
                    among = every.copy()
                    own = np.searchsorted(row_ids, q["query_row"])
                    if own < len(ids) and row_ids[own] == q["query_row"]:
                        among[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
                    slices, shift = score_slices(query, packed, bits)
                    found = top_rows(slices, among, k)
                    base = sum(a * b for a, b in zip(q["query"], low, strict=True)) - shift
                    hits = [(base + s, ids[at]) for s, at in zip(_values(slices, found), found.tolist(), strict=True)]
                    if any(abs(s) >> 63 for s, _ in hits):
                        raise OverflowError("a score exceeds a long")
                    hits.sort(key=lambda h: (-h[0], h[1] is None, h[1] or 0))
                    out += [(q["query_row"], q["query_id"], vec_id, s) for s, vec_id in hits[:k]]
                columns = list(zip(*out, strict=True)) or [[]] * 4
                names = ["query_row", "query_id", "vec_id", "score"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    found = met.mapInArrow(best, "query_row bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """Index and search in one go."""
    rows = keep(quantised(vectors, scale), "quantised")
    return search(rows, keep(build(rows), "bit-slices"), is_query, k)
