"""DataFrame comparison.

Both directions of the difference come from ONE aggregation over the union
of the two frames (tagged by side), instead of two anti-joins: one shuffle,
and partial aggregation collapses duplicated rows on the map side, so a
row repeated millions of times costs one shuffled record per task.

Tables that are expected to agree need not be shuffled at all:
``bucketed_frame_diff`` first compares digests of buckets of rows, which do not
depend on the rows' order, and only rows of buckets that differ are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEFT_ONLY = "left_only"
RIGHT_ONLY = "right_only"


def _names(stem: str) -> Iterator[str]:
    return (f"_copies_{stem}{'_' * n}" for n in count())


def frame_diff(left: DataFrame, right: DataFrame, multiset: bool = False) -> DataFrame:
    """Rows that are in one frame and not the other, with a ``side`` column.

    Columns are matched by name; ``left``'s columns must all exist in
    ``right`` (extra right-hand columns are ignored). With ``multiset=False``
    rows compare as sets (EXCEPT DISTINCT both ways). With ``multiset=True``
    duplicates count and a ``copies`` column says how many more copies that
    side holds (rows are not replicated). NULLs compare equal.
    """
    missing = [c for c in left.columns if c not in right.columns]
    if missing:
        raise ValueError(f"columns missing on the right: {missing}")
    cols = left.columns
    taken = {c.lower() for c in cols}
    in_left, in_right = (next(n for n in _names(stem) if n not in taken) for stem in ("left", "right"))
    tagged = left.select(*cols, F.lit(1).alias(in_left), F.lit(0).alias(in_right)).unionByName(
        right.select(*cols, F.lit(0).alias(in_left), F.lit(1).alias(in_right))
    )
    counts = tagged.groupBy(*cols).agg(F.sum(in_left).alias(in_left), F.sum(in_right).alias(in_right))
    if multiset:
        delta = F.col(in_left) - F.col(in_right)
        side = F.when(delta > 0, F.lit(LEFT_ONLY)).when(delta < 0, F.lit(RIGHT_ONLY))
        return counts.where(delta != 0).select(*cols, side.alias("side"), F.abs(delta).alias("copies"))
    side = F.when(F.col(in_right) == 0, F.lit(LEFT_ONLY)).when(F.col(in_left) == 0, F.lit(RIGHT_ONLY))
    return counts.where((F.col(in_left) == 0) | (F.col(in_right) == 0)).select(*cols, side.alias("side"))


#: Buckets of rows that digests are made of, unless the caller says otherwise.
BUCKETS = 4096


def _row_hash(df: DataFrame, columns: list[str], seed: int) -> Column:
    # a NULL hashes as nothing, so each column says whether it is one
    return F.xxhash64(F.lit(seed), *[c for name in columns for c in (F.col(name).isNull(), F.col(name))])


def bucket_digests(df: DataFrame, buckets: int = BUCKETS, columns: list[str] | None = None) -> DataFrame:
    """(bucket, rows, digest_sum, digest_xor): one row per bucket of ``df``'s
    rows, whatever their order or number of files. A row's bucket and its two
    digests come from its values alone; equal bags have equal digests, and two
    different bags of a bucket agree with odds of about 2**-100."""
    columns = columns or df.columns
    rows = df.select(
        F.pmod(_row_hash(df, columns, 1), F.lit(buckets)).cast("int").alias("bucket"),
        _row_hash(df, columns, 2).alias("one"),
        _row_hash(df, columns, 3).alias("other"),
    )
    return rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("one").cast("decimal(20,0)")).alias("digest_sum"),
        F.bit_xor("other").alias("digest_xor"),
    )


def differing_buckets(left: DataFrame, right: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The buckets (at most ``buckets`` rows) whose digests differ."""
    cols = left.columns
    both = bucket_digests(left, buckets, cols).unionByName(bucket_digests(right, buckets, cols))
    values = [c for c in both.columns if c != "bucket"]
    agreed = both.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("sides"), F.countDistinct(F.struct(*values)).alias("kinds")
    )
    return agreed.where((F.col("sides") != 2) | (F.col("kinds") != 1)).select("bucket")


def bucketed_frame_diff(left: DataFrame, right: DataFrame, multiset: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """As ``frame_diff``, but rows are shuffled only if their bucket's digests
    differ between the frames. Each frame is read twice, once for the digests;
    equal frames end there. The differing buckets reach every task as a list
    of at most ``buckets`` numbers."""
    missing = [c for c in left.columns if c not in right.columns]
    if missing:
        raise ValueError(f"columns missing on the right: {missing}")
    cols = left.columns
    right = right.select(*cols)
    taken = {c.lower() for c in cols}
    name = next(n for n in _names("bucket") if n not in taken)
    found = F.broadcast(differing_buckets(left, right, buckets).withColumnRenamed("bucket", name))

    def some(df: DataFrame) -> DataFrame:
        bucket = F.pmod(_row_hash(df, cols, 1), F.lit(buckets)).cast("int")
        return df.withColumn(name, bucket).join(found, name, "left_semi").select(*cols)

    return frame_diff(some(left), some(right), multiset)


def frames_equal(left: DataFrame, right: DataFrame, multiset: bool = False) -> bool:
    """True when ``frame_diff`` is empty (one job, stops at the first row)."""
    return frame_diff(left, right, multiset).isEmpty()


def assert_frames_equal(left: DataFrame, right: DataFrame, multiset: bool = False) -> None:
    diff = frame_diff(left, right, multiset)
    sample = diff.take(10)
    assert not sample, f"frames differ, first rows: {sample}"
