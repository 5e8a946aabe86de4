"""Document lengths of flat token files that have no index.

A flat file is nothing but token ids, each document followed by an
end-of-document id. The scan cuts every file into blocks of a fixed number
of ids, finds the separators of each block with one vectorised comparison,
and stitches documents that run across blocks with a prefix scan: the last
separator before a block is the running maximum over the blocks before it.

Results for odd input: an empty document has length 0; ids after a file's
last separator are no document; an empty folder gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagerecs.llm.common import keep
from pagerecs.llm.tokens import encoder, vocabulary

#: Ids in a block.
BLOCK_IDS = 1 << 18
#: Ids at a document's head that spell its doc_id, 15 bits each, none of
#: which can be the separator.
HEAD_IDS = 5


def write_flat(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 49407) -> None:
    """Encodes documents to flat files of little-endian unsigned 16-bit ids.

    A document is its doc_id (``HEAD_IDS`` ids of 15 bits, lowest first; a
    null id is all ones), its text's ids (null: none) and ``end_id``, which
    Spark's text writer puts after every row.
    """
    if not 1 << 15 <= end_id < 1 << 16:
        raise ValueError("the separator must be no 15-bit id and fit in 16 bits")

    def encode_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer or vocabulary("word_bpe_49k.json"), plain=True).encode
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = batch.slice(at, 256)
                out = []
                for doc_id, ids in zip(rows.column(0).to_pylist(), encode(rows.column(1).to_pylist()), strict=True):
                    doc_id = (1 << 15 * HEAD_IDS) - 1 if doc_id is None else doc_id + (1 << 63)
                    head = [(doc_id >> 15 * k) & 0x7FFF for k in range(HEAD_IDS)]
                    out.append(np.array(head, "<u2").tobytes() + np.frombuffer(ids, "<u4").astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["row"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(encode_all, "row binary")
    (
        rows.select(F.col("row").cast("string").alias("value"))
        .write.option("encoding", "ISO-8859-1")
        .option("lineSep", end_id.to_bytes(2, "little").decode("latin-1"))
        .text(path)
    )


def scan_flat(spark: SparkSession, path: str, end_id: int = 49407, head_ids: int = 0) -> DataFrame:
    """(file, file_start, n_tokens, head) of every document under ``path``:
    where it begins in its file, its ids without separator, and its first
    ``head_ids`` ids (fewer, if it is shorter) as little-endian bytes."""
    schema = "file string, block bigint, last bigint, ends array<bigint>, heads array<binary>"

    def separators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                raw = batch.column(1)[row].as_py()
                ids = np.frombuffer(raw, "<u2")
                name = batch.column(0)[row].as_py()
                for block, at in enumerate(range(0, len(ids), BLOCK_IDS)):
                    ends = at + np.flatnonzero(ids[at : at + BLOCK_IDS] == end_id)
                    starts = np.concatenate([[0] if at == 0 else [], ends + 1]).astype(np.int64)
                    # a head may reach into the next block, as the block's reader may
                    heads = [raw[2 * s : 2 * (s + head_ids)] for s in starts.tolist()] if head_ids else [b""] * len(starts)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name]),
                            pa.array([block], pa.int64()),
                            pa.array([ends[-1] if len(ends) else -1], pa.int64()),
                            pa.array([ends.tolist()], pa.list_(pa.int64())),
                            pa.array([heads], pa.list_(pa.binary())),
                        ],
                        ["file", "block", "last", "ends", "heads"],
                    )

    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    except AnalysisException:  # an empty table made no file
        files = spark.createDataFrame([], "path string, content binary")
    blocks = keep(files.select("path", "content").mapInArrow(separators, schema), "separators")
    by_block = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # of each block: the last separator before it, and the head of the document that is open there
    state = blocks.select(
        "file",
        "block",
        F.coalesce(F.max("last").over(by_block), F.lit(-1)).alias("open_after"),
        F.last(F.when(F.size("heads") > 0, F.element_at("heads", -1)), ignorenulls=True).over(by_block).alias("open_head"),
    )
    documents = (
        blocks.select("file", "block", "ends", "heads")
        .join(state, ["file", "block"])
        .select("file", "ends", "heads", "open_after", "open_head", F.posexplode("ends").alias("k", "end"))
    )
    # block 0 lists the head at place 0 before those that follow its separators
    heads = F.when(F.size("heads") > F.size("ends"), F.col("heads")).otherwise(F.concat(F.array("open_head"), F.col("heads")))
    after = F.when(F.col("k") == 0, F.col("open_after")).otherwise(F.get("ends", F.col("k") - 1))
    return documents.select(
        "file",
        (after + 1).alias("file_start"),
        (F.col("end") - after - 1).alias("n_tokens"),
        F.get(heads, F.col("k")).alias("head"),
    )


def head_doc_id(head: Column) -> Column:
    """The doc_id that ``write_flat`` spelled in a document's head."""
    text = F.hex(head)
    digits = [
        F.conv(F.concat(F.substring(text, 4 * k + 3, 2), F.substring(text, 4 * k + 1, 2)), 16, 10).cast("bigint")
        for k in range(HEAD_IDS)
    ]
    bits = digits[0]
    for k in range(1, HEAD_IDS):
        bits = bits.bitwiseOR(F.shiftleft(digits[k], 15 * k))
    return F.when(digits[-1] != 0x7FFF, bits.bitwiseXOR(F.lit(-(1 << 63))))
