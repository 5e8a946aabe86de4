"""Token files of independent zstandard frames with a seek table.

A file holds one frame per document (its ids as little-endian unsigned
32-bit integers), then a skippable frame naming the documents, then the seek
table of the zstandard seekable format: compressed size, plain size and
XXH64 checksum of every frame, and a footer. A reader takes the table from
the file's end and decompresses only the frames of the documents asked for.

Files go through Spark's text writer, so they reach any file system that
Spark writes and a lost task leaves none behind: each row is a whole file,
and the row's end is the footer's last four bytes.

Documents lie in ascending doc_id order (null last, equal ids by text, null
text first): the id range is cut at approximate quantiles of the ids alone,
and each part is sorted. Results for odd input: a null or empty text is its
end token alone; an empty table gives no files and no rows; other columns
are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagerecs.llm.common import give_back, shuffle_partitions
from pagerecs.llm.tokens import encoder, vocabulary

#: Fixed values of the zstandard formats.
SEEK_MAGIC = b"\xb1\xea\x92\x8f"
SEEK_FRAME = 0x184D2A5E
NAMES_FRAME = 0x184D2A50
#: A file is closed when its plain frames reach this many bytes.
FILE_BYTES = 16 << 20
_ENTRY = np.dtype([("stored", "<u4"), ("plain", "<u4"), ("checksum", "<u4")])


def in_id_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) dealt by ranges of doc_id and sorted; the partition
    index ascends with the id."""
    n = shuffle_partitions(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else None
    if cuts and len(set(cuts)) > 1:
        splits = [-float("inf"), *sorted(set(map(float, cuts))), float("inf")]
        docs = docs.withColumn("at", F.col("doc_id").cast("double"))
        docs = Bucketizer(splits=splits, inputCol="at", outputCol="range", handleInvalid="keep").transform(docs)
        part = F.coalesce(F.col("range").cast("int"), F.lit(len(splits) - 1))  # null ids last
        docs = docs.repartitionById(len(splits), part).drop("at", "range")
    else:
        docs = docs.repartition(1)
    return docs.sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def _file(part: int, number: int, ids: list[int | None], frames: list[bytes], table: list[tuple[int, int, int]]) -> bytes:
    """A whole file but its last four bytes."""
    names = struct.pack("<III", part, number, len(ids)) + np.array([i or 0 for i in ids], "<i8").tobytes()
    named = _skippable(NAMES_FRAME, names + bytes(i is None for i in ids))
    entries = np.array([*table, (len(named), 0, 0)], _ENTRY).tobytes()
    seek = _skippable(SEEK_FRAME, entries + struct.pack("<IB", len(table) + 1, 0x80) + SEEK_MAGIC)
    return (b"".join(frames) + named + seek)[:-4]


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1) -> None:
    """Encodes documents and writes them to ``path`` in ascending id order."""
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        encode = encoder(tokenizer or vocabulary("word_bpe_49k.json")).encode
        compress = zstandard.ZstdCompressor(level=1).compress
        part, number, plain = TaskContext.get().partitionId(), 0, 0
        ids, frames, table = [], [], []
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = batch.slice(at, 256)
                for doc_id, tokens in zip(rows.column(0).to_pylist(), encode(rows.column(1).to_pylist()), strict=True):
                    tokens += end
                    frames.append(compress(tokens))
                    table.append((len(frames[-1]), len(tokens), xxhash.xxh64_intdigest(tokens) & 0xFFFFFFFF))
                    ids.append(doc_id)
                    plain += len(tokens)
                    if plain >= FILE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([_file(part, number, ids, frames, table)])], ["file"])
                        number, plain = number + 1, 0
                        ids, frames, table = [], [], []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([_file(part, number, ids, frames, table)])], ["file"])
        give_back(keep_caches=True)

    files = in_id_order(docs).mapInArrow(pack, "file binary")
    (
        files.select(F.col("file").cast("string").alias("value"))
        .write.option("encoding", "ISO-8859-1")
        .option("lineSep", SEEK_MAGIC.decode("latin-1"))
        .option("maxRecordsPerFile", 1)
        .text(path)
    )


def _documents(file: bytes, wanted: set[int] | None) -> tuple[tuple[int, int], Iterator[tuple[int, int | None, bytes]]]:
    """The file's place and, in file order, (first id's place in the file,
    doc_id, ids) of the wanted documents."""
    import xxhash
    import zstandard

    if file[-4:] != SEEK_MAGIC:
        raise ValueError("no seek table at the file's end")
    n = struct.unpack("<I", file[-9:-5])[0]
    table = np.frombuffer(file, _ENTRY, n, len(file) - 9 - 12 * n)
    ends = np.cumsum(table["stored"].astype(np.int64))
    names = file[ends[-2] + 8 if n > 1 else 8 : ends[-1]]
    part, number, count = struct.unpack("<III", names[:12])
    ids = np.frombuffer(names, "<i8", count, 12).tolist()
    null = names[12 + 8 * count :]
    first = np.concatenate([[0], np.cumsum(table["plain"].astype(np.int64))]) // 4
    decompress = zstandard.ZstdDecompressor().decompress

    def read() -> Iterator[tuple[int, int | None, bytes]]:
        for i, doc_id in enumerate(ids):
            doc_id = None if null[i] else doc_id
            if wanted is None or doc_id in wanted:
                plain = decompress(file[ends[i] - table["stored"][i] : ends[i]], max_output_size=int(table["plain"][i]))
                if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != table["checksum"][i]:
                    raise ValueError(f"frame {i} fails its checksum")
                yield int(first[i]), doc_id, plain

    return (part, number), read()


def read_token_files(
    spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = True
) -> DataFrame:
    """Rows of the files under ``path``: file_part and file_number (their
    order is the files'), file_start (ids before the document in its file),
    doc_id, n_tokens, ids_crc32 and, if asked for, ids. Only frames of
    ``doc_ids`` (None: all) are decompressed; a bad checksum is an error."""
    wanted = None if doc_ids is None else set(doc_ids)
    schema = pa.schema(
        [("file_part", pa.int32()), ("file_number", pa.int32()), ("file_start", pa.int64()), ("doc_id", pa.int64())]
        + [("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
    )

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                (part, number), documents = _documents(content.as_py(), wanted)
                rows = [(part, number, at, i, len(b) // 4, zlib.crc32(b), b if with_ids else None) for at, i, b in documents]
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    except AnalysisException:  # an empty table made no file
        files = spark.createDataFrame([], "content binary")
    ddl = "file_part int, file_number int, file_start bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint, ids binary"
    return files.select("content").mapInArrow(unpack, ddl)


def with_start(rows: DataFrame) -> DataFrame:
    """Rows of ``read_token_files`` over all documents with ``start``: the ids
    of all documents before each, by a prefix sum over the files' totals."""
    totals = rows.groupBy("file_part", "file_number").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file_part", "file_number").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file_part", "file_number", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(totals, ["file_part", "file_number"]).withColumn("start", F.col("before") + F.col("file_start"))
