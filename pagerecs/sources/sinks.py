"""Partitioned sinks: production Parquet (K1-K3), search feed (K4) and the
tab-separated export (K5).

Every sink overwrites only the partitions present in the written frame
(dynamic partition overwrite, set per write) and none funnels the whole output
through one task: rows are rebalanced on the table's partition columns, which
splits a hot partition over tasks, and each file is sorted
(``file_order`` checks that). Every file of the tab-separated export carries
its own header.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from pagerecs.schemas import PROD_PARTITION_COLUMNS, PROD_SCHEMA, SEARCH_PARTITION_COLUMNS

# Hive text-format conventions.
TSV_SEPARATOR = "\t"
TSV_NULL = "\\N"


def _writer(df: DataFrame, partition_by: Sequence[str], max_records_per_file: int | None):
    """Writer that overwrites only the partitions present in ``df``."""
    w = (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
    )
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", int(max_records_per_file))
    return w


def prod_order(columns: Sequence[str] = PROD_PARTITION_COLUMNS) -> list[Column]:
    """Write order of the production table: partition, then page_title
    descending (NULLs last), then page and image so that equal titles are
    still splittable by the range partitioner."""
    return [F.col(c) for c in columns] + [
        F.desc_nulls_last("page_title"),
        F.asc("page_id"),
        F.asc_nulls_first("image_id"),
    ]


def write_prod(
    df: DataFrame,
    path: str,
    *,
    sort: bool = True,
    max_records_per_file: int | None = None,
) -> None:
    """Write production rows partitioned by (wiki, snapshot), data columns in
    table (DDL) order, each file sorted by page_title descending.

    The rows are rebalanced on the partition columns, so a table partition
    has few files and a large one is split over tasks. ``sort=False`` writes
    rows as they come (a frame already ordered by ``prod_order()`` within its
    partitions keeps that order)."""
    out = df.select(*[f.name for f in PROD_SCHEMA.fields])
    if sort:
        out = out.hint("rebalance", *PROD_PARTITION_COLUMNS).sortWithinPartitions(*prod_order())
    _writer(out, PROD_PARTITION_COLUMNS, max_records_per_file).parquet(path)


def write_search_feed(
    df: DataFrame,
    path: str,
    *,
    max_records_per_file: int | None = None,
) -> None:
    """Write the feed partitioned by year/month/day (int directory values,
    matching the table DDL)."""
    _writer(df, SEARCH_PARTITION_COLUMNS, max_records_per_file).parquet(path)


def tsv_field(c: Column | str, text_like: bool = True) -> Column:
    """One TSV field as Hive's text format writes it: string form, NULL as
    ``\\N``, no quoting. Tabs and line breaks inside a value would split the
    row, so they become spaces (a per-character ``translate``, no regex);
    ``text_like=False`` skips that for numbers and booleans, which cannot
    contain them."""
    c = F.col(c) if isinstance(c, str) else c
    text = c.cast("string")
    if text_like:
        text = F.translate(text, "\t\n\r", "   ")
    return F.coalesce(text, F.lit(TSV_NULL))


def tsv_line(columns: Sequence[str], df: DataFrame | None = None) -> Column:
    """Fields joined by tabs; with ``df`` the column types decide which
    fields need the tab/newline replacement."""
    plain = (NumericType, BooleanType)
    kinds = {f.name: not isinstance(f.dataType, plain) for f in df.schema.fields} if df is not None else {}
    return F.concat_ws(TSV_SEPARATOR, *[tsv_field(c, kinds.get(c, True)) for c in columns])


#: Stands between the fields of the one-column text sink; replaced in values.
_NO_SEPARATOR = "\x01"


def write_tsv(
    rows: DataFrame,
    path: str,
    columns: Sequence[str] | None = None,
    partition_by: Sequence[str] = PROD_PARTITION_COLUMNS,
    header_partitions: Sequence[Sequence[str]] | None = None,
    max_records_per_file: int | None = None,
) -> None:
    """Tab-separated text files, one folder per ``partition_by`` value.

    Every file begins with the header, so each stands for itself; the data is
    written where it is, with no shuffle. A row is one text column whose *name*
    is the header line: the sink that writes a column's name at the top of
    every file then writes headers, and there is nothing for it to quote or
    separate. ``header_partitions`` lists partition values that get a file even
    if no row has them (for example every requested wiki). ``columns`` defaults
    to every column, in frame order (partition columns included, as the
    original export carried ``wiki`` in its rows).
    """
    if columns is None:
        columns = list(rows.columns)
    header = TSV_SEPARATOR.join(columns)
    line = F.translate(tsv_line(columns, rows), _NO_SEPARATOR, " ")
    _text_with_header(_writer(rows.select(line.alias(header), *partition_by), partition_by, max_records_per_file), path)
    if header_partitions:
        # the folders that now have files, by their names alone
        found = read_tsv(rows.sparkSession, path, partition_by).select(*partition_by).distinct().collect()
        filled = {tuple(r) for r in found}
        empty = [v for v in ([str(x) for x in values] for values in header_partitions) if tuple(v) not in filled]
        if empty:
            schema = ", ".join(["value string"] + [f"`{p}` string" for p in partition_by])
            heads = rows.sparkSession.createDataFrame([(header, *v) for v in empty], schema)
            _writer(heads, partition_by, None).text(path)


def _text_with_header(writer, path: str) -> None:
    options = {
        "header": True,
        "sep": _NO_SEPARATOR,
        "quote": "",
        "escapeQuotes": False,
        "emptyValue": "",
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
    }
    writer.options(**options).csv(path)


def read_tsv(spark, path: str, partition_by: Sequence[str] = PROD_PARTITION_COLUMNS) -> DataFrame:
    """The export's lines as they stand, every file's header among them."""
    schema = ", ".join(["value string"] + [f"`{p}` string" for p in partition_by])
    return spark.read.schema(schema).text(path)


def read_tsv_rows(
    spark, path: str, columns: Sequence[str], partition_by: Sequence[str] = PROD_PARTITION_COLUMNS
) -> DataFrame:
    """The export's rows, each file parsed by itself: its first line must be the
    header, every other is split at tabs; a line of another number of fields fails."""
    lines = read_tsv(spark, path, partition_by)
    header = F.lit(TSV_SEPARATOR.join(columns))
    fields = F.split("value", TSV_SEPARATOR, -1)
    whole = F.when(F.size(fields) == len(columns), fields).otherwise(F.raise_error(F.lit("a line of other fields")))
    rest = [p for p in partition_by if p not in columns]
    return lines.where(F.col("value") != header).select(
        *[F.nullif(whole[i], F.lit(TSV_NULL)).alias(c) for i, c in enumerate(columns)], *rest
    )


def tsv_headers(spark, path: str, columns: Sequence[str], partition_by: Sequence[str] = PROD_PARTITION_COLUMNS) -> DataFrame:
    """Per partition: its files, its rows, and the files without exactly one header."""
    header = F.lit(TSV_SEPARATOR.join(columns))
    lines = read_tsv(spark, path, partition_by).select("*", F.col("_metadata.file_name").alias("file"))
    files = lines.groupBy(*partition_by, "file").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("value") == header).alias("headers")
    )
    return files.groupBy(*partition_by).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(F.col("lines") - F.col("headers")).alias("rows"),
        F.count_if(F.col("headers") != 1).alias("files_without_header"),
    )


def file_order(prod: DataFrame) -> DataFrame:
    """Per (wiki, snapshot): rows, and inversions, which are rows of a Parquet
    file whose page_title is greater than that of the row before them, where
    titles must descend and NULLs come last (K1). ``prod`` is a scan of the
    table; rows are compared within their file, by their place in it."""
    placed = prod.select(
        "wiki",
        "snapshot",
        "page_title",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("place"),
    )
    title, before = F.col("page_title"), F.lag("page_title").over(Window.partitionBy("file").orderBy("place"))
    first = F.col("place") == 0
    rises = ~first & F.coalesce(F.when(title.isNull(), F.lit(False)).otherwise(before.isNull() | (title > before)), F.lit(False))
    return (
        placed.withColumn("rises", rises)
        .groupBy("wiki", "snapshot")
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if("rises").alias("inversions"))
    )
