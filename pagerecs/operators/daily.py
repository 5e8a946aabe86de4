"""Count of new pages for one day, per database."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _as_date(day) -> dt.date:
    if isinstance(day, dt.datetime):
        return day.date()
    if isinstance(day, dt.date):
        return day
    return dt.date.fromisoformat(str(day))


def daily_new_pages(
    events: DataFrame,
    day,
    database: str | None = None,
    *,
    database_col: str = "database",
    ts_col: str | None = None,
) -> DataFrame:
    """(database, count_of_new_pages) for ``day``; no events -> no rows.

    Events partitioned by integer year/month/day columns are filtered on
    those (partition pruning). With ``ts_col`` the day is the half-open range
    [day, day + 1) on that timestamp, which the Parquet reader can use for
    row-group skipping (``year(ts) = ...`` could not be pushed down).
    """
    d = _as_date(day)
    if ts_col is None:
        cond = (F.col("year") == d.year) & (F.col("month") == d.month) & (F.col("day") == d.day)
    else:
        # Bounds are typed like the column (string -> timestamp_ntz involves
        # no time zone; -> timestamp reads the day in the session time zone).
        ts = F.col(ts_col)
        dtype = events.schema[ts_col].dataType.simpleString()
        start = F.lit(d.isoformat()).cast(dtype)
        end = F.lit((d + dt.timedelta(days=1)).isoformat()).cast(dtype)
        cond = (ts >= start) & (ts < end)
    if database is not None:
        cond = cond & (F.col(database_col) == F.lit(database))
    return (
        events.where(cond)
        .groupBy(F.col(database_col).alias("database"))
        .agg(F.count(F.lit(1)).alias("count_of_new_pages"))
    )


# The same count as SQL text over a catalog table or view. Names go through
# IDENTIFIER() and values through named markers: nothing is formatted in.
DAILY_SQL_PARTITIONED = """
SELECT IDENTIFIER(:database_col) AS database, count(*) AS count_of_new_pages
FROM IDENTIFIER(:table)
WHERE year = :year AND month = :month AND day = :day
  AND (:database IS NULL OR IDENTIFIER(:database_col) = :database)
GROUP BY IDENTIFIER(:database_col)
"""

DAILY_SQL_TIMESTAMP = """
SELECT IDENTIFIER(:database_col) AS database, count(*) AS count_of_new_pages
FROM IDENTIFIER(:table)
WHERE IDENTIFIER(:ts_col) >= CAST(:start AS TIMESTAMP_NTZ) AND IDENTIFIER(:ts_col) < CAST(:end AS TIMESTAMP_NTZ)
  AND (:database IS NULL OR IDENTIFIER(:database_col) = :database)
GROUP BY IDENTIFIER(:database_col)
"""


def daily_new_pages_sql(
    spark,
    table: str,
    day,
    database: str | None = None,
    *,
    database_col: str = "database",
    ts_col: str | None = None,
) -> DataFrame:
    """``daily_new_pages`` as parameterised SQL over ``table``."""
    d = _as_date(day)
    args = {"table": table, "database_col": database_col, "database": database}
    if ts_col is None:
        args.update(year=d.year, month=d.month, day=d.day)
        return spark.sql(DAILY_SQL_PARTITIONED, args=args)
    args.update(ts_col=ts_col, start=d.isoformat(), end=(d + dt.timedelta(days=1)).isoformat())
    return spark.sql(DAILY_SQL_TIMESTAMP, args=args)
