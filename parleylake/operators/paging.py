"""Keyset pages of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _size(limit: int) -> int:
    return min(max(limit, 1), 100)


def page_forward(messages: DataFrame, table: str, cursor: int = 1, limit: int = 20) -> DataFrame:
    """The rows of a table from a rowid on; filter and limit reach the scan and the top-k, nothing else is read."""
    return messages.where((F.col("msg_table") == table) & (F.col("rowid") >= max(cursor, 1))).orderBy("rowid", "ingested_at").limit(_size(limit))


def page_before(messages: DataFrame, table: str, before: int, limit: int = 20) -> DataFrame:
    """The rows just before a rowid, in ascending order."""
    return messages.where((F.col("msg_table") == table) & (F.col("rowid") < before)).orderBy(F.desc("rowid"), F.desc("ingested_at")).limit(_size(limit)).orderBy("rowid", "ingested_at")


def page_envelope(page: DataFrame, total: DataFrame, offset: int, limit: int) -> DataFrame:
    """First and last rowid, the neighbouring cursors and whether there is more; ``total`` has one row with rows_est."""
    e = page.agg(F.coalesce(F.min("rowid"), F.lit(0)).alias("first_rowid"), F.coalesce(F.max("rowid"), F.lit(0)).alias("last_rowid"), F.count(F.lit(1)).alias("items"))
    one = total.agg(F.coalesce(F.max("rows_est"), F.lit(0)).alias("total"))
    # one row each
    return e.join(F.broadcast(one)).select("first_rowid", "last_rowid", "items", "total", F.col("first_rowid").alias("prev_offset"), (F.col("last_rowid") + 1).alias("next_offset"), F.lit(offset > 0).alias("has_prev"), (F.lit(offset + _size(limit)) < F.col("total")).alias("has_next"))


def page_senders(page: DataFrame) -> DataFrame:
    """The distinct senders of a page, whose profiles are to be looked up."""
    return page.select(F.trim("sender_uin").alias("sender")).where("sender <> ''").distinct()


def row_detail(messages: DataFrame, table: str, rowid: int) -> DataFrame:
    """One message by its key."""
    return messages.where((F.col("msg_table") == table) & (F.col("rowid") == rowid))


def byte_window(rows: DataFrame, column: str, start: int, length: int) -> DataFrame:
    """Rows with ``window_hex``: the bytes of a hex column from ``start`` (0-based), in lower case."""
    return rows.withColumn("window_hex", F.lower(F.substring(F.col(column), 2 * start + 1, 2 * length)))
