"""Local message databases as a Spark data source."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThan
from pyspark.sql.types import StructType

#: Names of message tables: a conversation's type and its id.
MESSAGE_TABLES = r"^(?:buddy|group|discuss|system)_.+"
NEEDED = {"time", "rand", "senderuin", "msgcontent"}


def connect(path: str) -> sqlite3.Connection:
    """A read-only connection; the file is never changed, not even by a journal."""
    return sqlite3.connect(f"file:{quote(path)}?mode=ro&immutable=1", uri=True)


def identifier(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def user_tables(con: sqlite3.Connection) -> list[str]:
    return [r[0] for r in con.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by name")]


def columns(con: sqlite3.Connection, table: str) -> list[str]:
    return [r[1] for r in con.execute(f"pragma table_info({identifier(table)})")]


def message_tables(con: sqlite3.Connection, pattern: str = MESSAGE_TABLES) -> list[str]:
    """The tables named like conversations that have a message's columns, in order of name."""
    return [t for t in user_tables(con) if re.match(pattern, t) and {c.lower() for c in columns(con, t)} >= NEEDED]


class Range(InputPartition):
    def __init__(self, path: str, table: str, low: int, high: int) -> None:
        super().__init__((path, table, low, high))
        self.path, self.table, self.low, self.high = path, table, low, high


class MessageReader(DataSourceReader):
    """Reads rowid ranges of message tables; filters on table and rowid are applied before anything is read."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.pattern = options.get("tablepattern", MESSAGE_TABLES)
        self.rows = int(options.get("rowsperpartition", 200_000))
        self.table: str | None = None
        self.low, self.high = -(2**63), 2**63 - 1

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("msg_table",):
                self.table = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("rowid",):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value)
            elif isinstance(f, GreaterThanOrEqual) and f.attribute == ("rowid",):
                self.low = max(self.low, f.value)
            elif isinstance(f, LessThan) and f.attribute == ("rowid",):
                self.high = min(self.high, f.value - 1)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        con, out = connect(self.path), []
        try:
            for t in message_tables(con, self.pattern):
                if self.table not in (None, t):
                    continue
                first, last = con.execute(f"select min(rowid), max(rowid) from {identifier(t)}").fetchone()
                if first is None:
                    continue
                low, last = max(first, self.low), min(last, self.high)
                while low <= last:
                    out.append(Range(self.path, t, low, min(last, low + self.rows - 1)))
                    low += self.rows
        finally:
            con.close()
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        con = connect(partition.path)
        try:
            have = {c.lower() for c in columns(con, partition.table)}
            info = "Info" if "info" in have else "null"
            query = f"select rowid, Time, Rand, SenderUin, MsgContent, {info} from {identifier(partition.table)} where rowid between ? and ? order by rowid"
            for row in con.execute(query, (partition.low, partition.high)):
                yield (partition.table, *row)
        finally:
            con.close()


class ChatSqlite(DataSource):
    """Format ``chatsqlite``: option path, optionally tablePattern and rowsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "chatsqlite"

    def schema(self) -> str:
        return "msg_table string, rowid long, msg_time long, rand long, sender_uin long, content binary, info binary"

    def reader(self, schema: StructType) -> MessageReader:
        return MessageReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let it see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChatSqlite)


def table_report(path: str) -> list[tuple[str, int | None, str, str, str]]:
    """(table, rows, columns, indexes, error) of every table of a database, an unreadable one with its error."""
    con, out = connect(path), []
    try:
        for t in user_tables(con):
            try:
                n = con.execute(f"select count(*) from {identifier(t)}").fetchone()[0]
                out.append((t, n, ",".join(columns(con, t)), ",".join(r[1] for r in con.execute(f"pragma index_list({identifier(t)})")), ""))
            except sqlite3.Error as e:
                out.append((t, None, "", "", str(e)))
    finally:
        con.close()
    return out


def pragmas(path: str) -> dict[str, object]:
    """Page size and count, free pages, user version and encoding of a database."""
    con = connect(path)
    try:
        return {p: con.execute(f"pragma {p}").fetchone()[0] for p in ("page_size", "page_count", "freelist_count", "user_version", "encoding")}
    finally:
        con.close()
