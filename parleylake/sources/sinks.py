"""Where results go: CSV, TSV, JSON lines, the catalog and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleylake.functions.text import safe_file_name, tsv_cell
from parleylake.runtime import put_text


def write_csv(df: DataFrame, path: str, *, force: bool = False) -> None:
    """CSV with a header; null is empty, only cells that need it are quoted. The commit makes all files appear at once."""
    df.write.mode("overwrite" if force else "errorifexists").option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)


def export_tables(tables: dict[str, DataFrame], path: str, *, force: bool = False) -> dict[str, str]:
    """Every table as CSV below ``path``; the result says per table '' or what went wrong."""
    done = {}
    for name, df in tables.items():
        try:
            write_csv(df, f"{path}/{name}", force=force)
            done[name] = ""
        except Exception as e:  # noqa: BLE001
            done[name] = str(e).splitlines()[0]
    return done


def export_database(tables: dict[str, DataFrame], path: str, *, force: bool = False) -> dict[str, str]:
    """``export_tables`` with ``schema.sql``, a statement per table, and ``tables.txt``, what became of each."""
    done = export_tables(tables, path, force=force)
    column = lambda f: f"`{f.name}` {f.dataType.simpleString()}"
    spark = next(iter(tables.values())).sparkSession
    put_text(spark, f"{path}/schema.sql", "".join(f"create table `{n}` ({', '.join(map(column, df.schema))});\n" for n, df in tables.items()))
    put_text(spark, f"{path}/tables.txt", "table\terror\n" + "".join(f"{n}\t{e}\n" for n, e in done.items()))
    return done


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text with a header; tabs and line breaks in cells become spaces."""
    flat = df.select(*[tsv_cell(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns])
    flat.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "\u0000").option("emptyValue", "").csv(path)


def write_samples(df: DataFrame, path: str) -> None:
    """Sample rows with their payload in lower-case hex."""
    write_tsv(df.select(F.col("msg_table").alias("table"), "rowid", F.col("msg_time").alias("time"), "rand", "sender_uin", F.lower(F.hex("content")).alias("msgcontent_hex")), path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_report(df: DataFrame) -> DataFrame:
    """Each row as JSON text."""
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("report"))


def replace_catalog(tables: dict[str, DataFrame], path: str) -> None:
    """Replace the catalog's tables as a whole."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def markdown(header: list[str], rows: list[tuple]) -> str:
    """A padded Markdown table of collected metadata."""
    cells = [[str("" if c is None else c).replace("|", "\\|") for c in r] for r in [header, *rows]]
    width = [max(3, *(len(r[i]) for r in cells)) for i in range(len(header))]
    lines = ["| " + " | ".join(c.ljust(w) for c, w in zip(r, width)) + " |" for r in cells]
    return "\n".join([lines[0], "| " + " | ".join("-" * w for w in width) + " |", *lines[1:]])


def with_file_names(streams: DataFrame, keys: list[str], stream: str = "stream") -> DataFrame:
    """Streams with ``file_name``, safe for any file system and different for different streams of a file.

    Names that several streams would share, letter case aside, get a hash of the stream's own name.
    """
    named = streams.withColumn("_safe", safe_file_name(F.regexp_replace(stream, "/", "_")))
    shared = named.groupBy(*keys, F.lower("_safe").alias("_low")).agg((F.count_distinct(stream) > 1).alias("_many"))
    j = named.withColumn("_low", F.lower("_safe")).join(shared, [*keys, "_low"])
    return j.withColumn("file_name", F.when(F.col("_many"), F.concat("_safe", F.lit("."), F.substring(F.sha2(stream, 256), 1, 12))).otherwise(F.col("_safe"))).drop("_safe", "_low", "_many")


def database_report(title: str, tables: list[tuple]) -> str:
    """A Markdown report of a database: (table, rows, columns, indexes, error) of each of its tables."""
    return f"# {title}\n\n" + markdown(["table", "rows", "columns", "indexes", "error"], tables) + "\n"


def rows_as_json(df: DataFrame, rowid: str) -> DataFrame:
    """Each row as (rowid, row), the other columns as a JSON object; bytes as hex, null members are kept."""
    shown = [F.lower(F.hex(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() == "binary" else F.col(f"`{f.name}`") for f in df.schema if f.name != rowid]
    return df.select(F.col(rowid).alias("rowid"), F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("row"))
