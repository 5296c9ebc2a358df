"""Deterministic samples of rows per table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed(messages: DataFrame) -> DataFrame:
    """Distinct (msg_table, rowid)."""
    return messages.select("msg_table", "rowid").where("msg_table is not null and rowid is not null").distinct()


def first_rows(messages: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rowids of each table; limited on the map side before the shuffle."""
    return messages.select("msg_table", "rowid").where("rowid is not null").withColumn("k", F.dense_rank().over(Window.partitionBy("msg_table").orderBy("rowid"))).where(F.col("k") <= n).select("msg_table", "rowid").distinct()


def capped_rows(messages: DataFrame, per_table: int, most: int) -> DataFrame:
    """``per_table`` first rows of each table, and of these the first ``most`` overall."""
    return first_rows(messages, per_table).orderBy("msg_table", "rowid").limit(most)


def edge_rows(messages: DataFrame, edge: int) -> DataFrame:
    """The first and the last ``edge`` rowids of each table."""
    m = messages.select("msg_table", "rowid").where("rowid is not null")
    last = m.withColumn("k", F.dense_rank().over(Window.partitionBy("msg_table").orderBy(F.desc("rowid")))).where(F.col("k") <= edge).select("msg_table", "rowid")
    return first_rows(m, edge).union(last).distinct()


def even_targets(max_rowid: Column, points: int) -> Column:
    """``points`` evenly spaced rowids from 1 on."""
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(1) + F.floor((max_rowid - 1) * i / F.lit(points)))


def random_targets(maxima: DataFrame, points: int) -> DataFrame:
    """Pseudo-random rowids of each table: a 64-bit linear generator seeded by the table's name and its largest rowid."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The FNV-1a basis and prime, and the generator's factor and increment.
        basis, prime, factor, increment, word = 0xCBF29CE484222325, 0x100000001B3, 6364136223846793005, 1442695040888963407, (1 << 64) - 1
        for f in frames:
            out = []
            for name, top in zip(f["msg_table"], f["max_rowid"]):
                h = basis
                for b in name.encode():
                    h = (h ^ b) * prime & word
                s = (h ^ (int(top) << 17)) & word
                targets = []
                for _ in range(points if top > 0 else 0):
                    s = (s * factor + increment) & word
                    targets.append(1 + s % int(top))
                out.append(targets)
            yield f.assign(targets=out)

    return maxima.mapInPandas(run, "msg_table string, max_rowid long, targets array<long>")


def rows_at_or_after(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """The first rowid of each table at or after each target (columns msg_table, targets as an array).

    Each row is put into the interval between the sorted targets that it lies in, the least of each interval is taken
    (with partial aggregation), and empty intervals look to the next one: no row meets more than its own interval.
    """
    t = targets.select("msg_table", F.array_sort(F.array_distinct("targets")).alias("targets"))
    at = rows.join(t, "msg_table").withColumn("i", F.aggregate("targets", F.lit(0), lambda a, x: a + (x <= F.col("rowid")).cast("int"))).where("i > 0")
    least = at.groupBy("msg_table", "i").agg(F.min("rowid").alias("rowid"))
    asked = t.select("msg_table", F.posexplode("targets").alias("p", "target")).select("msg_table", (F.col("p") + 1).alias("i"))
    later = F.min("rowid").over(Window.partitionBy("msg_table").orderBy("i").rowsBetween(0, Window.unboundedFollowing))
    return asked.join(least, ["msg_table", "i"], "left").select("msg_table", later.alias("rowid")).where("rowid is not null").distinct()


def probe_sample(messages: DataFrame, *, edge: int = 6, points: int = 12, random_points: int = 0) -> DataFrame:
    """Edges, evenly spaced and pseudo-random rows of each table together, each once.

    A table of at most ``2 * edge + points`` rows is taken whole.
    """
    m = keyed(messages)
    tops = m.groupBy("msg_table").agg(F.max("rowid").alias("max_rowid"), F.count(F.lit(1)).alias("n"))
    out = edge_rows(m, edge).union(tops.select("msg_table", "max_rowid"))
    if points > 0:
        out = out.union(rows_at_or_after(m, tops.where("max_rowid > 0").select("msg_table", even_targets(F.col("max_rowid"), points).alias("targets"))))
    if random_points > 0:
        out = out.union(rows_at_or_after(m, random_targets(tops.select("msg_table", "max_rowid"), random_points)))
    small = first_rows(m.join(tops.where(F.col("n") <= 2 * edge + points).select("msg_table"), "msg_table", "left_semi"), 2 * edge + points)
    return out.union(small).distinct()
