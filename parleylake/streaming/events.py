"""Append-only event logs: normalised, each event once, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parleylake.runtime import names_in

IDENTITY = ["kind", "account", "source", "path", "key"]


def line_event(line: Column) -> Column:
    """The JSON object within a line, noise before and after it aside; else an object that holds the line as ``_raw``."""
    inner = F.regexp_extract(line, r"(\{.*\})", 1)
    return F.when(F.try_parse_json(line).isNotNull() & F.startswith(F.ltrim(line), F.lit("{")), line).when(F.try_parse_json(inner).isNotNull() & (inner != ""), inner).otherwise(F.to_json(F.struct(line.alias("_raw"))))


def normalised(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines as events: kind, account, source, path, key, at (epoch seconds) and the record; ``payload`` is unwrapped.

    Lines without a type have kind ``_raw``. Null lines give nothing. Other columns, such as an arrival time, pass.
    """
    j = lines.where(F.col(line).isNotNull()).withColumn("_event", line_event(F.col(line))).drop(line)
    record = F.coalesce(F.get_json_object("_event", "$.payload"), F.col("_event"))
    get = lambda *names: F.coalesce(*[F.get_json_object(record, f"$.{n}") for n in names], F.lit(""))
    kind = F.when(F.get_json_object("_event", "$._raw").isNotNull(), "_raw").otherwise(F.coalesce(F.get_json_object("_event", "$.type"), F.get_json_object(record, "$.type"), F.lit("_raw")))
    return j.select(*[c for c in j.columns if c != "_event"], kind.alias("kind"), get("account", "uin").alias("account"), get("source", "module").alias("source"), get("path", "file").alias("path"), F.when(kind == "_raw", F.get_json_object("_event", "$._raw")).otherwise(get("key", "id")).alias("key"), F.get_json_object(record, "$.at").try_cast("long").alias("at"), record.alias("record"))


def new_events(events: DataFrame, store: DataFrame) -> DataFrame:
    """Events whose identity the store does not hold, each once: the first by time, then by record."""
    first = events.groupBy(*IDENTITY).agg(F.min(F.struct(F.coalesce("at", F.lit(2**62)).alias("o"), F.col("record"), F.col("at"))).alias("s")).select(*IDENTITY, "s.at", "s.record")
    return first.join(store.select(*IDENTITY).distinct(), IDENTITY, "left_anti")


def counters(events: DataFrame, imported: DataFrame) -> DataFrame:
    """How many events came, were imported and ignored."""
    return events.agg(F.count(F.lit(1)).alias("events")).join(F.broadcast(imported.agg(F.count(F.lit(1)).alias("imported")))).withColumn("ignored", F.col("events") - F.col("imported"))


def follow(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Normalise the lines of files as they appear, and append each event once to a parquet table.

    Each micro-batch is compared with the identities that the target holds, however old they are, so nothing has to be
    remembered between batches, and a batch that is run again after a failure adds nothing twice. All present files are
    read, then the query ends, to be started again with the same checkpoint folder.
    """

    def append(batch: DataFrame, _: int) -> None:
        has = names_in(spark, target)
        store = batch.sparkSession.read.parquet(target) if has else batch
        new_events(batch, store if has else batch.limit(0)).write.mode("append").parquet(target)

    lines = spark.readStream.format("text").load(source)
    return normalised(lines).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, kind: str, *, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Events per window and kind; on a stream, windows close ``delay`` after they end."""
    return events.withWatermark(at, delay).groupBy(F.window(at, width), F.col(kind)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")
