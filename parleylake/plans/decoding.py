"""Queries over binary payloads and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parleylake.decode import tables
from parleylake.operators import audit
from parleylake.plans.chat import Query
from parleylake.runtime import new_path, table
from parleylake.streaming import events

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_rows").select("sample_id", F.try_to_binary("msgcontent_hex", F.lit("hex")).alias("content"))


@query()
def message_parse(spark: SparkSession, d: str) -> DataFrame:
    return tables.message_elements(_payloads(spark, d), ["sample_id"], "content")


@query()
def context_tags(spark: SparkSession, d: str) -> DataFrame:
    return tables.context_tags(_payloads(spark, d), ["sample_id"], "content")


@query()
def text_runs(spark: SparkSession, d: str) -> DataFrame:
    return tables.text_runs(_payloads(spark, d), ["sample_id"], "content")


@query()
def proto_fields(spark: SparkSession, d: str) -> DataFrame:
    return tables.proto_fields(_payloads(spark, d), ["sample_id"], "content")


@query()
def byte_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The bytes of sampled payloads that no element explains."""
    return audit.coverage_gaps(tables.coverage(_payloads(spark, d), ["sample_id"], "content"), key=["sample_id"], total="total")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.concat(F.when(F.col("event_id") % 3 == 0, "noise ").otherwise(""), F.to_json(F.struct(F.col("event_type").alias("type"), F.struct(F.col("user_id").cast("string").alias("account"), F.lit("log").alias("source"), F.date_format("ts", "yyyy-MM-dd").alias("path"), F.get_json_object("props", "$.k").alias("key"), F.unix_timestamp("ts").alias("at")).alias("payload")))).alias("value"))


_EVENTS = "select event_type as kind, cast(user_id as varchar) as account, 'log' as source, strftime(ts, '%Y-%m-%d') as path, json_extract_string(props, '$.k') as key from events"


@query(f"select kind, account, source, path, key, count(*) as n from ({_EVENTS}) group by all")
def event_normalize(spark: SparkSession, d: str) -> DataFrame:
    return events.normalised(_lines(spark, d)).groupBy(*events.IDENTITY).agg(F.count(F.lit(1)).alias("n"))


@query(f"select distinct kind, account, source, path, key from ({_EVENTS})")
def event_import(spark: SparkSession, d: str) -> DataFrame:
    """Events not yet in an empty store, each once."""
    e = events.normalised(_lines(spark, d))
    return events.new_events(e, e.limit(0)).select(*events.IDENTITY)


@query(f"select distinct kind, account, source, path, key from ({_EVENTS})")
def event_stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The same by a stream over files, run until all present files are read."""
    source, target = new_path(spark, "event-lines"), new_path(spark, "events")
    _lines(spark, d).write.text(source)
    events.follow(spark, source, target, new_path(spark, "event-state")).awaitTermination()
    return spark.read.parquet(target).select(*events.IDENTITY)


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return events.windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))
