"""Conversation lists, labels and last times over one table of all messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parleylake.functions.text import SYSTEM_SENDERS, plausible_time, sender_show_name, usable_name

# Words of generated labels.
FALLBACK = {"buddy": "私聊", "group": "群聊", "discuss": "讨论组"}
TYPES = ["buddy", "group", "discuss", "system"]


def split_table(name: Column) -> tuple[Column, Column]:
    """(conv_type, conv_id) of a message table's name; other names are (unknown, name)."""
    known = name.rlike("^(?:buddy|group|discuss|system)_")
    return F.when(known, F.substring_index(name, "_", 1)).otherwise("unknown"), F.when(known, F.regexp_extract(name, "^[a-z]+_(.*)$", 1)).otherwise(name)


def last_times(messages: DataFrame, now: int, depth: int = 20) -> DataFrame:
    """Per table the newest rowid as estimate of its rows, the last plausible time among its newest rows, and anomalies.

    Only the ``depth`` newest rowids are looked at; the window is limited before the shuffle, so a large table costs
    no more there than a small one. Without a plausible time the newest row's time counts.
    """
    new = messages.where("msg_table is not null and rowid is not null").select("msg_table", "rowid", "msg_time").withColumn("k", F.dense_rank().over(Window.partitionBy("msg_table").orderBy(F.desc("rowid")))).where(F.col("k") <= depth).groupBy("msg_table", "k").agg(F.max("rowid").alias("rowid"), F.max("msg_time").alias("t"))
    ok = plausible_time(F.col("t"), F.lit(now))
    per = new.groupBy("msg_table").agg(F.max("rowid").alias("rows_est"), F.max(F.when(F.col("k") == 1, F.col("t"))).alias("raw_last_time"), F.min(F.when(ok, F.struct("k", "t"))).alias("f"), F.count(F.lit(1)).alias("n"))
    return per.select("msg_table", "rows_est", F.coalesce("f.t", "raw_last_time").alias("last_time"), "raw_last_time", F.coalesce(F.col("f.k") - 1, F.col("n")).cast("long").alias("time_anomaly_count"))


def group_renames(messages: DataFrame, depth: int = 256) -> DataFrame:
    """The label set by the first rename message among a group's first rows, else among its last (msg_table, renamed)."""
    by = Window.partitionBy("msg_table")
    m = messages.where("conv_type = 'group' and rowid is not null").select("msg_table", "rowid", "sender_uin", "text")
    first = m.withColumn("k", F.dense_rank().over(by.orderBy("rowid"))).where(F.col("k") <= depth).withColumn("side", F.lit(0))
    last = m.withColumn("k", F.dense_rank().over(by.orderBy(F.desc("rowid")))).where(F.col("k") <= depth).withColumn("side", F.lit(1))
    label = F.trim(F.regexp_extract("text", '修改了群名称为[“"]([^”"]*)', 1))
    found = first.unionByName(last).where(F.trim("sender_uin").isin(SYSTEM_SENDERS)).withColumn("label", label).where("length(label) between 1 and 80")
    return found.groupBy("msg_table").agg(F.min(F.struct("side", "k", "label")).getField("label").alias("renamed"))


def stored_labels(kv: DataFrame, contacts: DataFrame) -> DataFrame:
    """Labels of groups and discussions from their stored fields, of contacts from remark or nick: (kind, id, stored)."""
    names = kv.where(F.lower("stream").rlike("group|discuss") & F.col("field_name").isin("strGroupName", "strRemark") & (F.size("texts") > 0))
    ranked = names.select(F.when(F.lower("stream").contains("discuss"), "discuss").otherwise("group").alias("kind"), F.col("entry_key").alias("id"), F.struct((F.col("field_name") == "strGroupName").alias("p"), F.col("read_at"), F.col("field_index"), F.trim(F.element_at("texts", 1)).alias("x")).alias("s")).where("length(s.x) > 0")
    groups = ranked.groupBy("kind", "id").agg(F.max("s").getField("x").alias("stored"))
    people = contacts.where("uin is not null").groupBy(F.lit("buddy").alias("kind"), F.col("uin").cast("string").alias("id")).agg(F.max(F.coalesce(F.nullif(F.trim("remark"), F.lit("")), F.nullif(F.trim("nick"), F.lit("")))).alias("stored"))
    return groups.unionByName(people)


def first_sender_names(messages: DataFrame, account: str, depth: int) -> DataFrame:
    """The first usable name of another sender among the first rows of each table: (msg_table, sender_label)."""
    m = messages.where("rowid is not null").select("msg_table", "conv_id", "rowid", F.trim("sender_uin").alias("sender"), "sender_name").withColumn("k", F.dense_rank().over(Window.partitionBy("msg_table").orderBy("rowid"))).where(F.col("k") <= depth)
    named = m.withColumn("x", sender_show_name(F.col("sender_name"), F.col("sender"), F.lit(account), F.col("conv_id"))).where((F.col("x") != "") & (F.col("sender") != account))
    return named.groupBy("msg_table").agg(F.min(F.struct("k", "x")).getField("x").alias("sender_label"))


def labels(messages: DataFrame, stored: DataFrame, account: str, *, full: bool = True, prefer_rename: bool = True) -> DataFrame:
    """One label per conversation with its source: system_rename, infostorage, message_info_sender or fallback.

    The full ladder reads 32 rows for a sender's name and knows renames, the light one 8 rows and does not.
    """
    acc = F.lit(account)
    base = messages.select("msg_table", "conv_type", "conv_id").where("msg_table is not null").groupBy("msg_table").agg(F.min("conv_type").alias("conv_type"), F.min("conv_id").alias("conv_id"))
    j = base.join(stored.withColumnsRenamed({"kind": "conv_type", "id": "conv_id"}), ["conv_type", "conv_id"], "left").join(first_sender_names(messages, account, 32 if full else 8), "msg_table", "left")
    j = j.join(group_renames(messages), "msg_table", "left") if full else j.withColumn("renamed", F.lit(None).cast("string"))
    ident = F.col("conv_id")
    renamed, kept = usable_name(F.col("renamed"), ident, acc), usable_name(F.col("stored"), ident, acc)
    person = ~F.col("conv_type").isin("group", "discuss", "system") & F.col("sender_label").isNotNull()
    word = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FALLBACK.items() for x in kv]), F.col("conv_type")), F.col("conv_type"))
    steps = [(renamed, F.col("renamed"), "system_rename"), (kept, F.col("stored"), "infostorage")]
    if not prefer_rename:
        steps.reverse()
    label = F.when(F.col("conv_type") == "system", F.concat(F.lit("系统 "), ident))
    source = F.when(F.col("conv_type") == "system", "fallback")
    for test, value, name in [*steps, (person, F.col("sender_label"), "message_info_sender")]:
        label, source = label.when(test, value), source.when(test, name)
    return j.select("msg_table", "conv_type", "conv_id", label.otherwise(F.concat(word, F.lit(" "), ident)).alias("label"), source.otherwise("fallback").alias("label_source"))


def conversation_list(times: DataFrame, labelled: DataFrame, *, conv_type: str = "", needle: str = "") -> DataFrame:
    """All conversations that pass the filters, with times and labels; the newest come first in ``place``."""
    c = times.join(labelled, "msg_table")
    if conv_type:
        c = c.where(F.col("conv_type") == conv_type)
    if needle:
        hay = F.lower(F.concat_ws(" ", "msg_table", F.concat_ws(":", "conv_type", "conv_id"), "conv_id", "label"))
        c = c.where(F.contains(hay, F.lit(needle.lower())))
    return c


def conversation_page(conversations: DataFrame, *, offset: int = 0, limit: int = 80) -> DataFrame:
    """A page of the list, newest first, then by table; at most 200 rows."""
    return conversations.orderBy(F.desc("last_time"), "msg_table").offset(max(0, offset)).limit(min(limit, 200))


def conversation_batch(conversations: DataFrame, tables: list[str]) -> DataFrame:
    """The conversations of at most 40 given tables; unknown ones give nothing."""
    return conversations.where(F.col("msg_table").isin([t.strip() for t in tables if t.strip()][:40]))
