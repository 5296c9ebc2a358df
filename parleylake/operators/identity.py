"""Who sent a message: profiles, contacts, names and roles; and which message a quote means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parleylake.functions.text import SYSTEM_SENDERS, first_nonempty, sender_show_name, with_mail_of
from parleylake.operators.nested import member

# Notes on where a group member's name comes from.
NOTE_MEMBER, NOTE_TITLE, NOTE_INFO, NOTE_NONE, SYSTEM_LABEL = "群成员库", "群成员库 · 头衔: ", "消息Info名称", "群成员昵称未命中", "系统消息"


def member_profiles(profiles: DataFrame) -> DataFrame:
    """One row per (group_id, uin): the name and title read last."""
    return profiles.where("group_id is not null and uin is not null").groupBy("group_id", "uin").agg(F.max(F.struct("read_at", F.coalesce("display_name", F.lit("")).alias("display_name"), F.coalesce("title", F.lit("")).alias("title"))).alias("s")).select("group_id", "uin", "s.display_name", "s.title")


def contact_profiles(kv: DataFrame, streams: list[str]) -> DataFrame:
    """Contacts merged from prioritised streams: of each attribute the first stream's non-empty value counts.

    Attributes are nick, remark, signature and city; within a stream the value read last wins, then the highest index.
    """
    names = {"strnick": "nick", "strremark": "remark", "strsignature": "signature", "strcity": "city"}
    prio = F.array_position(F.array(*[F.lit(s) for s in streams]), F.col("stream")).cast("int")
    attr = F.try_element_at(F.create_map(*[F.lit(x) for kv_ in names.items() for x in kv_]), F.lower(F.trim("field_name")))
    rows = kv.where(F.col("stream").isin(streams)).select("entry_key", prio.alias("p"), attr.alias("a"), F.trim(F.try_element_at("texts", F.lit(1))).alias("v"), "read_at", "field_index").where("a is not null and v <> ''")
    best = F.struct((-F.col("p")).alias("p"), F.col("read_at"), F.col("field_index"), F.col("v"))
    return rows.groupBy("entry_key").agg(*[F.coalesce(F.max(F.when(F.col("a") == a, best)).getField("v"), F.lit("")).alias(a) for a in names.values()])


def merged_contacts(profiles: DataFrame, contacts: DataFrame, *, insert_only: bool = False) -> DataFrame:
    """Profiles filled up from the contact table: missing contacts are added, and empty attributes filled unless ``insert_only``."""
    other = contacts.where("uin is not null").groupBy(F.col("uin").cast("string").alias("entry_key")).agg(F.max(F.coalesce("nick", F.lit(""))).alias("nick2"), F.max(F.coalesce("remark", F.lit(""))).alias("remark2"))
    j = profiles.select("entry_key", "nick", "remark", F.lit(True).alias("had")).join(other, "entry_key", "full")
    fill = lambda a, b: F.when(F.col("had") & F.lit(insert_only), F.col(a)).otherwise(first_nonempty(F.col(a), F.col(b)))
    return j.select("entry_key", fill("nick", "nick2").alias("nick"), fill("remark", "remark2").alias("remark"), F.coalesce("had", F.lit(False)).alias("from_profile"))


def sender_identity(messages: DataFrame, members: DataFrame, contacts: DataFrame, account: str) -> DataFrame:
    """Each message with its sender's name, line, role, source of the name and note.

    Group messages look up the member profile by (conv_id, sender), all others none; profiles and contacts have one row
    per key, so no message is multiplied. A key with very many messages is split by adaptive execution.
    """
    m = messages.select("msg_table", "rowid", "ingested_at", "conv_type", "conv_id", F.coalesce(F.regexp_replace(F.trim("sender_uin"), "^0+(?=.)", ""), F.lit("")).alias("sender"), F.coalesce("sender_name", F.lit("")).alias("shown"))
    p = members.select(F.lit("group").alias("conv_type"), F.col("group_id").alias("conv_id"), F.col("uin").alias("sender"), "display_name", "title")
    c = contacts.select(F.col("entry_key").alias("sender"), F.col("nick").alias("contact_nick"), F.col("remark").alias("contact_remark"))
    j = m.join(p, ["conv_type", "conv_id", "sender"], "left").join(c, "sender", "left")
    acc = F.lit(account)
    shown = sender_show_name(F.col("shown"), F.col("sender"), acc, F.col("conv_id"))
    j = j.withColumn("name_in_message", F.coalesce(shown, F.lit(""))).withColumn("member", with_mail_of(F.coalesce("display_name", F.lit("")), F.col("name_in_message")))
    j = j.withColumn("system_label", F.when(F.col("sender").isin(SYSTEM_SENDERS), SYSTEM_LABEL).otherwise("")).withColumn("is_own", F.col("sender") == acc)
    display = first_nonempty(F.col("member"), F.col("name_in_message"), F.col("system_label"), F.col("sender"))
    source = F.when(F.col("is_own"), "self").when(F.col("system_label") != "", "system").when(F.col("member") != "", "group_member").when(F.col("name_in_message") != "", "message_info").otherwise("uin")
    note = F.when((F.col("conv_type") == "group") & ~F.col("is_own") & (F.col("system_label") == ""), F.when(F.col("member") != "", F.when(F.coalesce("title", F.lit("")) == "", NOTE_MEMBER).otherwise(F.concat(F.lit(NOTE_TITLE), "title"))).when(F.col("name_in_message") != "", NOTE_INFO).otherwise(NOTE_NONE)).otherwise("")
    line = F.when((display == "") | F.col("is_own") | (F.col("system_label") != ""), display).otherwise(F.concat(display, F.lit("("), "sender", F.lit(")")))
    return j.select("msg_table", "rowid", "ingested_at", "sender", display.alias("display_sender"), line.alias("sender_line"), source.alias("sender_source"), note.alias("sender_note"), F.coalesce("contact_remark", F.lit("")).alias("contact_remark"))


def quote_targets(quotes: DataFrame, messages: DataFrame) -> DataFrame:
    """The message each quote means: same table and time, same sender if there is one, nearest rowid but not itself.

    Two equi-joins replace the search per quote: with the sender, then without for quotes that found none. Candidates
    are reduced by partial aggregation, so a time that very many rows share does not gather anywhere.
    """
    m = messages.where("msg_time is not null").select("msg_table", F.col("msg_time").alias("quote_time"), F.regexp_replace(F.trim("sender_uin"), "^0+(?=.)", "").try_cast("long").alias("who"), F.col("rowid").alias("target")).distinct()
    q = quotes.where("quote_time is not null").select("quote_id", "msg_table", "msg_rowid", "quote_time", F.col("sender_uin").alias("who")).distinct()
    nearest = F.min(F.struct(F.abs(F.col("target") - F.col("msg_rowid")).alias("far"), F.col("target"))).getField("target").alias("target_rowid")
    with_sender = q.join(m, ["msg_table", "quote_time", "who"]).where("target <> msg_rowid").groupBy("quote_id").agg(nearest)
    # only quotes that found none go on, to the rows of a second without regard to who wrote them
    open_ = q.join(with_sender.select("quote_id"), "quote_id", "left_anti").drop("who")
    without = open_.join(m.select("msg_table", "quote_time", "target").distinct(), ["msg_table", "quote_time"]).where("target <> msg_rowid").groupBy("quote_id").agg(nearest)
    return with_sender.withColumn("by_sender", F.lit(True)).unionByName(without.withColumn("by_sender", F.lit(False)))


def quotes_in_order(nodes: DataFrame, quotes: DataFrame) -> DataFrame:
    """The k-th quote node of a message with its k-th quote: (msg_table, msg_rowid, k, node_path, quote_id).

    Nodes come in the order of their paths, by number where a step is one, quotes in the order of their ids. Nodes need
    msg_table, msg_rowid, node_path and members; what has no counterpart is left out. A message has few of either.
    """
    steps = F.transform(F.split("node_path", "/"), lambda x: F.when(x.rlike("^[0-9]+$"), F.lpad(x, 9, "0")).otherwise(x))
    by = Window.partitionBy("msg_table", "msg_rowid")
    n = nodes.where(member("type") == "quote").select("msg_table", "msg_rowid", "node_path", steps.alias("o")).dropDuplicates(["msg_table", "msg_rowid", "node_path"]).withColumn("k", F.row_number().over(by.orderBy("o"))).drop("o")
    q = quotes.select("msg_table", "msg_rowid", "quote_id").distinct().withColumn("k", F.row_number().over(by.orderBy("quote_id")))
    return n.join(q, ["msg_table", "msg_rowid", "k"])
