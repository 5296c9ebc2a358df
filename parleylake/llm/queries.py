"""Queries of the text problems, with their SQL where SQL can express them."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parleylake.llm import conversations, leakage, mixing, mojibake, pii, splitting
from parleylake.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def _turns(spark: SparkSession, d: str, carry: list[str] | None = None) -> DataFrame:
    return conversations.reassemble(table(spark, d, "messages"), table(spark, d, "own_accounts"), table(spark, d, "quote_refs"), carry=carry)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = pii.find_personal(table(spark, d, "messages").where("msg_table is not null and rowid is not null"), ["msg_table", "rowid"], ["text", "display_text"])
    return found.select("msg_table", "rowid", "field", "pii_kind").distinct()


def p3_masked(spark: SparkSession, d: str) -> DataFrame:
    """Both texts of all messages with typed placeholders that hold collision-checked surrogates.

    The key is the setting ``parleylake.mask.key`` of the session; without it a key is drawn for this run and forgotten.
    """
    key = spark.conf.get("parleylake.mask.key", None) or secrets.token_hex(32)
    return pii.mask_personal(table(spark, d, "messages"), ["text", "display_text"], key=key.encode()).select("msg_table", "rowid", "ingested_at", "text_masked", "display_text_masked")


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    strings = mojibake.chat_strings(table(spark, d, "td_records"), table(spark, d, "tx_fields"))
    return mojibake.repair_garbled(strings, keys=["src_table", "row_key", "text_pos"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("src_table", "row_key", "text_pos").distinct()


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled strings with their likeliest original."""
    return _garbled(spark, d)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.judged(_turns(spark, d)).where("state <> 'whole'").select("msg_table")


def p5_turns(spark: SparkSession, d: str) -> DataFrame:
    """Ordered turns of the conversations kept."""
    return conversations.kept_turns(_turns(spark, d, ["text"])).select("msg_table", "turn", "rowid", "parent_rowid", "root_rowid", "depth", "link", "role", F.col("t").alias("msg_time"), "text")


def p5_threads(spark: SparkSession, d: str) -> DataFrame:
    """Reply threads along quotes, with orphans and cycles."""
    return conversations.reply_threads(table(spark, d, "messages"), table(spark, d, "quote_refs"))


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """Reply threads as paths from their first message to each last reply."""
    return conversations.thread_paths(table(spark, d, "messages"), table(spark, d, "quote_refs"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked item the number of documents and the longest passage."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.max("span").alias("longest"), F.max("item_size").alias("item_size"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents without those that leak."""
    return leakage.without_leaks(table(spark, d, "documents"), _leaks(spark, d)).select("doc_id", "source", "text")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets")).select("doc_id", "source", "copy_no", "text")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "documents")).where("piece_no = 0").select("doc_id")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p3_found, p3_masked, p4_found, p4_restored, p5_found, p5_turns, p5_threads, p5_paths, p8_found, p8_report, p8_clean, p9_mix, p9_report, p10_found, p10_pieces)}

_ROWS = r"""with m as (
 select msg_table, rowid, arg_min(struct_pack(msg_time := msg_time, sender := nullif(regexp_replace(sender_uin, '[\s\p{Z}\p{Cc}\p{Cf}]', '', 'g'), ''), is_self := is_self, text := text, ingested_at := ingested_at), ingested_at) as s
 from messages group by msg_table, rowid),
r as (
 select msg_table, rowid, s.text as text, coalesce(length(regexp_replace(s.text, '[\s\p{Z}\p{Cc}\p{Cf}]', '', 'g')) = 0, true) as blank, s.sender is not null as known,
  case when s.msg_time >= 946684800 and s.msg_time <= epoch(s.ingested_at) + 172800 then s.msg_time end as t,
  case when a.account_kind = 'system' then 'system' when coalesce(s.is_self, false) or coalesce(a.account_kind = 'self', false) then 'own' else 'other' end as role
 from m left join own_accounts a on a.uin = try_cast(s.sender as bigint)),
j as (
 select msg_table, case when 2 * count_if(t is null or not known) >= count(*) then 'broken'
  when count_if(not blank and role <> 'system') = 0 then 'empty'
  when count_if(not blank and role = 'own') = 0 or count_if(not blank and role = 'other') = 0 then 'no_reply' else 'whole' end as state from r group by msg_table),
o as (select *, row_number() over w - 1 as turn, lag(rowid) over w as before, first_value(rowid) over w as root_rowid from r where msg_table is not null and rowid is not null window w as (partition by msg_table order by t is null, t, rowid)),
q as (select q.msg_table, q.rowid, min(m.rowid) as quoted from (select msg_table, msg_rowid as rowid, min(seq) as seq from quote_refs where seq is not null and msg_table is not null and msg_rowid is not null group by 1, 2) q
 left join messages m on m.msg_table = q.msg_table and m.msg_seq = q.seq group by 1, 2),
e as (select o.*, q.rowid is not null as quotes, q.quoted, coalesce(q.quoted, o.before) as parent from o left join q on q.msg_table = o.msg_table and q.rowid = o.rowid)
"""

_POINTERS = """, w as (select msg_table, rowid, parent as place from e union select w.msg_table, w.rowid, e.parent from w join e on e.msg_table = w.msg_table and e.rowid = w.place),
around as (select msg_table, rowid from w group by 1, 2 having not bool_or(place is null)),
f as (select e.*, case when a.rowid is not null then e.before else e.parent end as parent_rowid, case when e.quotes and e.quoted is null then 'orphan' when a.rowid is not null and e.quoted is not null then 'cycle' when e.quoted is not null then 'quote' when e.before is null then 'root' else 'next' end as link
 from e left join around a on a.msg_table = e.msg_table and a.rowid = e.rowid),
s as (select msg_table, rowid, parent_rowid as place, 0 as n from f union all select s.msg_table, s.rowid, f.parent_rowid, s.n + 1 from s join f on f.msg_table = s.msg_table and f.rowid = s.place),
depths as (select msg_table, rowid, max(n) as depth from s group by 1, 2)
"""

SQL: dict[str, str] = {
    "p5_found": _ROWS + "select msg_table from j where state <> 'whole'",
    "p5_turns": _ROWS.replace("with m as", "with recursive m as", 1) + _POINTERS + "select f.msg_table, turn, f.rowid, f.parent_rowid, root_rowid, depth, link, role, t as msg_time, text from f join j on j.msg_table = f.msg_table join depths d on d.msg_table = f.msg_table and d.rowid = f.rowid where j.state = 'whole' and not blank",
}

_THREADS = """with recursive m as (select msg_table, rowid as msg_rowid, min(msg_seq) as msg_seq from messages where msg_table is not null and msg_seq is not null and rowid is not null group by 1, 2),
q as (select q.msg_table, m.msg_seq, q.seq from (select msg_table, msg_rowid, min(seq) as seq from quote_refs where seq is not null group by 1, 2) q join m on m.msg_table = q.msg_table and m.msg_rowid = q.msg_rowid),
e as (select msg_table || ':' || msg_seq as id, min(msg_table || ':' || seq) as parent from q group by 1),
n as (select * from e union all select distinct m.msg_table || ':' || m.msg_seq, cast(null as varchar) from m where (m.msg_table || ':' || m.msg_seq) in (select parent from e union select msg_table || ':' || seq from q) and (m.msg_table || ':' || m.msg_seq) not in (select id from e)),
c as (select count(*) as k from n),
w as (select id, id as place, 0 as depth from n union all select w.id, n.parent, w.depth + 1 from w join n on n.id = w.place join n p on p.id = n.parent where w.depth <= (select k from c)),
f as (select id, max(depth) as depth, arg_max(place, depth) as place from w group by 1)
"""
SQL["p5_threads"] = _THREADS + """select regexp_replace(f.id, ':-?[0-9]+$', '') as msg_table, cast(regexp_extract(f.id, ':(-?[0-9]+)$', 1) as bigint) as msg_seq, case when f.depth <= (select k from c) then cast(regexp_extract(f.place, ':(-?[0-9]+)$', 1) as bigint) end as root_seq,
 case when f.depth <= (select k from c) then f.depth end as depth, case when f.depth > (select k from c) then 'cycle' when n.parent is null then 'rooted' else 'orphan' end as state from f join n on n.id = f.place"""
SQL["p5_paths"] = _THREADS + """select regexp_replace(w.id, ':-?[0-9]+$', '') as msg_table, cast(regexp_extract(w.id, ':(-?[0-9]+)$', 1) as bigint) as leaf_seq, f.depth - w.depth as position, cast(regexp_extract(w.place, ':(-?[0-9]+)$', 1) as bigint) as msg_seq
 from w join f on f.id = w.id where f.depth <= (select k from c) and w.id not in (select parent from n where parent is not null)"""
