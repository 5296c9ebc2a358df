"""Queries over conversations, pages, identities, assets and audits, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parleylake.functions import media, text, urls
from parleylake.operators import assets, audit, conversations, identity, items, nested, paging, sampling
from parleylake.runtime import materialise, table

#: Parameters of the queries: the own account, a page's table and the time that counts as now.
ACCOUNT, TABLE, NOW = "1900000017", "group_288000777", 1_602_000_000
STREAMS = ["Contact/QQInfo.db", "Contact/NonRelationQQInfo.db", "Contact/PublicInfo.db", "discuss/remark.db"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_TIMES = f"""select msg_table, max(rowid) as rows_est, coalesce(arg_min(t, k) filter (where ok), max(t) filter (where k = 1)) as last_time, max(t) filter (where k = 1) as raw_last_time,
 coalesce(min(k) filter (where ok) - 1, count(*)) as time_anomaly_count from (
 select msg_table, rowid, t, row_number() over (partition by msg_table order by rowid desc) as k, coalesce(t >= 946684800 and t <= {NOW} + 172800, false) as ok from (
  select msg_table, rowid, max(msg_time) as t from messages group by all) where rowid is not null) where k <= 20 group by msg_table"""


@query(f"select * from ({_TIMES})")
def conversation_last_time(spark: SparkSession, d: str) -> DataFrame:
    return conversations.last_times(table(spark, d, "messages"), NOW)


_USABLE = "(length(trim({0})) > 0 and trim({0}) <> {1} and trim({0}) <> '" + ACCOUNT + "' and not regexp_matches(trim({0}), '^[0-9]*$') and not regexp_matches(trim({0}), '^\\([0-9]*\\)$'))"
_SHOWN = f"""case when {_USABLE.format('v', 'conv_id')} then v else '' end"""
_CUT = "case when ends_with(trim(sender_name), '(' || sender || ')') then trim(left(trim(sender_name), length(trim(sender_name)) - length(sender) - 2)) else trim(sender_name) end"
_LABEL_SQL = f"""with b as (select msg_table, min(conv_type) as conv_type, min(conv_id) as conv_id from messages group by 1),
r as (select msg_table, first(label order by side, k, label) as renamed from (
  select *, trim(regexp_extract(text, '修改了群名称为[“"]([^”"]*)', 1)) as label from (
   select msg_table, sender_uin, text, 0 as side, dense_rank() over (partition by msg_table order by rowid) as k from messages where conv_type = 'group' union all
   select msg_table, sender_uin, text, 1, dense_rank() over (partition by msg_table order by rowid desc) from messages where conv_type = 'group') where k <= 256 and trim(sender_uin) in ('0', '10000', '1000000')) where length(label) between 1 and 80 group by 1),
s as (select case when contains(lower(stream), 'discuss') then 'discuss' else 'group' end as conv_type, entry_key as conv_id, last(trim(texts[1]) order by field_name = 'strGroupName', read_at nulls first, field_index nulls first, trim(texts[1])) as stored
  from kv_fields where regexp_matches(lower(stream), 'group|discuss') and field_name in ('strGroupName', 'strRemark') and len(texts) > 0 and length(trim(texts[1])) > 0 group by 1, 2
 union all select 'buddy', cast(uin as varchar), max(coalesce(nullif(trim(remark), ''), nullif(trim(nick), ''))) from contacts where uin is not null group by 2),
n as (select msg_table, first(x order by k, x) as x from (select *, {_SHOWN} as x from (select *, {_CUT} as v from (
  select msg_table, conv_id, trim(sender_uin) as sender, sender_name, dense_rank() over (partition by msg_table order by rowid) as k from messages) where k <= 32)) where x <> '' and sender <> '{ACCOUNT}' group by 1),
l as (select b.*, case when b.conv_type = 'system' then '系统 ' || b.conv_id when {_USABLE.format('renamed', 'b.conv_id')} then renamed when {_USABLE.format('stored', 'b.conv_id')} then stored when b.conv_type = 'buddy' and n.x is not null then n.x
   else case b.conv_type when 'buddy' then '私聊' when 'group' then '群聊' when 'discuss' then '讨论组' else b.conv_type end || ' ' || b.conv_id end as label,
  case when b.conv_type = 'system' then 'fallback' when {_USABLE.format('renamed', 'b.conv_id')} then 'system_rename' when {_USABLE.format('stored', 'b.conv_id')} then 'infostorage' when b.conv_type = 'buddy' and n.x is not null then 'message_info_sender' else 'fallback' end as label_source
 from b left join r using (msg_table) left join s on s.conv_type = b.conv_type and s.conv_id = b.conv_id left join n using (msg_table))
"""


def _labels(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages")
    return conversations.labels(m, conversations.stored_labels(table(spark, d, "kv_fields"), table(spark, d, "contacts")), ACCOUNT)


@query(_LABEL_SQL + "select * from l")
def label_ladder(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d)


@query(_LABEL_SQL + f", t as ({_TIMES}) select * from t join l using (msg_table)")
def conversation_list(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversation_list(conversations.last_times(table(spark, d, "messages"), NOW), _labels(spark, d))


@query(_LABEL_SQL + f", t as ({_TIMES}) select * from t join l using (msg_table) where conv_type = 'group' and contains(lower(concat_ws(' ', msg_table, conv_type || ':' || conv_id, conv_id, label)), '群') order by last_time desc, msg_table limit 80")
def conversation_page(spark: SparkSession, d: str) -> DataFrame:
    times = conversations.last_times(table(spark, d, "messages"), NOW)
    return conversations.conversation_page(conversations.conversation_list(times, _labels(spark, d), conv_type="group", needle="群"))


@query(_LABEL_SQL + f", t as ({_TIMES}) select * from t join l using (msg_table) where msg_table in ('{TABLE}', 'buddy_2000000005')")
def conversation_batch(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversation_batch(conversation_list(spark, d), [TABLE, "buddy_2000000005", "none_1", ""])


_PAGE = "msg_table, rowid, msg_time, sender_uin, text, ingested_at"


@query(f"select {_PAGE} from messages where msg_table = '{TABLE}' and rowid >= 40 order by rowid, ingested_at limit 20")
def page_forward(spark: SparkSession, d: str) -> DataFrame:
    return paging.page_forward(table(spark, d, "messages").selectExpr(*_PAGE.split(", ")), TABLE, 40)


@query(f"select * from (select {_PAGE} from messages where msg_table = '{TABLE}' and rowid < 90 order by rowid desc, ingested_at desc limit 20) order by rowid")
def page_before(spark: SparkSession, d: str) -> DataFrame:
    return paging.page_before(table(spark, d, "messages").selectExpr(*_PAGE.split(", ")), TABLE, 90)


@query(f"""with p as (select rowid from messages where msg_table = '{TABLE}' and rowid >= 40 order by rowid, ingested_at limit 20), t as ({_TIMES})
 select min(rowid) as first_rowid, max(rowid) as last_rowid, count(*) as items, (select rows_est from t where msg_table = '{TABLE}') as total, min(rowid) as prev_offset, max(rowid) + 1 as next_offset, true as has_prev, 60 < (select rows_est from t where msg_table = '{TABLE}') as has_next from p""")
def page_envelope(spark: SparkSession, d: str) -> DataFrame:
    return paging.page_envelope(page_forward(spark, d), conversation_last_time(spark, d).where(F.col("msg_table") == TABLE), 40, 20)


@query(f"select distinct trim(sender_uin) as sender from (select sender_uin from messages where msg_table = '{TABLE}' and rowid >= 40 order by rowid, ingested_at limit 20) where trim(sender_uin) <> ''")
def page_senders(spark: SparkSession, d: str) -> DataFrame:
    return paging.page_senders(page_forward(spark, d))


@query(f"select {_PAGE} from messages where msg_table = '{TABLE}' and rowid = 42")
def row_detail(spark: SparkSession, d: str) -> DataFrame:
    return paging.row_detail(table(spark, d, "messages"), TABLE, 42).selectExpr(*_PAGE.split(", "))


@query("select sample_id, lower(substring(msgcontent_hex, 9, 16)) as window_hex from sample_rows")
def byte_window(spark: SparkSession, d: str) -> DataFrame:
    return paging.byte_window(table(spark, d, "sample_rows"), "msgcontent_hex", 4, 8).select("sample_id", "window_hex")


@query("select msg_table, count(*) as n, count(distinct rowid) as rowids, coalesce(max(rowid), 0) as max_rowid from messages group by 1")
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").groupBy("msg_table").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rowid").alias("rowids"), F.coalesce(F.max("rowid"), F.lit(0)).alias("max_rowid"))


_KEYS = "k as (select distinct msg_table, rowid from messages where msg_table is not null and rowid is not null), w as (select *, row_number() over (partition by msg_table order by rowid) as f, row_number() over (partition by msg_table order by rowid desc) as l, max(rowid) over (partition by msg_table) as m, count(*) over (partition by msg_table) as n from k)"


@query(f"with {_KEYS} select msg_table, rowid from w where f <= 6")
def first_rows(spark: SparkSession, d: str) -> DataFrame:
    return sampling.first_rows(table(spark, d, "messages"), 6)


@query(f"with {_KEYS} select msg_table, rowid from w where f <= 3 order by msg_table, rowid limit 100")
def capped_rows(spark: SparkSession, d: str) -> DataFrame:
    return sampling.capped_rows(table(spark, d, "messages"), 3, 100)


@query(f"with {_KEYS} select msg_table, rowid from w where f <= 6 or l <= 6")
def edge_rows(spark: SparkSession, d: str) -> DataFrame:
    return sampling.edge_rows(table(spark, d, "messages"), 6)


@query(f"""with {_KEYS}, t as (select distinct msg_table, 1 + ((m - 1) * i) // 12 as target from w, range(12) r(i) where m > 0),
 p as (select t.msg_table, min(k.rowid) as rowid from t join k on k.msg_table = t.msg_table and k.rowid >= t.target group by t.msg_table, t.target)
 select msg_table, rowid from w where f <= 6 or l <= 6 or rowid = m or n <= 24 union select msg_table, rowid from p""")
def point_probe_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.probe_sample(table(spark, d, "messages"))


@query(r"""with m as (select distinct msg_table, msg_time, try_cast(regexp_replace(trim(sender_uin), '^0+(.)', '\1') as bigint) as who, rowid from messages where msg_time is not null),
 c as (select q.quote_id, m.rowid as target, coalesce(m.who = q.sender_uin, false) as same, abs(m.rowid - q.msg_rowid) as far from (select distinct quote_id, msg_table, msg_rowid, quote_time, sender_uin from quote_refs) q
  join m on m.msg_table = q.msg_table and m.msg_time = q.quote_time and m.rowid <> q.msg_rowid)
 select quote_id, target as target_rowid, same as by_sender from c qualify row_number() over (partition by quote_id order by not same, far, target) = 1""")
def quote_nearest(spark: SparkSession, d: str) -> DataFrame:
    return identity.quote_targets(table(spark, d, "quote_refs"), table(spark, d, "messages"))


_CONTACTS = f"""f as (select entry_key, list_position([{', '.join(repr(s) for s in STREAMS)}], stream) as p, lower(trim(field_name)) as a, trim(texts[1]) as v, read_at, field_index from kv_fields where stream in ({', '.join(repr(s) for s in STREAMS)}) and len(texts) > 0 and trim(texts[1]) <> ''),
 c as (select entry_key, """ + ", ".join(f"coalesce(last(v order by -p, read_at nulls first, field_index nulls first, v) filter (where a = 'str{a}'), '') as {a}" for a in ("nick", "remark", "signature", "city")) + " from f where a in ('strnick', 'strremark', 'strsignature', 'strcity') group by 1)"


@query(f"with {_CONTACTS} select * from c")
def profile_merge(spark: SparkSession, d: str) -> DataFrame:
    return identity.contact_profiles(table(spark, d, "kv_fields"), STREAMS)


@query(f"""with {_CONTACTS}, o as (select cast(uin as varchar) as entry_key, max(coalesce(nick, '')) as nick, max(coalesce(remark, '')) as remark from contacts where uin is not null group by 1)
 select coalesce(c.entry_key, o.entry_key) as entry_key, coalesce(nullif(c.nick, ''), nullif(o.nick, ''), '') as nick, coalesce(nullif(c.remark, ''), nullif(o.remark, ''), '') as remark, c.entry_key is not null as from_profile from c full join o on o.entry_key = c.entry_key""")
def social_full_merge(spark: SparkSession, d: str) -> DataFrame:
    return identity.merged_contacts(profile_merge(spark, d), table(spark, d, "contacts"))


_ID = f"""with {_CONTACTS}, p as (select group_id, uin, last(coalesce(display_name, '') order by read_at nulls first, coalesce(display_name, ''), coalesce(title, '')) as display_name, last(coalesce(title, '') order by read_at nulls first, coalesce(display_name, ''), coalesce(title, '')) as title from member_profiles where group_id is not null and uin is not null group by all),
 m as (select msg_table, rowid, ingested_at, conv_type, conv_id, coalesce(regexp_replace(trim(sender_uin), '^0+(.)', '\\1'), '') as sender, coalesce(sender_name, '') as sender_name from messages),
 v as (select *, {_CUT} as v from m), x as (select *, {_SHOWN} as name_in_message from v),
 j as (select x.*, coalesce(p.display_name, '') as member0, coalesce(p.title, '') as title, coalesce(c.remark, '') as contact_remark, sender = '{ACCOUNT}' as is_own, case when sender in ('0', '10000', '1000000') then '系统消息' else '' end as system_label
  from x left join p on x.conv_type = 'group' and p.group_id = x.conv_id and p.uin = x.sender left join c on c.entry_key = x.sender),
 k as (select *, case when member0 = '' then '' when contains(regexp_extract(name_in_message, '(<[^>]*>)', 1), '@') and not contains(member0, regexp_extract(name_in_message, '(<[^>]*>)', 1)) then member0 || regexp_extract(name_in_message, '(<[^>]*>)', 1) else member0 end as member from j),
 z as (select *, coalesce(nullif(member, ''), nullif(name_in_message, ''), nullif(system_label, ''), nullif(sender, ''), '') as display_sender from k)
"""


@query(_ID + """select msg_table, rowid, ingested_at, sender, display_sender, case when display_sender = '' or is_own or system_label <> '' then display_sender else display_sender || '(' || sender || ')' end as sender_line,
 case when is_own then 'self' when system_label <> '' then 'system' when member <> '' then 'group_member' when name_in_message <> '' then 'message_info' else 'uin' end as sender_source,
 case when conv_type = 'group' and not is_own and system_label = '' then case when member <> '' then case when title = '' then '群成员库' else '群成员库 · 头衔: ' || title end when name_in_message <> '' then '消息Info名称' else '群成员昵称未命中' end else '' end as sender_note, contact_remark from z""")
def sender_identity(spark: SparkSession, d: str) -> DataFrame:
    return identity.sender_identity(table(spark, d, "messages"), identity.member_profiles(table(spark, d, "member_profiles")), profile_merge(spark, d), ACCOUNT)


_KEY = r"lower(trim(regexp_replace({}, '[\\/]+', '/', 'g')))"
_NAME = r"regexp_extract(replace({}, '\', '/'), '([^/:]*)$', 1)"
_TMB = r"regexp_replace({0}, '^(.*[^.])(\.[^.]*)$', '\1_tmb\2') || case when regexp_matches({0}, '[^.]\.[^.]*$') then '' else '_tmb' end"
_ASSET = f"""r as (select distinct match_id, pos - 1 as pos, reference from (select match_id, unnest(candidate_paths) as reference, generate_subscripts(candidate_paths, 1) as pos from asset_matches) where trim(reference) <> ''),
 l as (select distinct path, lower({_NAME.format('path')}) as name_key, {_KEY.format('path')} as path_key from asset_files where not coalesce(is_deleted, false)),
 n as (select distinct reference, {_NAME.format('reference')} as n from r),
 w as (select reference, lower(n) as name from n union select reference, lower({_TMB.format('n')}) from n),
 h as (select w.reference, w.name, l.path, count(*) over (partition by w.reference, w.name) > 1 as ambiguous from w join l on l.name_key = w.name)"""


def _refs(spark: SparkSession, d: str) -> DataFrame:
    return assets.references(table(spark, d, "asset_matches"))


@query(f"with {_ASSET} select * from h")
def basename_match(spark: SparkSession, d: str) -> DataFrame:
    return assets.basename_matches(_refs(spark, d), table(spark, d, "asset_files"))


@query(f"with {_ASSET} select (select count(distinct name) from w) as wanted_names, (select count(distinct name) from h) as hit_names, (select count(distinct name) from h where not ambiguous) as unique_hit_names, (select count(distinct name) from h where ambiguous) as ambiguous_hit_names, (select count(distinct reference) from h where not ambiguous) as mapped_references")
def basename_summary(spark: SparkSession, d: str) -> DataFrame:
    return assets.basename_summary(_refs(spark, d), table(spark, d, "asset_files"))


@query(f"""with {_ASSET}, t as (select reference, 0 as i, 'basename_exact' as rule, lower(n) as k from n union all select reference, 1, 'basename_tmb', lower({_TMB.format('n')}) from n),
 f as (select reference, min(i) as i from t where k in (select name_key from l) group by 1) select t.rule, count(*) as references, array_to_string(list(t.reference order by t.reference)[1:10], '|') as examples from f join t on t.reference = f.reference and t.i = f.i group by 1""")
def candidate_rules(spark: SparkSession, d: str) -> DataFrame:
    return assets.rule_hits(_refs(spark, d), table(spark, d, "asset_files")).withColumn("examples", F.array_join("examples", "|"))


@query(f"""with {_ASSET} select lower(regexp_replace(name_key, '\\.[^.]*$', '')) as stem, path from l where lower(regexp_replace(name_key, '\\.[^.]*$', '')) in (select lower(regexp_replace(n, '\\.[^.]*$', '')) from n where regexp_matches(lower(regexp_replace(n, '\\.[^.]*$', '')), '^([0-9a-f]{{16}}|[0-9a-f]{{32}})$'))""")
def digest_hits(spark: SparkSession, d: str) -> DataFrame:
    return assets.digest_hits(_refs(spark, d), table(spark, d, "asset_files"))


@query(f"with {_ASSET} select match_id, min(l.path) as path, r.pos from r join l on l.path_key = {_KEY.format('r.reference')} group by match_id, r.pos qualify row_number() over (partition by match_id order by r.pos, min(l.path)) = 1")
def asset_first_hit(spark: SparkSession, d: str) -> DataFrame:
    return assets.first_present(_refs(spark, d), table(spark, d, "asset_files"))


@query(f"with {_ASSET} select match_id, first(reference order by pos, reference) as reference from r group by 1 having not bool_or({_KEY.format('reference')} in (select path_key from l))")
def unresolved_first(spark: SparkSession, d: str) -> DataFrame:
    return assets.unresolved(_refs(spark, d), table(spark, d, "asset_files"))


_NEEDLES = ["backup", "截图", "report.docx", "快递"]


@query("select msg_table, rowid, ingested_at, array_to_string(hits, '|') as hits from (select *, list_filter(['backup', 'report.docx', '快递', '截图'], lambda n: contains(lower(text), n)) as hits from messages) where len(hits) > 0")
def token_contains(spark: SparkSession, d: str) -> DataFrame:
    return assets.contains_any(table(spark, d, "messages"), _NEEDLES).select("msg_table", "rowid", "ingested_at", F.array_join("hits", "|").alias("hits"))


_EXT = "jpg|jpeg|png|gif|webp|bmp|mp4|webm|mov|avi|amr|slk|mp3|wav|ogg|m4a|pdf|zip|rar|7z|doc|docx|xls|xlsx|ppt|pptx|txt"
_KIND = "case when regexp_matches(lower({0}), '\\.(mp4|webm|mov|avi)$') then 'video' when regexp_matches(lower({0}), '\\.(amr|slk|mp3|wav|ogg|m4a)$') then 'voice' when regexp_matches(lower({0}), '\\.(jpg|jpeg|png|gif|webp|bmp)$') then 'image' when regexp_matches(lower({0}), '\\.(pdf|zip|rar|7z|doc|docx|xls|xlsx|ppt|pptx|txt)$') then 'file' end"


@query(f"with k as (select match_id, list_transform(coalesce(candidate_paths, []), lambda x: {_KIND.format('x')}) as k from (select distinct match_id, candidate_paths from asset_matches)) select match_id, case when list_contains(k, 'voice') then 'voice' when list_contains(k, 'video') then 'video' when list_contains(k, 'image') then 'image' when list_contains(k, 'file') then 'file' end as kind from k")
def media_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "asset_matches").select("match_id", "candidate_paths").distinct().select("match_id", media.media_kind(F.col("candidate_paths")).alias("kind"))


@query(f"""with k as (select distinct match_id, media_kind, list_transform(list_filter(candidate_paths, lambda x: trim(x) <> ''), lambda x: {_KIND.format('x')}) as k from asset_matches where media_kind in ('image', 'video', 'voice', 'file')),
 e as (select *, case when list_contains(k, 'video') then 'video' when list_contains(k, 'voice') then 'voice' when list_contains(k, 'image') then 'image' when list_contains(k, 'file') then 'file' end as e from k)
 select distinct match_id, case when coalesce(len(k), 0) = 0 then 'missing_candidates:' || media_kind else 'type_mismatch:' || media_kind || '->' || e end as issue from e where coalesce(len(k), 0) = 0 or e <> media_kind""")
def media_issues(spark: SparkSession, d: str) -> DataFrame:
    return audit.media_issues(table(spark, d, "asset_matches"))


_BLANK = r"coalesce(regexp_replace(text, '[\s\p{Z}\p{Cc}\p{Cf}]', '', 'g') = '', true)"
_SUSPICIOUS = "(case when contains(text, chr(65533)) then true else len(regexp_extract_all(text, '[\\x{E000}-\\x{F8FE}\\x{1200}-\\x{137F}\\x{2C80}-\\x{2CFF}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')) >= 2 and len(regexp_extract_all(text, '[\\x{E000}-\\x{F8FE}\\x{1200}-\\x{137F}\\x{2C80}-\\x{2CFF}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')) * 100 // nullif(length(text), 0) > 12 end)"
_PIECE = f"(not regexp_matches(trim(x), '^\\{{|^com\\.|[“”]|文件|成功|取消') and trim(x) <> '' and (regexp_matches(trim(x), '^(UserDataImage|UserDataCustomFace|UserDataRoot|UserDataFileRecv|OSRoot|sysres):') or regexp_matches(trim(x), '(?i)^https?://[^?#]*\\.({_EXT})([?#].*)?$') or (regexp_matches(trim(x), '[\\\\/]|^[\\x20-\\x7e]*$') and regexp_matches(trim(x), '(?i)\\.({_EXT})$'))))"
_ISSUES = f"""i as (select msg_table, rowid, unnest(list_filter([
 case when {_BLANK} and media_kind is null then 'empty_text_and_nodes' end, case when {_BLANK} and media_kind is not null then 'blank_text_message' end, case when {_SUSPICIOUS} then 'suspicious_text' end,
 case when msg_time is null or msg_time < 946684800 then 'implausible_time' end, case when coalesce(trim(sender_uin) = '', true) then 'no_sender' end, case when is_recalled then 'recalled' end,
 case when media_kind is null and len(list_filter(regexp_split_to_array(text, '[\\s，。；！]+'), lambda x: {_PIECE})) > 0 then 'unrendered_media_candidate' end], lambda y: y is not null)) as issue from messages)"""


@query(f"with {_ISSUES} select msg_table, issue, count(*) as n, cast(grouping(msg_table, issue) as integer) as level from i group by rollup(msg_table, issue)")
def issue_rollup(spark: SparkSession, d: str) -> DataFrame:
    return audit.issue_rollup(audit.row_issues(table(spark, d, "messages")))


@query(f"with {_ISSUES} select msg_table, rowid, array_to_string(list_sort(list(distinct issue)), ',') as issues from i group by 1, 2 order by msg_table, rowid limit 64")
def issue_samples(spark: SparkSession, d: str) -> DataFrame:
    return audit.issue_samples(audit.row_issues(table(spark, d, "messages")))


@query(f"""select unnest(['rows', 'blank_text', 'with_media', 'recalled', 'text_differs', 'suspicious_text', 'null_time', 'null_seq', 'null_sender', 'self']) as counter, unnest([count(*), count_if({_BLANK}), count_if(media_kind is not null), count_if(coalesce(is_recalled, false)), count_if(text is distinct from display_text),
 count_if({_SUSPICIOUS}), count_if(msg_time is null), count_if(msg_seq is null), count_if(sender_uin is null), count_if(coalesce(is_self, false))]) as value from messages""")
def quality_counters(spark: SparkSession, d: str) -> DataFrame:
    return audit.quality_counters(table(spark, d, "messages"))


@query("""with recursive u as (select cast(match_id as varchar) as owner_key, rich_nodes as j from asset_matches where json_valid(rich_nodes) group by 1, 2 union all select owner_key, json_extract_string(j, '$') from u where json_type(j) = 'VARCHAR' and json_valid(json_extract_string(j, '$')))
 select json_extract_string(json_tree.value, '$.type') as node_type, count(*) as nodes, count(distinct owner_key) as owners from u, json_tree(cast(j as json)) where json_type(u.j) in ('OBJECT', 'ARRAY') and json_tree.type = 'OBJECT' and json_extract_string(json_tree.value, '$.type') is not null group by 1""")
def media_histogram(spark: SparkSession, d: str) -> DataFrame:
    return audit.node_histogram(nested.flatten_nested(table(spark, d, "asset_matches").select("match_id", "rich_nodes").distinct(), "match_id", "rich_nodes"))


@query("""with e as (select msg_table, rowid, td_offset as s, td_offset + td_len as e from td_records where td_offset >= 0 and td_len > 0),
 g as (select msg_table, rowid, coalesce(max(e) over (partition by msg_table, rowid order by s, e rows between unbounded preceding and 1 preceding), 0) as gap_start, s as gap_end from e) select * from g where gap_end > gap_start""")
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    return audit.coverage_gaps(table(spark, d, "td_records").select("msg_table", "rowid", F.col("td_offset").alias("start"), (F.col("td_offset") + F.col("td_len")).alias("end")), key=["msg_table", "rowid"])


_SENDER = r"regexp_replace(trim(sender_uin), '^0+(.)', '\1')"
_WORDS = r"contains(' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''), ' ') || ' ', ' {} ')"


@query(f"select msg_table, rowid, msg_time, text from messages where {_SENDER} = '2000000005' order by msg_time nulls first, rowid, msg_table, ingested_at limit 30")
def index_account(spark: SparkSession, d: str) -> DataFrame:
    return audit.index_search(table(spark, d, "messages"), account="2000000005").orderBy("msg_time", "rowid", "msg_table", "ingested_at").limit(30).select("msg_table", "rowid", "msg_time", "text")


@query("select msg_table, rowid, msg_time, text from messages where text ilike '%BACKUP%'")
def index_like(spark: SparkSession, d: str) -> DataFrame:
    return audit.index_search(table(spark, d, "messages"), like="%BACKUP%").select("msg_table", "rowid", "msg_time", "text")


@query(f"select msg_table, rowid, msg_time, text from messages where {_WORDS.format('the')} and {_WORDS.format('looks stale')}")
def index_match(spark: SparkSession, d: str) -> DataFrame:
    return audit.index_search(table(spark, d, "messages"), match='the "looks stale"').select("msg_table", "rowid", "msg_time", "text")


@query(f"select msg_table, rowid, ingested_at from messages where {_WORDS.format('the')} and {_WORDS.format('looks stale')}")
def index_words(spark: SparkSession, d: str) -> DataFrame:
    """The same search from an inverted index, which is stored sorted by word so that a lookup skips the rest."""
    key = ["msg_table", "rowid", "ingested_at", "copy"]
    # a row that is there twice counts twice
    numbered = table(spark, d, "messages").withColumn("copy", F.monotonically_increasing_id())
    stored = materialise(audit.word_index(materialise(numbered, "numbered"), key).repartitionByRange("word").sortWithinPartitions("word"), "words")
    return audit.index_lookup(stored, key, 'the "looks stale"').drop("copy")


@query(f"""select 'account' as search, msg_table, rowid, msg_time from messages where {_SENDER} = '2000000005' union all select 'account_like', msg_table, rowid, msg_time from messages where {_SENDER} = '2000000005' and text ilike '%the%'
 union all select 'like', msg_table, rowid, msg_time from messages where text ilike '%the%' union all select 'match', msg_table, rowid, msg_time from messages where {_WORDS.format('backup')}""")
def index_union(spark: SparkSession, d: str) -> DataFrame:
    return audit.search_report(table(spark, d, "messages"), "2000000005", "%the%", "backup")


_V = r"regexp_replace(value_texts[1], '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
_TX = f"select record_id, field_name, field_id, field_index, {_V} as v from tx_fields where field_name is not null and len(value_texts) > 0 and {_V} <> ''"


@query(f"select record_id, field_name as name, last(v order by field_id, field_index) as value from ({_TX}) group by 1, 2")
def info_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return audit.last_values(table(spark, d, "tx_fields").withColumn("v", F.try_element_at("value_texts", F.lit(1))), ["record_id"], "field_name", ["field_id", "field_index"], "v")


@query(f"select record_id, field_name as name, array_to_string(list(v order by field_id, field_index), '|') as values from ({_TX}) group by 1, 2")
def info_all_values(spark: SparkSession, d: str) -> DataFrame:
    return audit.all_values(table(spark, d, "tx_fields").withColumn("v", F.try_element_at("value_texts", F.lit(1))), ["record_id"], "field_name", ["field_id", "field_index"], "v").withColumn("values", F.array_join("values", "|"))


@query("select stream, entry_key, count(*) as hits from kv_fields where lower(field_name) in ('strremark', 'dwlevel') or uint_value in (42, 97) group by 1, 2")
def kv_field_scan(spark: SparkSession, d: str) -> DataFrame:
    return audit.entries_with(table(spark, d, "kv_fields"), ["strRemark", "dwLevel"], [42, 97])


@query("select distinct stream, entry_key from kv_fields where contains(lower(concat_ws(chr(10), field_name, array_to_string(coalesce(texts, []), chr(10)))), 'yuzu') or contains(lower(concat_ws(chr(10), field_name, array_to_string(coalesce(texts, []), chr(10)))), '夜航')")
def kv_needles(spark: SparkSession, d: str) -> DataFrame:
    return audit.entries_containing(table(spark, d, "kv_fields"), ["yuzu", "夜航"])


_ROLE = "array_to_string(list_filter([" + ", ".join(f"case when contains(lower(stream), '{k}') then '{v}' end" for k, v in text.ROLES) + "], lambda x: x is not null), ', ')"


@query(f"select stream, count(*) as rows, count(distinct entry_key) as entries, coalesce(nullif({_ROLE}, ''), 'unknown from name alone') as role from kv_fields group by 1")
def stream_roles(spark: SparkSession, d: str) -> DataFrame:
    return audit.stream_inventory(table(spark, d, "kv_fields"))


@query("select stream, entry_key, max(read_at) as read_at from kv_fields group by 1, 2")
def latest_by_entry(spark: SparkSession, d: str) -> DataFrame:
    return audit.latest_by(table(spark, d, "kv_fields").select("stream", "entry_key", "read_at"), ["stream", "entry_key"], ["read_at"])


@query(f"select path, rtrim(translate(to_base64(encode(path)), '+/', '-_'), '=') as href, lower({_NAME.format('path')}) as name, coalesce(case {' '.join(f'''when lower(regexp_extract(path, '[^.]\\.([^./]*)$', 1)) = '{e}' then '{t}' ''' for e, t in urls.ENDINGS.items())} end, 'application/octet-stream') as kind from asset_files")
def asset_hrefs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "asset_files").select("path", urls.asset_href(F.col("path")).alias("href"), F.lower(urls.file_name(F.col("path"))).alias("name"), urls.media_type(F.lit(None).cast("binary"), urls.file_name(F.col("path"))).alias("kind"))


@query(r"""select msg_table, rowid, ingested_at, regexp_extract(text, '(?i)<?((?:mailto|tel|https?|data):[^\s<>，。]*)', 1) as link from messages where regexp_matches(text, '(?i)(mailto|tel|https?|data):')""")
def text_links(spark: SparkSession, d: str) -> DataFrame:
    pattern = r"(?i)<?((?:mailto|tel|https?|data):[^\s<>，。]*)"
    return table(spark, d, "messages").where(F.col("text").rlike(r"(?i)(mailto|tel|https?|data):")).select("msg_table", "rowid", "ingested_at", F.regexp_extract("text", pattern, 1).alias("link"))


_LINK = r"(?i)<?((?:mailto|tel|https?|data):[^\s<>，。]*)"


@query(rf"select msg_table, rowid, ingested_at, unnest(regexp_extract_all(text, '{_LINK}', 1)) as link from messages")
def all_links(spark: SparkSession, d: str) -> DataFrame:
    """Every link of every message."""
    return table(spark, d, "messages").select("msg_table", "rowid", "ingested_at", F.explode(F.regexp_extract_all("text", F.lit(_LINK), F.lit(1))).alias("link"))


@query("select record_id, pos - 1 as pos, regexp_replace(lower(hex(encode(t))), '(..)', '\\1 ', 'g') as hex from (select record_id, unnest(decoded_texts) as t, generate_subscripts(decoded_texts, 1) as pos from td_records)")
def all_spaced_hex(spark: SparkSession, d: str) -> DataFrame:
    """Every decoded string of every record as hex."""
    t = table(spark, d, "td_records").select("record_id", F.posexplode("decoded_texts").alias("pos", "t"))
    return t.select("record_id", "pos", F.concat(text.spaced_hex(F.encode("t", "UTF-8")), F.when(F.length("t") > 0, " ").otherwise("")).alias("hex"))


@query("select msg_table, rowid, ingested_at, strftime(make_timestamp(msg_time * 1000000), '%Y-%m-%d %H:%M:%S') as shown from messages where msg_time between 0 and 253402300799")
def message_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").where("msg_time between 0 and 253402300799").select("msg_table", "rowid", "ingested_at", text.iso_time(F.col("msg_time")).alias("shown"))


@query("select record_id, regexp_replace(lower(hex(encode(decoded_texts[1]))), '(..)', '\\1 ', 'g') as hex0 from td_records where len(decoded_texts) > 0")
def spaced_hex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "td_records").where(F.size("decoded_texts") > 0).select("record_id", F.concat(text.spaced_hex(F.encode(F.element_at("decoded_texts", 1), "UTF-8")), F.when(F.length(F.element_at("decoded_texts", 1)) > 0, " ").otherwise("")).alias("hex0"))


@query("select group_id, uin, case when f is null then '' else array_to_string(list_transform(['.large.png', '.large.jpg', '.large.jpeg', '.large.webp', '.large'], lambda x: 'acc/VasscUpdate/VasHead/face.' || f || x), '|') end as candidates from (select group_id, uin, last(faceshop_face_id order by read_at nulls first, faceshop_face_id nulls first) as f from member_profiles where group_id is not null and uin is not null group by 1, 2)")
def head_candidates(spark: SparkSession, d: str) -> DataFrame:
    return assets.head_candidates(table(spark, d, "member_profiles"), "acc").withColumn("candidates", F.array_join("candidates", "|"))


_NODE_OF = """with recursive u as (select match_id, msg_table, msg_rowid, rich_nodes as j from asset_matches where json_valid(rich_nodes) union all select match_id, msg_table, msg_rowid, json_extract_string(j, '$') from u where json_type(j) = 'VARCHAR' and json_valid(json_extract_string(j, '$'))),
 n as (select distinct msg_table, msg_rowid, coalesce(nullif(ltrim(replace(regexp_replace(regexp_replace(json_tree.fullkey, '^\\$', ''), '\\[([0-9]+)\\]', '/\\1', 'g'), '.', '/'), '/'), ''), '$') as node_path from u, json_tree(cast(j as json)) where json_type(u.j) in ('OBJECT', 'ARRAY') and json_tree.type = 'OBJECT' and json_extract_string(json_tree.value, '$.type') = 'quote'),
 a as (select *, row_number() over (partition by msg_table, msg_rowid order by list_transform(string_split(node_path, '/'), lambda x: case when regexp_matches(x, '^[0-9]+$') then lpad(x, 9, '0') else x end)) as k from n),
 q as (select *, row_number() over (partition by msg_table, msg_rowid order by quote_id) as k from (select distinct msg_table, msg_rowid, quote_id from quote_refs))"""


@query(_NODE_OF + " select a.msg_table, a.msg_rowid, a.k, a.node_path, q.quote_id from a join q on q.msg_table = a.msg_table and q.msg_rowid = a.msg_rowid and q.k = a.k")
def quote_zip(spark: SparkSession, d: str) -> DataFrame:
    """Quote nodes of asset matches with the quotes of the same message, by position."""
    m = table(spark, d, "asset_matches").select(F.col("match_id").cast("string").alias("owner_key"), "msg_table", "msg_rowid").distinct()
    nodes = nested.flatten_nested(table(spark, d, "asset_matches"), "match_id", "rich_nodes").join(m, "owner_key")
    return identity.quotes_in_order(nodes, table(spark, d, "quote_refs"))


@query("select case when is_deleted then 'deleted' when size_bytes is null then 'unsized' else 'kept' end as status, count(*) as files, coalesce(sum(size_bytes), 0) as bytes from asset_files group by 1")
def file_status(spark: SparkSession, d: str) -> DataFrame:
    """Listed files by status."""
    status = F.when(F.col("is_deleted"), "deleted").when(F.col("size_bytes").isNull(), "unsized").otherwise("kept")
    return table(spark, d, "asset_files").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


@query("select count(*) as total, count_if(kind = 'local') as local, count_if(kind = 'local' and here) as alive, count_if(kind = 'local' and not here) as dead, count_if(kind = 'external') as external, count_if(kind = 'anchor') as anchor from (select case when starts_with(trim(link), '#') or trim(link) = '' then 'anchor' when regexp_matches(link, '(?i)^(https?:|mailto:|javascript:|data:|tel:|ftp:|about:|//)') then 'external' else 'local' end as kind, " + _KEY.format("link") + " in (select " + _KEY.format("path") + " from asset_files where not coalesce(is_deleted, false)) as here from (select unnest(candidate_paths) as link from asset_matches) where link is not null)")
def link_report(spark: SparkSession, d: str) -> DataFrame:
    """The references of asset matches as links: how many are local, and how many of these lead to a present file."""
    from parleylake.functions.names import path_key

    links = table(spark, d, "asset_matches").select(F.explode("candidate_paths").alias("link")).where("link is not null")
    return assets.link_report(links.select("link", urls.link_class(F.col("link")).alias("kind"), path_key(F.col("link")).alias("path_key")), table(spark, d, "asset_files"))


_TARGETS = SQL["quote_nearest"]
_HITS = SQL["asset_first_hit"]
_STAND_IN = "case media_kind " + " ".join(f"when '{k}' then '{v}'" for k, v in items.STAND_INS.items()) + " else '' end"


@query(
    _ID.rstrip()
    + f""", tg as ({_TARGETS}), ht as ({_HITS}),
 qq as (select msg_table, msg_rowid as rowid, count(*) as quotes, min(target_rowid) as first_quoted_rowid from (select distinct quote_id, msg_table, msg_rowid from quote_refs) left join tg using (quote_id) group by 1, 2),
 aa as (select msg_table, msg_rowid as rowid, count(*) as assets, count(path) as assets_found, min(path) as asset_path from (select distinct match_id, msg_table, msg_rowid from asset_matches) left join ht using (match_id) group by 1, 2),
 ids as (select msg_table, rowid, ingested_at, display_sender, case when display_sender = '' or is_own or system_label <> '' then display_sender else display_sender || '(' || sender || ')' end as sender_line,
  case when is_own then 'self' when system_label <> '' then 'system' when member <> '' then 'group_member' when name_in_message <> '' then 'message_info' else 'uin' end as sender_source,
  case when conv_type = 'group' and not is_own and system_label = '' then case when member <> '' then case when title = '' then '群成员库' else '群成员库 · 头衔: ' || title end when name_in_message <> '' then '消息Info名称' else '群成员昵称未命中' end else '' end as sender_note from z)
 select m.msg_table, m.rowid, m.ingested_at, m.conv_type || ':' || m.conv_id as conv_key, m.msg_seq, case when coalesce(m.msg_time >= 946684800, false) then case when m.msg_time <= 253402300799 then strftime(make_timestamp(m.msg_time * 1000000), '%Y-%m-%d %H:%M:%S') else '' end else '' end as shown_time,
  coalesce(m.msg_time >= 946684800, false) as time_plausible, coalesce(m.is_self, false) as is_self, display_sender, sender_line, sender_source, sender_note, case when not {_BLANK} then text else {_STAND_IN} end as plain_text, media_kind, coalesce(is_recalled, false) as is_recalled,
  coalesce(quotes, 0) as quotes, first_quoted_rowid, coalesce(assets, 0) as assets, coalesce(assets_found, 0) as assets_found, asset_path
 from messages m left join ids on ids.msg_table = m.msg_table and ids.rowid = m.rowid and ids.ingested_at = m.ingested_at left join qq on qq.msg_table = m.msg_table and qq.rowid = m.rowid left join aa on aa.msg_table = m.msg_table and aa.rowid = m.rowid"""
)
def message_items(spark: SparkSession, d: str) -> DataFrame:
    return items.message_items(table(spark, d, "messages"), sender_identity(spark, d), table(spark, d, "quote_refs"), quote_nearest(spark, d), asset_first_hit(spark, d), table(spark, d, "asset_matches"))


@query("select path from asset_files where contains(lower(path), 'audio') or contains(lower(path), 'image/c2c')")
def path_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "asset_files").where(urls.path_has_any(F.col("path"), ["Audio", "Image\\C2C"])).select("path")
