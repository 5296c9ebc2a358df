"""Queries of the general table-shaping problems, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parleylake.operators import exactly_once as eo
from parleylake.operators import nested, orphans, wide
from parleylake.runtime import materialise, table

Query = Callable[[SparkSession, str], DataFrame]


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return wide.attributes_to_wide(wide.all_fields(table(spark, d, "kv_fields"), table(spark, d, "member_profiles")), table(spark, d, "kv_attributes"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return wide.wide_cells(_wide(spark, d))


def p1_wide(spark: SparkSession, d: str) -> DataFrame:
    w = _wide(spark, d)
    return w.select(*[F.array_join(c, "|").alias(c) if t == "array<string>" else F.col(c).cast("string").alias(c) for c, t in w.dtypes])


def p1_signatures(spark: SparkSession, d: str) -> DataFrame:
    """The characteristic sets and the number of entities of each."""
    return wide.signature_report(_wide(spark, d))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return orphans.chat_orphans(t("quote_refs"), t("asset_matches"), t("messages"), t("contacts"), t("own_accounts"), t("asset_files"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_field", "ref_key").distinct()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return materialise(nested.chat_nodes(table(spark, d, "asset_matches"), table(spark, d, "messages"), scalars=True), "nodes")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The links of the child tables' objects."""
    return nested.child_rows(_nodes(spark, d)).where("not is_scalar").select("src_field", "owner_key", "node_path", "parent_path").distinct()


def p6_schema(spark: SparkSession, d: str) -> DataFrame:
    return nested.merged_schema(_nodes(spark, d))


def p6_children(spark: SparkSession, d: str) -> DataFrame:
    """The typed child rows of every level of all three fields."""
    return nested.child_rows(_nodes(spark, d)).distinct()


def p6_scalars(spark: SparkSession, d: str) -> DataFrame:
    """The scalars of all arrays, such as candidates, texts and head_history_paths, with their place and parent."""
    return nested.child_rows(_nodes(spark, d)).where("is_scalar").select("src_field", "owner_key", "array_path", "node_path", "parent_path", "ordinal", "value").distinct()


def p6_assets(spark: SparkSession, d: str) -> DataFrame:
    """The assets of nodes at every depth, with their parents' types."""
    nodes = materialise(nested.flatten_nested(table(spark, d, "asset_matches"), "match_id", "rich_nodes", scalars=True), "nodes")
    rows = nested.child_rows(nodes)
    held = lambda n: F.col(n) if n in rows.columns else F.lit(None).cast("string")
    found = rows.where(~F.col("is_scalar") & F.col("array_path").rlike(r"(^|/)assets(\[\])+$")).select("owner_key", "node_path", "parent_path", "ordinal", *[held(f"m_{n}").cast("string").alias(f"m_{n}") for n in ("kind", "path", "name")]).distinct()
    parents = rows.where(~F.col("is_scalar")).select("owner_key", F.col("node_path").alias("parent_path"), held("m_type").cast("string").alias("parent_type")).distinct()
    return found.join(parents, ["owner_key", "parent_path"], "left")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sample_rows")
    return eo.surplus_copies(rows, eo.build_index(rows))


def p7_messages(spark: SparkSession, d: str) -> DataFrame:
    return eo.exactly_once(table(spark, d, "sample_rows"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_wide, p1_signatures, p2_found, p2_report, p6_found, p6_schema, p6_children, p6_scalars, p6_assets, p7_found, p7_messages)}

_FIELDS = """with f as (select stream, entry_key, field_index, field_name, uint_value, texts, read_at from kv_fields
 union all select stream, uin, f.field_index, f.field_name, f.uint_value, f.texts, read_at from (select stream, uin, read_at, unnest(fields) as f from member_profiles)),
n as (select *, lower(regexp_replace(translate(field_name, '{wide}', '{narrow}'), '[\\s\\p{{Z}}\\p{{Cc}}\\p{{Cf}}]', '', 'g')) as k from f)""".format(
    wide="".join(chr(c) for c in range(0xFF10, 0xFF5B)), narrow="".join(chr(c - 0xFEE0) for c in range(0xFF10, 0xFF5B)).replace("'", "''")
)
_BARE = "regexp_replace({}, '[\\s\\p{{Z}}\\p{{Cc}}\\p{{Cf}}]', '', 'g')"
_ORPHANS = r"""with o as (
 select 'quote_refs' as ref_table, 'seq' as ref_field, q.quote_id as ref_key, q.ingested_at as seen_at from quote_refs q where seq is not null and not exists (
  select 1 from messages m where m.msg_table = q.msg_table and m.msg_seq = q.seq and not coalesce(m.is_recalled, false) and m.ingested_at <= q.ingested_at)
 union select 'quote_refs', 'sender_uin', q.quote_id, q.ingested_at from quote_refs q where sender_uin is not null and sender_uin not in (select uin from own_accounts) and not exists (
  select 1 from contacts c where c.uin = q.sender_uin and not coalesce(c.is_deleted, false) and c.added_at <= q.ingested_at)
 union select 'asset_matches', 'unmatched_reason', p.match_id, p.ingested_at from (
  select match_id, ingested_at, lower(replace(unnest(list_concat(coalesce(candidate_paths, []), regexp_extract_all(coalesce(unmatched_reason, ''), '(?i)userdata[\\/][^\s\[\];；,，]+'))), '\', '/')) as k from asset_matches) p
  left join (select lower(replace(path, '\', '/')) as k, min(listed_at) as since from asset_files where not coalesce(is_deleted, false) group by 1) a on a.k = p.k
  where p.k is not null group by p.match_id, p.ingested_at having not bool_or(coalesce(a.since <= p.ingested_at, false)))
"""
_IDENTITY = "case when abs(msg_time) >= 100000000000 then msg_time // 1000 else msg_time end, rand & 4294967295, sender_uin"
_KEPT = f"""select *, case when msg_time is null or rand is null or sender_uin is null then 1 else row_number() over (partition by {_IDENTITY} order by sample_id) end as rn from sample_rows"""

SQL: dict[str, str] = {
    "p1_found": _FIELDS + f""" select distinct stream, entry_key, attr_name from n join kv_attributes a on lower(a.attr_name) = n.k
 where case when value_kind = 'uint' then coalesce(uint_value >= 0, false) or len(list_filter(texts, lambda x: regexp_matches({_BARE.format('x')}, '^([0-9]+|0[xX][0-9a-fA-F]+)$'))) > 0
  else len(list_filter(texts, lambda x: length({_BARE.format('x')}) > 0)) > 0 end""",
    "p2_found": _ORPHANS + "select distinct ref_table, ref_field, ref_key from o",
    "p2_report": _ORPHANS + "select ref_table, ref_field, strftime(seen_at, '%Y-%m') as month, count(distinct ref_key) as orphans from o group by all",
    "p7_found": f"select sample_id from ({_KEPT}) where rn > 1",
    "p7_messages": f"select * exclude (rn) from ({_KEPT}) where rn = 1",
}

# one column per catalog entry: the catalog of the test tables, as the columns' names must be known to the SQL
_CATALOG = {
    "uint": "cGender cGroupMemIdentity cUseCustomFace dwCreateTime dwFaceshopFaceId dwJoinTime dwLastSpeak dwLevel dwMemberCount dwOwnerUin dwUserHeadTimestampV2 wAge wGroupFace wHeadIndex",
    "text": "strCardName strCity strCustomHeadFile100 strCustomHeadFile140 strFingerMemo strGroupMemo strGroupName strImageFilePath strNick strPhoneRemark strRemark strSignature strTitle",
    "text_list": "arrayGroupHeadHistory arrayTagNames",
}
_NUMBER = f"case when regexp_matches({_BARE.format('x')}, '^[0-9]{{1,38}}$') then cast(cast({_BARE.format('x')} as decimal(38, 0)) as varchar) when regexp_matches({_BARE.format('x')}, '^0[xX]0*[0-9a-fA-F]{{1,16}}$') then cast(cast('0x' || substring({_BARE.format('x')}, 3) as ubigint) as varchar) end"
SQL["p1_wide"] = (
    _FIELDS
    + f""", c as (select stream, entry_key, attr_name, read_at, field_index, case value_kind
  when 'uint' then coalesce(case when uint_value >= 0 then cast(uint_value as varchar) end, list_filter(list_transform(texts, lambda x: {_NUMBER}), lambda y: y is not null)[1])
  when 'text' then list_filter(texts, lambda x: length({_BARE.format('x')}) > 0)[1]
  else nullif(array_to_string(list_filter(texts, lambda x: length({_BARE.format('x')}) > 0), '|'), '') end as v from n join kv_attributes a on lower(a.attr_name) = n.k),
 w as (select stream, entry_key, attr_name, v from c where v is not null qualify row_number() over (partition by stream, entry_key, attr_name order by read_at desc nulls last, field_index desc nulls last, v desc) = 1)
 select stream, entry_key, """
    + ", ".join(f"max(v) filter (where attr_name = '{a}') as {a}" for names in _CATALOG.values() for a in names.split())
    + " from w group by 1, 2"
)
SQL["p1_signatures"] = f"select signature, count(*) as entities from (select stream, entry_key, string_agg(attr_name, ',' order by attr_name) as signature from ({SQL['p1_found']}) group by 1, 2) group by 1"
SQL["p6_found"] = r"""with recursive v as (
 select 'asset_matches.rich_nodes' as src_field, cast(match_id as varchar) as owner_key, rich_nodes as j from asset_matches
 union select 'messages.member_profile', msg_table || ':' || rowid, member_profile from messages union select 'messages.conversation', msg_table || ':' || rowid, conversation from messages),
u as (select src_field, owner_key, j from v where json_valid(j) union all select src_field, owner_key, json_extract_string(j, '$') from u where json_type(j) = 'VARCHAR' and json_valid(json_extract_string(j, '$'))),
t as (select src_field, owner_key, json_tree.fullkey as f, regexp_replace(regexp_replace(json_tree.fullkey, '(\[[0-9]+\])+$', ''), '\.("[^"]*"|[^.\[\]]+)$', '') as p from u, json_tree(cast(j as json)) where json_type(u.j) in ('OBJECT', 'ARRAY') and json_tree.type = 'OBJECT'),
k as (select src_field, owner_key, f, case when f = '$' then null else p end as p from t)
select distinct src_field, owner_key, coalesce(nullif(ltrim(replace(regexp_replace(regexp_replace(f, '^\$', ''), '\[([0-9]+)\]', '/\1', 'g'), '.', '/'), '/'), ''), '$') as node_path,
 case when p is null then '' else coalesce(nullif(ltrim(replace(regexp_replace(regexp_replace(p, '^\$', ''), '\[([0-9]+)\]', '/\1', 'g'), '.', '/'), '/'), ''), '$') end as parent_path from k"""
_TREE = r"""with recursive v as (
 select 'asset_matches.rich_nodes' as src_field, cast(match_id as varchar) as owner_key, rich_nodes as j from asset_matches union all select 'messages.member_profile', msg_table || ':' || rowid, member_profile from messages union all select 'messages.conversation', msg_table || ':' || rowid, conversation from messages),
u as (select * from v where json_valid(j) union all select src_field, owner_key, json_extract_string(j, '$') from u where json_type(j) = 'VARCHAR' and json_valid(json_extract_string(j, '$'))),
t as (select src_field, owner_key, json_tree.path as p, json_tree.fullkey as f, json_tree.key as member, json_tree.type as t, case when json_tree.type = 'VARCHAR' then json_extract_string(json_tree.value, '$') when json_tree.type <> 'NULL' then cast(json_tree.value as varchar) end as v
 from u, json_tree(cast(j as json)) where json_type(u.j) in ('OBJECT', 'ARRAY')),
n as (select *, regexp_replace(f, '(\[[0-9]+\])+$', '') as bare from t),
w as (select *, {way} as node_path, coalesce(nullif({of_bare}, ''), '$') as up, {kind} as array_path from n)
""".format(
    way=r"ltrim(replace(regexp_replace(regexp_replace(f, '^\$', ''), '\[([0-9]+)\]', '/\1', 'g'), '.', '/'), '/')",
    of_bare=r"ltrim(replace(regexp_replace(regexp_replace(regexp_replace(bare, '\.[^.\[\]]+$', ''), '^\$', ''), '\[([0-9]+)\]', '/\1', 'g'), '.', '/'), '/')",
    kind=r"ltrim(replace(regexp_replace(regexp_replace(f, '^\$', ''), '\[[0-9]+\]', '[]', 'g'), '.', '/'), '/')",
)
SQL["p6_schema"] = _TREE + r""", m as (select case when regexp_matches(f, '\]$') then array_path else coalesce(nullif(regexp_replace(array_path, '/?[^/]+$', ''), ''), '$') end as array_path, case when regexp_matches(f, '\]$') then '[]' else member end as member,
 case t when 'NULL' then 0 when 'UBIGINT' then 1 when 'BIGINT' then 1 when 'DOUBLE' then 2 when 'BOOLEAN' then 4 else 8 end as k from w where t not in ('OBJECT', 'ARRAY'))
select array_path, member, case bit_or(k) when 1 then 'long' when 2 then 'double' when 3 then 'double' when 4 then 'boolean' else 'string' end as kind, count(*) as nodes from m group by 1, 2"""
SQL["p6_scalars"] = _TREE + r"""select distinct src_field, owner_key, array_path, node_path, up as parent_path, cast(regexp_extract(f, '\[([0-9]+)\]$', 1) as int) as ordinal, v as value from w where t not in ('OBJECT', 'ARRAY') and regexp_matches(f, '\]$')"""
SQL["p6_assets"] = _TREE + r""", a as (select distinct owner_key, node_path, up, f, p from w where src_field = 'asset_matches.rich_nodes' and t = 'OBJECT' and regexp_matches(array_path, '(^|/)assets(\[\])+$')),
 x as (select distinct owner_key, p, member, v from w where src_field = 'asset_matches.rich_nodes' and t not in ('OBJECT', 'ARRAY') and not regexp_matches(f, '\]$') and member in ('kind', 'path', 'name')),
 y as (select distinct owner_key, coalesce(nullif(ltrim(replace(regexp_replace(regexp_replace(p, '^\$', ''), '\[([0-9]+)\]', '/\1', 'g'), '.', '/'), '/'), ''), '$') as up, v as parent_type from w where src_field = 'asset_matches.rich_nodes' and t not in ('OBJECT', 'ARRAY') and member = 'type' and not regexp_matches(f, '\]$'))
select a.owner_key, a.node_path, a.up as parent_path, cast(regexp_extract(a.f, '\[([0-9]+)\]$', 1) as int) as ordinal, y.parent_type, k.v as m_kind, h.v as m_path, n.v as m_name from a left join y on y.owner_key = a.owner_key and y.up = a.up
 left join x k on k.owner_key = a.owner_key and k.p = a.f and k.member = 'kind' left join x h on h.owner_key = a.owner_key and h.p = a.f and h.member = 'path' left join x n on n.owner_key = a.owner_key and n.p = a.f and n.member = 'name'"""
