"""Queries of the decoders over payloads that are encoded from the test tables, so that SQL over the same tables tells what must come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parleylake.decode import faces, record, stores, tables
from parleylake.operators import audit, nested
from parleylake.plans import payloads as p
from parleylake.plans.chat import Query
from parleylake.runtime import table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
KEYS = ["msg_table", "rowid"]
#: The key of the sealed streams made here.
SEAL = bytes(range(1, 17))


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_R = "r as (select msg_table, rowid, coalesce(min(text), '') as text, coalesce(max(msg_time), 0) & 4294967295 as t, coalesce(max(rand), 0) & 4294967295 as r, coalesce(min(sender_name), '') as nick from messages where msg_table is not null and rowid is not null group by 1, 2)"
#: What an element keeps of a text, a text of its own kind behind a letter, and its bytes in UTF-16.
_KEPT = r"case when regexp_matches(regexp_replace(text, '^[\x00-\x08\x0b\x0c]+', ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffd}]') then '' else regexp_replace(text, '^[\x00-\x08\x0b\x0c]+', '') end"
_LETTERED = r"case when regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffd}]') then '' else 'k' || text end"
_UNITS = r"(length({0}) + length(regexp_replace({0}, '[^\x{{10000}}-\x{{10ffff}}]', '', 'g')))"

_FACE = "['" + "', '".join(faces.FACES) + "']"
_TRIM = r"regexp_replace({}, '^[\s\p{{Z}}\x1c-\x1f\x{{85}}]+|[\s\p{{Z}}\x1c-\x1f\x{{85}}]+$', '', 'g')"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").where("msg_table is not null and rowid is not null")
    word = lambda c: F.coalesce(F.max(c), F.lit(0)).bitwiseAND(F.lit(0xFFFFFFFF))
    return m.groupBy(*KEYS).agg(F.coalesce(F.min("text"), F.lit("")).alias("text"), word("msg_time").alias("t"), word("rand").alias("r"), F.coalesce(F.min("sender_name"), F.lit("")).alias("nick"))


def _encoded(rows: DataFrame, build: Callable[..., bytes], *columns: str) -> DataFrame:
    """The keys and ``content``, which ``build`` makes of the columns."""
    # few bytes, but much work each: without a number of its own the rows would end in one task
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(parts).withColumn("content", F.udf(build, "binary", useArrow=True)(*columns))


def _whole(rowid: int, text: str, t: int, r: int, nick: str) -> bytes:
    """A header, a text, a face, an empty layout, a picture, and a record with a string and numbers of three widths."""
    rec = p.td_record((8, "strNick", p.locked(p.wide("N:" + nick))), (1, "dwUin", (rowid % 2**32).to_bytes(4, "little")), (3, "wAge", (rowid % 2**16).to_bytes(2, "little")), (2, "cGender", bytes([rowid % 256])))
    return p.header(t, r) + p.text_elements(text) + p.element(2, (1, bytes([rowid % 105]))) + p.element(0x0E) + p.element(3, (2, p.wide(f"UserDataImage:C2C\\{rowid}.jpg"))) + rec


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(_rows(spark, d), _whole, "rowid", "text", "t", "r", "nick")


@query(f"with {_R} select msg_table, rowid, t as msg_time, r as rand from r")
def decoded_headers(spark: SparkSession, d: str) -> DataFrame:
    return tables.headers(_messages(spark, d), KEYS, "content").drop("error")


@query(f"""with {_R}, s as (select *, 2 * {_UNITS.format('text')} as n, 2 * {_UNITS.format('nick')} + 4 as k, 2 * (22 + length(cast(rowid as varchar))) as w from r),
 e as (select msg_table, rowid, unnest([0, 1, 2, 3, 4]) as pos, unnest([n + 6, 7, 3, w + 6, 6 + 21 + k + 21 + 17 + 22]) as size, unnest([1, 2, 14, 3, 0]) as type, unnest(['text', 'sysface', 'layout_metadata', 'image', 'raw']) as label from s)
 select msg_table, rowid, pos, cast(20 + coalesce(sum(size) over (partition by msg_table, rowid order by pos rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset", size, type, label from e""")
def decoded_elements(spark: SparkSession, d: str) -> DataFrame:
    return tables.message_elements(_messages(spark, d), KEYS, "content").select(*KEYS, "pos", "offset", "size", "type", "label")


@query(f"""with {_R}, f as (select *, unnest(['strNick', 'dwUin', 'wAge', 'cGender']) as name, unnest([8, 1, 3, 2]) as header, unnest([0, 1, 2, 3]) as pos, unnest([cast(null as bigint), rowid % 4294967296, rowid % 65536, rowid % 256]) as number from r)
 select msg_table, rowid, 'TD' as tag, true as complete, pos, header, name, number, case when pos = 0 and not regexp_matches(nick, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{{fffd}}]') then 'N:' || nick else '' end as texts from f""")
def decoded_records(spark: SparkSession, d: str) -> DataFrame:
    return tables.record_fields(_messages(spark, d), KEYS, "content").select(*KEYS, "tag", "complete", "pos", "header", "name", "number", F.array_join("texts", "|").alias("texts"))


@query(f"with {_R} select msg_table, rowid, {_KEPT} || '[' || ({_FACE})[cast(rowid % 105 as int) + 1] || ']' || '[图片]' as plain_text, 'UserDataImage:C2C\\' || rowid || '.jpg' as candidate from r where rowid >= 0")
def decoded_text(spark: SparkSession, d: str) -> DataFrame:
    shown = tables.rendered(_messages(spark, d).where("rowid >= 0"), KEYS, "content")
    nodes = F.from_json("rich_nodes", "array<struct<type:string,candidates:array<string>>>")
    return shown.select(*KEYS, "plain_text", F.filter(nodes, lambda n: n["type"] == "image")[0]["candidates"][0].alias("candidate"))


@query(f"""with {_R}, k as (select *, 'k' || text as kt, octet_length(encode('k' || text)) as n, octet_length(encode('k' || rowid)) as m from r)
 select msg_table, rowid, pos, path, field, wire, varint, size, shown as text from (select msg_table, rowid, unnest([0, 1, 2, 3, 4]) as pos, unnest(['1', '2', '3.1', '3.2', '3']) as path, unnest([1, 2, 1, 2, 3]) as field, unnest([0, 2, 5, 2, 2]) as wire,
  unnest([cast(rowid as varchar), null, null, null, null]) as varint, unnest([0, n, 4, m, 7 + m]) as size, unnest(['', case when n <= 500 then {_LETTERED} else '' end, '', 'k' || rowid, '']) as shown from k)""")
def decoded_proto(spark: SparkSession, d: str) -> DataFrame:
    # a key that no number of the nested field's four bytes can make readable stands before it
    build = lambda rowid, text: p.wire((1, rowid), (2, f"k{text}".encode()), (3, p.fixed(1, rowid % 2**31 | 0x80000000) + p.wire((2, f"k{rowid}".encode()))))
    return tables.proto_fields(_encoded(_rows(spark, d), build, "rowid", "text"), KEYS, "content").drop("error")


@query(f"""with {_R}, n as (select *, octet_length(encode(text)) as n from r)
 select msg_table, rowid, unnest([0, 5, 8 + n]) as "offset", unnest([29, 7, 33]) as tag, unnest([2, n, 3]) as size, unnest([1, 0, 1]) as fields from n""")
def decoded_tags(spark: SparkSession, d: str) -> DataFrame:
    entry = lambda tag, data: bytes([tag]) + len(data).to_bytes(2, "big") + data
    build = lambda text: entry(0x1D, p.wire((1, 5))) + entry(7, text.encode()) + entry(0x21, p.wire((2, b"x"))) + b"\xff\x00\x00" + entry(9, b"unseen")
    return tables.context_tags(_encoded(_rows(spark, d), build, "text"), KEYS, "content").drop("error")


@query(f"with {_R} select msg_table, rowid, 0 as pos, rowid as seq, r as sender, t as quote_time, case when octet_length(encode('k' || text)) <= 500 then {_LETTERED} else '' end as quote_text from r")
def decoded_quotes(spark: SparkSession, d: str) -> DataFrame:
    build = lambda rowid, text, t, r: p.header(t, r) + p.element(0x19, (1, p.wire((45, p.wire((1, rowid), (2, r), (3, t), (4, f"k{text}".encode()))))))
    return tables.quotes(_encoded(_rows(spark, d), build, "rowid", "text", "t", "r"), KEYS, "content").drop("error")


@query(f"with {_R} select msg_table, rowid, unnest([0, 1]) as item, unnest([t, rowid % 4294967296]) as msg_time, unnest([r, 7]) as rand, unnest([{_KEPT}, 'second ' || rowid]) as text from r")
def decoded_forwards(spark: SparkSession, d: str) -> DataFrame:
    build = lambda rowid, text, t, r: p.td_record((9, "buffMsgPackListStream", p.locked(p.pack(p.header(t, r) + p.text_elements(text), p.header(rowid % 2**32, 7) + p.text_elements(f"second {rowid}")))))
    return tables.forwarded_messages(_encoded(_rows(spark, d), build, "rowid", "text", "t", "r"), KEYS, "content").drop("content", "error")


@query(f"with {_R} select msg_table, rowid, coalesce(nullif({_TRIM.format("replace(text, chr(34), '')")}, ''), 'T' || rowid) as plain_text, 'http://cards.example/T' || rowid as href from r")
def decoded_cards(spark: SparkSession, d: str) -> DataFrame:
    shown = tables.rendered(_encoded(_rows(spark, d), lambda rowid, text: p.card(text, f"T{rowid}"), "rowid", "text"), KEYS, "content")
    return shown.select(*KEYS, "plain_text", F.get_json_object("rich_nodes", "$[0].href").alias("href"))


@query(f"with {_R} select msg_table, rowid, {_TRIM.format("'k' || text")} as plain_text, 'app' as kind from r")
def decoded_apps(spark: SparkSession, d: str) -> DataFrame:
    shown = tables.rendered(_encoded(_rows(spark, d), lambda text: p.app("k" + text), "text"), KEYS, "content")
    return shown.select(*KEYS, "plain_text", F.get_json_object("rich_nodes", "$[0].type").alias("kind"))


@query(f"with {_R} select msg_table, rowid, unnest([0, 1]) as pos, unnest(['k' || text, 'line ' || rowid]) as title from r where not regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{{fffd}}]') union all select msg_table, rowid, 0, 'line ' || rowid from r where regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{{fffd}}]')")
def decoded_titles(spark: SparkSession, d: str) -> DataFrame:
    build = lambda rowid, text: p.ta_record((8, p.locked(p.wide("k" + text))), (3, b"\x01\x02"), (8, p.locked(p.wide(f"line {rowid}"))))
    return tables.titles(_encoded(_rows(spark, d), build, "rowid", "text"), KEYS, "content").drop("error")


@query(f"with {_R} select msg_table, rowid, 0 as pos, 'f' || rowid || '.pdf' as name, 1000 + rowid as size, '00000000-0000-0000-0000-' || lpad(cast(rowid as varchar), 12, '0') as uuid, md5(text) as hash from r")
def decoded_files(spark: SparkSession, d: str) -> DataFrame:
    build = lambda rowid, digest: p.element(7, (2, p.wide(f"f{rowid}.pdf")), (3, p.wide(f"{1000 + rowid}Byte")), (4, p.wide(digest)), (5, p.wide(f"00000000-0000-0000-0000-{rowid:012d}")))
    return tables.file_metas(_encoded(_rows(spark, d).withColumn("digest", F.md5(F.encode("text", "UTF-8"))), build, "rowid", "digest"), KEYS, "content").drop("error")


@query(f"with {_R} select msg_table, rowid, 0 as \"offset\", 'run:' || rowid || ' UserDataImage:' || rowid || '.png' as text, 'UserDataImage:' || rowid || '.png' as reference from r")
def decoded_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = _encoded(_rows(spark, d), lambda rowid: p.wide(f"run:{rowid} UserDataImage:{rowid}.png") + bytes(5), "rowid")
    return tables.text_runs(rows, KEYS, "content").drop("error").join(tables.embedded(rows, KEYS, "content").select(*KEYS, "reference"), KEYS)


@query(f"with {_R}, q as (select *, case when octet_length(encode('k' || text)) <= 500 then {_LETTERED} else '' end as quoted from r) select msg_table, rowid, '@y' || '[' || ({_FACE})[cast(rowid % 105 as int) + 1] || ']' || 'T' || rowid as display_text, 3 + cast(quoted <> '' as int) as rendered, 5 as ignored, '7' as styles from q where rowid >= 0")
def decoded_display(spark: SparkSession, d: str) -> DataFrame:
    """Replies: what leads to the quote and the mention repeated after it are not shown, a face after a mention belongs to it."""

    def build(rowid: int, text: str) -> bytes:
        quote = p.element(0x19, (1, p.wire((45, p.wire((1, rowid), (2, 5), (3, 6), (4, f"k{text}".encode()))))))
        style = p.element(0x19, (1, p.wire((37, p.wire((17, 7))))))
        return p.header(1, 2) + p.text_elements("@x") + p.text_elements(" ") + quote + p.text_elements("@y") + p.text_elements(" ") + p.text_elements("@y") + p.element(2, (1, bytes([rowid % 105]))) + p.text_elements(f"T{rowid}") + style

    shown = tables.displayed(_encoded(_rows(spark, d).where("rowid >= 0"), build, "rowid", "text"), KEYS, "content")
    return shown.select(*KEYS, "display_text", "rendered", "ignored", F.array_join(F.col("styles").cast("array<string>"), ",").alias("styles"))


@query(f"with {_R} select msg_table, rowid, 20 as gap_start, 25 as gap_end from r")
def decoded_gaps(spark: SparkSession, d: str) -> DataFrame:
    rows = _encoded(_rows(spark, d), lambda text, t, r: p.header(t, r) + b"\xfe" * 5 + p.text_elements("k" + text), "text", "t", "r")
    return audit.coverage_gaps(tables.coverage(rows, KEYS, "content"), key=KEYS, total="total").select(*KEYS, "gap_start", "gap_end")


@query(f"with {_R} select msg_table, rowid, case rowid % 4 when 1 then 'partial_txdata' when 2 then 'txdata_trailer' else 'too_many_fields' end as issue, 1 as n from r where rowid % 4 <> 0")
def decoded_issues(spark: SparkSession, d: str) -> DataFrame:
    """Field lists of which three in four are cut, followed by other bytes, or announce too many fields."""

    def build(rowid: int, nick: str) -> bytes:
        whole = p.field_list((8, "strNick", p.locked(p.wide(nick))), (1, "dwUin", bytes(4)))
        return [whole, whole[:-1], whole + b"x", b"\xff\xff" + whole[2:]][rowid % 4]

    return tables.record_issues(tables.field_lists(_encoded(_rows(spark, d), build, "rowid", "nick"), KEYS, "content"), KEYS)


_CASES = ["fine", "empty_text_and_nodes", "blank_text", "suspicious_text", "rich_empty_href", "type_mismatch", "unrendered_media"]


def _flawed(spark: SparkSession, d: str) -> DataFrame:
    """Messages of which one in seven is fine and the others have one flaw each."""

    def build(rowid: int) -> bytes:
        bodies = [
            p.text_elements("fine"), p.element(0x0E), p.text_elements(" "), p.text_elements("a\ue001\ue002b"), p.element(0x14, (1, p.wide("<msg brief='b'></msg>"))),
            p.element(3, (2, p.wide("UserDataImage:a\\b.amr")), (2, p.wide("UserDataImage:a\\c.avi"))), p.element(8, (2, p.wide("UserDataImage:a.png"))) + p.text_elements("t"),
        ]
        return p.header(1, 2) + bodies[rowid % 7]

    return tables.shown_issues(_encoded(_rows(spark, d).where("rowid >= 0"), build, "rowid"), KEYS, "content")


@query(f"with {_R} select msg_table, rowid, ({_CASES})[cast(rowid % 7 as int) + 1] as issue from r where rowid >= 0 and rowid % 7 <> 0")
def shown_issues(spark: SparkSession, d: str) -> DataFrame:
    return _flawed(spark, d).drop("error")


@query(f"with {_R} select ({_CASES})[cast(rowid % 7 as int) + 1] as counter, count(*) as value from r where rowid >= 0 and rowid % 7 <> 0 group by 1")
def shown_counters(spark: SparkSession, d: str) -> DataFrame:
    return _flawed(spark, d).groupBy(F.col("issue").alias("counter")).agg(F.count(F.lit(1)).alias("value"))


@query(f"with {_R} select msg_table, rowid, 'entry' || rowid as entry_key, unnest([0, 1]) as field_index, unnest([8, 1]) as header, unnest(['strNick', 'dwUin']) as field_name, unnest([null, rowid % 4294967296]) as uint_value, unnest([case when regexp_matches(nick, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{{fffd}}]') then '' else 'N:' || nick end, '']) as texts from r")
def decoded_streams(spark: SparkSession, d: str) -> DataFrame:
    """A plain key/value stream of each message, of whose two entries only one is wanted."""

    def build(rowid: int, nick: str) -> bytes:
        fields = p.td_record((8, "strNick", p.locked(p.wide("N:" + nick))), (1, "dwUin", (rowid % 2**32).to_bytes(4, "little")))
        return b"ES\x01\x01" + p.entries(("unwanted", fields), (f"entry{rowid}", fields))

    read = tables.kv_fields(_encoded(_rows(spark, d), build, "rowid", "nick"), KEYS, "content").where("entry_key <> 'unwanted'")
    return read.drop("error").withColumn("texts", F.array_join("texts", "|"))


@query("select uin, 'account' as entry_key, account_kind as kind, uin as number from own_accounts where uin is not null")
def sealed_streams(spark: SparkSession, d: str) -> DataFrame:
    """Sealed and compressed streams of the own accounts, opened with their key; a block that cannot be opened is skipped."""

    def build(uin: int, kind: str) -> bytes:
        return p.sealed_file(p.entries(("account", p.td_record((8, "strKind", p.locked(p.wide(kind))), (1, "dwUin", (uin % 2**32).to_bytes(4, "little")))), ("other", p.td_record((2, "cX", b"\x01")))), SEAL)

    files = table(spark, d, "own_accounts").where("uin is not null").withColumn("content", F.udf(build, "binary", useArrow=True)("uin", "account_kind"))
    read = tables.kv_fields(files, ["uin"], "content", SEAL.hex(), ["account"])
    return read.groupBy("uin", "entry_key").agg(F.max(F.try_element_at("texts", F.lit(1))).alias("kind"), F.max("uint_value").alias("number"))


@query("select n_regionkey, n_name as stream, cast(length(n_name) * n_nationkey * 40 as bigint) as size, md5(repeat(n_name, n_nationkey * 40)) as digest from nation")
def compound_streams(spark: SparkSession, d: str) -> DataFrame:
    """Compound files, one of each region, with a stream of each nation: empty, in the mini stream or in sectors of their own."""
    build = lambda names, numbers: p.compound_file([(n, n.encode() * (k * 40)) for n, k in sorted(zip(names, numbers))])
    # a fixed table of five regions
    files = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct("n_name", "n_nationkey")).alias("s")).withColumn("content", F.udf(build, "binary", useArrow=True)("s.n_name", "s.n_nationkey"))
    return tables.compound_streams(files, ["n_regionkey"], "content").select("n_regionkey", "stream", "size", F.md5("data").alias("digest"))


@query(f"""with {_R}, k as (select distinct text, encode(text) as b from r where octet_length(encode(text)) between 1 and 65535), x as (select *, xor(octet_length(b) % 256, octet_length(b) // 256) as key, hex(b) as h from k)
 select text, array_to_string(list_transform(range(octet_length(b)), lambda i: printf('%02x', cast(xor(255 - cast(('0x' || substring(h, 2 * i + 1, 2)) as integer), cast(key as integer)) as integer))), '') as coded from x""")
def length_keyed(spark: SparkSession, d: str) -> DataFrame:
    coded = F.udf(lambda t: record.unkey(t.encode()).hex(), "string", useArrow=True)
    return _rows(spark, d).where(F.octet_length("text").between(1, 65535)).select("text").distinct().withColumn("coded", coded("text"))


_REVERSED = "'0x' || array_to_string(list_reverse(regexp_extract_all(substring(h, {}, 16), '..')), '')"
_DIGITS = " || ".join(f"substring('{stores.DIGITS}', cast((n // cast({48**i} as uhugeint)) % 48 as integer) + 1, 1)" for i in range(23))


@query(f"""with {_R}, h as (select distinct text, md5(text) as h from r), v as (select *, cast(cast({_REVERSED.format(17)} as ubigint) as uhugeint) * cast(18446744073709551616 as uhugeint) + cast(cast({_REVERSED.format(1)} as ubigint) as uhugeint) as n from h)
 select text, {_DIGITS} as name, h as back from v""")
def hashed_names(spark: SparkSession, d: str) -> DataFrame:
    """Digests as file-name hashes, and the digests that the names mean."""
    name = F.udf(lambda h: stores.hash_name(bytes.fromhex(h)), "string", useArrow=True)
    back = F.udf(lambda n: stores.name_hash(n.lower()).hex(), "string", useArrow=True)
    return _rows(spark, d).select("text").distinct().withColumn("name", name(F.md5(F.encode("text", "UTF-8")))).withColumn("back", back("name"))


@query(f"with {_R} select msg_table, rowid, case rowid % 4 when 0 then 'k好' || rowid when 1 then 'k好' || rowid when 2 then 'k好' else '00 01 02' end as shown from r where rowid >= 0")
def displayed_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Bytes for people: UTF-8, UTF-16LE, GB18030 and such as are no text."""
    build = lambda rowid: [f"k好{rowid}".encode(), p.wide(f"k好{rowid}"), "k好".encode("gb18030"), b"\x00\x01\x02"][rowid % 4]
    return _encoded(_rows(spark, d).where("rowid >= 0"), build, "rowid").select(*KEYS, F.udf(stores.display, "string", useArrow=True)("content").alias("shown"))


def _multi(c: Column) -> Column:
    return F.concat(F.lit("item "), c)


@query("""with recursive u as (select cast(match_id as varchar) as owner_key, rich_nodes as j from asset_matches where json_valid(rich_nodes) group by 1, 2 union all select owner_key, json_extract_string(j, '$') from u where json_type(j) = 'VARCHAR' and json_valid(json_extract_string(j, '$'))),
 n as (select owner_key, coalesce(nullif(ltrim(replace(regexp_replace(regexp_replace(json_tree.fullkey, '^\\$', ''), '\\[([0-9]+)\\]', '/\\1', 'g'), '.', '/'), '/'), ''), '$') as node_path from u, json_tree(cast(j as json)) where json_type(u.j) in ('OBJECT', 'ARRAY') and json_tree.type = 'OBJECT' and json_extract_string(json_tree.value, '$.type') = 'multi_msg')
 select owner_key, node_path, 'item ' || owner_key as item from n qualify row_number() over (partition by owner_key order by list_transform(string_split(node_path, '/'), lambda x: case when regexp_matches(x, '^[0-9]+$') then lpad(x, 9, '0') else x end)) = 1""")
def attached_items(spark: SparkSession, d: str) -> DataFrame:
    """Forwarded items hung below the first forwarded-chat node of their match."""
    matches = table(spark, d, "asset_matches")
    owners = matches.select(F.col("match_id").cast("string").alias("owner_key")).distinct()
    return nested.attached(nested.flatten_nested(matches, "match_id", "rich_nodes"), owners.withColumn("item", _multi(F.col("owner_key"))))
