"""Queries of column functions, sources and sinks over the test tables, each with its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parleylake.functions import media, text, urls
from parleylake.functions.names import path_key
from parleylake.operators import assets
from parleylake.plans.chat import Query
from parleylake.runtime import new_path, put_text, shared_dir, table
from parleylake.sources import files, sinks, sqlite

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_TEXTS = "t as (select distinct text from messages where text is not null)"
_ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;')"
_UNESCAPED = "replace(replace(replace(replace(replace(replace({}, '&amp;', '&'), '&quot;', chr(34)), '&#39;', chr(39)), '&apos;', chr(39)), '&lt;', '<'), '&gt;', '>')"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").where("text is not null").select("text").distinct()


@query(f"""with {_TEXTS} select text, {_ESCAPED.format("text || '<a b=\"&amp;c\">'")} as escaped, {_UNESCAPED.format("text || '&amp;lt; &lt;&quot;&apos;&#39;&gt; &amp;amp;'")} as unescaped,
 case when regexp_matches(text, '[,"\\n\\r]') then '"' || replace(text, '"', '""') || '"' else text end as csv, regexp_replace(text, '[\\t\\r\\n]', ' ', 'g') as tsv from t""")
def text_escapes(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _texts(spark, d).select("text", text.html_escape(F.concat(t, F.lit('<a b="&amp;c">'))).alias("escaped"), text.html_unescape(F.concat(t, F.lit("&amp;lt; &lt;&quot;&apos;&#39;&gt; &amp;amp;"))).alias("unescaped"), text.csv_cell(t).alias("csv"), text.tsv_cell(t).alias("tsv"))


@query(r"""with p as (select path, 'http://h.example/' || path || '?p=' || url_encode(path) || '&q=a+b&&q=' || asset_id || '&flag' as url from asset_files)
 select path, string_split(url, '?')[1] as bare, substring(url, strpos(url, '?') + 1) as query, path as p, cast(regexp_extract(url, '&q=([0-9]+)&', 1) as varchar) as q, '' as flag, 'a+b ü' as decoded, '100%' as undecoded from p""")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("http://h.example/"), "path", F.lit("?p="), F.url_encode("path"), F.lit("&q=a+b&&q="), F.col("asset_id").cast("string"), F.lit("&flag"))
    made = table(spark, d, "asset_files").where("path is not null").select("path", url.alias("url")).select("path", urls.url_path(F.col("url")).alias("bare"), urls.url_query(F.col("url")).alias("query"))
    # blanks are written as plus signs by the encoder, which the decoder keeps; paths hold none
    m = made.withColumn("m", urls.query_map(F.col("query")))
    return m.select("path", "bare", "query", *[F.col("m")[k].alias(k) for k in ("p", "q", "flag")], urls.percent_decode(F.lit("a+b%20%C3%BC")).alias("decoded"), urls.percent_decode(F.lit("100%")).alias("undecoded"))


@query(r"""select path, array_to_string(list_filter(string_split(replace('..\.\' || path || '//x', '\', '/'), '/'), lambda p: p not in ('', '.', '..')), '/') as relative, '/mnt/c/' || replace(path, '\', '/') as portable, replace(path, '\', '/') as kept,
 regexp_replace(trim(replace(path, '\', '/')), '[^\p{L}\p{N}._-]', '_', 'g') as safe, 'unnamed' as blank_name from asset_files where path is not null""")
def path_forms(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return table(spark, d, "asset_files").where("path is not null").select("path", urls.relative_parts(F.concat(F.lit("..\\.\\"), p, F.lit("//x"))).alias("relative"), urls.portable_path(F.concat(F.lit("C:\\"), p)).alias("portable"), urls.portable_path(p).alias("kept"), text.safe_file_name(F.replace(p, F.lit("\\"), F.lit("/"))).alias("safe"), text.safe_file_name(F.lit(" .. ")).alias("blank_name"))


_EXT = [*media.IMAGE, *media.VIDEO, *media.VOICE, *media.FILE]
_CANDIDATE = "not regexp_matches({0}, '^\\{{|^com\\.|[“”]|文件|成功|取消') and (regexp_matches({0}, '^(" + "|".join(media.SCHEMES) + "):') or regexp_matches({0}, '(?i)^https?://[^?#]*\\.(" + "|".join(_EXT) + ")([?#].*)?$') or (regexp_matches({0}, '[\\\\/]|^[\\x20-\\x7e]*$') and regexp_matches({0}, '(?i)\\.(" + "|".join(_EXT) + ")$')))"


@query("with c as (select distinct trim(unnest(candidate_paths)) as reference from asset_matches) select reference, " + _CANDIDATE.format("reference") + " as is_candidate, coalesce(" + ", ".join(f"case when strpos(lower(reference), '.{e}') > 0 then substring(reference, 1, strpos(lower(reference), '.{e}') + {len(e)}) end" for e in _EXT) + ", reference) as trimmed from c where reference <> ''")
def media_texts(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "asset_matches").select(F.explode("candidate_paths").alias("c")).select(F.trim("c").alias("reference")).where("reference <> ''").distinct()
    return refs.select("reference", media.is_media_candidate(F.col("reference")).alias("is_candidate"), media.trim_media_path(F.col("reference")).alias("trimmed"))


@query("select sender, n, usable, label_ok from (select distinct trim(sender_uin) as sender, sender_name as n, coalesce(trim(sender_name) <> '' and trim(sender_name) <> trim(sender_uin) and trim(sender_name) <> '1900000017' and not regexp_matches(trim(sender_name), '^[0-9]*$') and not regexp_matches(trim(sender_name), '^\\([0-9]*\\)$'), false) as usable, coalesce(trim(sender_name) <> '' and trim(sender_name) <> trim(sender_uin) and octet_length(encode(trim(sender_name))) <= 80 and not regexp_matches(trim(sender_name), '[\\\\/\\x00-\\x1f]') and not regexp_matches(trim(sender_name), '^[0-9]+$'), false) as label_ok from messages)")
def usable_names(spark: SparkSession, d: str) -> DataFrame:
    n, s = F.col("sender_name"), F.trim("sender_uin")
    return table(spark, d, "messages").select(s.alias("sender"), n.alias("n"), text.usable_name(n, s, F.lit("1900000017")).alias("usable"), text.usable_label(n, s).alias("label_ok")).distinct()


_PAGE = "'<A HREF=\"f/' || m.rowid || '.html?x=1&amp;y=2#z\">a</A> <img alt=x src=''g%20' || m.rowid || '.png''><a class=k href=#top>t</a><video poster=p' || m.rowid || '.jpg></video><script src=\"https://x.example/' || m.rowid || '.js\"></script><b title=\"href=no\">'"
_LINKS = "['f/' || rowid || '.html?x=1&y=2#z', 'g%20' || rowid || '.png', '#top', 'p' || rowid || '.jpg', 'https://x.example/' || rowid || '.js']"


@query(f"""with m as (select distinct msg_table, rowid from messages where msg_table is not null and rowid is not null)
 select msg_table, rowid, unnest([0, 1, 2, 3, 4]) as pos, unnest({_LINKS}) as link, unnest(['local', 'local', 'anchor', 'local', 'external']) as kind, unnest(['base/f/' || rowid || '.html', 'base/g ' || rowid || '.png', '', 'base/p' || rowid || '.jpg', '']) as path from m""")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    """The links of a page made for each message: quoted, unquoted, escaped, anchors and outside ones."""
    m = table(spark, d, "messages").where("msg_table is not null and rowid is not null").select("msg_table", "rowid").distinct().alias("m")
    links = m.withColumn("html", F.expr(_PAGE)).select("msg_table", "rowid", F.posexplode(urls.html_links(F.col("html"))).alias("pos", "link")).withColumn("kind", urls.link_class(F.col("link")))
    return links.withColumn("path", F.when(F.col("kind") == "local", urls.local_path(F.lit("base/"), F.col("link"))).otherwise(""))


@query("""with m as (select distinct msg_table, rowid from messages where msg_table is not null and rowid is not null)
 select 5 * count(*) as total, 3 * count(*) as local, count_if(rowid % 2 = 0) as alive, 3 * count(*) - count_if(rowid % 2 = 0) as dead, count(*) as external, count(*) as anchor from m""")
def html_link_report(spark: SparkSession, d: str) -> DataFrame:
    """Links of these pages against files of which those of even rows exist."""
    links = html_links(spark, d)
    there = table(spark, d, "messages").where("rowid is not null and msg_table is not null and rowid % 2 = 0").select(F.concat(F.lit("base/p"), F.col("rowid").cast("string"), F.lit(".jpg")).alias("path"), F.lit(False).alias("is_deleted")).distinct()
    return assets.link_report(links.select("link", "kind", path_key(F.col("path")).alias("path_key")), there)


_THUMBS = lambda stem, ending: ", ".join(f"{stem} || '{t}.{e}'" for e in [ending, *[x for x in media.THUMBNAIL_ENDINGS if x != ending]] for t in ("_tmb", "fix"))
_LIES = {
    "'UserDataImage:Group/x\\ab' || asset_id || '.png'": [x for base in ("'acc/Image/Group/x/ab' || asset_id", "'acc/Image/Group/thumbnail/x/ab' || asset_id", "'acc/Image/Group2/ab/' || substring('ab' || asset_id || '.png', 3, 2) || '/ab' || asset_id") for x in (f"{base} || '.png'", _THUMBS(base, "png"))] + ["'extracted/Thumbnails.db/PicFile/ab' || asset_id", "'extracted/Thumbnails.db/PicFile/ab' || asset_id || '.png'"],
    "'UserDataCustomFace:' || asset_id || '.gif'": [x for base in ("'acc/CustomFace/' || asset_id", "'extracted/CustomFace.db/' || asset_id") for x in (f"{base} || '.gif'", _THUMBS(base, "gif"))] + ["'extracted/Thumbnails.db/PicFile/' || asset_id", "'extracted/Thumbnails.db/PicFile/' || asset_id || '.gif'"],
    "'FaceStore:a\\' || asset_id || '.fixed'": ["'extracted/FaceStore.db/a/' || asset_id || '.fixed'", "'extracted/FaceStore.db/a/' || asset_id || '_tmb.fixed'", "'extracted/FaceStore.db/a/' || asset_id || 'fix.fixed'", "'extracted/FaceStore.db/' || asset_id"],
    "'SysFaceResFileSystem:' || asset_id || '.dat'": [f"'extracted{now}/SysFaceResFileSystem/' || asset_id || '{t}.dat'" for now in ("", "-current") for t in ("", "_tmb", "fix")],
    "'UserDataRoot:..\\a\\.\\' || asset_id": ["'acc/a/' || asset_id"],
    "'UserDataFileRecv:' || asset_id || '.pdf'": ["'acc/FileRecv/' || asset_id || '.pdf'", "'acc/' || asset_id || '.pdf'"],
    "'a/' || asset_id || '.mp3'": ["'acc/a/' || asset_id || '.mp3'", "'acc/FileRecv/a/' || asset_id || '.mp3'"],
    "asset_id || '.docx'": [f"'acc/{f}' || asset_id || '.docx'" for f in ("FileRecv/", "", "Audio/", "Video/", "GroupFile/")],
}


@query("with a as (select distinct asset_id from asset_files) " + " union all ".join(f"select {ref} as reference, unnest([{', '.join(paths)}]) as path, unnest(range(len([{', '.join(paths)}]))) as pos from a" for ref, paths in _LIES.items()))
def asset_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Where references of every scheme may lie, made of the numbers of the listed files."""
    a = table(spark, d, "asset_files").select("asset_id").distinct()
    refs = a.select(F.explode(F.array(*[F.expr(x.replace("\\", "\\\\")) for x in _LIES])).alias("reference"))
    return refs.select("reference", F.posexplode(media.asset_candidates(F.col("reference"), "acc")).alias("pos", "path"))


_CONTENTS = "c as (select distinct text, 'UserData/Image/' || coalesce(length(text), 0) || '/' || md5(text) || '.dat' as path from messages where text is not null)"


@query(f"with {_CONTENTS} select path, md5(text) as md5 from c where length(text) % 3 = 0")
def content_digests(spark: SparkSession, d: str) -> DataFrame:
    """Files by content: those whose digest is the name of a picture that messages refer to."""
    t = _texts(spark, d)
    held = t.select(F.concat(F.lit("UserData/Image/"), F.length("text").cast("string"), F.lit("/"), F.md5(F.encode("text", "UTF-8")), F.lit(".dat")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    refs = t.where("length(text) % 3 = 0").select(F.concat(F.lit("UserDataImage:C2C\\"), F.upper(F.md5(F.encode("text", "UTF-8"))), F.lit(".jpg")).alias("reference"))
    return assets.content_digests(held, assets.wanted_digests(refs))


_MASK = "18446744073709551616::uhugeint"
_STEPS = "".join(f", s{i} as (select *, (x{i - 1} * 6364136223846793005::uhugeint + 1442695040888963407::uhugeint) % {_MASK} as x{i} from {'seeds' if i == 1 else f's{i - 1}'})" for i in range(1, 9))


@query(f"""with k as (select distinct msg_table, rowid from messages where msg_table is not null and rowid is not null), tops as (select msg_table, max(rowid) as m, count(*) as n from k group by 1),
 bytes as (select *, list_transform(regexp_extract_all(hex(encode(msg_table)), '..'), lambda h: ('0x' || h)::int::uhugeint) as b from tops),
 hashed as (select *, list_reduce(list_prepend(14695981039346656037::uhugeint, b), lambda a, x: (xor(a, x) * 1099511628211::uhugeint) % {_MASK}) as h from bytes),
 seeds as (select *, xor(h, (m::uhugeint * 131072::uhugeint) % {_MASK}) as x0 from hashed where m > 0){_STEPS},
 t as (select distinct msg_table, 1 + (unnest([{', '.join(f'x{i}' for i in range(1, 9))}]) % m::uhugeint)::bigint as target from s8)
 select msg_table, m as rowid from tops union select t.msg_table, min(k.rowid) from t join k on k.msg_table = t.msg_table and k.rowid >= t.target group by t.msg_table, t.target""")
def random_probe_sample(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each table and the rows at eight pseudo-random places."""
    from parleylake.operators import sampling

    return sampling.probe_sample(table(spark, d, "messages"), edge=0, points=0, random_points=8)


# ------------------------------------------------------------------------------------------------ sources and sinks


def _local(spark: SparkSession, name: str) -> str:
    """A new local path in the shared folder, for stores that only open local files."""
    if not shared_dir(spark).startswith(("file:", "/")):
        raise ValueError("this needs a shared folder that is mounted as a local path")
    return re.sub(r"^file:/*", "/", new_path(spark, name))


def _database(spark: SparkSession, d: str) -> str:
    """A message database with a table per region, and tables that only look like messages; the nations are a fixed table."""
    import os
    import sqlite3

    path = _local(spark, "database") + ".db"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    con = sqlite3.connect(path)
    for r in table(spark, d, "nation").orderBy("n_nationkey").collect():
        t = f"{('group', 'buddy', 'system')[r.n_regionkey % 3]}_{r.n_regionkey}"
        con.execute(f"create table if not exists {t} (Time integer, Rand integer, SenderUin integer, MsgContent blob)")
        con.execute(f"insert into {t} (rowid, Time, Rand, SenderUin, MsgContent) values (?, ?, ?, ?, ?)", (r.n_nationkey + 1, 1_500_000_000 + r.n_nationkey, r.n_nationkey, r.n_regionkey, r.n_name.encode()))
    con.executescript("create table groupX1 (Time integer, Rand integer, SenderUin integer, MsgContent blob); create table buddy_odd (x integer); create index by_time on group_0 (Time);")
    con.commit()
    con.close()
    return path


_TABLE = "case n_regionkey % 3 when 0 then 'group' when 1 then 'buddy' else 'system' end || '_' || n_regionkey"


@query(f"select {_TABLE} as msg_table, cast(n_nationkey + 1 as bigint) as rowid, cast(1500000000 + n_nationkey as bigint) as msg_time, cast(n_nationkey as bigint) as rand, cast(n_regionkey as bigint) as sender_uin, hex(encode(n_name)) as content from nation")
def sqlite_messages(spark: SparkSession, d: str) -> DataFrame:
    sqlite.register(spark)
    rows = spark.read.format("chatsqlite").option("path", _database(spark, d)).option("rowsPerPartition", "2").load()
    return rows.withColumn("content", F.hex("content")).drop("info")


@query(f"select {_TABLE} as msg_table, cast(n_nationkey + 1 as bigint) as rowid from nation where n_regionkey <> 2 and n_nationkey + 1 >= 5 and n_nationkey + 1 < 20")
def sqlite_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Tables of three kinds only, and a range of rows that is pushed to the database."""
    sqlite.register(spark)
    rows = spark.read.format("chatsqlite").option("path", _database(spark, d)).option("tablePattern", r"^(?:buddy|group|discuss)_.+").load()
    return rows.where("rowid >= 5 and rowid < 20").select("msg_table", "rowid")


@query(f"""select {_TABLE} as name, count(*) as rows, 'Time,Rand,SenderUin,MsgContent' as columns, case when {_TABLE} = 'group_0' then 'by_time' else '' end as indexes, '' as error from nation group by 1, 4
 union all values ('groupX1', 0, 'Time,Rand,SenderUin,MsgContent', '', ''), ('buddy_odd', 0, 'x', '', '')""")
def sqlite_tables(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(sqlite.table_report(_database(spark, d)), "name string, rows long, columns string, indexes string, error string")


@query("select * from (values ('page_size', '4096'), ('freelist_count', '0'), ('user_version', '0'), ('encoding', 'UTF-8')) v(pragma, value)")
def sqlite_pragmas(spark: SparkSession, d: str) -> DataFrame:
    found = sqlite.pragmas(_database(spark, d))
    return spark.createDataFrame([(k, str(v)) for k, v in found.items() if k != "page_count"], "pragma string, value string")


@query("select * from (values ('a.db', 'pcqq', 18, 'sqlite'), ('b.db', 'pcqq', 16, 'ole_compound'), ('c.db', 'ntqq', 1040, 'prefixed_sqlite'), ('d.db', 'ntqq_global', 4, '61626364'), ('e.db', null, 1, '78')) v(name, class, size, kind)")
def discovered_databases(spark: SparkSession, d: str) -> DataFrame:
    """Databases below a folder by header, with the kind of client that their place makes them."""
    import os

    root, mark = _local(spark, "account"), b"SQLite format 3\0"
    for place, content in (("1/a.db", mark + b"xx"), ("1/QQ/b.db", bytes.fromhex("d0cf11e0a1b11ae1") + bytes(8)), ("1/nt_qq/nt_db/c.db", bytes(1024) + mark), ("nt_qq/global/nt_db/d.db", b"abcd"), ("1/other/e.db", b"x"), ("1/notes.txt", b"x")):
        os.makedirs(os.path.dirname(f"{root}/{place}"), exist_ok=True)
        with open(f"{root}/{place}", "wb") as f:
            f.write(content)
    found = files.listing(spark, f"file://{root}", "*.db").join(files.contents(spark, f"file://{root}", "*.db"), "path")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), files.source_class(F.col("path"), "1").alias("class"), "size", files.header_kind(F.col("content")).alias("kind"))


@query("select n_nationkey, n_name, row_number() over (order by n_regionkey desc, n_name) as place from nation")
def discovery_order(spark: SparkSession, d: str) -> DataFrame:
    """Databases newest first, then by path: the nations as files whose time is the region."""
    found = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("path"), F.col("n_regionkey").cast("long").alias("modified_unix"))
    return files.in_discovery_order(found).select("n_nationkey", F.col("path").alias("n_name"), "place")


@query("""with p as (select n_nationkey as seq, 'role' || n_regionkey as role, n_nationkey % 2 = 0 as ok, n_name as source_path, case when n_nationkey % 3 = 0 then '' else 'p/' || n_name end as prepared_path from nation)
 select role, max(seq) as seq, arg_max(coalesce(nullif(prepared_path, ''), source_path), seq) as path from p group by 1""")
def catalog_sources(spark: SparkSession, d: str) -> DataFrame:
    """The newest source of each role, read back from a catalog that was written as a whole."""
    at = new_path(spark, "catalog")
    prepared = table(spark, d, "nation").select(F.col("n_nationkey").alias("seq"), F.concat(F.lit("role"), "n_regionkey").alias("role"), (F.col("n_nationkey") % 2 == 0).alias("ok"), F.col("n_name").alias("source_path"), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.concat(F.lit("p/"), "n_name")).alias("prepared_path"))
    for _ in range(2):
        sinks.replace_catalog({"prepared_sources": prepared}, at)
    return files.current_sources(spark.read.parquet(f"{at}/prepared_sources")).select("role", "seq", "path")


@query("select 'all' as scope, coalesce(sum(n_regionkey), 0) as records, count(*) as sources from nation union all select 'none', 0, 0")
def catalog_totals(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("records"))
    return files.catalog_totals(n).withColumn("scope", F.lit("all")).unionByName(files.catalog_totals(n.limit(0)).withColumn("scope", F.lit("none")))


_LINE = "n_nationkey || ',' || case when n_regionkey = 0 then '\"a,\"\"b\"\" ' || n_name || '\"' else n_name end || ',' || case when n_regionkey = 1 then '' else cast(n_regionkey as varchar) end"


@query(f"select line, count(*) as n from (select {_LINE} as line from nation union all select 'k,s,r') group by 1")
def exported_csv(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a CSV export, read back as text."""
    at = new_path(spark, "csv")
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_regionkey") == 0, F.concat(F.lit('a,"b" '), "n_name")).otherwise(F.col("n_name")).alias("s"), F.when(F.col("n_regionkey") != 1, F.col("n_regionkey")).alias("r"))
    sinks.write_csv(t.coalesce(1), at)
    return spark.read.text(at).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("select name, columns, rows, error from (values ('nation', 'n_nationkey int,n_name string,n_regionkey int', (select count(*) from nation), ''), ('region', 'r_regionkey int,r_name string', (select count(*) from region), '')) v(name, columns, rows, error)")
def exported_database(spark: SparkSession, d: str) -> DataFrame:
    """Two tables exported with their list and schema, which are read back."""
    at = new_path(spark, "export")
    sinks.export_database({n: table(spark, d, n) for n in ("nation", "region")}, at)
    schema = spark.read.text(f"{at}/schema.sql").select(F.regexp_extract("value", r"^create table `([^`]+)` \((.*)\);$", 1).alias("name"), F.regexp_replace(F.regexp_extract("value", r"^create table `([^`]+)` \((.*)\);$", 2), "`|(?<=,) ", "").alias("columns"))
    rows = [(n, spark.read.option("header", True).csv(f"{at}/{n}").count()) for n in ("nation", "region")]
    listed = spark.read.option("sep", "\t").option("header", True).csv(f"{at}/tables.txt").select(F.col("table").alias("name"), F.coalesce("error", F.lit("")).alias("error"))
    return schema.join(listed, "name").join(spark.createDataFrame(rows, "name string, rows long"), "name").select("name", "columns", "rows", "error")


@query("select 'group_' || n_regionkey as msg_table, cast(n_nationkey as bigint) as rowid, cast(n_nationkey * 2 as bigint) as msg_time, cast(7 as bigint) as rand, cast(n_regionkey as bigint) as sender_uin, n_name as content from nation")
def sample_files(spark: SparkSession, d: str) -> DataFrame:
    """Samples written with their payload in hex and read back."""
    at = new_path(spark, "samples")
    n = F.col("n_nationkey").cast("long")
    sinks.write_samples(table(spark, d, "nation").select(F.concat(F.lit("group_"), "n_regionkey").alias("msg_table"), n.alias("rowid"), (n * 2).alias("msg_time"), F.lit(7).cast("long").alias("rand"), F.col("n_regionkey").cast("long").alias("sender_uin"), F.encode("n_name", "UTF-8").alias("content")), at)
    return files.sample_tsv(spark, at).withColumnRenamed("table", "msg_table").withColumnRenamed("time", "msg_time").withColumn("content", F.decode("content", "UTF-8"))


@query("select cast(n_nationkey as varchar) as k, replace(replace(n_name || chr(9) || 'x' || chr(10) || 'y', chr(9), ' '), chr(10), ' ') as s from nation")
def text_tables(spark: SparkSession, d: str) -> DataFrame:
    at = new_path(spark, "tsv")
    sinks.write_tsv(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat("n_name", F.lit("\tx\ny")).alias("s")), at)
    return files.tsv(spark, at)


@query("select n_nationkey as k, n_name as name from nation")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines written and read back among lines that are none."""
    at = new_path(spark, "jsonl")
    sinks.write_jsonl(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), f"{at}/good")
    put_text(spark, f"{at}/bad/part.txt", "not json\n{broken\n")
    lines = files.jsonl(spark, f"{at}/*")
    return lines.select(F.expr("variant_get(record, '$.k', 'int')").alias("k"), F.expr("variant_get(record, '$.name', 'string')").alias("name"))


@query("select '{\"k\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' as report from nation")
def json_reports(spark: SparkSession, d: str) -> DataFrame:
    made = sinks.json_report(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")))
    return made.select(F.regexp_replace("report", r"\s*\n\s*|(?<=\") (?=:)|(?<=:) ", "").alias("report"))


@query("select unnest(['# database', '|table|rows|columns|indexes|error|', '|nation|25|n_nationkey,n_name,n_regionkey|||', '|region|5|r_regionkey,r_name|||']) as line")
def schema_report(spark: SparkSession, d: str) -> DataFrame:
    """The Markdown report of a database, its padding taken out and rules left away."""
    rows = [(n, table(spark, d, n).count(), ",".join(table(spark, d, n).columns), "", "") for n in ("nation", "region")]
    lines = [(x,) for x in sinks.database_report("database", rows).splitlines() if x and "---" not in x]
    return spark.createDataFrame(lines, "line string").select(F.regexp_replace("line", r" *\| *", "|").alias("line"))


@query("""select 'nation' as source, n_nationkey as rowid, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' as row from nation""")
def sampled_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows as JSON, whatever the table's columns are."""
    return sinks.rows_as_json(table(spark, d, "nation").withColumn("rowid", F.col("n_nationkey")), "rowid").select(F.lit("nation").alias("source"), "rowid", "row")
