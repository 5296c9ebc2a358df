"""Listings of files, text tables and the catalog of prepared sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The first bytes that tell a database, a prefixed one and a compound file.
SQLITE, COMPOUND = "53514C69746520666F726D6174203300", "D0CF11E0A1B11AE1"


def listing(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, size and modification time of files; contents are not read, as the scan drops the column."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(root).select("path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("modified_unix"))


def contents(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path and content of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "content")


def header_kind(content: Column) -> Column:
    """What the first bytes of a file say: sqlite, prefixed_sqlite (behind 1024 bytes), ole_compound, or the bytes in hex."""
    h = F.hex(F.substring(content, 1, 16))
    return F.when(h == SQLITE, "sqlite").when(F.startswith(h, F.lit(COMPOUND)), "ole_compound").when(F.hex(F.substring(content, 1025, 16)) == SQLITE, "prefixed_sqlite").otherwise(F.lower(h))


# The folders of an account that hold databases, and one beside the accounts, with the kind of client they belong to.
ACCOUNT_FOLDERS = {"": "pcqq", "QQ": "pcqq", "Audio/AudioInfo": "pcqq", "MyCollection": "pcqq", "GroupCollection": "pcqq", "nt_qq/nt_db": "ntqq", "nt_qq/nt_data": "ntqq"}
GLOBAL_FOLDER, GLOBAL_CLASS = "nt_qq/global/nt_db", "ntqq_global"


def source_class(path: Column, account: str) -> Column:
    """The kind of client a database belongs to, by the folder it lies in itself; null for any other folder."""
    folder = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/[^/]*$", "")
    kind = F.when(F.endswith(folder, F.lit(f"/{GLOBAL_FOLDER}")), GLOBAL_CLASS)
    for f, c in ACCOUNT_FOLDERS.items():
        kind = kind.when(F.endswith(folder, F.lit("/" + "/".join(x for x in (account, f) if x))), c)
    return kind


def in_discovery_order(found: DataFrame) -> DataFrame:
    """Files (path, modified_unix) with their ``place``: newest first, then by path. A listing is metadata of one account."""
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("modified_unix"), "path")))


def catalog_totals(entries: DataFrame) -> DataFrame:
    """The records of all entries together, 0 for none, and the number of entries."""
    return entries.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.count(F.lit(1)).alias("sources"))


def tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A tab-separated file with a header; quotes mean nothing, short rows are filled with null."""
    reader = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("mode", "PERMISSIVE")
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def sample_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Samples (table, rowid, time, rand, sender_uin, payload in hex); rows that do not fit are dropped."""
    s = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("mode", "DROPMALFORMED").schema("table string, rowid long, time long, rand long, sender_uin long, msgcontent_hex string").csv(path)
    return s.where("rowid is not null").withColumn("content", F.try_to_binary("msgcontent_hex", F.lit("hex"))).where("content is not null").drop("msgcontent_hex")


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One variant per line that is JSON; other lines are left out."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("record")).where("record is not null")


def current_sources(prepared: DataFrame) -> DataFrame:
    """The newest row per role (columns seq, role, ok, source_path, prepared_path), with the path to use."""
    best = prepared.groupBy("role").agg(F.max(F.struct("seq", "ok", "source_path", "prepared_path")).alias("s")).select("role", "s.*")
    return best.withColumn("path", F.coalesce(F.nullif(F.col("prepared_path"), F.lit("")), "source_path"))


def resolve(selector: str, known: list[str], roots: list[str]) -> str:
    """The file a selector means: an absolute path that is known, one below the first of the roots that has it, or the only known file of that name."""
    plain = lambda p: p.replace("\\", "/").rstrip("/")
    have = {plain(p).lower(): p for p in known}
    for candidate in [plain(selector), *[f"{plain(r)}/{plain(selector)}" for r in roots]]:
        if candidate.lower() in have:
            return have[candidate.lower()]
    named = [p for k, p in have.items() if k.rsplit("/", 1)[-1] == plain(selector).lower()]
    if len(named) != 1:
        raise ValueError(f"{selector!r} names {len(named)} files")
    return named[0]
